"""Set-like operators over sources, rankings and cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import beside
from .aggregates import duplicate_keys


def source_union(parts: Sequence[DataFrame], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """All sources in one shape (absent columns null) and the keys that occur twice."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out, duplicate_keys(out, keys)


def base_plus_missing(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The base rows and those of a second inventory whose key the base lacks."""
    return base.unionByName(other.join(base.select(*keys).distinct(), list(keys), "left_anti"))


def topk_jaccard(left: DataFrame, right: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Overlap of two short top-k lists per key, both given long; 1 if both are empty."""
    keys = list(keys)
    both = left.select(*keys, item, F.lit(1).alias("l")).join(
        right.select(*keys, item, F.lit(1).alias("r")), [*keys, item], "full_outer"
    )
    return both.groupBy(*keys).agg(
        (F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()) / F.count("*")).alias("jaccard")
    )


def incremental_contribution(families: DataFrame, source: str, family: Sequence[str]) -> DataFrame:
    """Families only one source provides: what the full combination loses without it."""
    return (
        families.select(source, *family)
        .distinct()
        .groupBy(*family)
        .agg(F.count("*").alias("_sources"), F.min(source).alias(source))
        .where("_sources = 1")
        .drop("_sources")
        .select(source, *family)
    )


def joint_members(left: DataFrame, right: DataFrame, keys: Sequence[str], minimum: int) -> DataFrame:
    """Identities present on both sides, if there are enough of them."""
    both = left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys))
    size = both.agg(F.count("*").alias("joint_peers"))
    return beside(both, size).where(F.col("joint_peers") >= minimum)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    lost = child.join(parent, F.col(child_key) == F.col(parent_key), "left_anti")
    return lost.agg(F.count("*").alias("orphans")).withColumn("check", F.lit(name))


def canonical_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in an order that does not depend on how they arrived (range-partitioned sort)."""
    return df.orderBy(*keys)


def page(df: DataFrame, value: str, ties: Sequence[str], offset: int, limit: int) -> DataFrame:
    """One page, best first and missing values last, with the total number of matches."""
    total = df.agg(F.count("*").alias("total"))
    return beside(df.orderBy(F.col(value).desc_nulls_last(), *ties).offset(offset).limit(limit), total)
