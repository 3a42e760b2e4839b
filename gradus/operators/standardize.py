"""Cohort statistics, z-scores, percentiles, ranks, curves.

Statistics are partial aggregates joined back to the rows (a cohort is never gathered in one
task); order statistics go through ``ordered``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import beside
from .ordered import cumulative, finite, quantiles, value_counts

EPSILON = 1e-12


def cohort_stats(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``<v>_mean``, ``<v>_sd`` (population) and ``<v>_n`` over finite values, one row per cohort."""
    aggs = []
    for v in values:
        c = F.when(finite(F.col(v)), F.col(v).cast("double"))
        aggs += [F.avg(c).alias(f"{v}_mean"), F.stddev_pop(c).alias(f"{v}_sd"), F.count(c).alias(f"{v}_n")]
    return df.groupBy(*keys).agg(*aggs)


def subject_z(value: Column, mean: Column, sd: Column, n: Column) -> Column:
    """z of a value that need not belong to the cohort."""
    return F.when((n >= 2) & finite(value) & (sd > EPSILON), (value - mean) / sd).when(
        (n >= 2) & finite(value) & (F.abs(value - mean) <= EPSILON), F.lit(0.0)
    )


def member_z(value: Column, mean: Column, sd: Column) -> Column:
    """z of a cohort member; a cohort without spread gives 0 for all."""
    return F.when(sd > EPSILON, (value - mean) / sd).otherwise(F.when(value.isNotNull(), F.lit(0.0)))


def shrink(value: Column, exposure: Column, mean: Column, prior: Column) -> Column:
    reliability = exposure / (exposure + prior)
    return F.when(
        finite(value) & (exposure > 0), reliability * value + (F.lit(1.0) - reliability) * mean
    )


def zscores(df: DataFrame, keys: Sequence[str], value: str, out: str = "z") -> DataFrame:
    stats = cohort_stats(df, keys, [value])
    return (
        df.join(stats, list(keys), "left")
        .withColumn(out, member_z(F.col(value), F.col(f"{value}_mean"), F.col(f"{value}_sd")))
        .drop(f"{value}_mean", f"{value}_sd", f"{value}_n")
    )


def percentile_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    peer: str = "true",
    direction: int = 1,
    out: str = "percentile",
    rank: str | None = None,
) -> DataFrame:
    """Mid-rank percentile of each row among the rows of its cohort that satisfy ``peer`` (SQL).

    A row outside the peers is ranked against them but never counted; ``rank`` names a column
    for its competition rank. Rows are counted per distinct value, so no cohort is sorted whole.
    """
    keys = list(keys)
    counts = df.where(finite(F.col(value))).groupBy(*keys, value).agg(F.expr(f"count_if({peer}) AS n"))
    p = "100D * (below + 0.5D * n) / total"
    scored = cumulative(counts, keys, value).selectExpr(
        *keys, value, f"IF(total > 0, {'100D - ' if direction < 0 else ''}{p}, NULL) AS {out}", *([f"total - below - n + 1 AS {rank}"] if rank else [])
    )
    return df.join(scored, [*keys, value], "left")


def ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Competition rank (highest first), mid-rank percentile, neighbour gaps, population."""
    keys = list(keys)
    ranked = cumulative(value_counts(df, keys, value), keys, value).select(
        *keys,
        value,
        (F.col("total") - F.col("below") - F.col("n") + 1).alias("rank"),
        (F.lit(100.0) * (F.col("below") + F.lit(0.5) * F.col("n")) / F.col("total")).alias("percentile"),
        F.col("total").alias("population"),
        (F.col(value) - F.col("previous")).alias("gap_below"),
        (F.col("following") - F.col(value)).alias("gap_above"),
    )
    return df.join(ranked, [*keys, value], "left")


def quantile_curve(df: DataFrame, keys: Sequence[str], value: str, points: int = 101) -> DataFrame:
    probabilities = [i / (points - 1) for i in range(points)]
    return quantiles(value_counts(df, keys, value), keys, value, probabilities)


def density_curve(df: DataFrame, keys: Sequence[str], value: str, points: int = 65) -> DataFrame:
    """Gaussian density on even points between each cohort's extremes, Scott bandwidth.

    Every distinct value contributes once per point, weighted by its count; sums are partial.
    """
    keys = list(keys)
    clean = df.where(finite(F.col(value)))
    shape = clean.groupBy(*keys).agg(
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.stddev_samp(value).alias("sd"),
        F.count("*").alias("n"),
    )
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    grid = shape.select(
        *keys,
        "lo",
        "hi",
        "n",
        (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"),
    )
    flat = grid.where(F.col("hi") - F.col("lo") < EPSILON).select(
        *keys, F.lit(0).alias("point"), F.col("lo").alias("x"), F.lit(1.0).alias("density")
    )
    curved = (
        value_counts(clean, keys, value, "w")
        .join(grid.where(F.col("hi") - F.col("lo") >= EPSILON), keys)
        .withColumn("point", F.explode(steps))
        .withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / F.lit(points - 1))
        .groupBy(*keys, "point", "x")
        .agg(
            F.sum(
                F.col("w")
                * F.exp(-0.5 * F.pow((F.col("x") - F.col(value)) / F.col("h"), F.lit(2.0)))
                / (F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
            ).alias("density")
        )
    )
    return curved.unionByName(flat)


def robust_scale(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """max(interquartile range, a tenth of the absolute median, 0.01) per group."""
    keys = list(keys)
    q = quantiles(value_counts(df, keys, value), keys, value, [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("probability") == p, F.col("quantile")))
    return q.groupBy(*keys).agg(
        F.greatest(at(0.75) - at(0.25), F.abs(at(0.5)) * 0.1, F.lit(0.01)).alias("scale")
    )


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """One row per key, chosen by (column, descending) pairs; a partial max, not a sorted window.

    A row without a value comes after those with one. In a mixed order the descending columns must be numeric.
    """
    keys = list(keys)
    down = all(desc for _, desc in order)
    if down:  # nulls are the least, so the greatest row has a value if any has
        parts = [F.col(c).alias(f"_{i}") for i, (c, _) in enumerate(order)]
    else:
        signed = [(F.col(c), -F.col(c) if desc else F.col(c)) for c, desc in order]
        parts = [x.alias(f"_{i}_{j}") for i, (c, v) in enumerate(signed) for j, x in enumerate((c.isNull(), v))]
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if down else F.min_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*parts)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def chronological_folds(df: DataFrame, match: str, date: str, label: str) -> DataFrame:
    """Whole-date 60/20/20 folds by distinct date index.

    The calendar of distinct days is the only thing ordered in one place; it grows with the
    days observed, not with the events.
    """
    dates = df.select(F.to_date(date).alias("_d")).distinct()
    index = Window.orderBy("_d")
    numbered = dates.select("_d", F.row_number().over(index).alias("_i"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("_n"))
    cuts = numbered.agg(
        F.max(F.when(F.col("_i") == F.greatest(F.lit(1), F.floor(F.col("_n") * 0.6).cast("int")), F.col("_d"))).alias("_train"),
        F.max(F.when(F.col("_i") == F.greatest(F.lit(2), F.floor(F.col("_n") * 0.8).cast("int")), F.col("_d"))).alias("_valid"),
    )
    return (
        beside(df, cuts)
        .withColumn(
            "fold",
            F.when(F.to_date(date) <= F.col("_train"), "train")
            .when(F.to_date(date) <= F.col("_valid"), "validation")
            .otherwise("test"),
        )
        .drop("_train", "_valid")
    )


def fold_problems(df: DataFrame, match: str, date: str, label: str) -> DataFrame:
    """Rows naming each reason why the folds may not be used; empty when they may."""
    folds = chronological_folds(df, match, date, label)
    spans = (
        df.groupBy(match).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    )
    shape = spans.agg(
        F.count("*").alias("matches"),
        F.count_distinct("a").alias("dates"),
        F.count_if(F.col("a") != F.col("b")).alias("spanning"),
    )
    classes = folds.groupBy("fold").agg(F.count_distinct(label).alias("classes"))
    lacking = classes.agg(F.count_if(F.col("classes") >= 2).alias("complete"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("spanning") > 0, "match spans dates"),
            F.when(F.col("matches") < 20, "fewer than 20 matches"),
            F.when(F.col("dates") < 5, "fewer than 5 dates"),
            F.when(F.col("complete") < 3, "a fold lacks a class"),
        )
    )
    return beside(shape, lacking).select(F.explode(reasons).alias("reason"))
