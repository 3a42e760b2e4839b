"""Digests, immutable revisions, release gates and the active release."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import beside
from ..sources.commit import attempt, commit, committed, remove
from .quality import validate


MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
MICROSECONDS_NTZ = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def digest_frame(df: DataFrame) -> DataFrame:
    """One row that depends on the multiset of rows only: not on order or partitioning.

    Each row's SHA-256 covers its columns by name, nulls included; the four quarters of all of them are added
    up. Column names and types belong to the digest.
    """
    columns = sorted(df.columns)
    types = dict(df.dtypes)
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampFormat": MICROSECONDS, "timestampNTZFormat": MICROSECONDS_NTZ})
    hashed = df.select(F.sha2(F.coalesce(row, F.lit("")), 256).alias("h"))
    quarters = [F.conv(F.substring("h", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)") for k in range(4)]
    body = hashed.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(q), F.lit(0)).cast("string").alias(f"q{k}") for k, q in enumerate(quarters)])
    header = ",".join(f"{c}:{types[c]}" for c in columns)
    return body.select("rows", F.sha2(F.concat_ws("|", F.lit(header), F.col("rows").cast("string"), "q0", "q1", "q2", "q3"), 256).alias("digest"))


def digest(df: DataFrame) -> str:
    return digest_frame(df).first()["digest"]


def revise(
    spark: SparkSession, root: str, inputs: Mapping[str, DataFrame], operation: str, version: str, transform: Callable[..., DataFrame]
) -> tuple[DataFrame, dict]:
    """Apply a policy to input tables as a new immutable revision.

    The revision's place follows from the input digests, the operation and its version, so a
    rerun finds the finished revision, and of two that run at once one is kept. Inputs are only
    read; nothing is activated.
    """
    marks = {name: digest(df) for name, df in sorted(inputs.items())}
    key = spark.range(1).select(
        F.sha2(F.lit("|".join([operation, version, *[f"{n}={d}" for n, d in marks.items()]])), 256).alias("k")
    ).first()["k"]
    folder = f"{root}/{operation}/{key[:24]}"
    facts, own = committed(spark, folder), False
    if facts is None:
        name = attempt(spark, folder, transform(**inputs))
        written = digest_frame(spark.read.parquet(f"{folder}/{name}")).first()
        facts, own = commit(spark, folder, name, {"operation": operation, "version": version, "key": key, "rows": written["rows"], "digest": written["digest"]})
    return spark.read.parquet(facts["data"]), {**facts, "reused": not own, "folder": folder}


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """What was committed in a folder, refused if its digest does not match the commit's."""
    facts = committed(spark, folder)
    if facts is None:
        raise ValueError("nothing was committed here")
    data = spark.read.parquet(facts["data"])
    if digest(data) != facts["digest"]:
        raise ValueError("content does not match its digest")
    return data


def publish(spark: SparkSession, root: str, release_id: str, df: DataFrame) -> dict:
    """Write a release once. The same content again does nothing; other content is refused.

    So it is when both come at once: each writes its own attempt, one of them becomes the release.
    """
    folder = f"{root}/{release_id}"
    mark = digest_frame(df).first()
    known, own = committed(spark, folder), False
    if known is None:
        name = attempt(spark, folder, df)
        stored = digest(spark.read.parquet(f"{folder}/{name}"))
        if stored != mark["digest"]:
            remove(spark, f"{folder}/{name}")
            raise ValueError("the release changed while it was written")
        known, own = commit(spark, folder, name, {"release_id": release_id, "rows": mark["rows"], "digest": mark["digest"]})
    if known["digest"] != mark["digest"]:
        raise ValueError("release ids are immutable; use a new version")
    return {"release_id": release_id, "digest": mark["digest"], "written": own, "folder": folder, "data": known["data"]}


def content_id(df: DataFrame, prefix: str) -> str:
    return f"{prefix}-{digest(df)[:32]}"


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that do not occur equally often on both sides, with the surplus of the left.

    One shuffle for both directions: each side is counted before it moves.
    """
    columns = left.columns
    a = left.groupBy(*columns).agg(F.count("*").alias("surplus"))
    b = right.select(*columns).groupBy(*columns).agg((-F.count("*")).alias("surplus"))
    return a.unionByName(b).groupBy(*columns).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0")


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: counts, headers and the number of differing rows of two tables."""
    same = left.columns == right.columns
    diff = differences(left, right).agg(F.coalesce(F.sum(F.abs("surplus")), F.lit(0)).alias("differing_rows"))
    return (
        beside(beside(left.agg(F.count("*").alias("left_rows")), right.agg(F.count("*").alias("right_rows"))), diff)
        .withColumn("same_header", F.lit(same))
        .withColumn("agrees", F.expr("left_rows = right_rows AND differing_rows = 0 AND same_header"))
    )


def release_violations(stints: DataFrame, teams: DataFrame, metrics: DataFrame, leagues: int, roles: int, floor: float = 450) -> DataFrame:
    """Broken release rules, one row each: every rule is an aggregate."""
    shape = stints.agg(
        F.count("*").alias("n"),
        F.count_distinct("stint").alias("ids"),
        F.count_distinct("season").alias("seasons"),
        F.count_distinct("league").alias("leagues"),
        F.count_distinct("role").alias("roles"),
    )
    unknown = stints.join(teams.select("team"), "team", "left_anti").agg(F.count("*").alias("unknown_team"))
    bare = stints.join(metrics.select("stint").distinct(), "stint", "left_anti").agg(F.count("*").alias("without_metric"))
    synthetic = metrics.agg(F.count_if(F.col("evidence").isin("synthetic", "unavailable")).alias("synthetic"))
    thin = (
        stints.where(F.col("minutes") >= floor).groupBy("league").agg(F.count_distinct("role").alias("r")).agg(
            F.count_if(F.col("r") == roles).alias("covered")
        )
    )
    one = beside(beside(beside(beside(shape, unknown), bare), synthetic), thin)
    return validate(
        one,
        {
            "empty": "n = 0",
            "duplicate ids": "ids <> n",
            "unknown team": "unknown_team > 0",
            "several seasons": "seasons <> 1",
            "league missing": f"leagues <> {leagues}",
            "role missing": f"roles <> {roles}",
            "synthetic evidence": "synthetic > 0",
            "stint without metric": "without_metric > 0",
            "thin role coverage": f"covered <> {leagues}",
        },
    ).select(F.explode("reasons").alias("violation"))


def publication_errors(records: DataFrame, now: str, minimum: int = 30, days: int = 45) -> DataFrame:
    """Why a release may not be published.

    ``records``: (league, rated, version, season, cutoff, retrieved, quarantined).
    """
    per_league = records.groupBy("league").agg(F.count_if("rated").alias("rated"))
    short = per_league.where(F.col("rated") < minimum).select(
        F.concat(F.col("league"), F.lit(": too few rated")).alias("violation")
    )
    facts = records.agg(
        F.count_distinct("version").alias("versions"),
        F.count_distinct("season", "cutoff").alias("windows"),
        F.expr(f"count_if(datediff(date'{now}', retrieved) > {days}) AS stale"),
        F.count_if("quarantined").alias("quarantined"),
        F.count_if(~F.col("rated")).alias("unrated"),
    )
    general = validate(
        facts,
        {
            "several measurement versions": "versions > 1",
            "several seasons or cutoffs": "windows <> 1",
            "stale retrieval": "stale > 0",
            "open quarantine": "quarantined > 0",
            "unrated records": "unrated > 0",
        },
    ).select(F.explode("reasons").alias("violation"))
    return short.unionByName(general)


def active_release(releases: DataFrame, violations: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """Per slot: the newest approved, non-historical release without violations, unless rolled back.

    A rollback row names an existing non-historical release; the latest one wins.
    """
    fit = releases.where("kind <> 'historical'")
    clean = fit.where("approved").join(violations.select("release_id").distinct(), "release_id", "left_anti")
    newest = clean.groupBy("slot").agg(F.max_by("release_id", F.struct("created", "release_id")).alias("newest"))
    back = (
        rollbacks.join(fit.select("slot", "release_id"), ["slot", "release_id"], "left_semi")
        .groupBy("slot")
        .agg(F.max_by("release_id", F.struct("at", "release_id")).alias("rolled"))
    )
    return newest.join(back, "slot", "full_outer").select(
        "slot", F.coalesce("rolled", "newest").alias("release_id"), F.col("rolled").isNotNull().alias("rolled_back")
    )
