"""Resumable intake and latest-per-key upserts on file streams.

Each stream's progress lives under the shared folder; every micro-batch writes to a place named by its number, so a
batch that is run again replaces itself. The upsert's state is a table of versions: batches leave what they changed,
and every so many of them are merged into the next version, which a marker makes valid. Nothing grows in the stream.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import Rules, split
from ..operators.release import MICROSECONDS
from ..sources.commit import attempt, names, put_if_absent, read_text, remove


def intake(spark: SparkSession, source: str, schema: str, root: str, rules: Rules, key: list[str]) -> None:
    """Read files not seen before; append their valid rows and their quarantine."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()  # split twice
        valid, bad = split(df, rules, key)
        valid.write.mode("overwrite").parquet(f"{root}/valid/batch={number}")
        bad.write.mode("overwrite").parquet(f"{root}/quarantine/batch={number}")
        df.unpersist()

    query = (
        spark.readStream.schema(schema)
        .json(source)
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


# --- Latest row per key ---------------------------------------------------------------------------
def _changes(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, row, t, high, low): the newest row of each key, its time, and the greatest and least hash at that time."""
    values = [c for c in rows.columns if c not in keys]
    # Hashed as text that keeps nulls in their places; a hash over the columns would skip them.
    text = F.to_json(F.struct(*values), {"ignoreNullFields": "false", "timestampFormat": MICROSECONDS})
    one = rows.select(*keys, F.struct(*values).alias("row"), F.col(at).alias("t"), F.xxhash64(text).alias("high"))
    return _merged(one.withColumn("low", F.col("high")), keys)


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of one key put together: the newest time wins, and at one time the greatest hash. The order of batches
    does not matter, and a change that is merged twice counts once."""
    newest = F.struct("t", "high")
    least = F.struct("t", F.bitwise_not(F.col("low")).alias("low"))
    best = rows.groupBy(*keys).agg(F.max_by("row", newest).alias("row"), F.max(newest).alias("_high"), F.max(least).alias("_low"))
    return best.select(*keys, "row", F.col("_high.t").alias("t"), F.col("_high.high").alias("high"), F.bitwise_not(F.col("_low.low")).alias("low"))


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Batch numbers up to which versions are complete, ascending."""
    return sorted(int(n.removesuffix(".json")) for n in names(spark, f"{root}/versions") if n.endswith(".json"))


def _version(spark: SparkSession, root: str, number: int) -> dict:
    return json.loads(read_text(spark, f"{root}/versions/{number}.json"))


def _state(spark: SparkSession, root: str, keys: list[str], up_to: int | None = None) -> DataFrame | None:
    """The last version and the changes that follow it, merged; None if there is neither."""
    done = [v for v in _versions(spark, root) if up_to is None or v <= up_to]
    last = done[-1] if done else -1
    later = [int(n.split("=")[1]) for n in names(spark, f"{root}/changes") if n.startswith("batch=")]
    later = sorted(n for n in later if n > last and (up_to is None or n <= up_to))
    paths = [f"{root}/changes/batch={n}" for n in later]
    if done:
        paths.insert(0, f"{root}/data/{_version(spark, root, last)['attempt']}")
    if not paths:
        return None
    return _merged(spark.read.parquet(*paths), keys)


def compact(spark: SparkSession, root: str, keys: list[str], number: int, horizon: str | None = None) -> None:
    """Merge the last version and all changes up to batch ``number`` into the next version.

    With a ``horizon`` (an interval, such as "90 days") keys whose newest time lies further back than that from the
    newest of all are evicted. A compaction that is run again finds its marker and does nothing. The version before
    last, its markers and the changes that both hold are removed; readers of the last one are not disturbed.
    """
    if number in _versions(spark, root):
        return
    merged = _state(spark, root, keys, number)
    if merged is None:
        return
    if horizon is not None:
        newest = merged.agg(F.max(F.col("t").cast("timestamp")).alias("_now"))
        near = F.expr(f"t IS NULL OR cast(t AS timestamp) >= _now - INTERVAL {horizon}")
        merged = merged.crossJoin(F.broadcast(newest)).where(near).drop("_now")
    name = attempt(spark, f"{root}/data", merged)
    if not put_if_absent(spark, f"{root}/versions/{number}.json", json.dumps({"attempt": name})):
        remove(spark, f"{root}/data/{name}")
    for old in _versions(spark, root)[:-2]:
        remove(spark, f"{root}/data/{_version(spark, root, old)['attempt']}")
        remove(spark, f"{root}/versions/{old}.json")
    kept = _versions(spark, root)
    for change in names(spark, f"{root}/changes"):
        if change.startswith("batch=") and len(kept) > 1 and int(change.split("=")[1]) <= kept[-2]:
            remove(spark, f"{root}/changes/{change}")


def upsert_latest(
    spark: SparkSession, source: str, schema: str, root: str, keys: list[str], at: str, every: int = 10, horizon: str | None = None, files: int | None = None
) -> None:
    """Keep the newest row per key over all files of a folder, seen once each.

    Equal repeats change nothing. Two different rows of one key at the same newest time set ``conflict``. Every
    ``every`` batches are compacted; ``files`` bounds the files of a batch.
    """

    def batch(df: DataFrame, number: int) -> None:
        _changes(df, keys, at).write.mode("overwrite").parquet(f"{root}/changes/batch={number}")
        if (number + 1) % every == 0:
            compact(spark, root, keys, number, horizon)

    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    query = (
        reader.json(source)
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """The latest row of every key, from the last version and the few changes after it, and whether it is contested."""
    state = _state(spark, root, keys)
    if state is None:
        raise ValueError("nothing was taken in yet")
    return state.select(*keys, "row.*", (F.col("high") != F.col("low")).alias("conflict"))
