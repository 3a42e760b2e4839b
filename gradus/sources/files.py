"""Columnar and JSON scans, layered writes, spreadsheet-safe CSV."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, schema: str | None = None, kind: str = "parquet") -> DataFrame:
    """Parquet, ORC, CSV or JSON rows; text formats need a schema, so no pass is spent guessing."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(kind).load(path)


def scan_snapshots(spark: SparkSession, path: str, schema: str, season: int | None = None, whole: bool = False) -> DataFrame:
    """A folder of JSON snapshots with their file name, one season of them if asked.

    With ``whole`` each file is one document or one list, however it is laid out; else one document per line.
    A document that cannot be read keeps its text in ``corrupt``.
    """
    reader = spark.read.schema(f"{schema}, corrupt string").option("columnNameOfCorruptRecord", "corrupt").option("multiLine", whole)
    df = reader.json(path).withColumn("file", F.input_file_name())
    return df if season is None else df.where(F.col("season") == season)


def write_layers(root: str, release_id: str, layers: Mapping[str, DataFrame]) -> None:
    """One Parquet table per layer, partitioned by release; only this release is replaced."""
    for name, df in layers.items():
        (
            df.withColumn("release_id", F.lit(release_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("release_id")
            .parquet(f"{root}/{name}")
        )


def formula_safe(cell: Column) -> Column:
    """Text a spreadsheet would run as a formula gets a leading apostrophe; numbers stay."""
    number = F.when(cell.rlike(r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"), cell.try_cast("double"))
    is_number = F.coalesce(F.abs(number) < float("inf"), F.lit(False))
    # White space of every kind before the sign is passed over; a leading tab or return is a marker itself.
    risky = cell.rlike(r"^[\s\p{Z}\x1c-\x1f\x85]*[=+\-@]|^[\t\r]")
    return F.when(is_number | ~risky, cell).otherwise(F.concat(F.lit("'"), cell))


def write_safe_csv(df: DataFrame, path: str) -> None:
    """Cells and headers without formulas."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    heads = df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(df.columns)], "k int, c string").select("k", formula_safe(F.col("c")).alias("c"))
    names = [r.c for r in heads.orderBy("k").collect()]  # one per column
    cells = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    df.select(*[(formula_safe(x) if c in text else x).alias(n) for x, c, n in zip(cells, df.columns, names)]).write.mode("overwrite").option(
        "header", True
    ).csv(path)
