"""Session settings and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# SQL settings every plan here is written for; all can be set on a live session.
SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hot join keys are split even where that costs one extra shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles a method of more than 8,000 bytes of code: a stage that would need one runs as split projections.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gradus")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in SQL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="gradus-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a global aggregate next to every row. Such a frame has exactly one row."""
    return df.crossJoin(F.broadcast(one_row))


def each(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Every row once per value of a fixed parameter list, without a join."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))


def unfold(df: DataFrame, keep: Sequence[str], structs: Sequence[str]) -> DataFrame:
    """``keep`` and the fields of each struct (SQL): a row per struct.

    The structs are projected before they are generated: a projection is compiled in parts of any number, a generator's
    own expressions are one method, which the JVM leaves uncompiled where they are many. The list is never empty;
    ``outer`` keeps Spark from asking so by a filter that would make the structs once more."""
    return df.selectExpr(*keep, f"array({', '.join(structs)}) AS _each").selectExpr(*keep, "inline_outer(_each)")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so a lost executor never restarts the loop."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
