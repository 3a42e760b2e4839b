"""What the operators of this package share: Arrow batches over chosen columns, and frames cut by a written table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import new_folder

#: Rows and bytes of an Arrow batch: some documents are very long.
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that bound what a Python worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later steps never run it again."""
    folder = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def named(column: str):
    return F.col("`" + column.replace("`", "``") + "`")


def map_columns(
    df: DataFrame,
    keep: Sequence[str],
    use: Sequence[str],
    out: str,
    work: Callable[..., Iterator[tuple] | None],
    start: Callable[[], object] | None = None,
) -> DataFrame:
    """Columns ``keep`` as they are, and those of the DDL string ``out`` that ``work`` makes.

    ``work`` gets the Arrow arrays of ``use`` and returns one array or list per column of ``out``, each as long
    as its input. With ``start``, its result (made once per task) comes first. A kept column with the name of an
    output gives way to it.
    """
    added = StructType.fromDDL(out)
    keep = [c for c in dict.fromkeys(keep) if c not in added.fieldNames()]
    fields = [StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    plain = StructType(fields + [StructField(f"o{i}", f.dataType) for i, f in enumerate(added.fields)])
    kinds = _arrow(StructType([StructField(f"o{i}", f.dataType) for i, f in enumerate(added.fields)]))
    names, first = plain.fieldNames(), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = () if start is None else (start(),)
        for batch in batches:
            if batch.num_rows:
                made = work(*more, *batch.columns[first:])
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, k) for a, k in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:first], *arrays], names)

    chosen = [named(c).alias(f"k{i}") for i, c in enumerate(keep)] + [named(c).alias(f"u{i}") for i, c in enumerate(use)]
    done = df.select(*chosen).mapInArrow(run, plain)
    return done.select(*[F.col(a).alias(b) for a, b in zip(names, [*keep, *added.fieldNames()])])


def map_rows(df: DataFrame, use: Sequence[str], out: str, work: Callable[[Iterator[list]], Iterator[dict]]) -> DataFrame:
    """Rows made from whole partitions: ``work`` gets an iterator over lists of Arrow arrays (the columns of
    ``use``) and yields dictionaries of column lists for the DDL string ``out``."""
    schema = StructType.fromDDL(out)
    kinds = _arrow(schema)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in work(b.columns for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([a if isinstance(a := made[n], pa.Array) else pa.array(a, k) for n, k in zip(names, kinds)], names)

    return df.select(*[named(c).alias(f"u{i}") for i, c in enumerate(use)]).mapInArrow(run, schema)


def _arrow(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(schema)]


def remainder(column: str, by: int):
    """crc32 of the column as text, modulo ``by``; a null counts as the empty text."""
    return F.crc32(F.coalesce(named(column).cast("string"), F.lit("")).cast("binary")) % by
