"""The corpus pipeline: each stage works on all that the one before it kept, and its decisions take effect.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder
and rereads it as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import decontamination, jaccard, packing, secrets, toxicity
from gradus.llm.common import load, map_columns, named, prepare, written
from gradus.llm.tokens import public_path

#: What a found secret is replaced by.
MASK = "[secret]"


def _held(docs: DataFrame) -> DataFrame:
    """Each document as one column beside its text, so that no column can clash with an operator's."""
    return docs.select(F.struct(*[named(c) for c in docs.columns]).alias("__doc"), named("text").alias("__text"))


def _freed(held: DataFrame, docs: DataFrame) -> DataFrame:
    return held.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it learns from the labelled training rows among ``docs``."""
    prepare(spark)
    rows, worth = toxicity.labelled(docs, load(spark, sf_dir, "labels"))
    scored = toxicity.score(_held(docs), toxicity.train(rows, worth), ["__doc"], "__text")
    return _freed(scored.where("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = decontamination.decontaminate(_held(docs), load(spark, sf_dir, "benchmark"), ["__doc"], "__text")
    return _freed(found.where(~F.col("contaminated")), docs)


def masked(text: str | None, spans: list[dict]) -> str | None:
    """The text with its spans (ascending by start) masked; spans that overlap or touch become one mask."""
    if not text or not spans:
        return text
    parts, to = [], 0
    for k, s in enumerate(spans):
        if k == 0 or s["start"] > to:
            parts += [text[to : s["start"]], MASK]
        to = max(to, s["end"])
    return "".join([*parts, text[to:]])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret is masked; all documents stay, and ``n_chars`` follows the text."""
    found = secrets.find_secrets(_held(docs), ["__doc", "__text"], "__text")

    def mask(texts, spans):
        out = [masked(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist())]
        return out, [bool(s) for s in spans.to_pylist()]

    made = map_columns(found, ["__doc"], ["__text", "found"], "masked string, changed boolean", mask)
    old = lambda c: F.col("__doc").getField(c)
    new = {"text": F.col("masked"), "n_chars": F.when(F.col("changed"), F.length("masked")).otherwise(old("n_chars")) if "n_chars" in docs.columns else None}
    return made.select(*[new.get(c, old(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return packing.pack(docs, public_path("byte_bpe_50k.json"))


STAGES = (
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
)

#: SQL cannot express the trained model of the first stage, the banded join or the genetic algorithm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        prepare(spark)
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
