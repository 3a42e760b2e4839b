"""Rows beside their group's numbers, without moving the rows by a few hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups whose numbers are sent to every task; more of them meet the rows in a salted join.
SENT = 20_000
SALTS = 32


def beside_cohort(rows: DataFrame, cohorts: DataFrame, keys: Sequence[str], how: str = "inner", sent: int | None = None) -> DataFrame:
    """Rows with their cohort's numbers, without sorting or shuffling the rows by a few hot keys.

    ``cohorts`` (cheap to read: cut before) is counted. Up to ``sent`` rows are broadcast; beyond that every cohort
    is repeated once per salt, and rows are salted by what they hold."""
    keys = list(keys)
    if cohorts.count() <= (SENT if sent is None else sent):
        return rows.join(F.broadcast(cohorts), keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    many = cohorts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(many, [*keys, "_salt"], how).drop("_salt")
