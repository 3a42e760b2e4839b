"""Pairwise familiarity: five components out of ten, their mean and its band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = ("nationality", "club_tenure", "language", "age", "shared_minutes")


def pair_measures(pairs: DataFrame) -> DataFrame:
    """Components of each pair; verified absence is 0, unknown or incomplete evidence is null.

    Columns read: nations_a, nations_b, nations_complete, languages_a, languages_b,
    languages_complete (short arrays per player), club_days, age_gap, minutes.
    """

    def overlap(a: str, b: str, complete: str) -> str:
        return f"CASE WHEN arrays_overlap({a}, {b}) THEN 10D WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND {complete} THEN 0D END"

    return pairs.selectExpr(
        "*",
        f"{overlap('nations_a', 'nations_b', 'nations_complete')} AS nationality",
        "IF(club_days IS NULL, NULL, least(greatest(club_days, 0) / 365, 1D) * 10) AS club_tenure",
        f"{overlap('languages_a', 'languages_b', 'languages_complete')} AS language",
        "IF(age_gap IS NULL, NULL, greatest(0D, 1 - abs(age_gap) / 10) * 10) AS age",
        "IF(minutes IS NULL, NULL, least(greatest(minutes, 0) / 1800, 1D) * 10) AS shared_minutes",
    )


def half_up(expression: str) -> str:
    """Two decimals, halves away from zero, decided on the decimal digits."""
    return f"double(round(cast(round({expression}, 9) AS decimal(18, 9)), 2))"


def pair_score(measured: DataFrame) -> DataFrame:
    """Mean of the known components, if there are at least three."""
    known = " + ".join(f"int({c} IS NOT NULL)" for c in COMPONENTS)
    total = " + ".join(f"coalesce({c}, 0D)" for c in COMPONENTS)
    return measured.withColumn("available", F.expr(known)).withColumn(
        "score", F.expr(f"CASE WHEN available >= 3 THEN {half_up(f'({total}) / available')} END")
    )


def score_band(df: DataFrame, score: str = "score", out: str = "band") -> DataFrame:
    rounded = half_up(score)
    return df.withColumn(
        out,
        F.expr(
            f"CASE WHEN {score} IS NULL THEN 'unknown' WHEN {rounded} <= 3.33D THEN 'red' WHEN {rounded} <= 6.66D THEN 'yellow' ELSE 'green' END"
        ),
    )
