"""Unions and overlaps of half-open intervals for long keys.

Days are bits: a key's calendar year is six words of 64 days, so a union is an aggregate of words whatever the number
of intervals, and an overlap is the bits two rows share. No interval is sorted, and joins see years instead of pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of 64 days that hold a year.
WORDS = range(6)


def year_days(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, year, w0 to w5): the days covered by each key's intervals, one row per key and calendar year."""
    first, following = "make_date(year, 1, 1)", "make_date(year + 1, 1, 1)"
    parts = (
        df.where(F.col(start) < F.col(end))
        .select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
        .withColumn("year", F.expr("explode(sequence(year(_s), year(date_sub(_e, 1))))"))
        .selectExpr(*keys, "year", f"datediff(greatest(_s, {first}), {first}) AS _from", f"datediff(least(_e, {following}), {first}) AS _to")
    )
    bits = (
        "IF(least(_to - {at}, 64) > greatest(_from - {at}, 0), "
        "shiftleft(-1L, greatest(_from - {at}, 0)) & shiftrightunsigned(-1L, 64 - least(_to - {at}, 64)), 0L)"
    )
    return parts.groupBy(*keys, "year").agg(*[F.expr(f"bit_or({bits.format(at=64 * i)}) AS w{i}") for i in WORDS])


def shared_days(tenures: DataFrame, pairs: DataFrame) -> DataFrame:
    """Days each given pair spent at a common club, counted once.

    ``tenures``: (player, club, start, end) half-open dates; ``pairs``: (player_a, player_b).
    """
    days = year_days(tenures, ["player", "club"])
    a = days.selectExpr("player AS player_a", "club", "year", *[f"w{i} AS a{i}" for i in WORDS])
    b = days.selectExpr("player AS player_b", "club", "year", *[f"w{i} AS b{i}" for i in WORDS])
    pair = ["player_a", "player_b"]
    wanted = pairs.select(*pair).distinct()
    common = (
        wanted.join(a, "player_a")
        .join(b, ["player_b", "club", "year"])
        .where(" OR ".join(f"a{i} & b{i} <> 0" for i in WORDS))
        # Two clubs at the same time still are one day.
        .groupBy(*pair, "year")
        .agg(*[F.expr(f"bit_or(a{i} & b{i}) AS w{i}") for i in WORDS])
        .groupBy(*pair)
        .agg(F.expr(f"sum({' + '.join(f'bit_count(w{i})' for i in WORDS)}) AS days"))
    )
    return wanted.join(common, pair, "left").withColumn("days", F.coalesce("days", F.lit(0)).cast("long"))


VALID = "start >= 0 AND end >= start AND end <= 150"


def concurrent_minutes(intervals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Minutes both players of a pair were on in one match, and ``status``.

    A pair is refused (status ``invalid interval``, no minutes) if either player has an interval outside whole
    minutes 0..150 in the match. Within them a (match, player) has a bounded number of different intervals
    after removing repeats, and its pieces fit one small window.
    """
    key = ["match", "player"]
    refused = invalid_intervals(intervals).select(*key).distinct()
    valid = intervals.where(VALID).select(*key, "start", "end").groupBy(*key, "start").agg(
        F.max("end").alias("end")
    )
    w = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        valid.withColumn("start", F.greatest("start", F.max("end").over(w))).where("start < end")
    )
    a = pieces.selectExpr("match", "player AS player_a", "start AS s1", "end AS e1")
    b = pieces.selectExpr("match", "player AS player_b", "start AS s2", "end AS e2")
    wanted = pairs.select("match", "player_a", "player_b").distinct()
    minutes = (
        wanted.join(a, ["match", "player_a"])
        .join(b, ["match", "player_b"])
        .groupBy("match", "player_a", "player_b")
        .agg(F.sum(F.expr("greatest(0, least(e1, e2) - greatest(s1, s2))")).alias("minutes"))
    )
    sides = wanted.select("match", "player_a", "player_b", F.explode(F.array("player_a", "player_b")).alias("player"))
    bad = sides.join(refused, key, "left_semi").select("match", "player_a", "player_b").distinct().withColumn("bad", F.lit(True))
    pair = ["match", "player_a", "player_b"]
    return (
        wanted.join(minutes, pair, "left")
        .join(bad, pair, "left")
        .select(
            *pair,
            F.when(F.col("bad").isNull(), F.coalesce("minutes", F.lit(0))).cast("long").alias("minutes"),
            F.when(F.col("bad"), "invalid interval").otherwise("ok").alias("status"),
        )
    )


def invalid_intervals(intervals: DataFrame) -> DataFrame:
    return intervals.where(f"NOT coalesce({VALID}, false)")
