"""Order statistics against brute force, with hot groups, ties, tails and non-numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import standardize as S
from gradus.operators import ordered
from gradus.operators.ordered import cumulative, quantiles, value_counts


def sample(seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        group = "hot" if i % 3 else f"g{i % 5}"
        kind = i % 4
        value = [rng.gauss(0, 1), float(rng.randint(-3, 3)), rng.lognormvariate(0, 6), 1000 + rng.random() / 1e4][kind]
        rows.append((i, group, value))
    return rows + [(9001, "hot", float("nan")), (9002, "hot", float("inf")), (9003, "hot", None)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(sample(), "id int, g string, v double").persist()


def groups():
    out = {}
    for i, g, v in sample():
        if v is not None and math.isfinite(v):
            out.setdefault(g, []).append((i, v))
    return out


@pytest.fixture(params=[None, 7, 60])
def size(request, monkeypatch):
    """The largest group that is sorted whole: as it is, or so small that groups are cut into many cells."""
    if request.param:
        monkeypatch.setattr(ordered, "CELL", request.param)
    return request.param


def test_cells_follow_the_values(spark):
    base = 1_700_000_000
    counts = spark.range(200_000).selectExpr("'g' AS g", f"timestamp_micros(({base} + id) * 1000000 + id) AS v", "1L AS n")
    splits = ordered.splitters(counts, ["g"], "v", 10_000)
    cells = ordered.in_cells(counts, splits, ["g"], "v").groupBy("_cell").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("_cell").collect()
    assert len(cells) >= 15 and max(c.n for c in cells) < 20_000
    assert all(x.b < y.a for x, y in zip(cells, cells[1:]))
    assert ordered.splitters(counts, ["g"], "v", 200_000) is None


def test_cumulative_counts_and_neighbours(frame, size):
    got = {(r["g"], r["v"]): r for r in cumulative(value_counts(frame, ["g"], "v"), ["g"], "v").collect()}
    for g, members in groups().items():
        values = [v for _, v in members]
        distinct = sorted(set(values))
        for k, v in enumerate(distinct):
            r = got[(g, v)]
            assert r["below"] == sum(x < v for x in values)
            assert r["n"] == values.count(v) and r["total"] == len(values)
            assert r["previous"] == (distinct[k - 1] if k else None)
            assert r["following"] == (distinct[k + 1] if k + 1 < len(distinct) else None)


def test_quantiles_interpolate_linearly(frame, size):
    probs = [0.0, 0.1, 0.25, 0.5, 0.65, 0.9, 1.0]
    rows = quantiles(value_counts(frame, ["g"], "v"), ["g"], "v", probs).collect()
    assert len(rows) == len(probs) * len(groups())
    for r in rows:
        want = np.quantile([v for _, v in groups()[r["g"]]], r["probability"])
        assert r["quantile"] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_percentile_of_subjects_outside_the_peers(spark):
    df = spark.createDataFrame([("a", v, p) for v, p in [(1.0, True), (2.0, True), (2.0, True), (4.0, True), (2.0, False), (9.0, False)]], "g string, v double, peer boolean")
    got = {(r["v"], r["peer"]): r["percentile"] for r in S.percentile_ranks(df, ["g"], "v", "peer").collect()}
    assert got[(1.0, True)] == 12.5 and got[(2.0, True)] == 50.0 and got[(2.0, False)] == 50.0
    assert got[(4.0, True)] == 87.5 and got[(9.0, False)] == 100.0
    lower = {r["v"]: r["percentile"] for r in S.percentile_ranks(df.where("peer"), ["g"], "v", direction=-1).collect()}
    assert lower[1.0] == 87.5


def test_ranks_match_brute_force_and_ignore_partitioning(frame):
    clean = frame.where("v IS NOT NULL AND NOT isnan(v) AND v < double('Infinity')")
    for df in (clean, clean.repartition(7, "id")):
        for r in S.ranks(df, ["g"], "v").collect():
            values = [v for _, v in groups()[r["g"]]]
            assert r["rank"] == 1 + sum(x > r["v"] for x in values)
            assert r["population"] == len(values)


def test_density_of_a_flat_cohort_is_one_point(spark):
    df = spark.createDataFrame([("a", 2.0)] * 4 + [("b", float(i)) for i in range(10)], "g string, v double")
    rows = S.density_curve(df, ["g"], "v").collect()
    assert [(r["x"], r["density"]) for r in rows if r["g"] == "a"] == [(2.0, 1.0)]
    curve = sorted((r["x"], r["density"]) for r in rows if r["g"] == "b")
    assert len(curve) == 65
    values = np.arange(10.0)
    h = values.std(ddof=1) * 10 ** (-0.2)
    for x, y in curve[::16]:
        assert y == pytest.approx(np.exp(-0.5 * ((x - values) / h) ** 2).sum() / (10 * h * math.sqrt(2 * math.pi)))


def test_zscore_rules(spark):
    df = spark.createDataFrame([("flat", 3.0)] * 3 + [("two", 1.0), ("two", 3.0), ("one", 5.0)], "g string, v double")
    z = {(r["g"], r["v"]): r["z"] for r in S.zscores(df, ["g"], "v").collect()}
    assert z[("flat", 3.0)] == 0 and z[("two", 1.0)] == -1 and z[("two", 3.0)] == 1
    stats = S.cohort_stats(df, ["g"], ["v"])
    subjects = spark.createDataFrame([("flat", 3.0), ("flat", 4.0), ("one", 5.0)], "g string, v double")
    out = subjects.join(stats, "g").withColumn("z", S.subject_z(F.col("v"), F.col("v_mean"), F.col("v_sd"), F.col("v_n")))
    got = {(r["g"], r["v"]): r["z"] for r in out.collect()}
    assert got == {("flat", 3.0): 0.0, ("flat", 4.0): None, ("one", 5.0): None}


def test_fold_problems(spark):
    rows = [(m, f"2024-01-{1 + m // 2:02d}", i % 2) for m in range(50) for i in range(2)]
    df = spark.createDataFrame(rows, "match int, day string, goal int")
    assert S.fold_problems(df, "match", "day", "goal").count() == 0
    few = {r["reason"] for r in S.fold_problems(df.where("match < 4"), "match", "day", "goal").collect()}
    assert {"fewer than 20 matches", "fewer than 5 dates"} <= few
    torn = df.unionByName(df.where("match = 0").withColumn("day", F.lit("2024-02-01")))
    assert "match spans dates" in {r["reason"] for r in S.fold_problems(torn, "match", "day", "goal").collect()}
