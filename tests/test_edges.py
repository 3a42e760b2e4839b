"""Inputs the bound tables never show: large counts, moved nulls, mixed documents, refused intervals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions.posterior import beta_cdf, gamma_cdf, gamma_quantile
from gradus.operators import intervals, recruit, release, research, standardize
from gradus.sources import files, nested


def test_ranking_keeps_each_briefs_own_limit(spark):
    parts = spark.createDataFrame(
        [("b", p, 1.0 * p, 1.0, 1.0, None, 100.0, []) for p in range(300)],
        "brief string, player int, similarity double, quality double, tactical_fit double, replacement_fit double, coverage double, unknowns array<string>",
    )
    weights = {f"w_{c}": 1.0 for c in recruit.COMPONENTS}
    brief = lambda n: spark.createDataFrame([("b", n)], "brief string, max_results int").withColumns({k: F.lit(v) for k, v in weights.items()})
    assert recruit.recommend(parts, brief(150)).count() == 150
    assert recruit.recommend(parts, brief(7)).count() == 7
    assert [r.max_results for r in recruit.limit_violations(brief(150)).collect()] == [150]
    assert recruit.limit_violations(brief(100)).count() == 0
    stints = spark.createDataFrame([(1, "R"), (2, "S")], "player int, role string")
    asked = spark.createDataFrame([("a", "R", 1, 5), ("b", "R", 2, 5), ("c", "R", 9, 0), ("d", "R", None, 5)], "brief string, role string, replacement int, max_results int")
    assert sorted(r.brief for r in recruit.brief_violations(asked, stints).collect()) == ["b", "c", "c"]


def test_an_intended_style_comes_before_the_teams(spark):
    stints = spark.sql("SELECT player, 'R' AS role, 900D AS minutes, 25 AS age, 'left' AS foot, false AS inferred, map('x', true) AS attributes FROM VALUES (1), (2), (3) t(player)")
    profiles = spark.sql("SELECT player, 'R' AS role, 'pace' AS metric, double(player) AS posterior, 50D AS percentile, true AS is_style, false AS is_quality, 1 AS direction, 1 AS role_metrics, 1D AS weight FROM VALUES (1), (2), (3) t(player)")
    brief = spark.sql("""SELECT brief, 'R' AS role, 450D AS min_minutes, 15 AS min_age, 40 AS max_age, cast(NULL AS string) AS foot, cast(array() AS array<string>) AS attributes,
        true AS allow_unknown, cast(NULL AS int) AS replacement, 7 AS team, intended FROM VALUES ('own', map('pace', 3D)), ('team', cast(map() AS map<string,double>)) t(brief, intended)""")
    teams = spark.sql("SELECT 7 AS team, 'pace' AS metric, 1D AS target")
    none = spark.createDataFrame([], "brief string, metric string, weight double")
    made = {(r.brief, r.player): r.tactical_fit for r in recruit.components(stints, profiles, brief, teams, none).collect()}
    assert made[("own", 3)] == made[("team", 1)] == 100.0 and made[("own", 1)] < 100 and made[("team", 3)] < 100


@pytest.mark.parametrize("shape", [50.0, 9999.0, 1e4, 1e6, 1e8])
def test_gamma_intervals_of_large_shapes(shape):
    middle = gamma_cdf(np.array([shape]), np.array([shape]))[0]
    assert abs(middle - (0.5 + 1 / (3 * math.sqrt(2 * math.pi * shape)))) < 2e-4 / math.sqrt(shape)
    for q, z in ((0.05, -1.6448536269514722), (0.95, 1.6448536269514722)):
        x = gamma_quantile(q, np.array([shape]))[0]
        assert abs(gamma_cdf(np.array([x]), np.array([shape]))[0] - q) < 1e-6
        # Cornish-Fisher to the third term
        near = shape + z * math.sqrt(shape) + (z * z - 1) / 3 + (z**3 - 7 * z) / (36 * math.sqrt(shape))
        assert abs(x - near) < 0.05 / math.sqrt(shape) + 1e-7 * math.sqrt(shape)


def test_both_gamma_branches_agree():
    x = 9999.0 + np.linspace(-300, 300, 25)
    from gradus.functions import posterior

    assert np.allclose(gamma_cdf(x, np.full(25, 9999.0)), posterior._uniform_gamma(x, np.full(25, 9999.0)), atol=1e-9)


def test_beta_of_large_counts():
    n = 1e8
    assert abs(beta_cdf(np.array([0.5]), np.array([n]), np.array([n]))[0] - 0.5) < 1e-6


def test_mixed_documents_lose_nothing(spark):
    docs = [(1, '{"a":{"b":{"c":7}}}'), (2, '{"a":5}'), (3, '{"a":"x } ] \\\\" {["}'), (4, "{broken"), (5, None), (6, "[[[1],[2,[3]]]]")]
    rows = {tuple(r) for r in nested.flatten_json(spark.createDataFrame(docs, "id int, text string"), ["id"], "text").collect()}
    assert {r for r in rows if r[0] in (1, 2)} == {(1, "a.b.c", "7"), (2, "a", "5")}
    assert (4, None, "{broken") in rows and not [r for r in rows if r[0] == 5]
    assert {r[2] for r in rows if r[0] == 6} == {"1", "2", "3"}
    assert len([r for r in rows if r[0] == 3]) == 1


def test_invalid_match_intervals_are_refused(spark):
    rows = [(1, 1, 0, 200), (1, 2, 0, 90), (2, 1, 0, 90), (2, 2, 45, 90), (3, 1, 10, None), (3, 2, 0, 90)]
    played = spark.createDataFrame(rows, "match int, player int, start int, end int")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2)], "match int, player_a int, player_b int")
    made = {r.match: (r.minutes, r.status) for r in intervals.concurrent_minutes(played, pairs).collect()}
    assert made == {1: (None, "invalid interval"), 2: (45, "ok"), 3: (None, "invalid interval"), 4: (0, "ok")}


def test_every_attribute_of_a_brief_counts(spark):
    stints = spark.createDataFrame(
        [(1, {"strong": True, "calm_ball": True}), (2, {"strong": False}), (3, {"strong": True})], "player int, attributes map<string,boolean>"
    ).selectExpr("player", "'R' AS role", "900D AS minutes", "25 AS age", "'left' AS foot", "false AS inferred", "attributes")
    profiles = spark.createDataFrame([], "player int, role string, metric string, posterior double, percentile double, is_style boolean, is_quality boolean, direction int, role_metrics int, weight double")
    brief = spark.createDataFrame([("b", ["strong", "calm_ball"])], "brief string, attributes array<string>").selectExpr(
        "brief", "'R' AS role", "450D AS min_minutes", "15 AS min_age", "40 AS max_age", "cast(NULL AS string) AS foot", "attributes", "true AS allow_unknown",
        "cast(NULL AS int) AS replacement", "cast(NULL AS int) AS team",
    )
    none = spark.createDataFrame([], "team int, metric string, target double")
    wishes = spark.createDataFrame([], "brief string, metric string, weight double")
    made = {r.player: r.unknowns for r in recruit.components(stints, profiles, brief, none, wishes).collect()}
    assert made == {1: [], 3: ["Calm ball must be verified by scouting"]}


def test_digest_sees_nulls_types_and_cells(spark):
    base = spark.createDataFrame([(1, None, 5), (2, 3, 4)], "a int, b int, c int")
    mark = release.digest(base)
    assert release.digest(base.repartition(3)) == mark
    assert release.digest(spark.createDataFrame([(1, 5, None), (2, 3, 4)], "a int, b int, c int")) != mark
    assert release.digest(spark.createDataFrame([(1, None, 5), (2, 3, 5)], "a int, b int, c int")) != mark
    assert release.digest(base.withColumn("c", F.col("c").cast("long"))) != mark
    assert release.digest(base.union(base)) != mark and release.digest(base.limit(0)) != mark
    times = spark.sql("SELECT timestamp'2024-01-01 00:00:00.000001' AS t")
    assert release.digest(times) != release.digest(spark.sql("SELECT timestamp'2024-01-01 00:00:00.000002' AS t"))


def test_formulas_do_not_get_out(spark, tmp_path):
    cells = ["\n=1+1", " =1", "-1d", "+2f", "-1.5e3", "+7", "a=1", " @x", "-", None, "0x1p3", "-Infinity", "plain"]
    frame = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, `=head` string")
    files.write_safe_csv(frame, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("ignoreLeadingWhiteSpace", False).csv(str(tmp_path / "csv"))
    assert back.columns == ["k", "'=head"]
    made = {int(r[0]): r[1] for r in back.collect()}
    escaped = {k for k, c in enumerate(cells) if c is not None and made[k] is not None and made[k].startswith("'")}
    assert escaped == {0, 1, 2, 3, 7, 8, 11}


def test_only_plain_decimal_numbers_pass(spark):
    texts = ["5", "5.25", "5d", "7F", "0x1p3", "-1", "1e3", " 5", "", None, "NaN"]
    frame = spark.createDataFrame([(k, "90", t) for k, t in enumerate(texts)], "k int, minutes string, goals string")
    totals, bad = research.normalise_source(frame, "k", ["minutes", "goals"])
    assert sorted(r.k for r in totals.collect()) == [0, 1, 9]
    assert sorted(r.k for r in bad.collect()) == [2, 3, 4, 5, 6, 7, 8, 10]


def test_a_missing_value_never_wins(spark):
    frame = spark.createDataFrame([(1, 10, None), (1, 11, 9.0), (1, 12, 9.0), (2, 20, None)], "g int, id int, minutes double")
    made = {r.g: r.id for r in standardize.best_row(frame, ["g"], [("minutes", True), ("id", False)]).collect()}
    assert made == {1: 11, 2: 20}


def test_pretty_printed_snapshots(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n  "season": 2024,\n  "name": "x"\n}\n')
    (tmp_path / "two.json").write_text("{\n  broken\n")
    rows = files.scan_snapshots(spark, str(tmp_path), "season int, name string", whole=True).collect()
    assert sorted((r.season or 0, r.name or "") for r in rows) == [(0, ""), (2024, "x")]
    assert [r.corrupt is not None for r in rows if r.season is None] == [True]
