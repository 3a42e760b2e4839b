"""Evidence states, quarantine, pages, nested documents, familiarity, posteriors, models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import status as T
from gradus.functions.posterior import beta_cdf, beta_quantile, gamma_cdf, gamma_quantile
from gradus.operators import aggregates as A
from gradus.operators import familiarity as P
from gradus.operators import quality as Q
from gradus.operators import recruit as C
from gradus.operators import research as G
from gradus.sources import files, nested, pages


def test_ratio_and_cells(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, -1.0), (1.0, 2.0), (None, 0.0)], "n double, d double")
    assert [r[0] for r in df.select(T.ratio_status(F.col("n"), F.col("d"))).collect()] == ["na", "invalid", "invalid", None, None]
    cells = spark.createDataFrame([("1,234",), ("12.5%",), ("-",), ("",), ("N/A",), ("abc",), ("+3",)], "c string")
    s, v = T.numeric_text(F.col("c"), empty_zero=True)
    got = [tuple(r) for r in cells.select(s, v).collect()]
    assert got == [("numeric", 1234.0), ("numeric", 12.5), ("numeric", 0.0), ("numeric", 0.0), ("missing", None), ("categorical", None), ("numeric", 3.0)]


def test_split_covers_the_input_once(spark):
    df = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None), (4, -1.0)], "id int, v double")
    good, bad = Q.split(df, {"missing": "v IS NULL", "bad": "isnan(v) OR v < 0"}, ["id"])
    assert {r["id"] for r in good.collect()} == {1}
    assert {(r["id"], tuple(r["reasons"])) for r in bad.collect()} == {(2, ("bad",)), (3, ("missing",)), (4, ("bad",))}
    assert bad.columns == ["id", "reasons"]


def test_shots_and_shootouts(spark):
    day = "2024-05-01"
    rows = [
        ("e1", 1, day, "Shot", 1, 110.0, 40.0, "Goal", "Head", None, 1), ("e1", 1, day, "Shot", 1, 110.0, 40.0, "Goal", "Head", None, 2),
        ("e2", 1, day, "Shot", 5, 110.0, 40.0, "Goal", "Head", None, 3), ("e3", 1, day, "Pass", 1, 1.0, 1.0, None, None, None, 4),
        ("e4", 1, day, "Shot", 1, 130.0, 40.0, "Goal", "Head", True, 5),
    ]
    df = spark.createDataFrame(rows, "event_id string, match_id int, match_date string, type string, period int, x double, y double, outcome string, body_part string, under_pressure boolean, o int")
    shots, bad = Q.prepare_shots(df, ["o"])
    s = shots.collect()
    assert len(s) == 1 and (s[0]["distance"], s[0]["goal"], s[0]["header"], s[0]["under_pressure"]) == (10.0, 1, 1, 0)
    assert s[0]["angle"] == pytest.approx(math.atan2(80, 84))
    assert sorted((r["event_id"], r["reason"], r["copies"]) for r in bad.collect()) == [("e1", "duplicate", 1), ("e4", "invalid coordinates", 1)]


def test_strict_sums_and_unknown_on_target(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, v double")
    assert {r["k"]: r["v"] for r in df.groupBy("k").agg(A.strict_sum("v")).collect()} == {"a": None, "b": 5.0}
    shots = spark.createDataFrame(
        [("m", False, True, True, False, True, True, True, 0.2), ("n", False, True, True, None, True, True, True, 0.2)],
        "m string, penalty boolean, goal boolean, on_target boolean, blocked boolean, in_box boolean, header boolean, open_play boolean, xg double",
    )
    got = {r["m"]: r for r in A.event_totals(shots, ["m"]).collect()}
    assert got["m"]["shots_on_target"] == 1 and got["n"]["shots_on_target"] is None and got["m"]["npxg"] == 0.2


def test_coverage_gate_is_exact(spark):
    rows = [("k", float(i < 9), 1.0 if i < 9 else None, 1.0 if i < 9 else None, "per90") for i in range(10)]
    rows = [("k", 1.0, 1.0, 1.0, "per90")] * 9 + [("k", None, None, None, "per90")] + [("z", None, 0.0, 0.0, "%")] * 10
    df = spark.createDataFrame(rows, "key string, value double, numerator double, denominator double, unit string")
    got = {r["key"]: r for r in A.feature_coverage(df, []).collect()}
    assert got["k"]["accepted"] and got["k"]["coverage_pct"] == 90 and got["k"]["missing"] == 1
    assert got["z"]["accepted"] and got["z"]["coverage_pct"] == 0 and got["z"]["not_applicable"] == 10


def test_incomplete_league_makes_a_person_incomplete(spark):
    obs = spark.createDataFrame(
        [("f", "E", 1, "s1", "numeric", 1.0), ("f", "S", 1, "s2", "numeric", 2.0), ("f", "E", 2, "s3", "na", None)],
        "field string, league string, id int, sample string, status string, value double",
    )
    expected = spark.createDataFrame([("E", 1, 1), ("S", 1, 2), ("E", 2, 1)], "league string, id int, samples int")
    r = A.field_inventory(obs, expected, ["f"]).first()
    assert (r["players"], r["numeric"], r["complete_supported"], r["complete_numeric"], r["na"]) == (2, 1, 1, 0, 1)


def test_pair_components(spark):
    df = spark.createDataFrame(
        [(["x"], ["x"], True, ["l"], ["l"], True, 182.5, 5.0, 1800), (["x"], ["y"], True, ["l"], ["m"], False, 0.0, 30.0, 9000), (None, ["y"], True, None, None, True, None, None, 900)],
        "nations_a array<string>, nations_b array<string>, nations_complete boolean, languages_a array<string>, languages_b array<string>, languages_complete boolean, club_days double, age_gap double, minutes int",
    )
    rows = P.score_band(P.pair_score(P.pair_measures(df))).collect()
    vectors = [[r[c] for c in P.COMPONENTS] for r in rows]
    assert vectors[0] == [10, 5, 10, 5, 10] and vectors[1] == [0, 0, None, 0, 10] and vectors[2] == [None, None, None, None, 5]
    assert [(r["score"], r["band"]) for r in rows] == [(8.0, "green"), (2.5, "red"), (None, "unknown")]


@pytest.mark.parametrize("score,band", [(3.334, "red"), (3.335, "yellow"), (6.664, "yellow"), (6.665, "green"), (None, "unknown")])
def test_bands_round_half_up_first(spark, score, band):
    df = spark.createDataFrame([(score,)], "score double")
    assert P.score_band(df).first()["band"] == band


def test_posterior_quantiles_invert_their_cdf():
    a, b = np.array([1.0, 0.5, 3.0, 250.0, 30.0]), np.array([1.0, 0.5, 90.0, 400.0, 0.3])
    for q in (0.05, 0.5, 0.95):
        # Close to 1 the spacing of doubles alone moves the last of these by 1e-9.
        assert beta_cdf(beta_quantile(q, a, b), a, b) == pytest.approx(np.full(5, q), abs=1e-8)
        s = np.array([1.0, 0.2, 8.0, 900.0])
        assert gamma_cdf(gamma_quantile(q, s), s) == pytest.approx(np.full(4, q), abs=1e-9)
    assert beta_quantile(0.05, np.array([1.0]), np.array([1.0]))[0] == pytest.approx(0.05)
    assert gamma_quantile(0.95, np.array([1.0]))[0] == pytest.approx(-math.log(0.05))


def test_posterior_lies_between_observed_and_prior(spark):
    rows = [(i, "r", "l", 900.0, "m", "ratio", i / 10, float(i), 10.0) for i in range(1, 10)] + [(50, "r", "l", 900.0, "n", "ratio", 0.4, None, None)]
    df = spark.createDataFrame(rows, "player int, role string, league string, minutes double, metric string, unit string, value double, numerator double, denominator double")
    out = C.with_intervals(C.posterior_means(df, ["role", "league"])).collect()
    for r in out:
        low, high = sorted((r["value"], r["prior"]))
        assert low - 1e-12 <= r["posterior"] <= high + 1e-12 and r["lo"] <= r["posterior"] <= r["hi"]
        if r["metric"] == "n":
            assert (r["lo"], r["hi"]) == (0.0, 1.0)


def test_pages(spark):
    html = (
        '<a href="/a">A</a><script>var x="<a href=no>";</script><select><option value="7">2025/2026</option></select>'
        '<table><tr><th>Player</th><th>Goals</th></tr><tr><td><img alt="Bob"></td><td>3<table><tr><td>in</td></tr></table></td></tr></table><p>seen</p>'
    )
    rows = pages.extract(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").collect()
    assert [(r["value"], r["text"]) for r in rows if r["kind"] in ("link", "option")] == [("/a", "A"), ("7", "2025/2026")]
    in_order = sorted((r for r in rows if r["kind"] == "row"), key=lambda r: (r["table_no"], r["row_no"]))
    tables = [list(r["cells"]) for r in in_order]
    assert tables == [["in"], ["Player", "Goals"], ["Bob", "3"]]
    text = next(r["text"] for r in rows if r["kind"] == "text")
    assert "seen" in text and "var x" not in text


def test_flatten_keeps_short_lists_apart(spark):
    doc = '{"a":{"b":[1,2,3],"c":[1,2,3,4]},"d":null,"e":[{"f":"x"}],"g":{},"h":true}'
    out = nested.flatten_json(spark.createDataFrame([(1, doc), (2, '{"a":5}')], "id int, j string"), ["id"], "j")
    got = sorted((r["path"], r["value"]) for r in out.where("id = 1").collect() if r["path"] != "d")
    assert got == [("a.b[0]", "1"), ("a.b[1]", "2"), ("a.b[2]", "3"), ("a.c[]", "1"), ("a.c[]", "2"), ("a.c[]", "3"), ("a.c[]", "4"), ("e[0].f", "x"), ("h", "true")]
    assert [r["value"] for r in out.where("id = 2").collect()] == ["5"]


def test_spreadsheet_safety(spark, tmp_path):
    df = spark.createDataFrame([("=1+1",), ("-5",), (" @x",), ("+a",), ("ok",), ("\tz",), (None,)], "c string")
    got = [r[0] for r in df.select(files.formula_safe(F.col("c"))).collect()]
    assert got == ["'=1+1", "-5", "' @x", "'+a", "ok", "'\tz", None]
    files.write_safe_csv(df, str(tmp_path / "out"))
    back = files.scan(spark, str(tmp_path / "out"), "c string", "csv")
    assert back.where("c = \"'=1+1\"").count() == 1
    with pytest.raises(ValueError):
        files.scan(spark, "x", kind="csv")


def test_probability_metrics(spark):
    df = spark.createDataFrame([("a", 0, 0.2)] * 4 + [("b", 0, 0.1), ("b", 1, 0.9), ("b", 1, 0.1), ("b", 0, 0.5)], "m string, y int, p double")
    got = {r["m"]: r for r in G.probability_metrics(df, ["m"], "y", "p").collect()}
    assert got["a"]["brier"] == pytest.approx(0.04) and got["a"]["roc_auc"] is None
    assert got["b"]["roc_auc"] == pytest.approx(0.625)
    bins = G.calibration_bins(spark.createDataFrame([("a", 1, 1.0), ("a", 0, 0.95)], "m string, y int, p double"), ["m"], "y", "p").collect()
    assert [(r["bin"], r["count"]) for r in bins] == [(9, 2)]


def test_threat_surface_by_hand(spark):
    rows = [("shot", True, 0, 0), ("shot", False, 0, 0), ("move", True, 1, 0), ("move", True, 1, 0), ("move", False, 1, 0), ("move", True, 1, 1)]
    df = spark.createDataFrame(rows, "kind string, success boolean, start_zone int, end_zone int")
    surface = G.threat_surface(df, 1e-12)
    assert surface[0] == pytest.approx(0.5)
    assert surface[1] == pytest.approx((2 / 4 * 0.5) / (1 - 1 / 4))
    values = [r["value"] for r in G.action_values(df, surface).collect()]
    assert sorted(values)[0] == 0 and sorted(values)[1] == pytest.approx(0.5 - surface[1])


def test_registry_rules(spark):
    good = [("P", f"a{i}", 1 / 6, f"f{i}{j}", 0.5, 1) for i in range(6) for j in range(2)]
    bad = [("Q", "a", 0.5, "f00", 0.7, 1), ("Q", "a", 0.5, "nope", 0.2, 3)]
    df = spark.createDataFrame(good + bad, "position string, ability string, overall_weight double, feature string, weight double, direction int")
    known = spark.createDataFrame([(f"f{i}{j}",) for i in range(6) for j in range(2)], "feature string")
    got = {(r["position"], r["reason"]) for r in Q.registry_problems(df, known).collect()}
    assert got == {("Q", "unknown feature"), ("Q", "direction"), ("Q", "feature weights"), ("Q", "overall weights"), ("Q", "number of abilities")}


def test_feature_statuses(spark):
    from gradus.config import Feature
    from gradus.operators.rating import long_features

    df = spark.createDataFrame([(1, 5.0, 90.0, 0.0), (2, None, 90.0, 4.0), (3, 1.0, 0.0, 4.0)], "id int, goals double, minutes double, tries double")
    f = (Feature("g90", "goals"), Feature("pct", "goals", "tries", "%"))
    got = {(r["id"], r["key"]): (r["status"], r["value"]) for r in long_features(df, f, ["id"]).collect()}
    assert got[(1, "g90")] == ("observed", 5.0) and got[(1, "pct")] == ("not_applicable_zero_attempts", None)
    assert got[(2, "g90")] == ("unrecorded_zero", None) and got[(3, "g90")] == ("zero_exposure", None)


def test_combinations_of_sixteen_providers(spark):
    rng = random.Random(2)
    names = [f"p{i:02}" for i in range(16)]
    covers = {f"f{k}": {p for p in names if rng.random() < 0.15} for k in range(9)}
    thin = {f: {p for p in names if rng.random() < 0.1} for f in covers}
    rows = [(p, f, f, "L", i) for f, own in covers.items() for p in own for i in range(10)] + [(p, f, f, "L", 1) for f, own in thin.items() for p in own - covers[f]]
    variants = spark.createDataFrame(rows, "provider string, key string, family string, league string, id int")
    baseline = spark.createDataFrame([("L", i) for i in range(10)], "league string, id int")
    got = {r.sources: (r.size, r.reliable_families, r.observed_families) for r in A.source_combinations(variants, baseline, names).collect()}
    for mask in range(1, 1 << 16, 37):
        own = {p for i, p in enumerate(names) if mask >> i & 1}
        seen = sum(bool(own & (covers[f] | thin[f])) for f in covers)
        assert got.get("+".join(sorted(own))) == ((len(own), sum(bool(own & covers[f]) for f in covers), seen) if seen else None)
