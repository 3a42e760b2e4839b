"""Feature views, distributions, whole roles, alternatives, reserves, reports and embedded data."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.config import POSITION_IDS, ROLE_SPECS, SOURCE_POSITIONS, Ability, Feature, Model
from gradus.operators import aggregates as A
from gradus.operators import rating as R
from gradus.operators import recruit as C
from gradus.operators import views as V
from gradus.sources import nested, pages

FEATURES = (Feature("goals90", "goals"), Feature("lost90", "lost", direction=-1))
MODEL = Model(FEATURES, (Ability("A", 0.6, {"goals90": 0.7, "lost90": 0.3}), Ability("B", 0.4, {"lost90": 1.0})), minimum_exposure=900, minimum_peers=30)
SCHEMA = "player int, position string, minutes double, goals double, lost double"
COHORT = ["position", "ability", "signature"]


@pytest.fixture(scope="module")
def judged(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "ST", float(900 + 10 * i), float(rng.integers(0, 20)), float(rng.integers(0, 40))) for i in range(40)]
    rows += [(100, "ST", 400.0, 9.0, 3.0), (101, "ST", 400.0, 100.0, 0.0)]
    ability = R.ability_rows(spark.createDataFrame(rows, SCHEMA), MODEL, ["player", "position"], "minutes").persist()
    return rows, ability, R.cohort_numbers(ability, COHORT, MODEL.slots, 30)


def standing(rows):
    """Per feature: values and shrunk values of the peers, and of everybody against them."""
    peers = [r for r in rows if r[2] >= 900]
    out = {}
    for k, at in (("goals90", 3), ("lost90", 4)):
        value = lambda r: r[at] / r[2] * 90  # noqa: B023, E731
        mean = np.mean([value(r) for r in peers])
        stable = {r[0]: r[2] / (r[2] + 450) * value(r) + (1 - r[2] / (r[2] + 450)) * mean for r in rows}
        own = np.array([stable[p[0]] for p in peers])
        out[k] = ({r[0]: value(r) for r in rows}, np.array([value(p) for p in peers]), {i: (s - own.mean()) / own.std() for i, s in stable.items()}, stable)
    return out


def test_feature_views_of_peers_and_subjects(judged):
    rows, ability, numbers = judged
    want = standing(rows)
    got = {(r.player, r.ability, r.key): r for r in V.feature_views(ability, numbers, MODEL, ["player"], COHORT).collect()}
    assert len(got) == 42 * 3
    for (player, name, key), r in got.items():
        values, peers, z, stable = want[key]
        sign = -1 if key == "lost90" else 1
        below, same = (peers < values[player] - 1e-12).sum(), (abs(peers - values[player]) <= 1e-12).sum()
        percentile = 100 * (below + 0.5 * same) / 40
        assert (r.value, r.stabilised, r.z, r.percentile) == pytest.approx((values[player], stable[player], sign * z[player], percentile if sign > 0 else 100 - percentile))
        assert (r.weight, r.base_weight, r.peer_count) == (pytest.approx(MODEL.abilities["AB".index(name)].weights[key]), MODEL.abilities["AB".index(name)].weights[key], 40)


def test_distributions_and_population(judged, spark):
    rows, ability, numbers = judged
    peers = standing(rows)["goals90"][1]
    curves = V.feature_distributions(ability, numbers, MODEL, COHORT).where("key = 'goals90'").collect()
    quantile = sorted((r.point, r.x) for r in curves if r.curve == "quantile")
    assert [x for _, x in quantile] == pytest.approx(np.quantile(peers, np.arange(101) / 100).tolist())
    density = sorted((r.point, r.x, r.y) for r in curves if r.curve == "density")
    h = peers.std(ddof=1) * 40**-0.2
    for _, x, y in density[::8]:
        assert y == pytest.approx(np.exp(-0.5 * ((x - peers) / h) ** 2).sum() / (40 * h * np.sqrt(2 * np.pi)))
    assert len(density) == 65
    name = lambda df: {r.g: r.population for r in V.population_hash(df, ["g"], "m").collect()}
    groups = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 1), ("c", 1)], "g string, m int")
    made = name(groups)
    assert made == name(groups.repartition(3)) and made["a"] == made["b"] != made["c"] and len(made["a"]) == 12


def test_role_view_measures_subjects_against_peers(judged):
    rows, ability, numbers = judged
    scores = R.score_subjects(ability, numbers, COHORT, MODEL.slots).where("z IS NOT NULL")
    got = {r.player: r for r in V.role_view(scores, ["player"], "position", 2, 30).collect()}
    z = {k: standing(rows)[k][2] for k in ("goals90", "lost90")}
    raw = {r[0]: 0.7 * z["goals90"][r[0]] - 0.3 * z["lost90"][r[0]] for r in rows}
    peers = [r[0] for r in rows if r[2] >= 900]
    std = lambda own: {i: (v - np.mean([own[p] for p in peers])) / np.std([own[p] for p in peers]) for i, v in own.items()}
    a, b = std(raw), std({i: -v for i, v in z["lost90"].items()})
    whole = std({i: 0.6 * a[i] + 0.4 * b[i] for i in a})
    assert got.keys() == whole.keys()
    for i, r in got.items():
        lower, greater = [whole[p] for p in peers if whole[p] < whole[i] - 1e-9], [whole[p] for p in peers if whole[p] > whole[i] + 1e-9]
        assert r.role_z == pytest.approx(whole[i], abs=1e-9) and r.rank == 1 + len(greater) and r.population_size == 40 and r.is_peer == (i < 100)
        assert r.gap_to_next_z == (pytest.approx(whole[i] - max(lower), abs=1e-9) if lower else None)
        assert r.gap_to_previous_z == (pytest.approx(min(greater) - whole[i], abs=1e-9) if greater else None)
    assert got[101].rank == 1 and got[101].gap_to_previous_z is None


def test_alternatives_and_supported_counts(spark):
    rows = [("p", "shots", "web", 2, "observed"), ("p", "shots", "opta", 1, "missing_measurement"), ("p", "shots", "opta", 3, "observed"), ("p", "pass", "web", 4, "not_applicable_zero_attempts"), ("p", "duels", "web", 5, "invalid")]
    df = spark.createDataFrame(rows, "who string, key string, provider string, id int, status string")
    got = {(r.key, r.place): r for r in R.combined_profile(df, ["who"], ["opta", "web"], "id").collect()}
    assert [got["shots", k].id for k in range(3)] == [3, 2, 1]
    assert {(r.numeric_features, r.supported_features) for r in got.values()} == {(1, 2)}
    assert got["shots", 0].definition_reconciliation == "source_specific_not_equivalent" and got["pass", 0].definition_reconciliation == "single_source"


def test_reserves_and_positions(spark):
    squads = spark.createDataFrame([(1, p) for p in "abcdea"] + [(2, "a")], "lineup int, player string")
    placed = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, None)], "lineup int, slot int, player string")
    bench = spark.createDataFrame([(1, "b"), (2, "z")], "lineup int, player string")
    assert sorted(map(tuple, A.reserves(squads, placed, bench).collect())) == [(1, "c"), (1, "d"), (1, "e"), (2, "a")]
    labels = spark.createDataFrame([(x,) for x in ("Winger", "Full Back", "LCM", "GK", "Nobody", "W")], "label string")
    got = {r.label: r.position for r in R.map_positions(labels, "label", [SOURCE_POSITIONS, POSITION_IDS]).collect()}
    assert got == {"Winger": "LW_RW", "Full Back": "RB_LB", "LCM": "CM", "GK": "GK", "Nobody": "Nobody", "W": "LW_RW"}


def test_profiles_of_the_fixed_roles(spark):
    """Every metric of every role's specification is profiled for players of that role."""
    rows = [(i, role, "L", 900.0 + i, m, "ratio" if m.endswith(("pct", "share")) else "per90", 0.5, float(5 + i % 3), 10.0) for role, spec in ROLE_SPECS.items() for m in spec.keys for i in range(3)]
    df = spark.createDataFrame(rows, "player int, role string, league string, minutes double, metric string, unit string, value double, numerator double, denominator double")
    got = {(r.role, r.metric) for r in C.role_profiles(df).select("role", "metric").distinct().collect()}
    assert got == {(role, m) for role, spec in ROLE_SPECS.items() for m in spec.keys}


def test_balanced_json_of_pages(spark):
    data = {"a": [1, {"b": "x}]{ \\\" ]"}], "c": None}
    text = json.dumps(data)
    html = {
        1: f'<script id="D">{text}</script><script>z</script>', 2: f"<script>window.data = {text}; var b = [1];</script>", 3: "<script id='D'>{{\"a\": [1</script>", 4: "none", 5: None, 6: '<script id="D"></script>',
        7: '<SCRIPT type="x" ID = \'D\' >\n [1, 2] </SCRIPT>',
    }
    df = spark.createDataFrame(list(html.items()), "k int, html string")
    assert {r.k: json.loads(r.body) for r in pages.embedded_json(df, "k", "html", script_id="D").collect()} == {1: data, 7: [1, 2]}
    assert {r.k: json.loads(r.body) for r in pages.embedded_json(df, "k", "html", variable="data").collect()} == {2: data}


def test_match_statistics(spark):
    stat = lambda key, **s: {"key": key, "stat": s}
    player = lambda i, minutes, **more: {"player": {"id": i, "name": "N"}, "team_id": 4, "stats": [{"stats": {"m": stat("minutes_played", type="integer", value=minutes), **more}}]}
    frac = lambda v, t: stat("duels", type="fractionWithPercentage", value=v, total=t)
    body = [player("a", 90, d=frac(1, 4)), player("b", 0, d=frac(1, 4)), player("c", 5, d=frac(5, 4), x={"stat": {"value": "?"}}), player("d", 5, d=frac(0, 0)), player("e", 1, d=frac(None, 3))]
    df = spark.createDataFrame([(1, 77, json.dumps(body)), (2, 78, "no json"), (3, 79, None)], "league int, match int, body string")
    got = {(r.entity, r.field): (r.value, r.status, r.kind) for r in nested.match_statistics(df, ["league"], "match", "body").collect()}
    assert {e for e, _ in got} == set("acde")
    assert got["a", "stats.duels.calculated_percentage"] == ("25.0", "numeric", "metric") and got["a", "metadata.player.id"] == ("a", "categorical", "identity")
    assert got["c", "stats.duels.value"][1] == "invalid" and got["c", "stats.duels.calculated_percentage"][:2] == (None, "invalid")
    assert got["d", "stats.duels.calculated_percentage"][:2] == (None, "na") and got["e", "stats.duels.value"][:2] == (None, "missing")
    assert got["e", "stats.duels.calculated_percentage"][:2] == (None, "missing") and got["c", "stats.unnamed.value"] == ("?", "categorical", "context")
