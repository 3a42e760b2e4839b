"""Rating semantics: weights, cohorts, shrinkage, composites."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.config import Ability, Feature, Model
from gradus.operators import moments as M
from gradus.operators import rating as R
from gradus.operators.lookup import beside_cohort

FEATURES = (Feature("goals90", "goals"), Feature("rate", "hits", "tries", "%"), Feature("lost90", "lost", direction=-1), Feature("context", "seen", direction=0))
ABILITIES = (Ability("A", 0.6, {"goals90": 0.5, "rate": 0.3, "context": 0.2}), Ability("B", 0.4, {"lost90": 1.0}))
MODEL = Model(FEATURES, ABILITIES, minimum_exposure=900, minimum_peers=30)
SCHEMA = "player int, position string, minutes double, goals double, hits double, tries double, lost double, seen double"


def cohort(n=40, position="ST"):
    rng = np.random.default_rng(5)
    return [
        (i, position, float(900 + 10 * i), float(rng.integers(0, 20)), float(rng.integers(1, 20)), 30.0, float(rng.integers(0, 40)), 3.0)
        for i in range(n)
    ]


def brute(rows):
    minutes = np.array([r[2] for r in rows])

    def std(v):
        return (v - v.mean()) / v.std() if v.std() > 1e-12 else np.zeros(len(v))

    def feature(value, n, k):
        r = n / (n + k)
        return std(r * value + (1 - r) * value.mean())

    goals = feature(np.array([r[3] / r[2] * 90 for r in rows]), minutes, 450)
    rate = feature(np.array([r[4] / r[5] * 100 for r in rows]), np.array([r[5] for r in rows]), 30)
    lost = -feature(np.array([r[6] / r[2] * 90 for r in rows]), minutes, 450)
    a, b = std(0.5 * goals + 0.3 * rate), std(lost)
    return a, b, std(0.6 * a + 0.4 * b)


def run(spark, rows, model=MODEL):
    df = spark.createDataFrame(rows, SCHEMA).persist()
    return R.score_catalogue(df, model, ["player", "position"], "position", "minutes")


def test_matches_brute_force_and_direction_zero_keeps_weight(spark):
    rows = cohort()
    scores, overall = run(spark, rows)
    a, b, total = brute(rows)
    got = {(r["player"], r["ability"]): r["z"] for r in scores.collect()}
    for i in range(40):
        assert got[(i, "A")] == pytest.approx(a[i], abs=1e-9)
        assert got[(i, "B")] == pytest.approx(b[i], abs=1e-9)
    final = {r["player"]: r for r in overall.collect()}
    z = np.array([final[i]["overall_z"] for i in range(40)])
    assert z == pytest.approx(total, abs=1e-9)
    assert abs(z.mean()) < 1e-9 and z.std() == pytest.approx(1)
    best = int(np.argmax(total))
    assert final[best]["rank"] == 1
    assert final[best]["overall"] == pytest.approx(max(1, 50 + 15 * total[best]))


def test_order_and_partitioning_do_not_matter(spark):
    rows = cohort()
    _, one = run(spark, rows)
    _, two = run(spark, list(reversed(rows)))
    pick = lambda df: {r["player"]: (r["overall_z"], r["rank"]) for r in df.collect()}
    assert pick(one) == pick(two)


def test_small_cohorts_and_low_exposure_are_not_rated(spark):
    _, overall = run(spark, cohort(29))
    assert overall.count() == 0
    low = [(r[0], r[1], 100.0, *r[3:]) for r in cohort()]
    assert run(spark, low)[1].count() == 0


def test_only_declared_zeros_move_weight(spark):
    rows = [(r[0], r[1], r[2], None if r[0] == 99 else r[3], *r[4:]) for r in cohort()] + [(99, "ST", 1000.0, None, 5.0, 30.0, 4.0, 3.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    by = {(r["player"], r["ability"]): r for r in R.ability_rows(df, MODEL, ["player", "position"], "minutes").collect()}
    mask = by[(99, "A")]
    assert (mask["w0"], mask["w1"], mask["w2"]) == (0.0, pytest.approx(0.6), 0.0) and mask["excluded"] == 1
    plain = by[(0, "A")]
    assert (plain["w0"], plain["w1"]) == (0.5, 0.3)
    assert mask["signature"] != plain["signature"]
    # A ratio without attempts is not a declared zero: it blocks the ability instead.
    zero = spark.createDataFrame([(1, "ST", 1000.0, 2.0, 0.0, 0.0, 1.0, 1.0)], SCHEMA)
    rows = {r["ability"]: r for r in R.ability_rows(zero, MODEL, ["player", "position"], "minutes").collect()}
    assert not rows["A"]["eligible"] and rows["B"]["eligible"]


def test_flat_composite_is_withheld_unless_kept(spark):
    flat = [(i, "ST", 1000.0, 2.0, 5.0, 30.0, 3.0, 3.0) for i in range(35)]
    assert run(spark, flat)[1].count() == 0
    df = spark.createDataFrame(flat, SCHEMA).persist()
    _, kept = R.score_catalogue(df, MODEL, ["player", "position"], "position", "minutes", "position = 'ST'")
    assert {r["overall_z"] for r in kept.collect()} == {0.0}


def test_calibration_is_one_pass_and_never_sorts_the_rows(spark):
    df = spark.createDataFrame(cohort(), SCHEMA)
    rows = R.ability_rows(df, MODEL, ["player", "position"], "minutes")
    plan = R.calibrate(rows, ["position", "ability", "signature"], MODEL.slots, 30)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_features_that_cancel_leave_no_spread(spark):
    up = (Feature("up", "goals"), Feature("down", "lost"))
    model = Model(up, (Ability("A", 1.0, {"up": 0.5, "down": 0.5}),), minimum_exposure=900, minimum_peers=30)
    rows = [(i, "ST", 1000.0, float(i % 17), 1.0, 30.0, float(1000 - i % 17), 3.0) for i in range(60)]
    scores, _ = R.score_catalogue(spark.createDataFrame(rows, SCHEMA), model, ["player", "position"], "position", "minutes")
    assert scores.count() == 0


def test_merged_moments_are_those_of_the_whole(spark):
    rng = np.random.default_rng(8)
    rows = [("c", f"g{i % 5}", *(float(x) for x in rng.normal(1e4, 3, 2)), *(float(x) for x in rng.uniform(50, 900, 2)), 450.0, 30.0, 0.7, 0.3) for i in range(400)]
    rows.append(("c", "g9", 1.0, 2.0, 3.0, 4.0, 450.0, 30.0, 0.7, 0.3))
    df = spark.createDataFrame(rows, "cohort string, part string, v0 double, v1 double, n0 double, n1 double, k0 double, k1 double, w0 double, w1 double")
    pick = lambda m: [tuple(r)[1:] for r in M.statistics(m, ["cohort"], 2, 30).collect()]
    whole, parts = pick(M.moments(df, ["cohort"], 2)), pick(M.merged(M.moments(df, ["cohort", "part"], 2), ["cohort"]))
    assert len(whole) == len(parts) == 1 and parts[0] == pytest.approx(whole[0], rel=1e-9)
    x = np.array([r[2:] for r in rows])
    s = [x[:, 2 + i] / (x[:, 2 + i] + x[:, 4 + i]) * x[:, i] + (1 - x[:, 2 + i] / (x[:, 2 + i] + x[:, 4 + i])) * x[:, i].mean() for i in (0, 1)]
    raw = sum(w * (t - t.mean()) / t.std() for w, t in zip((0.7, 0.3), s))
    # Of peer_count, m0, m1, a0, a1, d0, d1, raw_mean, raw_sd.
    assert whole[0] == pytest.approx((401, x[:, 0].mean(), x[:, 1].mean(), s[0].mean(), s[1].mean(), s[0].std(), s[1].std(), 0.0, raw.std()), rel=1e-9)


def test_many_cohorts_meet_the_rows_salted(spark):
    rows = spark.range(200).selectExpr("id", "id % 7 AS c")
    cohorts = spark.range(7).selectExpr("id AS c", "id * 10 AS m")
    both = [sorted(tuple(r) for r in beside_cohort(rows, cohorts, ["c"], sent=s).collect()) for s in (0, 100)]
    assert both[0] == both[1] and len(both[0]) == 200


def test_assigned_reference_need_not_share_the_mask(spark):
    rows = cohort() + [(99, "CB", 1000.0, None, 5.0, 30.0, 4.0, 3.0)]
    found = R.assigned_positions(spark.createDataFrame(rows, SCHEMA), {"ST": MODEL}, "player", "position", "minutes")
    got = {r["ability"]: r for r in found.scores.where("player = 99").collect()}
    assert got["A"]["peer_count"] == 40 and got["A"]["position"] == "ST"
    total = R.assigned_overall(found, "player").where("player = 99").collect()
    assert len(total) == 1 and total[0]["common_peers"] == 40


#: Another position's registry: the same abilities, weighed otherwise.
OTHER = Model(FEATURES, (Ability("A", 0.3, {"goals90": 0.2, "rate": 0.8}), Ability("B", 0.7, {"lost90": 0.6, "rate": 0.4})), minimum_exposure=900, minimum_peers=30)


def assigned_brute(rows, models, version, keeper="GK"):
    """{(player, position, ability): (z, peers)} by a loop over subjects, positions and references."""
    prior = {"goals90": 450, "rate": 30, "lost90": 450, "context": 450}
    values = lambda r: {"goals90": (r[3], r[2], 90), "rate": (r[4], r[5], 100), "lost90": (r[6], r[2], 90), "context": (r[7], r[2], 90)}
    sign = {f.key: f.direction for f in FEATURES}
    natural = {}
    for r in sorted(rows, key=lambda r: (r[0] % 2 == 0, r[0])):  # odd numbers are preferred
        if r[2] >= 900:
            natural.setdefault((r[1], r[0] // 2), r)
    out = {}
    for r in rows:
        if r[2] < 900:
            continue
        for position, model in models.items():
            if (position == keeper) != (r[1] == keeper):
                continue
            for a in model.abilities:
                own = values(r)
                kept = sum(w for k, w in a.weights.items() if own[k][0] is not None)
                used = {k: w * sum(a.weights.values()) / kept for k, w in a.weights.items() if own[k][0] is not None and sign[k]} if kept else {}
                if not used or any(not own[k][1] for k in used):
                    continue
                peers = [p for (at, _), p in natural.items() if at == position and all(values(p)[k][0] is not None and values(p)[k][1] and version(p, k) == version(r, k) for k in used)]
                if len(peers) < 30:
                    continue
                raw, mine = np.zeros(len(peers)), 0.0
                for k, w in used.items():
                    v = np.array([values(p)[k][0] / values(p)[k][1] * values(p)[k][2] for p in peers])
                    n = np.array([values(p)[k][1] for p in peers])
                    s = n / (n + prior[k]) * v + (1 - n / (n + prior[k])) * v.mean()
                    r_own = own[k][1] / (own[k][1] + prior[k])
                    t = r_own * own[k][0] / own[k][1] * own[k][2] + (1 - r_own) * v.mean()
                    raw += w * sign[k] * (s - s.mean()) / s.std()
                    mine += w * sign[k] * (t - s.mean()) / s.std()
                out[r[0], position, a.name] = ((mine - raw.mean()) / raw.std(), len(peers))
    return out


def test_assigned_scores_use_each_positions_registry(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(330):
        position = ("ST", "CB", "GK")[i % 3]
        goals = None if i % 11 == 0 else float(rng.integers(0, 20))
        tries = 0.0 if i % 13 == 0 else 30.0
        rows.append((i, position, float(rng.integers(880, 2000)), goals, float(rng.integers(1, 20)), tries, None if i % 17 == 0 else float(rng.integers(1, 40)), 3.0))
    version = lambda r, k: "2" if k == "rate" and r[0] % 5 == 0 else "1"
    models = {"ST": MODEL, "CB": OTHER, "GK": MODEL}
    df = spark.createDataFrame(rows, SCHEMA).withColumn("master", F.expr("player div 2"))
    found = R.assigned_positions(df, models, "player", "position", "minutes", "master", "player % 2 = 1", version="IF('{key}' = 'rate' AND player % 5 = 0, '2', '1')")
    got = {(r.player, r.position, r.ability): (r.z, r.peer_count) for r in found.scores.collect()}
    want = assigned_brute(rows, models, version)
    assert got.keys() == want.keys() and len(want) > 300
    for k in want:
        assert got[k] == (pytest.approx(want[k][0], abs=1e-9), want[k][1])
    # Weights differ by position, and so do the scores that one subject gets with one set of peers' features.
    assert any(abs(got[p, "ST", "A"][0] - got[p, "CB", "A"][0]) > 0.1 for p, at, a in want if at == "ST" and (p, "CB", "A") in want)
    peers = {(r.player, r.position, r.ability) for r in found.peers().select("player", "position", "ability").distinct().collect()}
    assert {p for p, _, _ in peers} <= {r[0] for r in rows if r[2] >= 900}


def test_assigned_positions_of_nobody(spark):
    none = spark.createDataFrame([], SCHEMA)
    found = R.assigned_positions(none, {"ST": MODEL}, "player", "position", "minutes")
    assert found.scores.count() == 0 and R.assigned_overall(found, "player").count() == 0


def test_keepers_below_thirty_give_no_rating(spark):
    rows = cohort(29, "GK") + [(100 + r[0], *r[1:]) for r in cohort(40, "CM")]
    _, overall = run(spark, rows)
    assert {r["position"] for r in overall.collect()} == {"CM"}


def test_keepers_are_only_asked_about_the_keeper_position(spark):
    rows = cohort(40, "GK") + [(100 + r[0], *r[1:]) for r in cohort(40, "CM")]
    found = R.assigned_positions(spark.createDataFrame(rows, SCHEMA), {"GK": MODEL, "CM": MODEL}, "player", "position", "minutes")
    asked = {(r["player"] >= 100, r["position"]) for r in found.scores.collect()}
    assert asked == {(False, "GK"), (True, "CM")}


def test_versatility_and_hybrid(spark):
    z = spark.createDataFrame([(1, "poacher", 1.0, 1), (1, "false-nine", 0.0, 2), (1, "target", -2.0, 3), (2, "poacher", 1.0, 1)], "id int, role string, z double, ord int")
    r = R.versatility(z, "id", "ord").collect()
    assert len(r) == 1 and r[0]["primary_role"] == "poacher"
    quality = (1 / 3 + 0) / 2
    consistency = (2 / 3 + 0) / 2
    assert r[0]["versatility"] == pytest.approx(100 * (0.4 * 0.5 + 0.4 * quality + 0.2 * consistency))
    a = spark.createDataFrame([(i, 1, float(i)) for i in range(40)], "id int, scope int, z double")
    b = a.withColumn("z", -F.col("z") * 2)
    assert R.hybrid([(a, 0.5), (b, 0.5)], "id", ["scope"], 30).count() == 40
    assert R.hybrid([(a.where("id < 20"), 0.5), (b, 0.5)], "id", ["scope"], 30).count() == 0


def test_priority_pick_keeps_alternatives(spark):
    df = spark.createDataFrame(
        [(1, "web", 5, "observed"), (1, "opta", 0, "invalid"), (1, "other", 9, "observed"), (2, "opta", 0, "observed")], "k int, provider string, v int, status string"
    )
    got = {r["k"]: r for r in R.priority_pick(df, ["k"], ["opta", "web"], "v", F.col("status") == "observed").collect()}
    assert got[1]["provider"] == "web" and got[1]["alternatives"] == 2
    assert got[2]["v"] == 0 and got[2]["alternatives"] == 0
