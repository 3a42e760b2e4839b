"""Standardisation, feature and rating queries over the bound entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import POSITION_IDS, ROLE_WEIGHTS, SOURCE_POSITIONS, Feature
from ..functions.status import rating
from ..operators import rating as R
from ..operators import standardize as S
from ..operators import views as V
from .bindings import (
    ABILITIES,
    APPEARANCES_SQL,
    ENTITIES_SQL,
    FEATURES,
    NAMED_SQL,
    PRIORITY,
    ROLE_Z,
    appearances,
    entities,
    features_sql,
    load,
    model,
    named,
    position_registry_sql,
    registry,
    registry_sql,
    role_z,
)
from .registry import query



def rate_entities(spark: SparkSession, sf: str, min_peers: int = 30) -> DataFrame:
    base = entities(spark, sf).persist()
    _, overall = R.score_catalogue(base, model(min_peers), ["player", "role"], "role", "minutes")
    return overall.select(
        "player",
        "role",
        F.round("overall_raw", 6).alias("overall_raw"),
        F.round("overall_z", 6).alias("overall_z"),
        F.round("overall", 6).alias("overall"),
        F.round("percentile", 6).alias("percentile"),
        F.col("rank").cast("long").alias("rank"),
        F.col("population").cast("long").alias("population"),
    )


# The same model, spelled out long: one row per (player, ability, feature).
SCORES_SQL = f"""
WITH {ENTITIES_SQL}, {features_sql()}, {registry_sql()},
weighted AS (
  SELECT f.*, g.ability, g.overall_weight, g.weight,
    sum(CASE WHEN status <> 'unrecorded_zero' THEN weight ELSE 0 END) OVER pa AS kept, sum(weight) OVER pa AS total
  FROM feats f JOIN registry g USING (key) WINDOW pa AS (PARTITION BY player, ability)),
active AS (SELECT *, CASE WHEN status = 'unrecorded_zero' OR kept <= 0 THEN 0.0 ELSE weight * total / kept END AS w FROM weighted),
flags AS (
  SELECT player, role, ability,
    bool_and(w = 0 OR dir = 0 OR (status = 'observed' AND isfinite(value) AND den > 0)) AND bool_or(w > 0 AND dir <> 0)
      AND max(minutes) >= 900 AS eligible,
    string_agg(CASE WHEN w > 0 AND dir <> 0 THEN key || ':' || CAST(round(w, 9) AS VARCHAR) END, ';' ORDER BY key) AS sig
  FROM active GROUP BY ALL),
sized AS (SELECT *, count(*) OVER (PARTITION BY role, ability, sig) AS peers FROM flags WHERE eligible),
members AS (
  SELECT a.*, s.sig, s.peers, avg(a.value) OVER (PARTITION BY a.role, a.ability, s.sig, a.key) AS mean
  FROM active a JOIN sized s USING (player, role, ability) WHERE s.peers >= {{min_peers}} AND a.w > 0 AND a.dir <> 0),
shrunk AS (SELECT *, den / (den + k) * value + (1 - den / (den + k)) * mean AS st FROM members),
zs AS (SELECT *, CASE WHEN stddev_pop(st) OVER c > 1e-12 THEN (st - avg(st) OVER c) / stddev_pop(st) OVER c ELSE 0 END AS fz
  FROM shrunk WINDOW c AS (PARTITION BY role, ability, sig, key)),
comp AS (SELECT player, role, ability, sig, max(overall_weight) AS overall_weight, max(peers) AS peers, sum(w * dir * fz) AS raw
  FROM zs GROUP BY player, role, ability, sig),
ability AS (SELECT *, (raw - avg(raw) OVER c) / stddev_pop(raw) OVER c AS z FROM
  (SELECT *, stddev_pop(raw) OVER (PARTITION BY role, ability, sig) AS sd FROM comp) WHERE sd > 1e-12
  WINDOW c AS (PARTITION BY role, ability, sig)),
lifted AS (SELECT player, role, sum(overall_weight * z) AS overall_raw, string_agg(ability || sig, '/' ORDER BY ability) AS cohort
  FROM ability GROUP BY player, role HAVING count(*) = {len(ABILITIES)}),
overall AS (SELECT *, round((overall_raw - avg(overall_raw) OVER c) / stddev_pop(overall_raw) OVER c, 10) AS overall_z,
  count(*) OVER c AS population FROM lifted WINDOW c AS (PARTITION BY role, cohort))
"""

RATED_SQL = (
    SCORES_SQL.replace("{min_peers}", "30")
    + """
SELECT player, role, round(overall_raw, 6) AS overall_raw, round(overall_z, 6) AS overall_z,
  round(greatest(1.0, 50 + 15 * overall_z), 6) AS overall,
  round(100.0 * (population - rank() OVER d - count(*) OVER v + 1 + 0.5 * count(*) OVER v) / population, 6) AS percentile,
  rank() OVER d AS rank, population
FROM overall WHERE population >= 30
WINDOW d AS (PARTITION BY role, cohort ORDER BY overall_z DESC), v AS (PARTITION BY role, cohort, overall_z)
"""
)


@query("score_catalogue", RATED_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rate_entities(spark, sf)


# The same steps with the registry of each entity's own position.
POSITION_SCORES_SQL = SCORES_SQL.replace(registry_sql(), position_registry_sql()).replace("JOIN registry g USING (key)", "JOIN registry g USING (key, role)").replace("{min_peers}", "30")


@query("score_catalogue_by_position", POSITION_SCORES_SQL + RATED_SQL[RATED_SQL.rindex("\nSELECT player, role, round(overall_raw") :])
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, overall = R.score_catalogue(entities(spark, sf), registry(), ["player", "role"], "role", "minutes")
    return overall.select(
        "player", "role", *[F.round(c, 6).alias(c) for c in ("overall_raw", "overall_z", "overall", "percentile")],
        F.col("rank").cast("long").alias("rank"), F.col("population").cast("long").alias("population"),
    )


@query(
    "withheld_reasons",
    POSITION_SCORES_SQL
    + """SELECT player, role, ability, CASE WHEN coalesce(b1.minutes, 0) < 900 THEN 'below exposure' WHEN NOT coalesce(f.eligible, FALSE) THEN 'missing feature' WHEN s.peers < 30 THEN 'too few peers' ELSE 'no spread' END AS reason
FROM flags f JOIN b1 USING (player, role) LEFT JOIN sized s USING (player, role, ability) ANTI JOIN ability USING (player, role, ability)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.ability_rows(entities(spark, sf), registry(), ["player", "role"], "minutes", position="role").persist()
    cohort = ["role", "ability", "signature"]
    _, slots = R.registered(registry())
    return R.withheld(rows, R.calibrate(rows, cohort, slots, 30), ["player", "role"], cohort, 30)


def ability_scores(spark: SparkSession, sf: str) -> DataFrame:
    m = model()
    rows = R.ability_rows(entities(spark, sf).persist(), m, ["player", "role"], "minutes")
    return R.calibrate(rows, ["role", "ability", "signature"], m.slots, m.minimum_peers)


LONG = ["player", "role", "league", "minutes"]


@query("derive_features", f"WITH {ENTITIES_SQL}, {features_sql()} SELECT player, key, round(value, 6) AS value FROM feats")
def _(spark: SparkSession, sf: str) -> DataFrame:
    wide = R.derive_features(entities(spark, sf), FEATURES, ["player"])
    out = wide.unpivot(["player"], [f.key for f in FEATURES], "key", "value")
    return out.withColumn("value", F.round("value", 6))


PAIR_FEATURES = (
    Feature("sot_pct", "on_target", "shots", "%"),
    Feature("goals_per_match", "np_goals", "matches", "ratio"),
    Feature("aerial_pct", "np_goals", "attempted", "%"),
    Feature("tax90", "tax"),
)


@query(
    "feature_rows",
    f"""WITH {ENTITIES_SQL}, c AS (SELECT *, CASE WHEN foot IS NULL THEN NULL ELSE shots - np_goals END AS lost FROM b1),
d AS (SELECT *, np_goals + lost AS attempted FROM c),
x AS (SELECT *, coalesce(on_target > shots OR np_goals > matches OR np_goals > attempted, FALSE) AS rejected FROM d)
SELECT player, rejected, 'sot_pct' AS key, '%' AS unit, round(100.0 * on_target / shots, 6) AS value, on_target::DOUBLE AS numerator, shots::DOUBLE AS denominator, 'observed' AS status FROM x
UNION ALL SELECT player, rejected, 'goals_per_match', 'ratio', round(np_goals / matches, 6), np_goals, matches, 'observed' FROM x
UNION ALL SELECT player, rejected, 'aerial_pct', '%', round(100.0 * np_goals / attempted, 6), np_goals, attempted, CASE WHEN attempted IS NULL THEN 'missing_measurement' ELSE 'observed' END FROM x
UNION ALL SELECT player, rejected, 'tax90', 'per90', round(90.0 * tax / minutes, 6), tax, minutes, CASE WHEN tax IS NULL THEN 'missing_measurement' ELSE 'observed' END FROM x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lost, attempted = R.complete_pairs("np_goals", "lost", "attempted")
    df = (
        entities(spark, sf)
        .withColumn("lost", F.expr("IF(foot IS NULL, NULL, shots - np_goals)"))
        .withColumn("attempted", F.lit(None).cast("long"))
        .withColumn("attempted", F.expr(attempted))
        .withColumn("lost", F.expr(lost))
    )
    return R.feature_rows(df, PAIR_FEATURES, ["player"]).withColumn("value", F.round("value", 6))


@query("measurement_status", f"WITH {ENTITIES_SQL}, {features_sql()} SELECT player, key, status FROM feats")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.long_features(entities(spark, sf), FEATURES, ["player"]).select("player", "key", "status")


BUNDLE_SQL = f"""
WITH {APPEARANCES_SQL}, obs AS (SELECT player AS row, flag AS provider, status AS sample,
  sum(minutes) AS mins, sum(price) AS saves, round(sum(xg), 2) AS goals, round(sum(tax), 2) AS conceded, count(*) AS attempts FROM b5 GROUP BY 1, 2, 3),
bundle AS (SELECT row, provider, sample, goals, conceded, attempts::DOUBLE AS attempts, CASE WHEN provider = 'N' THEN NULL ELSE conceded END AS keep,
  CASE provider WHEN 'R' THEN mins WHEN 'A' THEN attempts * 2 ELSE mins / 2 END AS minutes FROM obs)"""


def bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier totals by return flag (the source) and line status (the sample), as observations."""
    totals = (
        appearances(spark, sf)
        .groupBy(F.col("player").alias("row"), F.col("flag").alias("provider"), F.col("status").alias("sample"))
        .agg(
            F.sum("minutes").alias("mins"),
            F.round(F.sum("xg"), 2).alias("goals"),
            F.round(F.sum("tax"), 2).alias("conceded"),
            F.count("*").cast("double").alias("attempts"),
        )
    )
    obs = totals.selectExpr(
        "row",
        "provider",
        "sample",
        "stack(6, 'mins', mins, 'goals', goals, 'conceded', conceded, 'attempts', attempts, 'keep', IF(provider = 'N', NULL, conceded), "
        "'scaled', CASE provider WHEN 'A' THEN attempts * 2 ELSE mins / 2 END) AS (field, value)",
    )
    return R.bundle_build(
        obs,
        ["row", "provider", "sample"],
        ["mins", "goals", "conceded", "attempts", "keep", "scaled"],
        "IF(provider = 'R', 'mins', 'scaled')",
    )


@query("bundle_build", BUNDLE_SQL + " SELECT row, provider, sample, goals, conceded, attempts, keep, minutes FROM bundle")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return bundles(spark, sf).select("row", "provider", "sample", "goals", "conceded", "attempts", "keep", "minutes")


@query(
    "provider_local_measurement",
    BUNDLE_SQL
    + """, m AS (SELECT row, provider, sample, 'goal90' AS key, goals / minutes * 90 AS v, goals AS a, minutes AS b, 'per90' AS unit FROM bundle
UNION ALL SELECT row, provider, sample, 'keep_pct', keep / goals * 100, keep, goals, '%' FROM bundle WHERE keep IS NOT NULL
UNION ALL SELECT row, provider, sample, 'save_pct', goals, goals, conceded + attempts, '%' FROM bundle
UNION ALL SELECT row, provider, sample, 'dist_pct', goals, goals, attempts, '%' FROM bundle)
SELECT row, provider, sample, key, unit, CASE WHEN unit = '%' AND (v < 0 OR v > 100) THEN NULL ELSE round(v, 6) END AS value,
  a AS numerator, round(b, 4) AS denominator, CASE WHEN unit = '%' AND (v < 0 OR v > 100) THEN 'invalid' ELSE 'observed' END AS status FROM m""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    measures = [
        R.Measure("goal90", ["goals"], "per90"),
        R.Measure("keep_pct", ["keep", "goals"], "%"),
        R.Measure("save_pct", ["goals", "conceded", "attempts"], "%", "share"),
        R.Measure("dist_pct", ["goals", "attempts"], "%", "given"),
    ]
    out = R.provider_measurements(bundles(spark, sf), measures, ["row", "provider", "sample"])
    return out.withColumn("value", F.round("value", 6)).withColumn("denominator", F.round("denominator", 4))


@query(
    "attach_features",
    """WITH season AS (SELECT o_custkey AS player, count(*) * 30.0 AS minutes FROM orders GROUP BY 1),
c AS (SELECT o_custkey AS player, o_orderstatus AS key, o_orderpriority AS provider, o_orderkey AS id, o_totalprice AS value,
  CASE WHEN o_orderstatus = 'P' AND abs(o_totalprice / 1000 - minutes) > greatest(45, 0.02 * minutes) THEN 'partial_window' ELSE 'observed' END AS status
  FROM orders JOIN season ON player = o_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY player, key ORDER BY status <> 'observed', provider, id) AS n, count(*) OVER (PARTITION BY player, key) - 1 AS alternatives FROM c),
keys(key) AS (VALUES ('F'), ('O'), ('P'), ('X'))
SELECT s.player, k.key, CASE WHEN status IS NULL THEN 0 ELSE value END AS value, coalesce(status, 'unrecorded_zero') AS status,
  coalesce(provider, 'none') AS provider, coalesce(alternatives, 0) AS alternatives
FROM season s CROSS JOIN keys k LEFT JOIN r ON r.player = s.player AND r.key = k.key AND n = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    season = orders.groupBy(F.col("o_custkey").alias("player")).agg((F.count("*") * 30.0).alias("minutes"))
    candidates = orders.selectExpr(
        "o_custkey AS player",
        "o_orderstatus AS key",
        "o_orderpriority AS provider",
        "o_orderkey AS id",
        "IF(o_orderstatus = 'P', o_totalprice / 1000, NULL) AS window_minutes",
        "o_totalprice AS value",
        "o_totalprice AS numerator",
        "1D AS denominator",
        "'observed' AS status",
    )
    out = R.attach_features(season, candidates, "player", ["F", "O", "P", "X"], PRIORITY, "minutes")
    return out.drop("numerator", "denominator", "id")


ACTIVE_SQL = SCORES_SQL.replace("{min_peers}", "30")


@query("effective_weights", ACTIVE_SQL + "SELECT player, ability, key, round(w, 9) AS active_weight FROM active")
def _(spark: SparkSession, sf: str) -> DataFrame:
    registry = spark.createDataFrame(
        [(a.name, k, float(w)) for a in ABILITIES for k, w in a.weights.items()], "ability string, key string, weight double"
    )
    long = R.long_features(entities(spark, sf), FEATURES, ["player"]).select("player", "key", "status")
    out = R.effective_weights(long.join(F.broadcast(registry), "key"), ["player", "ability"])
    return out.select("player", "ability", "key", F.round("active_weight", 9).alias("active_weight"))


@query(
    "cohort_signature",
    ACTIVE_SQL + "SELECT player, role, ability, peers AS peer_count, peers >= 30 AS usable_cohort FROM sized",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = model()
    rows = R.ability_rows(entities(spark, sf), m, ["player", "role"], "minutes").where("eligible")
    sizes = rows.groupBy("role", "ability", "signature").agg(F.count("*").alias("peer_count"))
    return rows.join(sizes, ["role", "ability", "signature"]).select(
        "player", "role", "ability", "peer_count", (F.col("peer_count") >= m.minimum_peers).alias("usable_cohort")
    )


@query("calibrate_ability", ACTIVE_SQL + "SELECT player, role, ability, round(raw, 6) AS raw, round(z, 6) AS z, peers AS peer_count FROM ability")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ability_scores(spark, sf).select(
        "player", "role", "ability", F.round("raw", 6).alias("raw"), F.round("z", 6).alias("z"), "peer_count"
    )


@query("calibrate_composite", ACTIVE_SQL + "SELECT player, round(overall_raw, 6) AS overall_raw, round(overall_z, 6) AS overall_z, population AS peers FROM overall WHERE population >= 30")
def _(spark: SparkSession, sf: str) -> DataFrame:
    overall = R.compose(ability_scores(spark, sf), ["player", "role"], "role", len(ABILITIES), 30)
    return overall.select("player", F.round("overall_raw", 6).alias("overall_raw"), F.round("overall_z", 6).alias("overall_z"), "peers")


# A subject below the exposure floor is scored against the frozen peers of its mask.
SUBJECT_SQL = ACTIVE_SQL + """, fstats AS (SELECT role, ability, sig, key, max(mean) AS mean, avg(st) AS a, stddev_pop(st) AS d FROM shrunk GROUP BY 1, 2, 3, 4),
cstats AS (SELECT role, ability, sig, avg(raw) AS m, stddev_pop(raw) AS s, count(*) AS peers FROM comp GROUP BY 1, 2, 3),
wanted AS (SELECT player, role, ability, string_agg(CASE WHEN w > 0 AND dir <> 0 THEN key || ':' || CAST(round(w, 9) AS VARCHAR) END, ';' ORDER BY key) AS sig
  FROM active GROUP BY 1, 2, 3),
subj AS (SELECT q.player, q.role, q.ability, q.sig, sum(w * dir * ((den / (den + k) * value + (1 - den / (den + k)) * mean) - a) / d) AS raw, count(value) = count(*) AS full_row
  FROM wanted q JOIN active t USING (player, role, ability) JOIN fstats f ON f.role = q.role AND f.ability = q.ability AND f.sig = q.sig AND f.key = t.key
  WHERE t.w > 0 AND t.dir <> 0 GROUP BY 1, 2, 3, 4)
, fin AS (SELECT player, role, ability, sig, round((raw - m) / s, 10) AS z, peers, coalesce(eligible, FALSE)::INT AS e
  FROM subj JOIN cstats USING (role, ability, sig) JOIN flags USING (player, role, ability, sig) WHERE full_row AND s > 1e-12)
SELECT player, role, ability, round(z, 6) AS z, round(greatest(1.0, 50 + 15 * z), 6) AS rating, peers AS peer_count,
  round(100.0 * (sum(e) OVER (PARTITION BY role, ability, sig ORDER BY z) - 0.5 * sum(e) OVER (PARTITION BY role, ability, sig, z)) / peers, 6) AS percentile,
  CAST(peers - sum(e) OVER (PARTITION BY role, ability, sig ORDER BY z) + 1 AS BIGINT) AS rank FROM fin"""


@query("evaluate_role", SUBJECT_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = model()
    rows = R.ability_rows(entities(spark, sf).persist(), m, ["player", "role"], "minutes").persist()
    cohort = ["role", "ability", "signature"]
    numbers = R.cohort_numbers(rows, cohort, m.slots, m.minimum_peers).where("raw_sd > 0")
    out = (
        R.score_subjects(rows, numbers, cohort, m.slots)
        .where("z IS NOT NULL")
        .select("player", *cohort, "eligible", "peer_count", F.round("z", 10).alias("z"))
        .persist()
    )
    out = S.percentile_ranks(out, cohort, "z", "eligible", rank="rank")
    return out.select(
        "player", "role", "ability", F.round("z", 6).alias("z"), F.round(rating(F.col("z")), 6).alias("rating"), "peer_count",
        F.round("percentile", 6).alias("percentile"), "rank",
    )


@query(
    "unrated_view",
    ACTIVE_SQL
    + """SELECT player, key, round(value, 6) AS value, status, CAST(NULL AS DOUBLE) AS rating
FROM feats WHERE player NOT IN (SELECT player FROM overall WHERE population >= 30)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    overall = R.compose(ability_scores(spark, sf), ["player", "role"], "role", len(ABILITIES), 30)
    long = R.long_features(entities(spark, sf), FEATURES, ["player"])
    return R.unrated_view(long, overall, "player").select("player", "key", F.round("value", 6).alias("value"), "status", "rating")


def archetypes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(name, a.name, w) for name, weights in ROLE_WEIGHTS.items() for a, w in zip(ABILITIES, weights)],
        "archetype string, ability string, weight double",
    )


ARCHETYPE_VALUES = ", ".join(
    f"('{name}', '{a.name}', CAST({w} AS DOUBLE))" for name, weights in ROLE_WEIGHTS.items() for a, w in zip(ABILITIES, weights)
)


@query(
    "role_archetype_scores",
    ACTIVE_SQL
    + f""", arch(archetype, ability, weight) AS (VALUES {ARCHETYPE_VALUES}),
c AS (SELECT player, role, archetype, sum(weight * z) AS raw FROM ability JOIN arch USING (ability) GROUP BY 1, 2, 3 HAVING count(*) = 6),
k AS (SELECT c.*, league = 'AFRICA' AS masked FROM c JOIN (SELECT DISTINCT player, league FROM feats) USING (player)),
s AS (SELECT *, count(*) OVER w AS peers, (raw - avg(raw) OVER w) / stddev_pop(raw) OVER w AS z FROM k WINDOW w AS (PARTITION BY role, archetype, masked))
SELECT player, role, archetype, round(z, 6) AS z, round(greatest(1.0, 50 + 15 * z), 6) AS rating, peers FROM s WHERE peers >= 30""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    # The excluded-feature mask of all abilities together is part of the cohort.
    scores = ability_scores(spark, sf).persist()
    mask = scores.groupBy("player").agg(F.max(F.col("excluded") > 0).alias("masked"))
    out = R.archetype_scores(scores.join(mask, "player"), ["player"], archetypes(spark), ["role", "masked"], 30)
    return out.select("player", "role", "archetype", F.round("z", 6).alias("z"), F.round("rating", 6).alias("rating"), "peers")


@query(
    "hybrid_score",
    f"""WITH {ROLE_Z}, j AS (SELECT a.user_id, 0.5 * a.z + 0.5 * b.z AS raw FROM rz a JOIN rz b ON a.user_id = b.user_id AND a.role = 'click' AND b.role = 'purchase')
SELECT user_id, round(raw, 6) AS raw, round((raw - (SELECT avg(raw) FROM j)) / (SELECT stddev_pop(raw) FROM j), 5) AS z, (SELECT count(*) FROM j) AS joint_peers FROM j
WHERE (SELECT count(*) FROM j) >= 30""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    z = role_z(spark, sf).persist()
    pick = lambda r: z.where(F.col("role") == r).withColumn("scope", F.lit(1))
    out = R.hybrid([(pick("click"), 0.5), (pick("purchase"), 0.5)], "user_id", ["scope"])
    return out.select("user_id", F.round("raw", 6).alias("raw"), F.round("z", 5).alias("z"), "joint_peers")


@query(
    "versatility",
    f"""WITH {ROLE_Z}, v AS (SELECT * FROM rz WHERE role <> 'error'),
p AS (SELECT user_id, role AS primary_role, z AS zp FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY z DESC, role) AS r FROM v) WHERE r = 1)
SELECT v.user_id, primary_role, round(avg((z >= 0)::INT), 6) AS breadth, round(avg(least(1.0, greatest(0.0, (z + 1) / 3))), 6) AS secondary_quality,
  round(avg(greatest(0.0, 1 - abs(zp - z) / 3)), 6) AS consistency,
  round(100 * (0.4 * avg((z >= 0)::INT) + 0.4 * avg(least(1.0, greatest(0.0, (z + 1) / 3))) + 0.2 * avg(greatest(0.0, 1 - abs(zp - z) / 3))), 5) AS versatility
FROM v JOIN p ON v.user_id = p.user_id AND v.role <> p.primary_role GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    z = role_z(spark, sf).withColumn("ord", F.col("role")).persist()
    out = R.versatility(z, "user_id", "ord", ("error",))
    return out.select(
        "user_id",
        "primary_role",
        *[F.round(c, 6).alias(c) for c in ("breadth", "secondary_quality", "consistency")],
        F.round("versatility", 5).alias("versatility"),
    )


# Entities whose number ends in 1 are copies of the one before; xG was measured anew in one league.
MASTER, PREFERRED, VERSION = "IF(player % 10 = 1, player - 1, player)", "coalesce(foot = 'left', false)", "IF('{key}' LIKE 'xg%' AND league = 'AMERICA', 'v2', 'v1')"
ASSIGNED_SQL = f"""
WITH {ENTITIES_SQL}, {features_sql()}, {position_registry_sql()},
seen AS (SELECT *, CASE WHEN key LIKE 'xg%' AND league = 'AMERICA' THEN 'v2' ELSE 'v1' END AS ver FROM feats),
places AS (SELECT DISTINCT role AS position FROM registry),
weighted AS (
  SELECT f.*, g.role AS position, g.ability, g.overall_weight, g.weight,
    sum(CASE WHEN status <> 'unrecorded_zero' THEN weight ELSE 0 END) OVER pa AS kept, sum(weight) OVER pa AS total
  FROM seen f JOIN registry g ON f.key = g.key AND (g.role = 'BUILDING') = (f.role = 'BUILDING') WINDOW pa AS (PARTITION BY player, g.role, g.ability)),
active AS (SELECT *, CASE WHEN status = 'unrecorded_zero' OR kept <= 0 THEN 0.0 ELSE weight * total / kept END AS w FROM weighted),
flags AS (
  SELECT player, position, ability,
    bool_and(w = 0 OR dir = 0 OR (status = 'observed' AND isfinite(value) AND den > 0)) AND bool_or(w > 0 AND dir <> 0) AND max(minutes) >= 900 AS eligible,
    string_agg(CASE WHEN w > 0 AND dir <> 0 THEN key || ver || ':' || CAST(round(w, 9) AS VARCHAR) END, ';' ORDER BY key) AS sig
  FROM active GROUP BY ALL),
natural_ AS (SELECT player AS ref, role AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY role, CASE WHEN player % 10 = 1 THEN player - 1 ELSE player END ORDER BY coalesce(foot = 'left', FALSE) DESC, player) AS r FROM b1 WHERE minutes >= 900) WHERE r = 1),
masks AS (SELECT DISTINCT position, f.ability, f.sig, a.key, a.ver, a.w, a.dir, a.k, a.overall_weight FROM flags f JOIN active a USING (player, position, ability) WHERE eligible AND w > 0 AND dir <> 0),
need AS (SELECT position, ability, sig, count(*) AS n FROM masks GROUP BY ALL),
pool AS (SELECT m.*, n.ref, f.value, f.den FROM masks m JOIN natural_ n USING (position) JOIN seen f ON f.player = n.ref AND f.key = m.key AND f.ver = m.ver AND f.status = 'observed' AND f.den > 0),
okay AS (SELECT position, ability, sig, ref FROM pool JOIN need USING (position, ability, sig) GROUP BY ALL HAVING count(*) = max(n)),
size AS (SELECT position, ability, sig, count(*) AS peers FROM okay GROUP BY ALL HAVING count(*) >= 30),
m1 AS (SELECT pool.*, peers, avg(value) OVER (PARTITION BY position, ability, sig, key) AS mean FROM pool JOIN okay USING (position, ability, sig, ref) JOIN size USING (position, ability, sig)),
m2 AS (SELECT *, den / (den + k) * value + (1 - den / (den + k)) * mean AS st FROM m1),
fs AS (SELECT position, ability, sig, key, max(mean) AS mean, avg(st) AS a, stddev_pop(st) AS d FROM m2 GROUP BY ALL),
rr AS (SELECT position, ability, sig, ref, max(peers) AS peers, max(overall_weight) AS overall_weight, sum(w * dir * (st - a) / d) AS raw FROM m2 JOIN fs USING (position, ability, sig, key) GROUP BY ALL),
cs AS (SELECT position, ability, sig, max(peers) AS peers, avg(raw) AS m, stddev_pop(raw) AS s FROM rr GROUP BY ALL HAVING stddev_pop(raw) > 1e-12),
sub AS (SELECT f.player, f.position, f.ability, f.sig, max(t.overall_weight) AS overall_weight,
    sum(t.w * t.dir * ((t.den / (t.den + t.k) * t.value + (1 - t.den / (t.den + t.k)) * fs.mean) - a) / d) AS raw
  FROM flags f JOIN active t USING (player, position, ability) JOIN fs ON fs.position = f.position AND fs.ability = f.ability AND fs.sig = f.sig AND fs.key = t.key
  WHERE f.eligible AND t.w > 0 AND t.dir <> 0 GROUP BY ALL)"""


def assigned(spark: SparkSession, sf: str) -> R.Assigned:
    """Every entity in the positions of its class: the registry of each segment, one reference per master identity."""
    base = entities(spark, sf).withColumnRenamed("role", "position").withColumn("master", F.expr(MASTER)).persist()
    return R.assigned_positions(base, registry(), "player", "position", "minutes", "master", PREFERRED, "BUILDING", VERSION)


@query(
    "assigned_position_scores",
    ASSIGNED_SQL
    + """
SELECT player, position, ability, round((raw - m) / s, 6) AS z, peers AS peer_count FROM sub JOIN cs USING (position, ability, sig)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return assigned(spark, sf).scores.select("player", "position", "ability", F.round("z", 6).alias("z"), "peer_count")


COMMON_SQL = """, rz AS (SELECT position, rr.ability, rr.sig, ref, overall_weight, (raw - m) / s AS z FROM rr JOIN cs USING (position, ability, sig)),
sz AS (SELECT player, position, ability, sig, overall_weight, (raw - m) / s AS z FROM sub JOIN cs USING (position, ability, sig)),
tup AS (SELECT player, position, string_agg(ability || sig, '/' ORDER BY ability) AS cohort, sum(overall_weight * z) AS raw FROM sz GROUP BY 1, 2 HAVING count(*) = 6),
tset AS (SELECT DISTINCT position, cohort, ability, sig FROM tup JOIN sz USING (player, position)),
po AS (SELECT position, cohort, ref, sum(overall_weight * z) AS raw FROM rz JOIN tset USING (position, ability, sig) GROUP BY 1, 2, 3 HAVING count(*) = 6),
ps AS (SELECT position, cohort, avg(raw) AS m, stddev_pop(raw) AS s, count(*) AS common_peers FROM po GROUP BY 1, 2 HAVING count(*) >= 30 AND stddev_pop(raw) > 1e-12)"""


@query(
    "common_cohort_assigned",
    ASSIGNED_SQL
    + COMMON_SQL
    + """
SELECT player, position, round((raw - m) / s, 6) AS overall_z, round(greatest(1.0, 50 + 15 * (raw - m) / s), 5) AS overall, common_peers FROM tup JOIN ps USING (position, cohort)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = R.assigned_overall(assigned(spark, sf), "player")
    return out.select("player", "position", F.round("overall_z", 6).alias("overall_z"), F.round("overall", 5).alias("overall"), "common_peers")


@query(
    "canonical_reference",
    f"""WITH {NAMED_SQL} SELECT name, league, row, provider FROM (SELECT *, row_number() OVER (PARTITION BY name, league ORDER BY provider <> 'PROMO', row) AS r FROM b3) WHERE r = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = named(spark, sf).withColumn("preferred", (F.col("provider") == "PROMO").cast("int"))
    out = S.best_row(df.select("name", "league", "row", "provider", "preferred"), ["name", "league"], [("preferred", True), ("row", False)])
    return out.drop("preferred")


@query(
    "skill_composite",
    f"""WITH {ENTITIES_SQL}, {features_sql()},
z AS (SELECT *, CASE WHEN stddev_pop(value) OVER c > 1e-12 THEN (value - avg(value) OVER c) / stddev_pop(value) OVER c ELSE CASE WHEN value IS NULL THEN NULL ELSE 0 END END
  * CASE WHEN dir < 0 THEN -1 ELSE 1 END AS fz, CASE WHEN key IN ('goals90', 'tax90', 'xg90') THEN 2.0 ELSE 1.0 END AS wt FROM feats WINDOW c AS (PARTITION BY role, key)),
p AS (SELECT player, role, 100.0 * count(fz) / count(*) AS coverage, 100.0 * count(fz) FILTER (wt = 2) / count(*) FILTER (wt = 2) AS role_coverage,
  sum(wt) FILTER (fz IS NOT NULL) AS total_weight, sum(wt * fz) / sum(wt) FILTER (fz IS NOT NULL) AS raw, count(fz) AS mask FROM z GROUP BY 1, 2)
SELECT player, role, coverage, round(role_coverage, 6) AS role_coverage, total_weight, round(raw, 6) AS raw,
  round((raw - avg(raw) OVER g) / stddev_pop(raw) OVER g, 6) AS z FROM p WINDOW g AS (PARTITION BY role, mask)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    directions = spark.createDataFrame([(f.key, f.direction) for f in FEATURES], "key string, direction int")
    long = R.long_features(entities(spark, sf), FEATURES, ["player", "role"]).join(F.broadcast(directions), "key")
    out = R.skill_composite(long, "player", ["role"], ["goals90", "tax90", "xg90"], 2.0)
    return out.select(
        "player", "role", "coverage", F.round("role_coverage", 6).alias("role_coverage"), "total_weight",
        F.round("raw", 6).alias("raw"), F.round("z", 6).alias("z"),
    )


#: Every label that a source uses, one that no source uses, and positions that name themselves.
LABELS = (*SOURCE_POSITIONS, *POSITION_IDS, "GK", "CB", "Unknown")
_RESOLVED = {label: POSITION_IDS.get(SOURCE_POSITIONS.get(label, label), SOURCE_POSITIONS.get(label, label)) for label in LABELS}
_LABELS_SQL = ", ".join(f"({k}, '{label}', '{_RESOLVED[label]}')" for k, label in enumerate(LABELS))


@query(
    "position_map",
    f"""SELECT p_partkey, label, position FROM part JOIN (VALUES {_LABELS_SQL}) t(k, label, position) ON p_partkey % {len(LABELS)} = k""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Source labels to broad labels, and those to the registry's positions."""
    listed = ", ".join(f"'{label}'" for label in LABELS)
    labelled = load(spark, sf, "part").selectExpr("p_partkey", f"element_at(array({listed}), int(p_partkey % {len(LABELS)}) + 1) AS label")
    return R.map_positions(labelled, "label", [SOURCE_POSITIONS, POSITION_IDS])


@query(
    "ability_profile",
    ACTIVE_SQL
    + """SELECT player, role, ability, round(z, 6) AS z, round(greatest(1.0, 50 + 15 * z), 6) AS rating, overall_weight, peers AS peer_count,
  round(100.0 * (peers - rank() OVER d - count(*) OVER v + 1 + 0.5 * count(*) OVER v) / peers, 6) AS percentile, round(q50, 6) AS median_z,
  substr(sha256(peers || '|' || sum(CAST('0x' || substr(sha256(player::VARCHAR), 1, 15) AS BIGINT)) OVER (PARTITION BY role, ability, sig)), 1, 12) AS reference_population
FROM (SELECT *, quantile_cont(z, 0.5) OVER (PARTITION BY role, ability, sig) AS q50 FROM (SELECT * REPLACE (round(z, 10) AS z) FROM ability))
WINDOW d AS (PARTITION BY role, ability, sig ORDER BY z DESC), v AS (PARTITION BY role, ability, sig, z)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    key = ["role", "ability", "signature"]
    scores = (
        ability_scores(spark, sf)
        .select("player", *key, "overall_weight", "peer_count", F.round("z", 10).alias("z"))
        .persist()
    )
    median = S.quantiles(S.value_counts(scores, key, "z"), key, "z", [0.5]).select(*key, F.col("quantile").alias("median_z"))
    out = S.ranks(scores, key, "z").join(median, key).join(V.population_hash(scores, key, "player").drop("size").withColumnRenamed("population", "reference_population"), key)
    return out.select(
        "player", "role", "ability", F.round("z", 6).alias("z"), F.round(rating(F.col("z")), 6).alias("rating"),
        "overall_weight", "peer_count", F.round("percentile", 6).alias("percentile"), F.round("median_z", 6).alias("median_z"), "reference_population",
    )


PROFILE_STATUS = "CASE WHEN value >= 10 THEN 'observed' WHEN value >= 5 THEN 'not_applicable_zero_attempts' ELSE 'missing_measurement' END"


@query(
    "combined_profile",
    f"""WITH {NAMED_SQL}, c AS (SELECT name, league, unnest(['size', 'price']) AS key, unnest([size::DOUBLE, price]) AS value, provider, row FROM b3),
s AS (SELECT *, {PROFILE_STATUS} AS status FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY name, league, key ORDER BY status NOT IN ('observed', 'not_applicable_zero_attempts'), provider, row) - 1 AS place, count(*) OVER (PARTITION BY name, league, key) AS n FROM s),
k AS (SELECT name, league, count(*) FILTER (status = 'observed') AS numeric_features, count(*) FILTER (status <> 'missing_measurement') AS supported_features FROM r WHERE place = 0 GROUP BY 1, 2)
SELECT name, league, key, CAST(place AS INTEGER) AS place, value, status, provider, row, CASE WHEN n > 1 THEN 'source_specific_not_equivalent' ELSE 'single_source' END AS definition_reconciliation,
  numeric_features, supported_features FROM r JOIN k USING (name, league)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    candidates = named(spark, sf).selectExpr("name", "league", "provider", "row", "stack(2, 'size', cast(size AS double), 'price', price) AS (key, value)")
    priority = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    out = R.combined_profile(candidates.withColumn("status", F.expr(PROFILE_STATUS)), ["name", "league"], priority, "row")
    return out.select("name", "league", "key", "place", "value", "status", "provider", "row", "definition_reconciliation", "numeric_features", "supported_features")


def judged_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Ability rows of peers and subjects, and the numbers of their cohorts."""
    m = model()
    rows = R.ability_rows(entities(spark, sf).persist(), m, ["player", "role"], "minutes").persist()
    return rows, R.cohort_numbers(rows, COHORT, m.slots, m.minimum_peers)


COHORT = ["role", "ability", "signature"]
VIEWS_SQL = SUBJECT_SQL[: SUBJECT_SQL.index("\nsubj AS (")] + """
pops AS (SELECT role, ability, sig, substr(sha256(count(*) || '|' || sum(CAST('0x' || substr(sha256(player::VARCHAR), 1, 15) AS BIGINT))), 1, 12) AS population FROM sized WHERE peers >= 30 GROUP BY ALL)"""


@query(
    "feature_views",
    VIEWS_SQL
    + """, seen AS (SELECT q.player, q.role, q.ability, t.key, q.sig, t.dir, t.weight, t.w, t.value, t.den, t.k, f.mean, f.a, f.d, fl.eligible::INT AS e FROM wanted q JOIN active t USING (player, role, ability)
  JOIN fstats f ON f.role = q.role AND f.ability = q.ability AND f.sig = q.sig AND f.key = t.key JOIN flags fl ON fl.player = q.player AND fl.role = q.role AND fl.ability = q.ability WHERE t.w > 0 AND t.dir <> 0),
st AS (SELECT *, CASE WHEN den > 0 THEN den / (den + k) * value + (1 - den / (den + k)) * mean END AS stable, coalesce(e, 0) AS peer FROM seen),
pc AS (SELECT *, 100.0 * (sum(peer) OVER (PARTITION BY role, ability, sig, key ORDER BY value) - 0.5 * sum(peer) OVER (PARTITION BY role, ability, sig, key, value)) / sum(peer) OVER (PARTITION BY role, ability, sig, key) AS p,
  sum(peer) OVER (PARTITION BY role, ability, sig, key) AS peer_count FROM st)
SELECT player, role, ability, key, dir AS direction, weight AS base_weight, round(w, 6) AS weight, round(value, 6) AS value, round(stable, 6) AS stabilised, round(mean, 6) AS peer_mean,
  CASE WHEN value IS NOT NULL THEN round(den / (den + k), 6) END AS reliability, round(dir * (stable - a) / d, 6) AS z, CASE WHEN value IS NOT NULL THEN round(CASE WHEN dir < 0 THEN 100 - p ELSE p END, 6) END AS percentile,
  CAST(peer_count AS BIGINT) AS peer_count FROM pc""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows, numbers = judged_rows(spark, sf)
    out = V.feature_views(rows, numbers, model(), ["player"], COHORT)
    six = ("weight", "value", "stabilised", "peer_mean", "reliability", "z", "percentile")
    return out.select("player", "role", "ability", "key", "direction", "base_weight", *[F.round(c, 6).alias(c) for c in six], "peer_count")


@query(
    "feature_distributions",
    VIEWS_SQL
    + f""", vs AS (SELECT role, ability, sig, key, value FROM members),
ex AS (SELECT role, ability, sig, key, min(value) AS lo, max(value) AS hi, stddev_samp(value) * pow(count(*), -0.2) AS h, count(*) AS n FROM vs GROUP BY ALL),
q AS (SELECT role, ability, sig, key, 'quantile' AS curve, unnest(range(0, 101)) AS point, unnest(quantile_cont(value, [{', '.join(str(i / 100) for i in range(101))}])) AS x, CAST(NULL AS DOUBLE) AS y FROM vs GROUP BY role, ability, sig, key),
g AS (SELECT ex.*, unnest(range(0, 65)) AS point FROM ex WHERE hi - lo >= 1e-12),
dn AS (SELECT g.role, g.ability, g.sig, g.key, 'density' AS curve, point, lo + (hi - lo) * point / 64.0 AS x, sum(exp(-0.5 * pow((lo + (hi - lo) * point / 64.0 - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS y
  FROM g JOIN vs USING (role, ability, sig, key) GROUP BY g.role, g.ability, g.sig, g.key, point, lo, hi
  UNION ALL SELECT role, ability, sig, key, 'density', 0, lo, 1.0 FROM ex WHERE hi - lo < 1e-12)
SELECT role, ability, population, key, curve, CAST(point AS INTEGER) AS point, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT * FROM q UNION ALL SELECT * FROM dn) JOIN pops USING (role, ability, sig)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows, numbers = judged_rows(spark, sf)
    curves = V.feature_distributions(rows, numbers, model(), COHORT)
    populations = V.population_hash(rows.where("eligible"), COHORT, "player")
    return curves.join(populations, COHORT).select("role", "ability", "population", "key", "curve", "point", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "role_view",
    SUBJECT_SQL[: SUBJECT_SQL.index("\nSELECT player, role, ability, round(z, 6)")]
    + """, ow AS (SELECT DISTINCT ability, overall_weight FROM registry),
whole AS (SELECT player, role, round(sum(round(overall_weight * z, 12)), 11) AS raw, string_agg(ability || sig, '/' ORDER BY ability) AS cohort, min(e) AS e FROM fin JOIN ow USING (ability) GROUP BY 1, 2 HAVING count(*) = 6),
rstat AS (SELECT role, cohort, avg(raw) AS m, stddev_pop(raw) AS s, count(*) AS n FROM whole WHERE e = 1 GROUP BY 1, 2 HAVING count(*) >= 30 AND stddev_pop(raw) > 1e-12),
rzs AS (SELECT player, role, cohort, raw, e, n, round((raw - m) / s, 10) AS z FROM whole JOIN rstat USING (role, cohort))
SELECT player, role, round(raw, 6) AS role_raw, round(z, 6) AS role_z, round(greatest(1.0, 50 + 15 * z), 6) AS rating,
  round(100.0 * (sum(e) OVER (PARTITION BY role, cohort ORDER BY z) - 0.5 * sum(e) OVER (PARTITION BY role, cohort, z)) / n, 6) AS percentile,
  CAST(n - sum(e) OVER (PARTITION BY role, cohort ORDER BY z) + 1 AS BIGINT) AS rank, n AS population_size,
  round(z - max(CASE WHEN e = 1 THEN z END) OVER (PARTITION BY role, cohort ORDER BY z RANGE BETWEEN UNBOUNDED PRECEDING AND 0.00000000005 PRECEDING), 6) AS gap_to_next_z,
  round(min(CASE WHEN e = 1 THEN z END) OVER (PARTITION BY role, cohort ORDER BY z RANGE BETWEEN 0.00000000005 FOLLOWING AND UNBOUNDED FOLLOWING) - z, 6) AS gap_to_previous_z, e = 1 AS is_peer FROM rzs""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = model()
    rows, numbers = judged_rows(spark, sf)
    scores = R.score_subjects(rows, numbers.where("raw_sd > 0"), COHORT, m.slots).where("z IS NOT NULL")
    scores = scores.select("player", *COHORT, "overall_weight", "eligible", F.round("z", 10).alias("z"))
    out = V.role_view(scores, ["player"], "role", len(ABILITIES), m.minimum_peers)
    six = ("role_raw", "role_z", "rating", "percentile", "gap_to_next_z", "gap_to_previous_z")
    return out.select("player", "role", *[F.round(c, 6).alias(c) for c in six], "rank", "population_size", "is_peer")
