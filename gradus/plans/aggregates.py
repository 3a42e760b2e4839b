"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.status import feature_value
from ..operators import aggregates as A
from ..operators import rating as R
from .bindings import (
    APPEARANCES_SQL,
    ENTITIES_SQL,
    FEATURES,
    appearances,
    entities,
    features_sql,
    load,
    model,
)
from .rating import RATED_SQL
from .registry import query

LONG_KEEP = ["player", "role", "league", "minutes"]


def long_entities(spark: SparkSession, sf: str) -> DataFrame:
    return R.long_features(entities(spark, sf), FEATURES, LONG_KEEP)


@query(
    "league_season_coverage",
    """
WITH stints AS (SELECT c_custkey AS player, r_name AS league, year(o_orderdate) AS season, sum(l_quantity) AS minutes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)
SELECT league, season, count(*) AS stints, count(DISTINCT player) AS players, sum(minutes) AS exposure_minutes,
  count(*) FILTER (minutes >= 450) AS above_floor FROM stints GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("minutes"))
    geo = load(spark, sf, "nation").join(load(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    stints = (
        lines.join(load(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
        .groupBy("o_custkey", F.year("o_orderdate").alias("season"))
        .agg(F.sum("minutes").alias("minutes"))
        .join(load(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
        .join(geo, F.expr("c_nationkey = n_nationkey"))
        .selectExpr("c_custkey AS player", "r_name AS league", "season", "minutes")
    )
    return A.league_season_coverage(stints)


@query(
    "role_release_coverage",
    f"""WITH {ENTITIES_SQL}, p AS (SELECT role, league AS release,
  100.0 * ((age IS NOT NULL)::INT + (foot IS NOT NULL)::INT + (high_line IS NOT NULL)::INT + (tax IS NOT NULL)::INT) / 4 AS coverage FROM b1)
SELECT role, release, count(*) AS profiles, round(avg(coverage), 6) AS avg_coverage, min(coverage) AS min_coverage FROM p GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    profiles = entities(spark, sf).selectExpr(
        "role",
        "league AS release",
        "100D * (int(age IS NOT NULL) + int(foot IS NOT NULL) + int(high_line IS NOT NULL) + int(tax IS NOT NULL)) / 4 AS coverage",
    )
    return A.role_release_coverage(profiles).withColumn("avg_coverage", F.round("avg_coverage", 6))


@query(
    "duplicate_key_check",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.duplicate_keys(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "strict_season_rollup",
    f"""WITH {APPEARANCES_SQL}, s AS (SELECT player, year(match_date) AS season, minutes, xg, nullif(tax, 0) AS tax, team, retrieved, match, slot, price FROM b5)
SELECT player, season, sum(minutes) AS minutes, round(sum(xg), 2) AS xg,
  CASE WHEN count(tax) = count(*) THEN round(sum(tax), 2) END AS tax, min(retrieved) AS first_retrieved,
  count(DISTINCT team) AS teams, arg_max(team, (retrieved, match, slot, price, team)) AS last_team, count(*) AS appearances
FROM s GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = appearances(spark, sf).withColumn("season", F.year("match_date")).withColumn("tax", F.expr("nullif(tax, 0)"))
    out = A.strict_rollup(
        df, ["player", "season"], ["minutes", "xg", "tax"], "team", "retrieved", ["retrieved", "match", "slot", "price", "team"]
    )
    return out.withColumn("xg", F.round("xg", 2)).withColumn("tax", F.round("tax", 2))


SHOT_COLUMNS = (
    "match",
    "flag = 'A' AS penalty",
    "flag = 'R' AS goal",
    "flag <> 'N' AND xg > 0.02 AS on_target",
    "CASE WHEN tax > 0 THEN tax > 0.05 END AS blocked",
    "price < 30000 AS in_box",
    "slot = 1 AS header",
    "status = 'O' AS open_play",
    "xg",
)


@query(
    "conditional_event_totals",
    f"""WITH {APPEARANCES_SQL}, s AS (SELECT {', '.join(SHOT_COLUMNS)} FROM b5)
SELECT match, count(*) AS shots, count(*) FILTER (NOT penalty) AS non_penalty_shots,
  count(*) FILTER (NOT penalty AND goal) AS non_penalty_goals,
  round(coalesce(sum(xg) FILTER (NOT penalty), 0), 2) AS npxg,
  CASE WHEN bool_and(NOT on_target OR blocked IS NOT NULL) THEN count(*) FILTER (on_target AND NOT coalesce(blocked, FALSE)) END AS shots_on_target,
  count(*) FILTER (in_box) AS shots_inside_box, count(*) FILTER (header) AS headed_shots,
  round(coalesce(sum(xg) FILTER (open_play), 0), 2) AS open_play_xg FROM s GROUP BY match""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    shots = appearances(spark, sf).selectExpr(*SHOT_COLUMNS)
    return (
        A.event_totals(shots, ["match"])
        .withColumn("npxg", F.round("npxg", 2))
        .withColumn("open_play_xg", F.round("open_play_xg", 2))
    )


@query(
    "keeper_window_rollup",
    f"""WITH {APPEARANCES_SQL},
s AS (SELECT player, match, min(minutes) AS m, max(minutes) AS m2, min(round(xg * 1000)) AS r, max(round(xg * 1000)) AS r2,
  min(nullif(round(tax * 100), 8)) AS a, max(nullif(round(tax * 100), 8)) AS a2,
  count(*) FILTER (nullif(round(tax * 100), 8) IS NULL) AS an, count(nullif(round(tax * 100), 8)) AS av FROM b5 GROUP BY 1, 2),
k AS (SELECT * FROM s WHERE m = m2 AND r = r2 AND (av = 0 OR (a = a2 AND an = 0)) AND m > 0 AND m <= 130)
SELECT player, count(*) AS samples, sum(m) AS minutes, CASE WHEN count(a) = count(*) THEN sum(a) END AS attempts,
  CASE WHEN count(a) = count(*) AND bool_and(r BETWEEN 0 AND 100) AND sum(a) > 0 THEN round(sum(r * a) / sum(a), 6) END AS weighted_rate
FROM k GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    obs = appearances(spark, sf).selectExpr(
        "player",
        "match",
        "stack(3, 'minutes', minutes, 'accuracy', round(xg * 1000), 'attempts', nullif(round(tax * 100), 8D)) AS (field, value)",
    )
    out = A.window_rollup(obs, ["player"], "match", "minutes", "accuracy", "attempts")
    return out.withColumn("weighted_rate", F.round("weighted_rate", 6))


COVERAGE_SQL = """
SELECT {keys}, count(*) AS total, count(value) AS available,
  count(*) FILTER (value IS NULL AND num IS NOT NULL AND den = 0) AS undefined_zero_denominator,
  count(*) FILTER (value IS NULL AND num = 0 AND den = 0 AND den_key <> 'minutes') AS not_applicable,
  count(*) - count(value) - count(*) FILTER (value IS NULL AND num IS NOT NULL AND den = 0) AS missing,
  round(100.0 * count(value) / count(*), 6) AS coverage_pct,
  round(100.0 * (count(value) + count(*) FILTER (value IS NULL AND num = 0 AND den = 0 AND den_key <> 'minutes')) / count(*), 6) AS evidence_pct,
  100.0 * (count(value) + count(*) FILTER (value IS NULL AND num = 0 AND den = 0 AND den_key <> 'minutes')) / count(*) >= 90 AS accepted
FROM {source} GROUP BY {keys}"""


@query("feature_coverage_gate", f"WITH {ENTITIES_SQL}, {features_sql()}" + COVERAGE_SQL.format(keys="key", source="feats"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.feature_coverage(long_entities(spark, sf), [])


@query(
    "coverage_grouping_sets",
    f"""WITH {ENTITIES_SQL}, {features_sql()}, tagged AS (
  SELECT 'all' AS population, * FROM feats UNION ALL SELECT 'minimum_exposure', * FROM feats WHERE minutes >= 900
  UNION ALL SELECT 'league:' || league, * FROM feats)"""
    + COVERAGE_SQL.format(keys="population, key", source="tagged"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.grouped_coverage(long_entities(spark, sf))


@query(
    "provider_league_coverage",
    f"""WITH {ENTITIES_SQL}, {features_sql()}
SELECT role AS provider, league, key, count(*) AS records, count(*) FILTER (status = 'observed') AS numeric,
  count(*) FILTER (status = 'not_applicable_zero_attempts') AS not_applicable,
  round(100.0 * count(*) FILTER (status IN ('observed', 'not_applicable_zero_attempts')) / count(*), 2) AS supported_pct
FROM feats WHERE minutes > 0 GROUP BY 1, 2, 3""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.provider_coverage(long_entities(spark, sf).withColumnRenamed("role", "provider"))


STATE_SQL = (
    "CASE WHEN o_totalprice < 20000 THEN 'missing' WHEN o_totalprice < 60000 THEN 'na' "
    "WHEN o_totalprice > 480000 THEN 'invalid' WHEN o_totalprice > 450000 THEN 'categorical' ELSE 'numeric' END"
)


@query(
    "field_inventory_counts",
    f"""WITH obs AS (SELECT o_orderstatus AS field, o_orderpriority AS league, o_custkey AS id, o_orderkey AS sample,
  {STATE_SQL} AS status, o_totalprice AS value FROM orders),
expected AS (SELECT league, id, CAST(ceil(count(*) / 3.0) AS BIGINT) AS samples FROM obs GROUP BY 1, 2),
p AS (SELECT field, league, id, count(*) AS n, count(*) FILTER (status = 'numeric') AS nn,
  count(*) FILTER (status IN ('numeric', 'categorical')) AS nr, count(*) FILTER (status IN ('numeric', 'categorical', 'na')) AS ns,
  count(*) FILTER (status = 'na') AS na, count(*) FILTER (status = 'invalid') AS ni, count(*) FILTER (status = 'missing') AS nm
  FROM obs GROUP BY 1, 2, 3),
g AS (SELECT f.field, e.id, e.samples, p.n, nn, nr, ns, na, ni, nm, coalesce(p.n >= samples AND ns = n, FALSE) AS sup,
  coalesce(p.n >= samples AND nn = n, FALSE) AS num FROM expected e CROSS JOIN (SELECT DISTINCT field FROM obs) f
  LEFT JOIN p ON p.field = f.field AND p.league = e.league AND p.id = e.id),
i AS (SELECT field, id, bool_or(coalesce(nn, 0) > 0) AS a, bool_or(coalesce(nr, 0) > 0) AS b, bool_or(coalesce(na, 0) > 0) AS c,
  bool_or(coalesce(ni, 0) > 0) AS d, bool_or(n IS NULL OR nm > 0 OR n < samples) AS e,
  bool_or(coalesce(nr + na, 0) > 0 AND NOT sup) AS f, bool_and(sup) AS g, bool_and(num) AS h FROM g GROUP BY 1, 2)
SELECT field, count(*) AS players, count(*) FILTER (a) AS numeric, count(*) FILTER (b) AS recorded, 0 AS zero, count(*) FILTER (c) AS na,
  count(*) FILTER (d) AS invalid, count(*) FILTER (e) AS missing, count(*) FILTER (f) AS partial,
  count(*) FILTER (g) AS complete_supported, count(*) FILTER (h) AS complete_numeric FROM i GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    obs = load(spark, sf, "orders").selectExpr(
        "o_orderstatus AS field", "o_orderpriority AS league", "o_custkey AS id", "o_orderkey AS sample",
        f"{STATE_SQL} AS status", "o_totalprice AS value",
    )
    expected = obs.groupBy("league", "id").agg(F.expr("cast(ceil(count(*) / 3.0) AS bigint) AS samples"))
    return A.field_inventory(obs, expected, ["F", "O", "P"])


@query(
    "observation_idempotent_merge",
    """SELECT l_orderkey, l_linenumber, count(*) AS repeats,
  CASE WHEN count(q) = 0 THEN 'missing' WHEN count(q) < count(*) OR min(q) <> max(q) THEN 'invalid' ELSE 'numeric' END AS status,
  CASE WHEN count(q) = count(*) AND min(q) = max(q) THEN min(q) END AS value
FROM (SELECT *, nullif(l_quantity, 50) AS q FROM lineitem) GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "lineitem").withColumn("q", F.expr("nullif(l_quantity, 50D)"))
    return A.merge_observations(df, ["l_orderkey", "l_linenumber"], "q")


@query(
    "source_combination_coverage",
    """WITH v AS (SELECT DISTINCT o_orderpriority AS provider, o_orderstatus AS family, r_name AS league, o_custkey AS id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
base AS (SELECT DISTINCT league, id FROM v WHERE provider = '1-URGENT'),
sizes AS (SELECT league, count(*) AS benchmark FROM base GROUP BY 1),
hits AS (SELECT provider, family, v.league, count(*) AS hit, max(benchmark) AS benchmark FROM v JOIN base USING (league, id) JOIN sizes USING (league) GROUP BY ALL),
passing AS (SELECT provider, family, count(*) FILTER (100 * hit >= 55 * benchmark) = (SELECT count(*) FROM sizes) AS passes FROM hits GROUP BY 1, 2),
names AS (SELECT provider, row_number() OVER (ORDER BY provider) - 1 AS bit FROM (SELECT DISTINCT provider FROM v)),
members AS (SELECT mask, provider FROM range(1, 32) t(mask) JOIN names ON (mask >> bit) & 1 = 1),
subsets AS (SELECT mask, string_agg(provider, '+' ORDER BY provider) AS sources, count(*) AS size FROM members GROUP BY 1)
SELECT sources, size, count(*) FILTER (p) AS reliable_families, count(*) AS observed_families FROM
 (SELECT sources, size, family, bool_or(passes) AS p FROM passing JOIN members USING (provider) JOIN subsets USING (mask) GROUP BY 1, 2, 3)
GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    geo = load(spark, sf, "nation").join(load(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    variants = (
        load(spark, sf, "orders")
        .select("o_orderpriority", "o_orderstatus", "o_custkey")
        .distinct()
        .join(load(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
        .join(geo, F.expr("c_nationkey = n_nationkey"))
        .selectExpr("o_orderpriority AS provider", "o_orderstatus AS key", "o_orderstatus AS family", "r_name AS league", "o_custkey AS id")
    )
    baseline = variants.where("provider = '1-URGENT'").select("league", "id").distinct()
    providers = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return A.source_combinations(variants, baseline, providers, 55.0)


FAMILIES = {"click": "interaction", "view": "interaction", "error": "fault"}


@query(
    "metric_family_map",
    """SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'interaction' WHEN 'view' THEN 'interaction'
  WHEN 'error' THEN 'fault' ELSE event_type END AS family FROM events""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.synonym_map(load(spark, sf, "events").select("event_id", "event_type"), "event_type", FAMILIES)


@query(
    "freshness_summary",
    f"""WITH {APPEARANCES_SQL}, m AS (SELECT match_status, match, min(retrieved) AS a, max(retrieved) AS b, min(match_date) AS c,
  max(match_date) AS d, bool_and(retrieved >= match_date) AS v FROM b5 GROUP BY 1, 2)
SELECT match_status, min(a) AS first_retrieved, max(b) AS last_retrieved, min(c) AS first_match, max(d) AS last_match,
  count(*) AS inventory_matches, count(*) FILTER (v) AS validated_matches FROM m GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.freshness(
        appearances(spark, sf), "match_status", "retrieved", "match_date", "match", F.col("retrieved") >= F.col("match_date")
    )


@query(
    "evidence_manifest",
    """SELECT 'records' AS section, l_returnflag AS name, count(*) AS value FROM lineitem GROUP BY 2
UNION ALL SELECT 'quarantine', l_returnflag, count(*) FILTER (l_quantity > 45) FROM lineitem GROUP BY 2
UNION ALL SELECT 'links', 'reviewed', count(*) FROM labels WHERE quality = 1
UNION ALL SELECT 'feature_slots', 'all', count(*) * 10 FROM customer""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem")
    by = lines.groupBy(F.col("l_returnflag").alias("name")).agg(
        F.count("*").alias("value"), F.count_if(F.col("l_quantity") > 45).alias("bad")
    )
    links = load(spark, sf, "labels").where("quality = 1").agg(F.count("*").alias("value")).withColumn("name", F.lit("reviewed"))
    slots = load(spark, sf, "customer").agg((F.count("*") * len(FEATURES)).alias("value")).withColumn("name", F.lit("all"))
    return A.manifest(
        {"records": by, "quarantine": by.selectExpr("name", "bad AS value"), "links": links, "feature_slots": slots}
    )


@query(
    "catalogue_metadata",
    f"""WITH {ENTITIES_SQL} SELECT 'league' AS kind, league AS scope, league AS value, count(*) AS players FROM b1 GROUP BY league
UNION ALL SELECT 'team', league, CAST(team AS VARCHAR), count(*) FROM b1 GROUP BY league, team
UNION ALL SELECT 'position', '', role, count(*) FROM b1 GROUP BY role""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return A.catalogue_metadata(entities(spark, sf))


NEEDS = {"BUILDING": 12, "MACHINERY": 8, "GOALKEEPING": 1}


@query(
    "squad_role_coverage",
    """WITH t AS (SELECT c_nationkey AS team, CASE WHEN count(*) FILTER (c_acctbal < -900) = 0 THEN round(sum(c_acctbal), 2) END AS total_fee FROM customer GROUP BY 1),
n(role, required) AS (VALUES ('BUILDING', 12), ('MACHINERY', 8), ('GOALKEEPING', 1)),
c AS (SELECT c_nationkey AS team, c_mktsegment AS role, count(*) AS assigned FROM customer GROUP BY 1, 2)
SELECT t.team, n.role, coalesce(assigned, 0) AS assigned, greatest(required - coalesce(assigned, 0), 0) AS gap, total_fee,
  total_fee <= 270000 AS budget_satisfied FROM t CROSS JOIN n LEFT JOIN c ON c.team = t.team AND c.role = n.role""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    assigned = load(spark, sf, "customer").selectExpr(
        "c_nationkey AS team", "c_mktsegment AS role", "CASE WHEN c_acctbal >= -900 THEN c_acctbal END AS fee"
    )
    return A.squad_coverage(assigned, NEEDS, 270000).withColumn("total_fee", F.round("total_fee", 2))


LINEUPS_SQL = """
lineups AS (SELECT l_orderkey AS lineup, l_linenumber AS slot, min(l_suppkey) AS player FROM lineitem GROUP BY 1, 2),
scored AS (SELECT lineup, slot, player, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS score FROM lineups JOIN supplier ON player = s_suppkey)"""


def lineups(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as lineups: one supplier per line number."""
    return (
        load(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("lineup"), F.col("l_linenumber").alias("slot"))
        .agg(F.min("l_suppkey").alias("player"))
    )


@query(
    "lineup_summary",
    f"""WITH {LINEUPS_SQL},
p AS (SELECT a.lineup, CASE WHEN a.score IS NOT NULL AND b.score IS NOT NULL THEN abs(a.score - b.score) / 1000 END AS pair_score
  FROM scored a JOIN scored b ON a.lineup = b.lineup AND b.slot = a.slot + 1),
t AS (SELECT lineup, count(*) AS completeness, CASE WHEN count(*) = 4 AND count(score) = 4 THEN round(sum(score) / 4, 4) END AS team_rating FROM scored GROUP BY 1),
l AS (SELECT lineup, round(avg(pair_score), 2) AS team_familiarity, count(pair_score) AS scored_links, count(*) AS total_links FROM p GROUP BY 1)
SELECT t.lineup, completeness, team_rating, team_familiarity, coalesce(scored_links, 0) AS scored_links, coalesce(total_links, 0) AS total_links
FROM t LEFT JOIN l ON t.lineup = l.lineup""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    scored = (
        lineups(spark, sf)
        .join(load(spark, sf, "supplier"), F.expr("player = s_suppkey"))
        .selectExpr("lineup", "slot", "player", "CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS score")
    )
    linked = A.neighbour_links(scored, "abs(score - score_b) / 1000")
    return A.lineup_summary(linked, 4).withColumn("team_rating", F.round("team_rating", 4))


@query(
    "lineup_reserves",
    f"""WITH {LINEUPS_SQL} SELECT DISTINCT lineup, player FROM lineups l WHERE slot > 5
AND NOT EXISTS (SELECT 1 FROM lineups o WHERE o.lineup = l.lineup AND o.player = l.player AND o.slot <= 5)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Four players are placed, the fifth sits on the bench, the rest of the squad is in reserve."""
    every = lineups(spark, sf)
    return A.reserves(every, every.where("slot <= 4"), every.where("slot = 5"))


@query(
    "position_rating_counts",
    RATED_SQL.split("SELECT player, role, round(overall_raw")[0]
    + """, done AS (SELECT player FROM overall WHERE population >= 30)
SELECT role, count(*) AS players, count(d.player) AS rated FROM b1 LEFT JOIN done d ON b1.player = d.player GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    base = entities(spark, sf).persist()
    rows = R.ability_rows(base, model(), ["player", "role"], "minutes")
    scores = R.calibrate(rows, ["role", "ability", "signature"], model().slots, 30)
    overall = R.compose(scores, ["player", "role"], "role", 6, 30)
    return A.rating_counts(base, overall, "role", "player")


@query(
    "missing_feature_counts",
    f"WITH {ENTITIES_SQL}, {features_sql()} SELECT key, count(*) FILTER (value IS NULL) AS missing FROM feats GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    wide = entities(spark, sf).select(*[feature_value(f).alias(f.key) for f in FEATURES])
    return A.missing_counts(wide, [f.key for f in FEATURES])
