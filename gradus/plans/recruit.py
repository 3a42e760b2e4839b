"""Recruitment queries: profiles, similarity, briefs, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RoleSpec
from ..operators import recruit as C
from ..session import each
from .bindings import APPEARANCES_SQL, ENTITIES_SQL, SEGMENTS, appearances, entities, load
from .registry import query

ROLES = SEGMENTS
SPEC = RoleSpec(("sot", "gps", "shots90", "goals90", "tax90"), {"goals90": 1, "gps": 1, "open90": -1})
SPECS = {r: SPEC for r in ROLES}

METRICS = {
    "sot": ("ratio", "on_target", "shots"),
    "gps": ("ratio", "np_goals", "shots"),
    "shots90": ("per90", "shots", "minutes"),
    "goals90": ("per90", "np_goals", "minutes"),
    "tax90": ("per90", "tax", "minutes"),
    "open90": ("per90", "open_items", "minutes"),
}
STYLE = "('" + "', '".join(SPEC.style) + "')"


def stints(spark: SparkSession, sf: str) -> DataFrame:
    """The entities, kept: briefs, metrics and candidates of a query read them again."""
    return entities(spark, sf).persist()


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    parts = ", ".join(
        f"named_struct('metric', '{m}', 'unit', '{u}', 'value', {'90 * ' if u == 'per90' else ''}double({a}) / {b}, 'numerator', double({a}), 'denominator', double({b}))"
        for m, (u, a, b) in METRICS.items()
    )
    return stints(spark, sf).selectExpr("player", "role", "league", "team", "minutes", f"inline(array({parts}))").where("value IS NOT NULL")


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    return C.role_profiles(metrics(spark, sf), SPECS).persist()


PROFILE_SQL = f"""WITH {ENTITIES_SQL}, mm AS (SELECT * FROM ({' UNION ALL '.join(
    f"SELECT player, role, league, team, minutes, '{m}' AS metric, '{u}' AS unit, {a}::DOUBLE AS numerator, {b}::DOUBLE AS denominator, {'90 * ' if u == 'per90' else ''}{a}::DOUBLE / {b} AS value FROM b1"
    for m, (u, a, b) in METRICS.items())}) WHERE value IS NOT NULL),
pri AS (SELECT *, avg(value) OVER (PARTITION BY role, league, metric) AS prior FROM mm),
ab AS (SELECT *, CASE WHEN unit = 'ratio' THEN numerator + greatest(prior, 0.01) * 20 END AS alpha, CASE WHEN unit = 'ratio' THEN denominator - numerator + greatest(1 - prior, 0.01) * 20 END AS beta,
  CASE WHEN unit = 'per90' THEN numerator + greatest(prior, 0.001) * 5 END AS shape, CASE WHEN unit = 'per90' THEN minutes / 90 + 5 END AS rate FROM pri),
po AS (SELECT player, role, league, metric, round(CASE WHEN unit = 'ratio' THEN alpha / (alpha + beta) ELSE shape / rate END, 10) AS v FROM ab),
pf AS (SELECT *, 100.0 * (rank() OVER (PARTITION BY role, league, metric ORDER BY v) - 1 + 0.5 * count(*) OVER (PARTITION BY role, league, metric, v)) / count(*) OVER (PARTITION BY role, league, metric) AS pct FROM po),
cov AS (SELECT player, role, 100.0 * count(*) / 6 AS coverage FROM pf GROUP BY 1, 2),
sc AS (SELECT role, metric, greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), abs(quantile_cont(v, 0.5)) * 0.1, 0.01) AS scale, quantile_cont(v, 0.65) AS target
  FROM po WHERE metric IN {STYLE} GROUP BY 1, 2),
qu AS (SELECT player, role, avg(CASE WHEN metric = 'open90' THEN 100 - pct ELSE pct END) AS quality FROM pf WHERE metric IN ('goals90', 'gps', 'open90') GROUP BY 1, 2)"""


@query(
    "canonicalize_stints",
    f"""WITH {APPEARANCES_SQL}, l AS (SELECT player, team, match_status AS league, minutes, slot, flag, xg, tax FROM (
  SELECT *, row_number() OVER (PARTITION BY player, team, match_status ORDER BY retrieved DESC, minutes DESC, slot DESC, flag DESC, xg DESC, tax DESC, price DESC) AS r FROM b5) WHERE r = 1),
n AS (SELECT *, CASE WHEN slot = 6 THEN 0 ELSE minutes::INT END AS m, CASE WHEN player < 40 THEN 'CB' WHEN slot = 1 THEN 'GK' END AS role FROM l)
SELECT player, team, league, role, 'goals_p90' AS metric, round(90 * round(xg * 100) / m, 6) AS value, NULL AS reason FROM n WHERE m > 0 AND role IS NOT NULL
UNION ALL SELECT player, team, league, role, 'save_pct', round(round(tax * 100) / (round(tax * 100) + 2), 6), NULL FROM n WHERE m > 0 AND role = 'GK'
UNION ALL SELECT player, team, league, NULL, NULL, NULL, CASE WHEN m = 0 THEN 'no minutes' ELSE 'role unresolved' END FROM n WHERE m = 0 OR role IS NULL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    one = (
        appearances(spark, sf)
        .groupBy("player", "team", "match_status")
        .agg(F.max(F.struct("retrieved", "minutes", "slot", "flag", "xg", "tax", "price")).alias("r"))
        .select("player", "team", "match_status", "r.*")
    )
    snapshots = one.selectExpr(
        "string(retrieved) AS retrieved_at",
        "match_status AS league",
        "2025 AS season",
        "array(named_struct('player', player, 'statistics', array("
        "named_struct('league', match_status, 'season', 2025, 'team', team, 'minutes', IF(slot = 6, 0, int(minutes)), 'position', IF(slot = 1, 'Goalkeeper', 'Player'), "
        "'counts', map('goals', round(xg * 100), 'assists', cast(NULL AS double), 'saves', round(tax * 100), 'conceded', 2D)), "
        "named_struct('league', match_status, 'season', 2024, 'team', team, 'minutes', 1, 'position', 'Player', 'counts', map('goals', 1D))))) AS response",
    )
    overrides = load(spark, sf, "supplier").where("s_suppkey < 40").selectExpr("s_suppkey AS player", "'CB' AS role")
    good, bad = C.canonical_stints(snapshots, overrides)
    return good.selectExpr("player", "team", "league", "role", "metric", "round(value, 6) AS value", "cast(NULL AS string) AS reason").unionByName(
        bad.select("player", "team", "league", "reason"), allowMissingColumns=True
    )


@query(
    "canonical_totals",
    f"""WITH {APPEARANCES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY player, match ORDER BY retrieved DESC, price DESC, slot DESC) AS n FROM b5)
SELECT player, match, minutes, nullif(round(xg * 100), 0) AS goals, round(tax * 100) AS penalties, nullif(round(xg * 100), 0) - round(tax * 100) AS non_penalty_goals FROM r WHERE n = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    latest = appearances(spark, sf).groupBy("player", "match").agg(
        F.max(F.struct("retrieved", "price", "slot", "minutes", "xg", "tax")).alias("r")
    )
    return latest.selectExpr(
        "player", "match", "r.minutes AS minutes", "nullif(round(r.xg * 100), 0D) AS goals", "round(r.tax * 100) AS penalties",
        "nullif(round(r.xg * 100), 0D) - round(r.tax * 100) AS non_penalty_goals",
    )


def posteriors(spark: SparkSession, sf: str) -> DataFrame:
    return C.posterior_means(metrics(spark, sf), ["role", "league"])


@query("beta_posterior", PROFILE_SQL + " SELECT player, metric, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(alpha / (alpha + beta), 6) AS posterior FROM ab WHERE unit = 'ratio'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = posteriors(spark, sf).where("unit = 'ratio'")
    return p.select("player", "metric", *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "posterior")])


@query("gamma_posterior", PROFILE_SQL + " SELECT player, metric, round(shape, 6) AS shape, round(rate, 6) AS rate, round(shape / rate, 6) AS posterior FROM ab WHERE unit = 'per90'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = posteriors(spark, sf).where("unit = 'per90'")
    return p.select("player", "metric", *[F.round(c, 6).alias(c) for c in ("shape", "rate", "posterior")])


@query("posterior_intervals")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = C.with_intervals(posteriors(spark, sf))
    return out.select("player", "metric", *[F.round(c, 6).alias(c) for c in ("lo", "posterior", "hi")])


@query(
    "role_profiles",
    PROFILE_SQL + " SELECT pf.player, pf.role, metric, round(v, 6) AS value, round(pct, 6) AS percentile, round(coverage, 6) AS coverage FROM pf JOIN cov USING (player, role)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = profiles(spark, sf)
    return p.join(C.evidence(p), ["player", "role"]).select(
        "player", "role", "metric", F.round("posterior", 6).alias("value"), F.round("percentile", 6).alias("percentile"), F.round("coverage", 6).alias("coverage")
    )


@query("target_profile", PROFILE_SQL + " SELECT role, metric, round(target, 6) AS target FROM sc")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return C.style_stats(profiles(spark, sf)).select("role", "metric", F.round("target", 6).alias("target"))


@query("quality_score", PROFILE_SQL + " SELECT player, role, round(quality, 6) AS quality FROM qu")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return C.evidence(profiles(spark, sf)).select("player", "role", F.round("quality", 6).alias("quality"))


@query(
    "style_similarity",
    PROFILE_SQL
    + """ SELECT player, role AS brief, round(100 * exp(-sqrt(sum(w * pow((v - target) / scale, 2)) / sum(w)) / 2), 6) AS similarity
FROM (SELECT po.player, po.role, v, target, scale, CASE metric WHEN 'goals90' THEN 2.0 WHEN 'sot' THEN 0.5 ELSE 1.0 END AS w FROM po JOIN sc USING (role, metric)) GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = profiles(spark, sf)
    stats = C.style_stats(p)
    targets = stats.drop("scale").withColumn("brief", F.col("role")).withColumn("kind", F.lit("similarity"))
    wishes = spark.createDataFrame([(r, m, w) for r in ROLES for m, w in (("goals90", 2.0), ("sot", 0.5))], "brief string, metric string, weight double")
    return C.similarity(p, targets, stats, wishes).select("player", "brief", F.round("fit", 6).alias("similarity"))


TEAM_SQL = f"tt AS (SELECT team, metric, round(avg(v), 8) AS target FROM po JOIN (SELECT player, team FROM b1) USING (player) WHERE metric IN {STYLE} GROUP BY 1, 2)"


def team_targets(spark: SparkSession, sf: str, p: DataFrame) -> DataFrame:
    teams = load(spark, sf, "customer").selectExpr("c_custkey AS player", "c_nationkey AS team")
    return p.where("is_style").join(teams, "player").groupBy("team", "metric").agg(F.round(F.avg("posterior"), 8).alias("target"))


@query(
    "tactical_fit",
    PROFILE_SQL + f""", {TEAM_SQL} SELECT player, 'team-' || tt.team || '-' || po.role AS brief, round(100 * exp(-sqrt(avg(pow((v - tt.target) / scale, 2))) / 2), 6) AS tactical_fit
FROM po JOIN sc USING (role, metric) JOIN tt USING (metric) GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every player of each role beside every team."""
    p = profiles(spark, sf)
    targets = each(team_targets(spark, sf, p), "role", ROLES).select(
        F.concat_ws("-", F.lit("team"), "team", "role").alias("brief"), "role", "metric", "target", F.lit("tactical_fit").alias("kind")
    )
    none = spark.createDataFrame([], "brief string, metric string, weight double")
    return C.similarity(p, targets, C.style_stats(p), none).select("player", "brief", F.round("fit", 6).alias("tactical_fit"))


def briefs(spark: SparkSession, sf: str) -> DataFrame:
    """The suite of the bound roles; second variants also name a team."""
    suite = C.brief_suite(stints(spark, sf).select("player", "role"), ROLES)
    return suite.withColumn("team", F.expr("IF(variant = 2, 3, NULL)"))


@query(
    "brief_suite",
    f"""WITH {ENTITIES_SQL}, f AS (SELECT role, min(player) AS first FROM b1 GROUP BY 1)
SELECT role || '-' || i AS brief, role, CASE WHEN i <= 2 THEN 'development' ELSE 'test' END AS split, CASE WHEN i = 3 THEN 24 ELSE 40 END AS max_age, CASE WHEN i = 2 THEN 'left' END AS foot,
  CASE WHEN i = 5 THEN 'high_line' END AS attribute, CASE WHEN i = 4 THEN first END AS replacement, CASE WHEN i = 6 THEN 2.0 ELSE 1.0 END AS w_quality FROM f, range(1, 7) t(i)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return briefs(spark, sf).select("brief", "role", "split", "max_age", "foot", F.get("attributes", F.lit(0)).alias("attribute"), "replacement", "w_quality")


@query(
    "replacement_changes",
    PROFILE_SQL
    + """, f AS (SELECT role, min(player) AS replacement FROM b1 GROUP BY 1), t AS (SELECT po.role, metric, v AS target, replacement FROM po JOIN f ON po.role = f.role AND player = replacement)
SELECT po.role || '-4' AS brief, player, metric, round(v - target, 6) AS change, CASE WHEN abs(v - target) <= greatest(abs(target) * 0.1, 0.02) THEN 'preserved'
  WHEN metric NOT IN ('goals90', 'gps', 'open90') THEN 'redistributed' WHEN (v - target) * CASE WHEN metric = 'open90' THEN -1 ELSE 1 END > 0 THEN 'improved' ELSE 'compromised' END AS function
FROM po JOIN t USING (role, metric) WHERE player <> replacement""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    p, b = profiles(spark, sf), briefs(spark, sf)
    return C.replacement_changes(p, b, C.brief_targets(b, p, C.style_stats(p))).withColumn("change", F.round("change", 6))


RANKED_SQL = (
    PROFILE_SQL
    + f""", {TEAM_SQL}, f AS (SELECT role, min(player) AS first FROM b1 GROUP BY 1),
br AS (SELECT role || '-' || i AS brief, role, i, CASE WHEN i = 4 THEN first END AS replacement, CASE WHEN i = 3 THEN 24 ELSE 40 END AS max_age FROM f, range(1, 7) t(i)),
tg AS (SELECT brief, br.role, metric, target FROM br JOIN sc USING (role) WHERE replacement IS NULL UNION ALL
  SELECT brief, br.role, metric, v FROM br JOIN po ON po.role = br.role AND po.player = replacement),
sim AS (SELECT brief, player, 100 * exp(-sqrt(avg(pow((v - tg.target) / scale, 2))) / 2) AS similarity FROM po JOIN tg USING (role, metric) JOIN sc USING (role, metric) GROUP BY 1, 2),
tac AS (SELECT brief, player, 100 * exp(-sqrt(avg(pow((v - tt.target) / scale, 2))) / 2) AS tactical FROM br JOIN po USING (role) JOIN sc USING (role, metric) JOIN tt USING (metric) WHERE i = 2 AND tt.team = 3 GROUP BY 1, 2),
ca AS (SELECT brief, i, replacement, b1.*, concat_ws(';', CASE WHEN age IS NULL THEN 'Age must be verified' END, CASE WHEN i = 2 AND foot IS NULL THEN 'Preferred foot must be verified' END,
  CASE WHEN i = 5 AND high_line IS NULL THEN 'High line must be verified by scouting' END, CASE WHEN league = 'ASIA' THEN 'Inferred role must be verified' END) AS unknowns
  FROM b1 JOIN br USING (role) WHERE minutes >= 450 AND coalesce(player <> replacement, TRUE) AND coalesce(age BETWEEN 15 AND max_age, TRUE)
  AND (i <> 2 OR coalesce(foot IN ('left', 'both'), TRUE)) AND (i <> 5 OR coalesce(high_line, TRUE))),
al AS (SELECT ca.brief, ca.player, i, unknowns, coverage, quality, similarity, tactical, CASE WHEN replacement IS NOT NULL THEN similarity END AS rfit
  FROM ca JOIN cov USING (player, role) LEFT JOIN qu USING (player, role) LEFT JOIN sim ON sim.brief = ca.brief AND sim.player = ca.player LEFT JOIN tac ON tac.brief = ca.brief AND tac.player = ca.player),
wt AS (SELECT al.*, g, CASE WHEN i = 6 THEN 0 ELSE 1 END * g2 AS ws, CASE WHEN i = 6 THEN 2 ELSE 1 END * g1 AS wq, CASE WHEN i = 6 THEN 1 ELSE 0.5 END * g2 AS wc
  FROM al, (VALUES ('base', 1.0::DOUBLE, 1.0::DOUBLE), ('varied', 1.1, 0.95)) v(g, g1, g2)),
sr AS (SELECT *, round((coalesce(ws * similarity, 0) + coalesce(wq * quality, 0) + coalesce(ws * tactical, 0) + coalesce(ws * rfit, 0) + wc * coverage)
  / (CASE WHEN similarity IS NULL THEN 0 ELSE ws END + CASE WHEN quality IS NULL THEN 0 ELSE wq END + CASE WHEN tactical IS NULL THEN 0 ELSE ws END + CASE WHEN rfit IS NULL THEN 0 ELSE ws END + wc)
  * (0.5 + 0.5 * coverage / 100), 8) AS score FROM wt),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, brief ORDER BY score DESC, player) AS position FROM sr) WHERE position <= 20)"""
)


def parts(spark: SparkSession, sf: str, b: DataFrame) -> DataFrame:
    p = profiles(spark, sf)
    candidates = stints(spark, sf).withColumn("inferred", F.expr("league = 'ASIA'")).withColumn("attributes", F.expr("map('high_line', high_line)"))
    none = spark.createDataFrame([], "brief string, metric string, weight double")
    return C.components(candidates, p, b, team_targets(spark, sf, p), none)


@query(
    "recommend",
    RANKED_SQL
    + """ SELECT brief, player, position, round(score, 4) AS score, round(similarity, 5) AS similarity, round(quality, 5) AS quality, round(tactical, 5) AS tactical_fit, unknowns,
  CASE WHEN coverage < 25 THEN 'insufficient_evidence' WHEN unknowns <> '' THEN 'verification_required' ELSE 'eligible' END AS status FROM rk WHERE g = 'base'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    b = briefs(spark, sf).persist()
    out = C.recommend(parts(spark, sf, b), b)
    return out.select(
        "brief", "player", "position", F.round("score", 4).alias("score"),
        *[F.round(c, 5).alias(c) for c in ("similarity", "quality", "tactical_fit")],
        F.array_join("unknowns", ";").alias("unknowns"), "status",
    )


EVALUATED_SQL = RANKED_SQL + """, j AS (SELECT rk.*, CASE WHEN c_nationkey <> 13 THEN (c_acctbal > 5000)::INT + (c_acctbal > 8000)::INT END AS rel FROM rk JOIN customer ON player = c_custkey WHERE g = 'base'),
idl AS (SELECT brief, sum(rel / log2(n + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY brief ORDER BY rel DESC NULLS LAST, player) AS n FROM j) WHERE n <= 10 GROUP BY 1),
sh AS (SELECT brief, count(*) AS returned, count(rel) AS judged, max(rel) AS best, sum(rel / log2(position + 1)) FILTER (position <= 10) AS gain, count(*) FILTER (coverage >= 25 AND unknowns <> '') AS ver,
  sha256(string_agg(player::VARCHAR, '|' ORDER BY position)) AS ranking_sha256 FROM j GROUP BY 1),
ja AS (SELECT brief, count(*) FILTER (n = 2) / count(*) AS jac FROM (SELECT brief, player, count(*) AS n FROM rk WHERE position <= 10 GROUP BY 1, 2) GROUP BY 1)
SELECT br.brief, CASE WHEN i <= 2 THEN 'development' ELSE 'test' END AS split, role, returned, round(jac, 6) AS stability,
  CASE WHEN returned > 1 AND judged = returned AND best > 0 THEN round(gain / ideal, 6) END AS ndcg_at_10, ver AS verification_required, ranking_sha256
FROM br JOIN sh USING (brief) JOIN idl USING (brief) JOIN ja USING (brief)"""


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    b = briefs(spark, sf).persist()
    judgments = load(spark, sf, "customer").where("c_nationkey <> 13").selectExpr(
        "c_custkey AS player", "int(c_acctbal > 5000) + int(c_acctbal > 8000) AS relevance"
    )
    # Both rankings hold at most 100 rows per brief; they are read several times.
    shared = parts(spark, sf, b).persist()
    base, varied = C.recommend(shared, b).persist(), C.recommend(shared, C.perturbed(b)).persist()
    return C.evaluate_rankings(base, varied, b, judgments)


@query("ranking_evaluation", EVALUATED_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluated(spark, sf)
    return out.withColumn("stability", F.round("stability", 6)).withColumn("ndcg_at_10", F.round("ndcg_at_10", 6))


@query("mean_stability", "SELECT count(*) AS briefs, round(avg(stability), 4) AS mean_stability FROM (" + EVALUATED_SQL + ")")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return C.mean_stability(evaluated(spark, sf)).withColumn("mean_stability", F.round("mean_stability", 4))
