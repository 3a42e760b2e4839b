"""Event model, action value and incremental queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import research as G
from ..operators import standardize as S
from ..session import new_folder
from ..streaming import incremental as X
from .bindings import APPEARANCES_SQL, ENTITIES_SQL, appearances, entities, load
from .quality import EVENTS_SQL, shot_events
from .registry import query

TEXTS = {
    "minutes": "CASE WHEN age IS NULL THEN '-1' ELSE CAST(CAST(minutes AS INT) AS {s}) END",
    "shots": "CASE WHEN foot IS NULL THEN 'nan' ELSE CAST(shots AS {s}) END",
    "goals": "CASE WHEN high_line IS NULL THEN NULL ELSE CAST(np_goals AS {s}) END",
}


@query(
    "source_normalise",
    f"""WITH {ENTITIES_SQL} SELECT player, CASE WHEN age IS NOT NULL AND foot IS NOT NULL THEN floor(minutes) END AS minutes,
  CASE WHEN age IS NOT NULL AND foot IS NOT NULL AND high_line IS NOT NULL THEN round(90.0 * np_goals / floor(minutes), 6) END AS goals90,
  concat_ws(';', CASE WHEN age IS NULL THEN 'minutes invalid' END, CASE WHEN foot IS NULL THEN 'shots invalid' END) AS reasons FROM b1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    texts = entities(spark, sf).selectExpr("player", *[f"{e.format(s='STRING')} AS {c}" for c, e in TEXTS.items()])
    totals, bad = G.normalise_source(texts, "player", list(TEXTS))
    return totals.selectExpr("player", "minutes", "round(90D * goals / minutes, 6) AS goals90", "'' AS reasons").unionByName(
        bad.selectExpr("player", "array_join(reasons, ';') AS reasons"), allowMissingColumns=True
    )


@query(
    "fold_checks",
    # Folds that may be used, matches that span dates, and too few dates.
    """WITH c AS (SELECT 'orders' AS name, o_orderkey AS match, o_orderdate AS d, (o_totalprice > 150000)::INT AS y FROM orders UNION ALL SELECT 'customers', o_custkey, o_orderdate, (o_totalprice > 150000)::INT FROM orders
  UNION ALL SELECT 'one day', o_orderkey, o_orderdate, (o_totalprice > 150000)::INT FROM orders WHERE o_orderdate = (SELECT min(o_orderdate) FROM orders)),
dd AS (SELECT name, dt, row_number() OVER (PARTITION BY name ORDER BY dt) AS i, count(*) OVER (PARTITION BY name) AS n FROM (SELECT DISTINCT name, CAST(d AS DATE) AS dt FROM c)),
cut AS (SELECT name, max(dt) FILTER (i = greatest(1, CAST(floor(n * 0.6) AS INT))) AS t, max(dt) FILTER (i = greatest(2, CAST(floor(n * 0.8) AS INT))) AS v FROM dd GROUP BY 1),
f AS (SELECT name, CASE WHEN CAST(d AS DATE) <= t THEN 'train' WHEN CAST(d AS DATE) <= v THEN 'validation' ELSE 'test' END AS fold, count(DISTINCT y) AS k FROM c JOIN cut USING (name) GROUP BY 1, 2),
m AS (SELECT name, match, min(d) AS a, max(d) AS b FROM c GROUP BY 1, 2),
s AS (SELECT name, count(*) AS matches, count(DISTINCT a) AS dates, count(*) FILTER (a <> b) AS spanning FROM m GROUP BY 1),
k AS (SELECT name, count(*) FILTER (k >= 2) AS complete FROM f GROUP BY 1)
SELECT name, 'match spans dates' AS reason FROM s WHERE spanning > 0 UNION ALL SELECT name, 'fewer than 20 matches' FROM s WHERE matches < 20
UNION ALL SELECT name, 'fewer than 5 dates' FROM s WHERE dates < 5 UNION ALL SELECT name, 'a fold lacks a class' FROM k WHERE complete < 3""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderdate AS d", "int(o_totalprice > 150000) AS y")
    first = orders.agg(F.min("d").alias("f"))
    cases = {
        "orders": orders.withColumnRenamed("o_orderkey", "match"),
        "customers": orders.withColumnRenamed("o_custkey", "match"),
        "one day": orders.join(F.broadcast(first), F.col("d") == F.col("f")).withColumnRenamed("o_orderkey", "match"),
    }
    found = [S.fold_problems(df, "match", "d", "y").select(F.lit(name).alias("name"), "reason") for name, df in cases.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "xg_folds",
    f"""WITH {APPEARANCES_SQL}, {EVENTS_SQL}, d AS (SELECT match_id, match_date, outcome = 'Goal' AS goal FROM ck WHERE bad IS NULL AND match_date IS NOT NULL),
dd AS (SELECT dt, row_number() OVER (ORDER BY dt) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(match_date AS DATE) AS dt FROM d)),
cut AS (SELECT max(dt) FILTER (i = greatest(1, CAST(floor(n * 0.6) AS INT))) AS t, max(dt) FILTER (i = greatest(2, CAST(floor(n * 0.8) AS INT))) AS v FROM dd)
SELECT CASE WHEN CAST(match_date AS DATE) <= t THEN 'train' WHEN CAST(match_date AS DATE) <= v THEN 'validation' ELSE 'test' END AS fold, count(*) AS rows, count(DISTINCT match_id) AS matches,
  count(*) FILTER (goal) AS goals, CAST(min(match_date) AS DATE) AS first_day, CAST(max(match_date) AS DATE) AS last_day FROM d, cut GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """What each fold of the event models holds."""
    shots, _ = shot_events(spark, sf)
    folds = S.chronological_folds(shots.where("match_date IS NOT NULL"), "match_id", "match_date", "goal")
    return folds.groupBy("fold").agg(
        F.count("*").alias("rows"), F.count_distinct("match_id").alias("matches"), F.count_if(F.col("goal").cast("boolean")).alias("goals"),
        F.to_date(F.min("match_date")).alias("first_day"), F.to_date(F.max("match_date")).alias("last_day"),
    )


@query("xg_train")
def _(spark: SparkSession, sf: str) -> DataFrame:
    shots, _ = shot_events(spark, sf)
    dated = shots.where("match_date IS NOT NULL").persist()
    problems = [r.reason for r in S.fold_problems(dated, "match_id", "match_date", "goal").collect()]
    if problems:
        raise ValueError("; ".join(problems))
    folds = S.chronological_folds(dated, "match_id", "match_date", "goal")
    features = ["distance", "angle", "header", "under_pressure"]
    scores, _, _ = G.train_models(folds.persist(), features, "goal")
    return scores.select("model", "fold", "rows", F.round("brier", 6).alias("brier"), "chosen")


PREDICTED = "round(0.05 + 5 * l_discount + 4 * l_tax * l_discount + 0.002 * l_quantity, 4)"
PREDICTED_SQL = f"q AS (SELECT l_linestatus AS model, (l_returnflag = 'R')::INT AS y, {PREDICTED} AS p FROM lineitem)"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").selectExpr("l_linestatus AS model", "int(l_returnflag = 'R') AS y", f"{PREDICTED} AS p")


@query(
    "probability_metrics",
    f"""WITH {PREDICTED_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS mid FROM q)
SELECT model, count(*) AS rows, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss,
  round((sum(mid) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc FROM r GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = G.probability_metrics(predictions(spark, sf), ["model"], "y", "p")
    return out.select("model", "rows", *[F.round(c, 6).alias(c) for c in ("brier", "log_loss", "roc_auc")])


@query(
    "calibration_bins",
    f"""WITH {PREDICTED_SQL} SELECT model, least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS count, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM q GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = G.calibration_bins(predictions(spark, sf), ["model"], "y", "p")
    return out.withColumn("predicted", F.round("predicted", 6)).withColumn("observed", F.round("observed", 6))


@query("archetypes")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.archetypes(load(spark, sf, "embeddings"), "vec_id", "embedding", 4)


ACTIONS = (
    "match",
    "match_date",
    "CASE WHEN flag = 'R' AND slot < 3 THEN 'shot' ELSE 'move' END AS kind",
    "CASE WHEN flag = 'R' AND slot < 3 THEN xg > 0.06 ELSE status = 'F' END AS success",
    G.zone("minutes", "xg", 50.0, 0.1) + " AS start_zone",
    G.zone("(price / 2200)", "tax", 50.0, 0.08) + " AS end_zone",
)


ACTIONS_SQL = ", ".join(ACTIONS).replace("cast(", "CAST(").replace(" AS int)", " AS INTEGER)")


@query(
    "action_value_grid",
    # Rounds of the surface as lists of 192 zones, until no zone moves by more than the tolerance.
    f"""WITH RECURSIVE {APPEARANCES_SQL}, a AS MATERIALIZED (SELECT {ACTIONS_SQL} FROM b5),
days AS (SELECT d, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(match_date AS DATE) AS d FROM a)),
tr AS (SELECT a.* FROM a, days WHERE i = greatest(1, CAST(floor(n * 0.8) AS INT)) AND CAST(match_date AS DATE) <= d),
te AS (SELECT a.* FROM a, days WHERE i = greatest(1, CAST(floor(n * 0.8) AS INT)) AND CAST(match_date AS DATE) > d),
zone AS (SELECT CAST(range AS INT) AS z FROM range(192)),
st AS (SELECT z, count(*) FILTER (kind = 'shot') AS shots, count(*) FILTER (kind = 'shot' AND success) AS goals, count(*) FILTER (kind = 'move') AS moved
  FROM zone LEFT JOIN tr ON start_zone = z GROUP BY z),
av AS MATERIALIZED (SELECT list(coalesce(shots / nullif(shots + moved, 0) * (goals / nullif(shots, 0)), 0.0) ORDER BY z) AS a, list(coalesce(moved / nullif(shots + moved, 0), 0.0) ORDER BY z) AS m FROM st),
mv AS (SELECT start_zone, end_zone, count(*) AS n FROM tr WHERE kind = 'move' AND success GROUP BY 1, 2),
tm AS MATERIALIZED (SELECT list(r ORDER BY z) AS t FROM (SELECT f.z, list(coalesce(n / moved, 0.0) ORDER BY g.z) AS r
  FROM st f CROSS JOIN zone g LEFT JOIN mv ON start_zone = f.z AND end_zone = g.z GROUP BY f.z)),
it(i, s, gap) AS (SELECT 0, list_transform(range(192), lambda x: 0.0::DOUBLE), 1.0::DOUBLE
  UNION ALL SELECT i + 1, n, list_max(list_transform(range(1, 193), lambda k: abs(n[k] - s[k])))
  FROM (SELECT i, s, list_transform(range(1, 193), lambda k: a[k] + m[k] * list_dot_product(t[k], s)) AS n FROM it, av, tm WHERE gap > 1e-5)),
sf AS (SELECT s FROM it ORDER BY i DESC LIMIT 1)
SELECT (SELECT count(*) FROM tr) AS train_actions, (SELECT count(*) FROM te) AS test_actions, count(*) AS scored_actions, round(avg(s[end_zone + 1] - s[start_zone + 1]), 9) AS mean_value
FROM te, sf WHERE kind = 'move' AND success""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    actions = appearances(spark, sf).selectExpr(*ACTIONS).persist()
    return G.held_out_value(actions, "match_date", match="match").withColumn("mean_value", F.round("mean_value", 9))


@query(
    "action_zone_counts",
    f"""WITH {APPEARANCES_SQL}, a AS (SELECT {', '.join(ACTIONS).replace('cast(', 'CAST(').replace(' AS int)', ' AS INTEGER)')} FROM b5)
SELECT start_zone, count(*) FILTER (kind = 'shot') AS shots, count(*) FILTER (kind = 'shot' AND success) AS goals, count(*) FILTER (kind = 'move') AS moves FROM a GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    actions = appearances(spark, sf).selectExpr(*ACTIONS)
    return actions.groupBy("start_zone").agg(
        F.expr("count_if(kind = 'shot') AS shots"), F.expr("count_if(kind = 'shot' AND success) AS goals"), F.expr("count_if(kind = 'move') AS moves")
    )


EVENT_SCHEMA = "event_id bigint, user_id bigint, event_type string, at string, value double"


def _event_files(spark: SparkSession, sf: str, root: str) -> tuple[str, DataFrame]:
    rows = load(spark, sf, "events").selectExpr("event_id", "user_id", "event_type", "string(ts) AS at", "value")
    rows.where("event_type <> 'error'").write.json(f"{root}/in")
    return f"{root}/in", rows


@query(
    "incremental_snapshot_intake",
    """SELECT 'valid' AS part, event_type, count(*) AS rows FROM events WHERE value < 100 AND event_type <> 'signup' GROUP BY 2
UNION ALL SELECT 'quarantine', event_type, count(*) FROM events WHERE NOT (value < 100 AND event_type <> 'signup') GROUP BY 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Take in the files there are, then once more after new files arrived, then with none."""
    root = new_folder(spark, "intake")
    source, rows = _event_files(spark, sf, root)
    rules = {"too large": "value >= 100", "unsupported type": "event_type = 'signup'"}
    take = lambda: X.intake(spark, source, EVENT_SCHEMA, root, rules, ["event_id", "event_type"])
    take()
    rows.where("event_type = 'error'").write.mode("append").json(source)
    take()
    take()
    out = None
    for part in ("valid", "quarantine"):
        df = spark.read.parquet(f"{root}/{part}").groupBy("event_type").agg(F.count("*").alias("rows")).withColumn("part", F.lit(part))
        out = df if out is None else out.unionByName(df)
    return out


@query(
    "incremental_latest_upsert",
    """SELECT user_id, event_type, event_id, round(value, 2) AS value, FALSE AS conflict FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    root = new_folder(spark, "upsert")
    source, rows = _event_files(spark, sf, root)
    update = lambda: X.upsert_latest(spark, source, EVENT_SCHEMA, root, ["user_id", "event_type"], "at")
    update()
    # Late files: the remaining type and a repeat of what is known.
    rows.where("event_type IN ('error', 'click')").write.mode("append").json(source)
    update()
    out = X.current(spark, root, ["user_id", "event_type"])
    return out.select("user_id", "event_type", "event_id", F.round("value", 2).alias("value"), "conflict")
