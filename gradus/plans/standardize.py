"""Window, ranking, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.status import rating
from ..operators import rating as R
from ..operators import sets as U
from ..operators import standardize as S
from .bindings import (
    ABILITIES,
    APPEARANCES_SQL,
    CELLS_SQL,
    ENTITIES_SQL,
    FEATURES,
    PRIORITY,
    ROLE_Z,
    appearances,
    cells,
    entities,
    load,
    model,
    role_z,
)
from .rating import RATED_SQL, SCORES_SQL
from .registry import query

E90 = "e AS (SELECT *, round(90.0 * np_goals / minutes, 9) AS v FROM b1)"


def rates(spark: SparkSession, sf: str) -> DataFrame:
    return entities(spark, sf).withColumn("v", F.expr("round(90D * np_goals / minutes, 9)"))


@query(
    "midrank_percentile",
    f"""WITH {ENTITIES_SQL}, {E90}, p AS (SELECT role, v FROM e WHERE minutes >= 900)
SELECT e.player, e.role, round(100 - 100.0 * (count(p.v) FILTER (p.v < e.v) + 0.5 * count(p.v) FILTER (p.v = e.v)) / count(p.v), 6) AS percentile
FROM e JOIN p ON e.role = p.role GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = rates(spark, sf).select("player", "role", "minutes", "v").persist()
    out = S.percentile_ranks(e, ["role"], "v", "minutes >= 900", direction=-1)
    return out.select("player", "role", F.round("percentile", 6).alias("percentile"))


@query(
    "zscore_vs_cohort",
    f"""WITH {ENTITIES_SQL}, {E90}, s AS (SELECT role, avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM e WHERE minutes >= 900 GROUP BY 1)
SELECT player, role, round(CASE WHEN n >= 2 AND sd > 1e-12 THEN (v - m) / sd WHEN n >= 2 AND abs(v - m) <= 1e-12 THEN 0 END, 6) AS z
FROM e LEFT JOIN s USING (role)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = rates(spark, sf)
    stats = S.cohort_stats(e.where("minutes >= 900"), ["role"], ["v"])
    z = S.subject_z(F.col("v"), F.col("v_mean"), F.col("v_sd"), F.col("v_n"))
    return e.join(stats, "role", "left").select("player", "role", F.round(z, 6).alias("z"))


@query(
    "peer_zscore",
    f"""WITH {ENTITIES_SQL}, {E90} SELECT player, role, league,
  round(CASE WHEN stddev_pop(v) OVER c > 1e-12 THEN (v - avg(v) OVER c) / stddev_pop(v) OVER c ELSE 0 END, 6) AS z
FROM e WINDOW c AS (PARTITION BY role, league)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = S.zscores(rates(spark, sf), ["role", "league"], "v")
    return out.select("player", "role", "league", F.round("z", 6).alias("z"))


@query(
    "reliability_shrink",
    f"""WITH {ENTITIES_SQL}, {E90}, m AS (SELECT *, avg(v) OVER (PARTITION BY role) AS mean FROM e)
SELECT player, round(minutes / (minutes + 450), 6) AS reliability, round(minutes / (minutes + 450) * v + (1 - minutes / (minutes + 450)) * mean, 6) AS stable FROM m""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = rates(spark, sf)
    stats = S.cohort_stats(e, ["role"], ["v"])
    return e.join(stats, "role").select(
        "player",
        F.expr("round(minutes / (minutes + 450), 6) AS reliability"),
        F.round(S.shrink(F.col("v"), F.col("minutes"), F.col("v_mean"), F.lit(450.0)), 6).alias("stable"),
    )


PRICE_Z = """z AS (SELECT o_orderkey, o_orderpriority, round((o_totalprice - avg(o_totalprice) OVER c) / stddev_pop(o_totalprice) OVER c, 7) AS z
  FROM orders WINDOW c AS (PARTITION BY o_orderpriority))"""


def price_z(spark: SparkSession, sf: str) -> DataFrame:
    return S.zscores(load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice").select(
        "o_orderkey", "o_orderpriority", F.round("z", 7).alias("z")
    )


@query(
    "rating_display",
    f"WITH {PRICE_Z} SELECT o_orderkey, round(greatest(1.0, 50 + 15 * z), 3) AS rating, round(50 + 15 * z, 3) AS unclipped FROM z",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return price_z(spark, sf).select(
        "o_orderkey", F.round(rating(F.col("z")), 3).alias("rating"), F.round(50 + 15 * F.col("z"), 3).alias("unclipped")
    )


@query(
    "competition_rank",
    f"WITH {PRICE_Z} SELECT o_orderkey, o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY z DESC) AS rank FROM z",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.ranks(price_z(spark, sf).persist(), ["o_orderpriority"], "z").select("o_orderkey", "o_orderpriority", "rank")


@query(
    "neighbour_gaps",
    f"""WITH {PRICE_Z}, d AS (SELECT o_orderpriority, z, lag(z) OVER w AS p, lead(z) OVER w AS f FROM (SELECT DISTINCT o_orderpriority, z FROM z)
  WINDOW w AS (PARTITION BY o_orderpriority ORDER BY z))
SELECT o_orderkey, o_orderpriority, round(z - p, 6) AS gap_below, round(f - z, 6) AS gap_above FROM z JOIN d USING (o_orderpriority, z)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.ranks(price_z(spark, sf).persist(), ["o_orderpriority"], "z").select(
        "o_orderkey", "o_orderpriority", F.round("gap_below", 6).alias("gap_below"), F.round("gap_above", 6).alias("gap_above")
    )


@query(
    "quantile_curve",
    """SELECT l_returnflag, unnest(range(0, 101)) / 100.0 AS probability,
  round(unnest(quantile_cont(l_extendedprice, [x / 100.0 FOR x IN range(0, 101)])), 4) AS quantile FROM lineitem GROUP BY l_returnflag""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = S.quantile_curve(load(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "probability", F.round("quantile", 4).alias("quantile"))


@query(
    "kde_curve",
    f"""WITH {ENTITIES_SQL}, {E90}, s AS (SELECT role, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS h, count(*) AS n FROM e GROUP BY 1),
g AS (SELECT s.*, range AS point, lo + (hi - lo) * range / 64 AS x FROM s, range(0, 65))
SELECT g.role, point, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - v) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())), 6) AS density
FROM g JOIN e ON g.role = e.role GROUP BY g.role, point, x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = S.density_curve(rates(spark, sf).select("role", "v").persist(), ["role"], "v")
    return out.select("role", "point", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@query(
    "robust_scale",
    """SELECT l_returnflag, l_linestatus, round(greatest(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25),
  abs(quantile_cont(l_extendedprice, 0.5)) * 0.1, 0.01), 4) AS scale FROM lineitem GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = S.robust_scale(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.withColumn("scale", F.round("scale", 4))


@query(
    "highest_exposure_anchor",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return S.best_row(df, ["o_custkey"], [("o_totalprice", True), ("o_orderkey", True)])


@query(
    "latest_snapshot_wins",
    """SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    rows = df.groupBy("user_id", "event_type").agg(
        F.max_by(F.struct("event_id", "ts", "value"), F.struct("ts", "event_id")).alias("r")
    )
    return rows.select("user_id", "event_type", "r.*")


@query(
    "primary_role",
    f"WITH {ROLE_Z} SELECT user_id, role, z FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY z DESC, role) AS r FROM rz) WHERE r = 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.best_row(role_z(spark, sf), ["user_id"], [("z", True), ("role", False)])


@query(
    "chronological_folds",
    f"""WITH {APPEARANCES_SQL}, d AS (SELECT match_date, row_number() OVER (ORDER BY match_date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT match_date FROM b5)),
c AS (SELECT max(match_date) FILTER (i = greatest(1, floor(0.6 * n))) AS t, max(match_date) FILTER (i = greatest(2, floor(0.8 * n))) AS v FROM d)
SELECT CASE WHEN match_date <= t THEN 'train' WHEN match_date <= v THEN 'validation' ELSE 'test' END AS fold, count(*) AS rows,
  count(DISTINCT match) AS matches, count(*) FILTER (flag = 'R') AS positives, min(match_date) AS first_date FROM b5, c GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    shots = appearances(spark, sf).select("match", "match_date", (F.col("flag") == "R").alias("goal"))
    return (
        S.chronological_folds(shots, "match", "match_date", "goal")
        .groupBy("fold")
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct("match").alias("matches"),
            F.count_if("goal").alias("positives"),
            F.min("match_date").alias("first_date"),
        )
    )


@query(
    "ranked_top_k",
    """SELECT o_orderpriority, o_orderkey, o_totalprice, position FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders) WHERE position <= 10""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return R.top_per(df, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query(
    "nulls_last_page",
    """WITH c AS (SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_acctbal > 9500 THEN c_acctbal END AS rating FROM customer)
SELECT *, (SELECT count(*) FROM c) AS total FROM (SELECT * FROM c ORDER BY rating DESC NULLS LAST, c_name, c_custkey LIMIT 50 OFFSET 40)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "customer").selectExpr("c_custkey", "c_name", "c_mktsegment", "CASE WHEN c_acctbal > 9500 THEN c_acctbal END AS rating")
    return U.page(df, "rating", ["c_name", "c_custkey"], 40, 50)


@query(
    "priority_pick",
    f"""WITH {CELLS_SQL} SELECT master_row, column_id, provider, value, sample, alternatives FROM (
  SELECT *, count(*) OVER (PARTITION BY master_row, column_id) - 1 AS alternatives,
   row_number() OVER (PARTITION BY master_row, column_id ORDER BY value < 60000, provider, sample) AS r FROM b2) WHERE r = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.priority_pick(cells(spark, sf), ["master_row", "column_id"], PRIORITY, "sample", F.col("value") >= 60000)


@query(
    "priority_alternatives",
    f"""WITH {CELLS_SQL} SELECT master_row, column_id, provider, value, sample,
  CAST(row_number() OVER (PARTITION BY master_row, column_id ORDER BY value < 60000, provider, sample) - 1 AS INTEGER) AS place FROM b2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate in its order; the first is the one that priority_pick takes."""
    out = R.ranked_candidates(cells(spark, sf), ["master_row", "column_id"], PRIORITY, "sample", F.col("value") >= 60000)
    return out.select("master_row", "column_id", "provider", "value", "sample", "place")


@query("canonical_order", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return U.canonical_order(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey", "o_orderkey"])


@query(
    "source_union",
    """WITH s AS (SELECT 'customer' AS provider, c_custkey AS id, c_name AS name, c_nationkey AS team, c_acctbal AS total, c_mktsegment AS role FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier)
SELECT s.*, count(*) OVER (PARTITION BY provider, id) > 1 AS refused FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    customers = load(spark, sf, "customer").selectExpr(
        "'customer' AS provider", "c_custkey AS id", "c_name AS name", "c_nationkey AS team", "c_acctbal AS total", "c_mktsegment AS role"
    )
    suppliers = load(spark, sf, "supplier").selectExpr(
        "'supplier' AS provider", "s_suppkey AS id", "s_name AS name", "s_nationkey AS team", "s_acctbal AS total"
    )
    rows, twice = U.source_union([customers, suppliers], ["provider", "id"])
    return rows.join(twice, ["provider", "id"], "left").withColumn("refused", F.col("copies").isNotNull()).drop("copies")


@query(
    "base_plus_missing",
    """SELECT doc_id, 'labels' AS source FROM labels UNION ALL SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    base = load(spark, sf, "labels").select("doc_id", F.lit("labels").alias("source"))
    other = load(spark, sf, "documents").select("doc_id", F.lit("documents").alias("source"))
    return U.base_plus_missing(base, other, ["doc_id"])


TOP_SQL = "(SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {score} DESC, c_custkey) AS r FROM customer) WHERE r <= 10)"


@query(
    "topk_jaccard",
    f"""WITH a AS {TOP_SQL.format(score='c_acctbal + 40 * c_nationkey')}, b AS {TOP_SQL.format(score='c_acctbal * 1.1 + 38 * c_nationkey')},
u AS (SELECT c_mktsegment, c_custkey, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT c_mktsegment, round(count(*) FILTER (n = 2) / count(*), 6) AS jaccard FROM u GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    top = lambda score: R.top_per(c.withColumn("s", F.expr(score)), ["c_mktsegment"], [F.desc("s"), F.asc("c_custkey")], 10)
    out = U.topk_jaccard(top("c_acctbal + 40 * c_nationkey"), top("c_acctbal * 1.1 + 38 * c_nationkey"), ["c_mktsegment"], "c_custkey")
    return out.withColumn("jaccard", F.round("jaccard", 6))


@query(
    "incremental_contribution",
    """SELECT min(o_orderpriority) AS provider, o_custkey, o_orderstatus FROM orders GROUP BY 2, 3 HAVING count(DISTINCT o_orderpriority) = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "orders").withColumnRenamed("o_orderpriority", "provider")
    return U.incremental_contribution(df, "provider", ["o_custkey", "o_orderstatus"])


@query(
    "common_cohort",
    SCORES_SQL.replace("{min_peers}", "30")
    + "SELECT role, dense_rank() OVER (PARTITION BY role ORDER BY population) AS cohort_index, population FROM (SELECT DISTINCT role, cohort, population FROM overall)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = model()
    rows = R.ability_rows(entities(spark, sf).persist(), m, ["player", "role"], "minutes")
    scores = R.calibrate(rows, ["role", "ability", "signature"], m.slots, 30)
    overall = R.compose(scores, ["player", "role"], "role", len(m.abilities), 1)
    sizes = overall.groupBy("role", "cohort").agg(F.count("*").alias("population"))
    from pyspark.sql import Window

    # One row per cohort, not per peer.
    return sizes.select(
        "role",
        F.dense_rank().over(Window.partitionBy("role").orderBy("population")).alias("cohort_index"),
        "population",
    )


@query(
    "joint_identity_align",
    """WITH a AS (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')
SELECT user_id, (SELECT count(*) FROM a) AS joint_peers FROM a WHERE (SELECT count(*) FROM a) >= 30""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return U.joint_members(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], 30)


@query(
    "orphan_checks",
    """SELECT 'labels_without_document' AS "check", count(*) AS orphans FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'orders_without_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'customers_without_orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'documents_without_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("d"))
    labels = load(spark, sf, "labels").select("doc_id")
    return (
        U.orphans(labels, docs, "doc_id", "d", "labels_without_document")
        .unionByName(U.orphans(load(spark, sf, "orders"), load(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "orders_without_lines"))
        .unionByName(U.orphans(load(spark, sf, "customer"), load(spark, sf, "orders"), "c_custkey", "o_custkey", "customers_without_orders"))
        .unionByName(U.orphans(docs, labels, "d", "doc_id", "documents_without_label"))
    )
