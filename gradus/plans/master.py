"""Master-data and release queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_key
from ..operators import master as M
from ..operators import release as G
from ..session import new_folder
from .bindings import ENTITIES_SQL, NAMED_SQL, PRIORITY, entities, load, named
from .identity import COMPONENTS_SQL, component_labels
from .registry import query

ORDER = ["provider", "sample"]
VALUE = "CASE WHEN o_totalprice < 40000 THEN NULL ELSE ceil(o_totalprice / 170000.0) - 1 END"
CELL_SQL = f"""
b2 AS (SELECT o_custkey AS master_row, o_orderstatus AS column_id, o_orderpriority AS provider, o_orderkey AS sample, {VALUE} AS value FROM orders),
f2 AS (SELECT *, first_value(value) OVER (PARTITION BY master_row, column_id ORDER BY value IS NULL, provider, sample) AS first FROM b2),
co AS (SELECT master_row, column_id, CASE WHEN count(value) = 0 THEN 'unavailable' WHEN bool_and(value IS NULL OR abs(value - first) <= 1e-6 * greatest(1, abs(first))) THEN 'observed'
  ELSE 'source_conflict' END AS status, max(first) AS first, count(*) AS origins FROM f2 GROUP BY 1, 2),
ps AS (SELECT master_row, column_id, provider, arg_min(value, sample) AS first, min(value) AS lo, max(value) AS hi FROM b2 WHERE value IS NOT NULL GROUP BY 1, 2, 3),
pr AS (SELECT master_row, column_id, provider AS selected_provider, CASE WHEN lo = hi THEN first END AS selected_value, lo <> hi AS source_disagrees, sources FROM
  (SELECT *, row_number() OVER (PARTITION BY master_row, column_id ORDER BY provider) AS r, count(*) OVER (PARTITION BY master_row, column_id) AS sources FROM ps) WHERE r = 1),
rs AS (SELECT co.master_row, co.column_id, CASE WHEN status = 'observed' THEN first WHEN status = 'source_conflict' THEN selected_value END AS value,
  CASE WHEN status = 'source_conflict' AND selected_value IS NOT NULL THEN 'resolved_by_priority' ELSE status END AS status, selected_provider FROM co LEFT JOIN pr USING (master_row, column_id))"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(
        "o_custkey AS master_row", "o_orderstatus AS column_id", "o_orderpriority AS provider", "o_orderkey AS sample",
        f"double({VALUE}) AS value",
    )


@query("cell_coalesce", f"WITH {CELL_SQL} SELECT master_row, column_id, status, CASE WHEN status = 'observed' THEN first END AS value, origins FROM co")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.coalesce_cells(cells(spark, sf), ORDER)


@query("source_priority_select", f"WITH {CELL_SQL} SELECT * FROM pr")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.select_by_priority(cells(spark, sf), PRIORITY, ORDER)


@query(
    "conflict_resolution_audit",
    f"""WITH {CELL_SQL} SELECT b2.master_row, b2.column_id, provider, sample, b2.value, selected_provider, selected_value, source_disagrees
FROM b2 JOIN co ON co.master_row = b2.master_row AND co.column_id = b2.column_id AND co.status = 'source_conflict'
LEFT JOIN pr ON pr.master_row = b2.master_row AND pr.column_id = b2.column_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.resolution_audit(cells(spark, sf), PRIORITY, ORDER)


VECTORS = {
    ("alpha", "shots"): "shots",
    ("alpha", "goals"): "np_goals",
    ("alpha", "minutes"): "minutes",
    ("alpha", "apps"): "matches",
    ("gamma", "shots"): "shots",
    ("gamma", "Goals"): "np_goals",
    ("gamma", "Mins"): "minutes * 1.0000001",
    ("gamma", "Apps"): "matches + CASE WHEN team = 3 THEN 1 ELSE 0 END",
    ("gamma", "per_game.shots"): "shots / matches",
    ("beta", "goals"): "CASE WHEN player < 15 THEN np_goals END",
    ("beta", "time"): "minutes",
    ("beta", "games"): "matches",
}
# The candidates among these columns: equal labels, then known aliases.
VECTOR_PAIRS = [
    (("alpha", "apps"), ("beta", "games")),
    (("alpha", "apps"), ("gamma", "Apps")),
    (("alpha", "goals"), ("beta", "goals")),
    (("alpha", "goals"), ("gamma", "Goals")),
    (("alpha", "minutes"), ("beta", "time")),
    (("alpha", "minutes"), ("gamma", "Mins")),
    (("alpha", "shots"), ("gamma", "shots")),
    (("beta", "games"), ("gamma", "Apps")),
    (("beta", "goals"), ("gamma", "Goals")),
    (("beta", "time"), ("gamma", "Mins")),
]
VECTORS_SQL = "v AS (" + " UNION ALL ".join(
    f"SELECT '{p}' AS provider, '{n}' AS label, player AS row, CAST({e} AS DOUBLE) AS value FROM b1" for (p, n), e in VECTORS.items()
) + ")"
PAIRS_SQL = "prs(left_provider, left_label, right_provider, right_label) AS (VALUES " + ", ".join(
    f"('{a[0]}', '{a[1]}', '{b[0]}', '{b[1]}')" for a, b in VECTOR_PAIRS
) + ")"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    parts = ", ".join(f"named_struct('provider', '{p}', 'label', '{n}', 'value', double({e}))" for (p, n), e in VECTORS.items())
    return entities(spark, sf).selectExpr("player AS row", f"inline(array({parts}))")


@query(
    "column_equivalence",
    f"""WITH {ENTITIES_SQL}, {VECTORS_SQL}, {PAIRS_SQL},
j AS (SELECT prs.*, a.value AS x, b.value AS y FROM prs LEFT JOIN v a ON a.provider = left_provider AND a.label = left_label AND a.value IS NOT NULL
  JOIN v b ON b.provider = right_provider AND b.label = right_label AND b.row = a.row AND b.value IS NOT NULL),
s AS (SELECT left_provider, left_label, right_provider, right_label, count(*) AS matched_rows, count(*) FILTER (abs(x - y) <= 1e-6 * greatest(1, abs(x), abs(y))) AS equal_rows,
  count(*) FILTER (x <> 0 OR y <> 0) AS nonzero_rows, least(count(DISTINCT x), count(DISTINCT y)) AS distinct_values, round(avg(abs(x - y)), 5) AS mean_difference FROM j GROUP BY 1, 2, 3, 4)
SELECT *, round(equal_rows / matched_rows, 6) AS agreement, CASE WHEN matched_rows < 20 OR nonzero_rows < 10 OR distinct_values < 4 THEN 'insufficient_overlap' WHEN equal_rows = matched_rows THEN 'equivalent' ELSE 'different_values' END AS status FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = M.compare_columns(vectors(spark, sf), VECTOR_PAIRS)
    return out.withColumn("agreement", F.round("agreement", 6)).withColumn("mean_difference", F.round("mean_difference", 5))


_COLUMNS = sorted(VECTORS)
_NUMBER = {c: k + 1 for k, c in enumerate(_COLUMNS)}
_CANDIDATES = ", ".join(f"({n + 1}, {_NUMBER[a]}, {_NUMBER[b]}, {str(a[1] == b[1]).upper()})" for n, (a, b) in enumerate(VECTOR_PAIRS))
# Pairs decide one after another over the list of each column's group.
GROUPS_SQL = f"""WITH RECURSIVE {ENTITIES_SQL}, {VECTORS_SQL},
col AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{p}', '{n}')" for (p, n), k in _NUMBER.items())}) t(k, provider, label)),
cand AS (SELECT * FROM (VALUES {_CANDIDATES}) t(n, l, r, exact)),
j AS (SELECT a.k AS l, b.k AS r, x.value AS x, y.value AS y FROM col a JOIN col b ON a.k < b.k JOIN v x ON x.provider = a.provider AND x.label = a.label AND x.value IS NOT NULL
  JOIN v y ON y.provider = b.provider AND y.label = b.label AND y.row = x.row AND y.value IS NOT NULL),
s AS (SELECT l, r, count(*) AS matched, count(*) FILTER (abs(x - y) <= 1e-6 * greatest(1, abs(x), abs(y))) AS same, count(*) FILTER (x <> 0 OR y <> 0) AS nonzero,
  least(count(DISTINCT x), count(DISTINCT y)) AS distinct_values FROM j GROUP BY 1, 2),
eq AS (SELECT list(DISTINCT l * 1000 + r) || list(DISTINCT r * 1000 + l) AS e FROM s WHERE matched >= 20 AND nonzero >= 10 AND distinct_values >= 4 AND same = matched),
step(n, g, merged) AS (
  SELECT 0, list_transform(range(1, {len(_COLUMNS) + 1}), lambda k: k), FALSE
  UNION ALL
  SELECT q.n, CASE WHEN q.merged THEN list_transform(q.g, lambda x: CASE WHEN x = q.gr THEN q.gl ELSE x END) ELSE q.g END, q.merged FROM (
    SELECT c.n, g, g[c.l] AS gl, g[c.r] AS gr, c.exact OR (list_contains(e, c.l * 1000 + c.r) AND len(list_filter(range(1, {len(_COLUMNS) + 1}), lambda a:
      g[a] = g[c.l] AND len(list_filter(range(1, {len(_COLUMNS) + 1}), lambda b: g[b] = g[c.r] AND a <> b AND NOT list_contains(e, a * 1000 + b))) > 0)) = 0) AS merged
    FROM step JOIN cand c ON c.n = step.n + 1, eq) q)
"""


@query(
    "column_groups",
    GROUPS_SQL
    + f"""SELECT h.provider || ':' || h.label AS "group", col.provider, col.label FROM step JOIN col ON n = {len(VECTOR_PAIRS)} JOIN col h ON h.k = g[col.k]""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.column_groups(vectors(spark, sf).persist())[0]


@query(
    "column_decisions",
    GROUPS_SQL
    + """SELECT a.provider AS left_provider, a.label AS left_label, b.provider AS right_provider, b.label AS right_label,
  CASE WHEN exact THEN 'exact_name' ELSE 'candidate_alias' END AS reason, merged, coalesce(matched, 0) AS matched_rows, coalesce(same, 0) AS equal_rows
FROM step JOIN cand USING (n) JOIN col a ON a.k = cand.l JOIN col b ON b.k = cand.r LEFT JOIN s ON s.l = cand.l AND s.r = cand.r""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    decisions = M.column_groups(vectors(spark, sf).persist())[1]
    return decisions.selectExpr(
        "left.provider AS left_provider", "left.label AS left_label", "right.provider AS right_provider", "right.label AS right_label",
        "reason", "merged", "matched_rows", "equal_rows",
    )


MERGE_SQL = (
    COMPONENTS_SQL
    + """, lab AS (SELECT a AS row, min(b) AS label FROM reach GROUP BY 1),
ce AS (SELECT row, 'size' AS column_id, provider, CASE WHEN size > 5 THEN size::DOUBLE END AS value FROM b3 UNION ALL SELECT row, 'price', provider, price FROM b3),
cov AS (SELECT row, count(value) AS coverage FROM ce GROUP BY 1),
rk AS (SELECT b3.row, label, provider, coverage FROM b3 JOIN lab USING (row) JOIN cov USING (row)),
al AS (SELECT *, first_value(row) OVER (PARTITION BY label ORDER BY provider, -coverage, row) AS canonical_row, count(*) OVER (PARTITION BY label) AS merged_rows FROM rk),
kc AS (SELECT canonical_row, column_id, ce.provider, value, coverage, ce.row FROM ce JOIN al ON al.row = ce.row),
fv AS (SELECT *, first_value(value) OVER w AS sel, first_value(provider) OVER w AS selp, first_value(row) OVER w AS selr FROM kc
  WINDOW w AS (PARTITION BY canonical_row, column_id ORDER BY value IS NULL, provider, -coverage, row)),
mg AS (SELECT canonical_row, column_id, max(sel) AS value, max(selp) AS selected_provider, max(selr) AS selected_row, count(*) AS candidates,
  coalesce(bool_or(abs(value - sel) > 1e-6 * greatest(1, abs(sel), abs(value))), FALSE) AS disagree,
  coalesce(bool_or(provider = selp AND abs(value - sel) > 1e-6 * greatest(1, abs(sel), abs(value))), FALSE) AS same_provider_disagreement FROM fv GROUP BY 1, 2)"""
)


@query(
    "identity_merge",
    MERGE_SQL
    + """ SELECT canonical_row, column_id, value, CASE WHEN value IS NULL THEN 'unavailable' WHEN disagree THEN 'resolved_by_priority' ELSE 'observed' END AS status,
  CASE WHEN value IS NOT NULL THEN selected_provider END AS selected_provider, CASE WHEN value IS NOT NULL THEN selected_row END AS selected_row, candidates FROM mg""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = named(spark, sf)
    source = n.selectExpr(
        "row",
        "provider",
        "inline(array(named_struct('column_id', 'size', 'value', IF(size > 5, double(size), NULL)), named_struct('column_id', 'price', 'value', price)))",
    ).withColumn("status", F.lit("observed"))
    priority = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    _, merged, _ = M.merge_identities(n.select("row", "provider"), source, component_labels(spark, sf), priority)
    return merged


COLUMNS = {"F": "finished", "O": "open", "P": "pending", "X": "never"}


@query(
    "zero_fill_grid",
    f"""WITH {CELL_SQL}, cols(column_id) AS (VALUES ('F'), ('O'), ('P'), ('X')), p AS (SELECT DISTINCT master_row FROM b2)
SELECT p.master_row, cols.column_id, coalesce(value, 0) AS value, CASE WHEN value IS NULL THEN 'unrecorded_zero' ELSE status END AS status,
  CASE WHEN value IS NOT NULL THEN selected_provider END AS selected_provider FROM p CROSS JOIN cols LEFT JOIN rs ON rs.master_row = p.master_row AND rs.column_id = cols.column_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return M.zero_fill(c, list(COLUMNS), M.resolve(c, PRIORITY, ORDER))


@query(
    "single_sample_rule",
    """SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderkey) = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.single_samples(load(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey", "o_totalprice")


WIDE_SQL = """g AS (SELECT p.master_row, cols.column_id, coalesce(value, 0) AS value, CASE WHEN value IS NULL THEN 'unrecorded_zero' ELSE status END AS status
  FROM (SELECT DISTINCT master_row FROM b2) p CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('X')) cols(column_id) LEFT JOIN rs ON rs.master_row = p.master_row AND rs.column_id = cols.column_id)
SELECT master_row, max(value) FILTER (column_id = 'F') AS finished, max(value) FILTER (column_id = 'O') AS open, max(value) FILTER (column_id = 'P') AS pending, max(value) FILTER (column_id = 'X') AS never"""


@query(
    "master_build",
    f"""WITH {CELL_SQL}, {WIDE_SQL}, count(*) FILTER (status = 'observed') AS observed, count(*) FILTER (status = 'resolved_by_priority') AS resolved,
  count(*) FILTER (status = 'unrecorded_zero') AS unrecorded FROM g GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.build_master(cells(spark, sf), COLUMNS, PRIORITY, ORDER)


COMPOSED = {"alpha:shots": "shots", "alpha:goals": "goals", "web:Goals": "web_goals", "web:Apps": "apps", "web:Mins": "mins"}


@query(
    "master_composition",
    f"""WITH {ENTITIES_SQL}, same AS (SELECT count(*) >= 20 AND count(*) FILTER (shots <> 0) >= 10 AND count(DISTINCT shots) >= 4 AS merged FROM b1 WHERE team < 15)
SELECT player AS master_row, CASE WHEN merged THEN shots::DOUBLE END AS shots, np_goals::DOUBLE AS goals, CASE WHEN team < 15 THEN np_goals + (team >= 10)::INT ELSE 0 END::DOUBLE AS web_goals,
  CASE WHEN team < 15 THEN matches ELSE 0 END::DOUBLE AS apps, CASE WHEN team < 15 THEN minutes ELSE 0 END::DOUBLE AS mins, CASE WHEN team < 15 THEN 5 ELSE 2 END::BIGINT AS observed, 0::BIGINT AS resolved,
  CASE WHEN team < 15 THEN 0 ELSE 3 END::BIGINT AS unrecorded FROM b1, same""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """One source's aggregates and another's web tables, which saw the teams below 15 and counts goals its own way."""
    e = entities(spark, sf).withColumn("name_key", plain_key(F.col("name"))).persist()
    observed = e.selectExpr("player AS master_row", "'alpha' AS provider", "stack(2, 'shots', double(shots), 'goals', double(np_goals)) AS (label, value)", "concat('a', player) AS sample")
    seen = e.where("team < 15")
    link = "concat('/players/', player + 100000, '/show')"
    panel = lambda category, headers, cells: f"named_struct('panel', 'stats', 'category', {category}, 'accumulation', '2', 'headers', array({headers}), 'player', {link}, 'cells', array({cells}))"
    shots = panel("'shots'", "'Player', 'Apps', 'Mins', 'Total'", "name, string(matches), string(minutes), string(shots)")
    goals = panel("cast(NULL AS string)", "'Player', 'Goals'", "name, string(np_goals + int(team >= 10))")
    web = seen.selectExpr("league", "name_key", f"inline(array({shots}, {goals}))")
    known = lambda c: e.selectExpr("player AS row", f"double({c}) AS value")
    master, _, _ = M.compose_master(web, e.selectExpr("player AS row", "league", "name_key"), known("minutes"), known("matches"), observed, "web", COMPOSED, ["alpha", "web"], ORDER)
    return master


@query("long_to_wide_export", f"WITH {CELL_SQL}, {WIDE_SQL} FROM g GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return M.wide_export(M.zero_fill(c, list(COLUMNS), M.resolve(c, PRIORITY, ORDER)), COLUMNS)


@query(
    "stable_id_hash",
    """SELECT p_partkey, substring(sha256('["' || p_brand || '","' || p_name || '","' || p_partkey || '"]'), 1, 16) AS id FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", M.stable_id(F.col("p_brand"), F.col("p_name"), F.col("p_partkey")).alias("id"))


def filled(cells: DataFrame) -> DataFrame:
    return M.zero_fill(cells, list(COLUMNS), M.resolve(cells, PRIORITY, ORDER))


FILLED_SQL = f"""WITH {CELL_SQL}, filled AS (SELECT p.master_row, cols.column_id, coalesce(value, 0) AS value FROM (SELECT DISTINCT master_row FROM b2) p
  CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('X')) cols(column_id) LEFT JOIN rs ON rs.master_row = p.master_row AND rs.column_id = cols.column_id)"""


@query(
    "snapshot_revision",
    FILLED_SQL + """ SELECT column_id, count(*) AS rows, round(sum(value), 2) AS total, count(*) FILTER (value = 0) AS zeros, count(*) AS again_rows, round(sum(value), 2) AS again_total,
  FALSE AS first_reused, TRUE AS second_reused FROM filled GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Revise once, then again from a differently partitioned copy of the same input; both as stored."""
    root, c = new_folder(spark, "revisions"), cells(spark, sf)
    one, first = G.revise(spark, root, {"cells": c}, "zero-fill", "v1", filled)
    two, second = G.revise(spark, root, {"cells": c.repartition(5, "sample")}, "zero-fill", "v1", filled)
    sums = [F.count("*").alias("rows"), F.round(F.sum("value"), 2).alias("total")]
    again = two.groupBy("column_id").agg(*[s.alias(f"again_{n}") for s, n in zip(sums, ("rows", "total"))])
    return one.groupBy("column_id").agg(*sums, F.count_if(F.col("value") == 0).alias("zeros")).join(again, "column_id").select(
        "*", F.lit(first["reused"]).alias("first_reused"), F.lit(second["reused"]).alias("second_reused")
    )


@query(
    "revision_reconcile",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 50 THEN 49 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_tax < 0.08),
d AS (SELECT l_orderkey, l_linenumber, l_quantity, sum(w) AS s FROM (SELECT *, 1 AS w FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY 1, 2, 3)
SELECT (SELECT count(*) FROM a) AS left_rows, (SELECT count(*) FROM b) AS right_rows, CAST(sum(abs(s)) AS BIGINT) AS differing_rows, TRUE AS same_header, FALSE AS agrees FROM d""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    changed = lines.where("l_tax < 0.08").selectExpr("l_orderkey", "l_linenumber", "IF(l_quantity = 50, 49D, l_quantity) AS l_quantity")
    return G.reconcile(lines.drop("l_tax"), changed)


@query(
    "release_rules",
    f"""WITH {ENTITIES_SQL}, f AS (SELECT count(*) AS n FROM b1), t AS (SELECT count(*) AS u FROM b1 WHERE team NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> 7)),
c AS (SELECT count(*) FILTER (r = 5) AS covered FROM (SELECT league, count(DISTINCT role) AS r FROM b1 WHERE minutes >= 450 GROUP BY 1))
SELECT 'unknown team' AS violation FROM t WHERE u > 0 UNION ALL SELECT 'synthetic evidence' FROM b1 WHERE tax IS NULL HAVING count(*) > 0
UNION ALL SELECT 'thin role coverage' FROM c WHERE covered <> 5""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = entities(spark, sf).persist()
    stints = e.selectExpr("player AS stint", "'2025/26' AS season", "league", "role", "team", "minutes")
    teams = load(spark, sf, "nation").where("n_nationkey <> 7").select(F.col("n_nationkey").alias("team"))
    metrics = e.selectExpr("player AS stint", "IF(tax IS NULL, 'unavailable', 'observed') AS evidence")
    return G.release_violations(stints, teams, metrics, 5, 5)


@query(
    "publication_gate",
    f"""WITH {ENTITIES_SQL}, p AS (SELECT league, count(*) FILTER (minutes >= 1300) AS rated FROM b1 GROUP BY 1)
SELECT league || ': too few rated' AS violation FROM p WHERE rated < 50 UNION ALL SELECT 'several measurement versions' UNION ALL SELECT 'stale retrieval'
UNION ALL SELECT 'open quarantine' FROM b1 WHERE foot IS NULL HAVING count(*) > 0 UNION ALL SELECT 'unrated records' FROM b1 WHERE minutes < 1300 HAVING count(*) > 0""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    records = entities(spark, sf).selectExpr(
        "league", "minutes >= 1300 AS rated", "IF(tax IS NULL, 'v1', 'v2') AS version", "'2025/26' AS season", "date'2026-05-30' AS cutoff",
        "IF(age IS NULL, date'2026-01-01', date'2026-05-31') AS retrieved", "foot IS NULL AS quarantined",
    )
    return G.publication_errors(records, "2026-06-15", 50)


@query(
    "content_addressed_release",
    "SELECT o_orderstatus, count(*) AS rows, round(sum(o_totalprice), 2) AS total, TRUE AS first_written, FALSE AS second_written, TRUE AS refused_change FROM orders GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Publish, publish the same again, then something else; and read what is there."""
    root, df = new_folder(spark, "releases"), load(spark, sf, "orders")
    name = G.content_id(df, "orders")
    first, second = G.publish(spark, root, name, df), G.publish(spark, root, name, df.repartition(3, "o_custkey"))
    try:
        G.publish(spark, root, name, df.where("o_totalprice > 100000"))
        refused = False
    except ValueError:
        refused = True
    return G.verified(spark, first["folder"]).groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(
        "*", F.lit(first["written"]).alias("first_written"), F.lit(second["written"]).alias("second_written"), F.lit(refused).alias("refused_change")
    )


RELEASES = (
    "o_orderkey AS release_id",
    "o_custkey AS slot",
    "o_orderdate AS created",
    "o_totalprice > 100000 AS approved",
    "CASE WHEN o_orderstatus = 'P' THEN 'historical' ELSE 'real' END AS kind",
)


@query(
    "active_release_select",
    f"""WITH r AS (SELECT {', '.join(RELEASES)} FROM orders), v AS (SELECT DISTINCT l_orderkey AS release_id FROM lineitem WHERE l_discount >= 0.1),
b AS (SELECT o_custkey AS slot, o_orderkey AS release_id, o_orderdate AS at FROM orders WHERE o_totalprice > 470000),
n AS (SELECT slot, arg_max(release_id, (created, release_id)) AS newest FROM r WHERE kind <> 'historical' AND approved AND release_id NOT IN (SELECT release_id FROM v) GROUP BY 1),
k AS (SELECT b.slot, arg_max(b.release_id, (b.at, b.release_id)) AS rolled FROM b JOIN r ON r.slot = b.slot AND r.release_id = b.release_id AND kind <> 'historical' GROUP BY 1)
SELECT coalesce(n.slot, k.slot) AS slot, coalesce(rolled, newest) AS release_id, rolled IS NOT NULL AS rolled_back FROM n FULL JOIN k ON n.slot = k.slot""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    violations = load(spark, sf, "lineitem").where("l_discount >= 0.1").select(F.col("l_orderkey").alias("release_id"))
    rollbacks = orders.where("o_totalprice > 470000").selectExpr("o_custkey AS slot", "o_orderkey AS release_id", "o_orderdate AS at")
    return G.active_release(orders.selectExpr(*RELEASES), violations, rollbacks)


@query("integrity_read", "SELECT p_brand, count(*) AS rows, sum(p_size)::BIGINT AS size, TRUE AS tampering_found FROM part GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Read a published table back through its digest, and a tampered copy of it."""
    root, df = new_folder(spark, "integrity"), load(spark, sf, "part")
    good = G.publish(spark, root, "good", df)
    bad = G.publish(spark, root, "bad", df)
    df.withColumn("p_size", F.expr("p_size + int(p_partkey = 1)")).write.mode("overwrite").parquet(bad["data"])
    try:
        G.verified(spark, bad["folder"])
        found = False
    except ValueError:
        found = True
    return G.verified(spark, good["folder"]).groupBy("p_brand").agg(F.count("*").alias("rows"), F.sum("p_size").cast("long").alias("size")).withColumn("tampering_found", F.lit(found))


@query(
    "reproduce_release",
    FILLED_SQL + """ SELECT column_id, count(*) AS rows, round(sum(value), 2) AS stored_total, round(sum(value), 2) AS rebuilt_total, CAST(0 AS BIGINT) AS differing_rows FROM filled GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Rebuild a revision from its raw input, partitioned otherwise, and compare every row."""
    root, c = new_folder(spark, "reproduce"), cells(spark, sf)
    stored, _ = G.revise(spark, root, {"cells": c}, "zero-fill", "v1", filled)
    rebuilt = filled(c.repartition(7, "sample")).select(*stored.columns)
    other = rebuilt.groupBy("column_id").agg(F.round(F.sum("value"), 2).alias("rebuilt_total"))
    differing = G.differences(stored, rebuilt).groupBy("column_id").agg(F.sum(F.abs("surplus")).alias("d"))
    sums = stored.groupBy("column_id").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 2).alias("stored_total"))
    return sums.join(other, "column_id").join(differing, "column_id", "left").select("column_id", "rows", "stored_total", "rebuilt_total", F.coalesce("d", F.lit(0)).alias("differing_rows"))
