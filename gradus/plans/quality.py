"""Validation, quarantine and filter queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import status as T
from ..operators import quality as Q
from .bindings import APPEARANCES_SQL, ENTITIES_SQL, NAMED_SQL, appearances, entities, load, named
from .registry import query


def joined(rules: dict[str, str]) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules.items()) + ")"


SCALAR = (
    "CASE event_type WHEN 'click' THEN {num} WHEN 'view' THEN 'null' WHEN 'error' THEN '\"text\"' "
    "WHEN 'signup' THEN CASE WHEN value > 50 THEN 'true' ELSE '' END ELSE CASE WHEN value > 50 THEN '1e309' ELSE '[1]' END END"
)


@query(
    "classify_scalar",
    f"""WITH s AS (SELECT event_id, {SCALAR.format(num="CAST(value AS VARCHAR)")} AS t FROM events)
SELECT event_id, CASE WHEN t IN ('', 'null') THEN 'missing' WHEN t IN ('true', 'false') OR t LIKE '"%' THEN 'categorical'
  WHEN t = '1e309' OR t LIKE '[%' THEN 'invalid' ELSE 'numeric' END AS status FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "events").selectExpr("event_id", SCALAR.format(num="cast(value AS string)") + " AS t")
    kind = F.expr(
        "CASE WHEN t = 'null' THEN 'null' WHEN t IN ('true', 'false') THEN 'boolean' WHEN t LIKE '\"%' THEN 'string' "
        "WHEN t RLIKE '^-?[0-9]' THEN 'number' ELSE 'container' END"
    )
    return s.select("event_id", T.scalar_status(F.col("t"), kind).alias("status"))


CELL = (
    "CASE l_linenumber WHEN 1 THEN '1,' || {q} || '.5' WHEN 2 THEN ' ' || {q} || '%' WHEN 3 THEN '-' WHEN 4 THEN '' "
    "WHEN 5 THEN 'N/A' WHEN 6 THEN l_returnflag || {q} ELSE '+' || {q} END"
)


@query(
    "parse_numeric_text",
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, replace(trim({CELL.format(q="CAST(CAST(l_quantity AS INT) AS VARCHAR)")}), ',', '') AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN t IN ('', '-', 'N/A') THEN 'missing' WHEN l_linenumber = 6 THEN 'categorical' ELSE 'numeric' END AS status,
  CASE WHEN l_linenumber IN (1, 2, 7) THEN CAST(replace(t, '%', '') AS DOUBLE) END AS value,
  CASE WHEN t = 'N/A' THEN 'missing' WHEN l_linenumber = 6 THEN 'categorical' ELSE 'numeric' END AS zero_status,
  CASE WHEN l_linenumber IN (1, 2, 7) THEN CAST(replace(t, '%', '') AS DOUBLE) WHEN t IN ('', '-') THEN 0 END AS zero_value FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.expr(CELL.format(q="cast(cast(l_quantity AS int) AS string)"))
    status, value = T.numeric_text(cell)
    zero_status, zero_value = T.numeric_text(cell, empty_zero=True)
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", status.alias("status"), value.alias("value"),
        zero_status.alias("zero_status"), zero_value.alias("zero_value"),
    )


@query(
    "ratio_status",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount * 100) AS n, round(l_tax * 100) - 1 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN d < 0 OR (d = 0 AND n <> 0) THEN 'invalid' WHEN d = 0 AND n = 0 THEN 'na' END AS status FROM r""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    r = load(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "round(l_discount * 100) AS n", "round(l_tax * 100) - 1 AS d"
    )
    return r.select("l_orderkey", "l_linenumber", "l_partkey", T.ratio_status(F.col("n"), F.col("d")).alias("status"))


@query("nonnegative_finite_guard", "SELECT c_custkey, c_acctbal >= 0 AS accepted FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", T.nonnegative(F.col("c_acctbal")).alias("accepted"))


ORDER_RULES = {
    "price": "o_totalprice < 50000",
    "unfinished": "o_orderstatus <> 'F'",
    "priority": "o_orderpriority = '4-NOT SPECIFIED'",
}


@query(
    "validate_and_quarantine",
    f"""WITH c AS (SELECT *, {joined(ORDER_RULES)} AS reasons FROM orders)
SELECT o_orderkey, reasons = '' AS valid, reasons, CASE WHEN reasons = '' THEN o_totalprice END AS price FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    valid, bad = Q.split(load(spark, sf, "orders"), ORDER_RULES, ["o_orderkey"])
    good = valid.selectExpr("o_orderkey", "true AS valid", "'' AS reasons", "o_totalprice AS price")
    return good.unionByName(
        bad.selectExpr("o_orderkey", "false AS valid", "array_join(reasons, ';') AS reasons", "cast(NULL AS double) AS price")
    )


METRICS_SQL = """m AS (
  SELECT player, age, minutes, 'ratio' AS unit, round(np_goals / shots, 4) AS value, np_goals::DOUBLE AS numerator, shots::DOUBLE AS denominator FROM b1
  UNION ALL SELECT player, age, minutes, 'per90', round(90.0 * shots / minutes, 6), shots, minutes FROM b1
  UNION ALL SELECT player, age, minutes, 'ratio', xg / matches, xg, matches FROM b1
  UNION ALL SELECT player, age, minutes, 'per90', finishing / 10, NULL, minutes FROM b1)"""


@query(
    "contract_rules",
    f"""WITH {ENTITIES_SQL}, {METRICS_SQL}
SELECT player, unit, round(value, 9) AS value, concat_ws(';',
  CASE WHEN unit = 'ratio' AND (value < 0 OR value > 1) THEN 'ratio outside 0..1' END,
  CASE WHEN unit = 'per90' AND value < 0 THEN 'rate below 0' END,
  CASE WHEN unit = 'ratio' AND (denominator <= 0 OR numerator > denominator OR abs(value - numerator / denominator) > 1e-6) THEN 'ratio counts' END,
  CASE WHEN unit = 'per90' AND numerator IS NOT NULL AND minutes > 0 AND abs(value - 90 * numerator / minutes) > 1e-6 THEN 'rate counts' END,
  CASE WHEN age < 15 OR age > 50 THEN 'age bounds' END, CASE WHEN minutes < 0 OR minutes > 6000 THEN 'minutes bounds' END) AS reasons FROM m""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = entities(spark, sf).selectExpr(
        "player",
        "age",
        "minutes",
        "inline(array(named_struct('unit', 'ratio', 'value', round(np_goals / shots, 4), 'numerator', double(np_goals), 'denominator', double(shots)), "
        "named_struct('unit', 'per90', 'value', round(90D * shots / minutes, 6), 'numerator', double(shots), 'denominator', double(minutes)), "
        "named_struct('unit', 'ratio', 'value', xg / matches, 'numerator', xg, 'denominator', double(matches)), "
        "named_struct('unit', 'per90', 'value', finishing / 10, 'numerator', cast(NULL AS double), 'denominator', minutes)))",
    )
    return Q.validate(m, Q.metric_rules()).select(
        "player", "unit", F.round("value", 9).alias("value"), F.array_join("reasons", ";").alias("reasons")
    )


@query(
    "season_record_rules",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE AS cutoff, (o_orderdate + INTERVAL 60 DAY)::DATE AS retrieved, year(o_orderdate) AS y,
  CASE WHEN l_linestatus = 'O' AND l_quantity > 45 THEN year(o_orderdate)::VARCHAR || '/00' ELSE year(o_orderdate)::VARCHAR || '/' || right((year(o_orderdate) + 1)::VARCHAR, 2) END AS season,
  l_tax, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(';', CASE WHEN right(season, 2) <> right((y + 1)::VARCHAR, 2) THEN 'season label' END,
  CASE WHEN cutoff < make_date(y, 7, 1) OR cutoff >= make_date(y + 1, 8, 1) THEN 'cutoff outside season' END,
  CASE WHEN cutoff > retrieved THEN 'cutoff after retrieval' END,
  CASE WHEN l_tax > 0 AND l_returnflag = 'N' THEN 'value without citation' END) AS reasons FROM r""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    r = (
        load(spark, sf, "lineitem")
        .join(orders, F.expr("l_orderkey = o_orderkey"))
        .selectExpr(
            "l_orderkey", "l_linenumber", "l_partkey", "date(l_shipdate) AS cutoff", "date_add(date(o_orderdate), 60) AS retrieved",
            "IF(l_linestatus = 'O' AND l_quantity > 45, concat(year(o_orderdate), '/00'), concat(year(o_orderdate), '/', right(string(year(o_orderdate) + 1), 2))) AS season",
            "map('minutes', l_quantity, 'tax', IF(l_tax > 0, l_tax, NULL)) AS totals",
            "map('minutes', 'https://source.example/a', 'tax', IF(l_returnflag = 'N', NULL, 'https://source.example/b')) AS citations",
        )
    )
    checked = Q.validate(r, Q.season_rules("season", "cutoff", "retrieved", "totals", "citations"))
    return checked.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("reasons", ";").alias("reasons"))


NESTED = Q.nested_total_rules([("on_target", "shots"), ("np_goals", "matches"), ("xg", "np_goals"), ("tax", "xg")])


@query("nested_total_rules", f"WITH {ENTITIES_SQL} SELECT player, {joined(NESTED)} AS reasons FROM b1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return Q.validate(entities(spark, sf), NESTED).select("player", F.array_join("reasons", ";").alias("reasons"))


@query(
    "provenance_rules",
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, concat_ws(';', CASE WHEN url NOT LIKE 'https://%' THEN 'not https' END,
  CASE WHEN NOT regexp_matches(host, '\.example\.com$') THEN 'unexpected host' END,
  CASE WHEN split_part(url, '#', 1) LIKE '%?%' THEN 'query in url' END,
  CASE WHEN length(page_id::VARCHAR) > 2 THEN 'id length' END) AS reasons FROM p""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rules = Q.provenance_rules("url", "[.]example[.]com$", "page_id", 2)
    return Q.validate(load(spark, sf, "pages").select("page_id", "url"), rules).select("page_id", F.array_join("reasons", ";").alias("reasons"))


@query(
    "weight_registry_rules",
    """WITH s AS (SELECT p_brand AS position, p_type AS ability, sum(p_retailprice) AS t FROM part GROUP BY 1, 2),
r AS (SELECT p_brand AS position, p_type AS ability, p_name AS feature, round(p_retailprice / t, 3) AS weight,
  CASE WHEN p_size > 48 THEN 2 ELSE 1 END AS direction, p_size > 2 AS known, 1.0 / 6 AS o FROM part JOIN s ON p_brand = position AND p_type = ability),
a AS (SELECT position, ability, sum(weight) AS s, max(o) AS o, count(*) AS n, count(DISTINCT feature) AS d FROM r GROUP BY 1, 2),
k AS (SELECT DISTINCT p_name FROM part WHERE p_size > 45),
p AS (SELECT position, sum(o) AS s, count(*) AS n FROM a GROUP BY 1),
v AS (SELECT position, ability, 'unknown feature' AS reason FROM r WHERE feature NOT IN (SELECT p_name FROM k)
 UNION ALL SELECT position, ability, 'direction' FROM r WHERE direction = 2
 UNION ALL SELECT position, ability, 'weight outside 0..1' FROM r WHERE weight > 1 OR weight < 0
 UNION ALL SELECT position, ability, 'feature weights' FROM a WHERE abs(s - 1) > 1e-8
 UNION ALL SELECT position, ability, 'repeated feature' FROM a WHERE n <> d
 UNION ALL SELECT position, '', 'overall weights' FROM p WHERE abs(s - 1) > 1e-8
 UNION ALL SELECT position, '', 'number of abilities' FROM p WHERE n <> 6)
SELECT position, ability, reason, count(*) AS times FROM v GROUP BY 1, 2, 3""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    total = part.groupBy("p_brand", "p_type").agg(F.sum("p_retailprice").alias("t"))
    registry = part.join(total, ["p_brand", "p_type"]).selectExpr(
        "p_brand AS position", "p_type AS ability", "p_name AS feature", "round(p_retailprice / t, 3) AS weight",
        "IF(p_size > 48, 2, 1) AS direction", "1D / 6 AS overall_weight",
    )
    return Q.registry_problems(registry, part.where("p_size > 45").select(F.col("p_name").alias("feature")))


@query(
    "hard_constraint_filter",
    f"""WITH {ENTITIES_SQL} SELECT player, role, concat_ws(';', CASE WHEN age IS NULL THEN 'Age must be verified' END,
  CASE WHEN foot IS NULL THEN 'Preferred foot must be verified' END, CASE WHEN high_line IS NULL THEN 'High line must be verified by scouting' END) AS unknowns
FROM b1 WHERE minutes >= 900 AND coalesce(age BETWEEN 18 AND 32, TRUE) AND coalesce(foot IN ('left', 'both'), TRUE) AND coalesce(high_line, TRUE)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = Q.hard_constraints(entities(spark, sf), 900, (18, 32), "left", ["high_line"], True)
    return out.select("player", "role", F.array_join("unknowns", ";").alias("unknowns"))


EVENT_COLUMNS = (
    "concat(match, '-', slot) AS event_id",
    "match AS match_id",
    "match_date",
    "CASE WHEN flag = 'N' AND status = 'O' THEN 'Pass' ELSE 'Shot' END AS type",
    "CASE WHEN slot = 6 THEN 5 ELSE 1 END AS period",
    "price / 800 AS x",
    "minutes * 1.65 AS y",
    "CASE flag WHEN 'R' THEN 'Goal' WHEN 'A' THEN 'Saved' ELSE CASE WHEN tax > 0.06 THEN 'Vanished' ELSE 'Off T' END END AS outcome",
    "CASE WHEN slot = 1 THEN 'Head' WHEN slot < 4 THEN 'Left Foot' WHEN slot < 7 THEN 'Right Foot' ELSE 'Tail' END AS body_part",
    "xg > 0.05 AS under_pressure",
    "player",
    "team",
    "price",
)
EVENTS_SQL = f"""
ev AS (SELECT {', '.join(EVENT_COLUMNS)} FROM b5),
sh AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY event_id) AS copies FROM ev WHERE type = 'Shot' AND period <> 5
  WINDOW w AS (PARTITION BY event_id ORDER BY price, player, team, y, outcome, under_pressure)),
ck AS (SELECT *, CASE WHEN x > 120 OR y > 80 THEN 'invalid coordinates' WHEN outcome = 'Vanished' THEN 'unknown outcome'
  WHEN body_part = 'Tail' THEN 'unknown body part' END AS bad FROM sh WHERE r = 1)"""


def shot_events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = appearances(spark, sf).selectExpr(*EVENT_COLUMNS)
    return Q.prepare_shots(events, ["price", "player", "team", "y", "outcome", "under_pressure"])


@query(
    "shot_event_prepare",
    f"""WITH {APPEARANCES_SQL}, {EVENTS_SQL}
SELECT event_id, (outcome = 'Goal')::INT AS goal, round(sqrt((120 - x) * (120 - x) + (y - 40) * (y - 40)), 6) AS distance,
  round(atan2(8 * (120 - x), (120 - x) * (120 - x) + (y - 40) * (y - 40) - 16), 6) AS angle, (body_part = 'Head')::INT AS header,
  under_pressure::INT AS under_pressure, NULL AS reason, 1 AS copies FROM ck WHERE bad IS NULL
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, bad, 1 FROM ck WHERE bad IS NOT NULL
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, 'duplicate', copies - 1 FROM ck WHERE copies > 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    shots, bad = shot_events(spark, sf)
    return shots.select(
        "event_id", "goal", F.round("distance", 6).alias("distance"), F.round("angle", 6).alias("angle"), "header",
        "under_pressure", F.lit(None).cast("string").alias("reason"), F.lit(1).cast("long").alias("copies"),
    ).unionByName(bad, allowMissingColumns=True)


@query(
    "empty_cell_zero_policy",
    """WITH c AS (SELECT o_orderkey, o_custkey, o_orderstatus AS field, CASE WHEN o_totalprice < 50000 OR o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS value FROM orders),
n AS (SELECT field, bool_or(value IS NOT NULL) AS numeric FROM c GROUP BY 1)
SELECT o_orderkey, field, CASE WHEN numeric AND value IS NULL THEN 0 ELSE value END AS value, numeric AND value IS NULL AS touched FROM c JOIN n USING (field)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    cells = load(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderstatus AS field", "IF(o_totalprice < 50000 OR o_orderstatus = 'P', NULL, o_totalprice) AS value"
    )
    return Q.empty_cells_zero(cells, ["field"])


@query(
    "catalogue_search",
    """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '#00000') AND c_acctbal >= 500 AND c_acctbal <= 9000""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    return Q.search(c, "c_name", "#00000", {"c_mktsegment": "BUILDING"}, "c_acctbal", 500, 9000).select("c_custkey", "c_name", "c_acctbal")


EDGE = "[^\\p{L}\\p{N}_]"
# DuckDB knows word bounds of ASCII only, so they are written out.
_BOUNDED = {r"\b%s\b" % w: rf"(^|[^\p{{L}}\p{{N}}_]){w}([^\p{{L}}\p{{N}}_]|$)" for w in ("keeper", "gk", "fb", "cb", "dm", "am", "cm", "st")}
ROLE_CASE = " ".join(
    f"WHEN regexp_matches(t, '{'|'.join(_BOUNDED.get(part, part) for part in pattern.split('|'))}') THEN '{role}'" for role, pattern in Q.ROLE_PATTERNS
)


@query(
    "brief_keyword_rules",
    f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), r AS (SELECT *, CASE {ROLE_CASE} ELSE 'CM' END AS role FROM d)
SELECT doc_id, role, CASE WHEN contains(t, 'right-foot') OR contains(t, 'right foot') THEN 'right' WHEN contains(t, 'left-foot') OR contains(t, 'left foot') THEN 'left' END AS foot,
  concat_ws(';', CASE WHEN contains(t, 'athletic') THEN 'athletic' END, CASE WHEN contains(t, 'high line') THEN 'high_line' END,
    CASE WHEN contains(t, 'under pressure') THEN 'receives_under_pressure' END) AS attributes,
  (contains(t, 'passing') OR contains(t, 'breaks lines')) AND role IN ('CB', 'FB', 'DM', 'CM', 'AM') AS prefers_progression FROM r""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return Q.brief_rules(load(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query(
    "lineup_rules",
    """WITH l AS (SELECT l_orderkey AS lineup, l_linenumber AS slot, l_suppkey AS player FROM lineitem),
s AS (SELECT s_suppkey AS player, s_acctbal < 5000 AS keeper FROM supplier WHERE s_acctbal >= -500),
j AS (SELECT l.*, keeper FROM l LEFT JOIN s USING (player)),
p AS (SELECT lineup, count(DISTINCT slot) FILTER (slot IN (1, 2, 3)) AS known, count(*) FILTER (slot NOT IN (1, 2, 3)) AS other, count(*) AS n,
  count(DISTINCT slot) AS ds, count(DISTINCT player) AS dp, count(*) FILTER (keeper IS NULL) AS strangers,
  count(*) FILTER (keeper IS NOT NULL AND (slot = 1) <> keeper) AS misplaced FROM j GROUP BY 1),
r AS (SELECT lineup, concat_ws(';', CASE WHEN known <> 3 OR other > 0 OR n <> ds THEN 'slots' END, CASE WHEN strangers > 0 THEN 'unknown player' END,
  CASE WHEN n <> dp THEN 'repeated player' END, CASE WHEN misplaced > 0 THEN 'keeper exchange' END) AS problems FROM p)
SELECT * FROM r WHERE problems <> ''""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lineups = load(spark, sf, "lineitem").selectExpr("l_orderkey AS lineup", "l_linenumber AS slot", "l_suppkey AS player")
    squad = load(spark, sf, "supplier").where("s_acctbal >= -500").selectExpr("s_suppkey AS player", "s_acctbal < 5000 AS keeper")
    return Q.lineup_problems(lineups, squad, [1, 2, 3], 1)


@query(
    "identity_link_rules",
    f"""WITH {NAMED_SQL}, r AS (SELECT row AS record_id, league, provider FROM b3 WHERE size < 48),
l AS (SELECT row AS record_id, name AS canonical_id FROM b3 UNION ALL SELECT row, league FROM b3 WHERE size > 46),
k AS (SELECT l.*, r.league, r.provider FROM l LEFT JOIN r USING (record_id)),
a AS (SELECT record_id, count(*) AS n, bool_and(provider IS NOT NULL) AS ok FROM k GROUP BY 1),
g AS (SELECT canonical_id, count(DISTINCT league) AS leagues, count(DISTINCT provider) AS providers, count(*) AS n FROM k GROUP BY 1)
SELECT 'link' AS scope, record_id::VARCHAR AS id, 'unknown record' AS reason FROM a WHERE NOT ok
UNION ALL SELECT 'link', record_id::VARCHAR, 'record linked twice' FROM a WHERE n > 1
UNION ALL SELECT 'group', canonical_id, 'several leagues' FROM g WHERE leagues <> 1
UNION ALL SELECT 'group', canonical_id, 'provider repeated' FROM g WHERE providers <> n""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = named(spark, sf)
    records = parts.where("size < 48").select(F.col("row").alias("record_id"), "league", "provider")
    links = parts.selectExpr("row AS record_id", "name AS canonical_id").unionByName(
        parts.where("size > 46").selectExpr("row AS record_id", "league AS canonical_id")
    )
    return Q.link_problems(links, records)


@query(
    "fixture_inventory_rules",
    """WITH f AS (SELECT o_orderpriority AS league, o_custkey AS fixture, o_orderstatus <> 'P' AS finished, o_orderdate AS played FROM orders),
i AS (SELECT league, fixture, count(*) AS n, bool_and(finished) AS fin, bool_and(played >= TIMESTAMP '1997-07-01' AND played < TIMESTAMP '1998-07-01') AS s FROM f GROUP BY 1, 2),
e AS (SELECT o_orderpriority AS league, count(*) AS expected FROM orders GROUP BY 1),
l AS (SELECT league, sum(n) AS inventory, count(*) FILTER (n > 1) AS duplicate_ids, count(*) FILTER (NOT fin) AS unfinished, count(*) FILTER (NOT s) AS out_of_season,
  count(*) FILTER (n = 1 AND fin AND s) AS processed FROM i GROUP BY 1)
SELECT l.*, expected, inventory = expected AND processed = expected AS complete FROM l JOIN e USING (league)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    fixtures = orders.selectExpr(
        "o_orderpriority AS league", "o_custkey AS fixture", "o_orderstatus <> 'P' AS finished", "o_orderdate AS played"
    )
    expected = orders.groupBy(F.col("o_orderpriority").alias("league")).agg(F.count("*").alias("expected"))
    return Q.fixture_inventory(fixtures, expected, 1997)


@query(
    "first_fixtures",
    """SELECT league, fixture, played, position FROM (SELECT o_orderpriority AS league, o_orderkey AS fixture, o_orderdate AS played,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS position FROM orders) WHERE position <= 10""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    fixtures = load(spark, sf, "orders").selectExpr("o_orderpriority AS league", "o_orderkey AS fixture", "o_orderdate AS played")
    return Q.first_fixtures(fixtures, 10)
