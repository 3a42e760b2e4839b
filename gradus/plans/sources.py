"""Source and sink queries. Nested documents and pages are built by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, nested, pages
from ..session import new_folder
from .bindings import ENTITIES_SQL, entities, load
from .registry import query


@query("scan_columnar", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return files.scan(spark, f"{sf}/orders.parquet").where("o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("scan_csv", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_size > 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The parts as text files with a header, read back with their types."""
    folder = new_folder(spark, "csv")
    parts = load(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    parts.write.option("header", True).csv(folder)
    schema = ", ".join(f"{name} {kind}" for name, kind in parts.dtypes)
    return files.scan(spark, folder, schema, "csv").where("p_size > 10")


@query(
    "scan_json_snapshots",
    "SELECT event_id, event_type, round(value, 2) AS value, ts AS retrieved_at FROM events WHERE event_type <> 'error' AND year(ts) = 2024",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "snapshots")
    events = load(spark, sf, "events").selectExpr(
        "event_type AS endpoint", "year(ts) AS season", "string(ts) AS retrieved_at", "named_struct('id', event_id, 'value', value) AS payload"
    )
    events.write.partitionBy("endpoint").json(folder)
    schema = "endpoint string, season int, retrieved_at string, payload struct<id: bigint, value: double>"
    snapshots = files.scan_snapshots(spark, folder, schema, 2024).where("endpoint <> 'error'")
    return snapshots.selectExpr("payload.id AS event_id", "endpoint AS event_type", "round(payload.value, 2) AS value", "timestamp(retrieved_at) AS retrieved_at")


@query(
    "medallion_write",
    f"""WITH {ENTITIES_SQL} SELECT 'bronze' AS layer, 'r1' AS release_id, count(*) AS rows FROM orders UNION ALL SELECT 'silver', 'r1', count(*) FROM b1
UNION ALL SELECT 'silver', 'r2', count(*) FROM b1 WHERE minutes >= 900 UNION ALL SELECT 'gold', 'r1', count(DISTINCT role || league) FROM b1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    root, e = new_folder(spark, "layers"), entities(spark, sf).persist()
    gold = e.groupBy("role", "league").agg(F.count("*").alias("stints"))
    files.write_layers(root, "r1", {"bronze": load(spark, sf, "orders"), "silver": e, "gold": gold})
    files.write_layers(root, "r2", {"silver": e.where("minutes >= 900")})
    out = None
    for layer in ("bronze", "silver", "gold"):
        part = spark.read.parquet(f"{root}/{layer}").groupBy("release_id").agg(F.count("*").alias("rows")).withColumn("layer", F.lit(layer))
        out = part if out is None else out.unionByName(part)
    return out


RISKY = (
    "CASE l_linenumber WHEN 1 THEN '=' || {q} WHEN 2 THEN '-' || {q} WHEN 3 THEN '  @' || {q} WHEN 4 THEN '+' || l_returnflag "
    "WHEN 5 THEN {q} WHEN 6 THEN l_returnflag || '=' ELSE '-x' END"
)


@query(
    "formula_safe_csv",
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, {RISKY.format(q="CAST(CAST(l_quantity AS INT) AS VARCHAR)")} AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber IN (1, 3, 4, 7) THEN '''' || t ELSE t END AS cell FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.expr(RISKY.format(q="cast(cast(l_quantity AS int) AS string)"))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", files.formula_safe(cell).alias("cell"))


@query(
    "flatten_json_paths",
    """WITH o AS (SELECT o_orderkey AS doc, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT doc, 'order.key' AS path, doc::VARCHAR AS value FROM o UNION ALL SELECT doc, 'order.tags[0]', s FROM o UNION ALL SELECT doc, 'order.tags[1]', p FROM o
UNION ALL SELECT doc, 'order.steps[]', unnest(['1', '2', '3', '4']) FROM o UNION ALL SELECT doc, 'who.deep.est[0].c', c::VARCHAR FROM o UNION ALL SELECT doc, 'who.deep.flag', 'true' FROM o""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "orders").selectExpr(
        "o_orderkey AS doc",
        "to_json(named_struct('order', named_struct('key', o_orderkey, 'tags', array(o_orderstatus, o_orderpriority), 'steps', array(1, 2, 3, 4)), "
        "'who', named_struct('deep', named_struct('est', array(named_struct('c', o_custkey)), 'flag', true)))) AS body",
    )
    return nested.flatten_json(docs, ["doc"], "body")


@query(
    "explode_stat_groups",
    """WITH g AS (SELECT l_orderkey AS entity, min(l_quantity) AS q1, max(l_quantity) AS q2, min(round(l_discount * 100)) AS a1, max(round(l_discount * 100)) AS a2,
  min(round(l_tax * 100)) AS b1, max(round(l_tax * 100)) AS b2 FROM lineitem GROUP BY 1)
SELECT entity, 'minutes' AS stat, CASE WHEN q1 <> q2 THEN 'conflicting repeat' END AS reason, 'value' AS part, CASE WHEN q1 = q2 THEN q1 END AS value FROM g
UNION ALL SELECT entity, 'passes', CASE WHEN a1 <> a2 OR b1 <> b2 THEN 'conflicting repeat' WHEN a1 > b1 THEN 'numerator exceeds denominator' END, 'value',
  CASE WHEN a1 = a2 AND b1 = b2 AND a1 <= b1 THEN a1 END FROM g
UNION ALL SELECT entity, 'passes', NULL, 'total', b1 FROM g WHERE a1 = a2 AND b1 = b2 AND a1 <= b1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS entity",
        "array(named_struct('name', 'top', 'stats', map('minutes', named_struct('type', 'integer', 'value', l_quantity, 'total', cast(NULL AS double)))), "
        "named_struct('name', 'more', 'stats', map('passes', named_struct('type', 'fraction', 'value', round(l_discount * 100), 'total', round(l_tax * 100)), "
        "'noise', named_struct('type', 'text', 'value', 1D, 'total', cast(NULL AS double))))) AS groups",
    )
    return nested.stat_groups(rows, ["entity"], "groups", ["minutes", "passes"])


@query(
    "flatten_report_sections",
    """WITH s AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier)
SELECT 'attack' AS "group", 'overall' AS section, s_suppkey::VARCHAR AS entity, 'player' AS field, 'identity' AS kind, s_suppkey::VARCHAR AS value FROM s
UNION ALL SELECT 'attack', 'overall', s_suppkey::VARCHAR, 'mins', 'exposure', s_nationkey::VARCHAR FROM s
UNION ALL SELECT 'attack', 'overall', s_suppkey::VARCHAR, 'goals', 'metric', CAST(floor(s_acctbal) AS BIGINT)::VARCHAR FROM s
UNION ALL SELECT 'keeping', 'overall', s_suppkey::VARCHAR, 'player', 'identity', s_suppkey::VARCHAR FROM s
UNION ALL SELECT 'keeping', 'overall', s_suppkey::VARCHAR, 'saves', 'metric', CASE WHEN s_acctbal > 0 THEN s_nationkey::VARCHAR END FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "supplier").selectExpr(
        "map('attack', map('overall', array(map('player', string(s_suppkey), 'mins', string(s_nationkey), 'goals', string(floor(s_acctbal))))), "
        "'keeping', map('overall', array(map('player', string(s_suppkey), 'saves', IF(s_acctbal > 0, string(s_nationkey), NULL))))) AS doc"
    )
    return nested.report_sections(docs, "doc", ["player"], ["mins"])


@query(
    "explode_table_panels",
    """WITH o AS (SELECT o_orderkey AS sample, o_custkey::VARCHAR AS entity, o_orderstatus AS s, CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE '2' END AS acc,
  o_orderpriority = '5-LOW' AS short, CAST(floor(o_totalprice) AS BIGINT)::VARCHAR AS price FROM orders)
SELECT sample, entity, 'Apps' AS field, '3' AS cell, short AS mismatch FROM o UNION ALL SELECT sample, entity, 'per_game.summary.SpG', price, FALSE FROM o
UNION ALL SELECT sample, entity, CASE acc WHEN '0' THEN 'per_game.' WHEN '1' THEN 'per_90.' ELSE '' END || 'shots.Total', CASE WHEN short THEN NULL ELSE price END, short FROM o
UNION ALL SELECT sample, entity, 'Rating', '7', FALSE FROM o""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    link = "concat('/players/', o_custkey, '/show')"
    acc = "CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE '2' END"
    price = "string(floor(o_totalprice))"
    panels = load(spark, sf, "orders").selectExpr(
        "o_orderkey AS sample",
        f"inline(array(named_struct('panel', 'stats-detailed', 'category', 'shots', 'accumulation', {acc}, 'headers', array('Player', 'Apps', 'Total'), 'player', {link}, "
        f"'cells', IF(o_orderpriority = '5-LOW', array('n', '3'), array('n', '3', {price}))), "
        f"named_struct('panel', 'stats-summary', 'category', cast(NULL AS string), 'accumulation', cast(NULL AS string), 'headers', array('Player', '', 'SpG', 'Rating'), 'player', {link}, "
        f"'cells', array('n', 'x', {price}, '7'))))",
    )
    return nested.table_panels(panels, ["sample"])


def _decoded_sql(text: str) -> str:
    for name, sign in pages.REFERENCES.items():
        text = f"replace({text}, '&{name};', '{sign.replace(chr(39), chr(39) * 2)}')"
    return f"replace({text}, '&amp;', '&')"


_TAGS = r"'(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<[a-z/!?][^>]*>', chr(1), 'g'"
_TRIM = r"'^\s+|\s+$', '', 'g'"
_LINK = r"""'(?is)<a\b[^>]*?\shref="([^"]*)"[^>]*>(.*?)</a>'"""


# The bound pages hold links and text only; rows and options are compared by the queries that use them.
@query(
    "html_extract",
    f"""WITH piece AS (SELECT page_id, list_transform(string_split(regexp_replace(html, {_TAGS}), chr(1)), lambda x: regexp_replace({_decoded_sql("x")}, {_TRIM})) AS t FROM pages),
link AS (SELECT page_id, unnest(regexp_extract_all(html, {_LINK}, 1)) AS value, unnest(regexp_extract_all(html, {_LINK}, 2)) AS inner_html FROM pages),
found AS (
  SELECT page_id, 'text' AS kind, CAST(NULL AS VARCHAR) AS value, array_to_string(list_filter(t, lambda x: x <> ''), ' ') AS text FROM piece
  UNION ALL
  SELECT page_id, 'link', {_decoded_sql("value")},
    regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(inner_html, {_TAGS}), chr(1)), lambda x: {_decoded_sql("x")}), lambda x: x <> ''), ' '), {_TRIM}) FROM link)
SELECT page_id, kind, CAST(NULL AS INTEGER) AS table_no, CAST(NULL AS INTEGER) AS row_no, value, text, CAST(NULL AS VARCHAR[]) AS cells, CAST(NULL AS VARCHAR[]) AS headings FROM found""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract(load(spark, sf, "pages"), "page_id", "html")


@query(
    "html_links",
    """WITH l AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS a FROM pages)
SELECT page_id, unnest(range(0, len(a))) AS n, unnest(a) AS href FROM l""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pages.links(load(spark, sf, "pages"), "page_id", "html")


@query(
    "html_text_length",
    r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>', '', 'gs'), '<!--.*?-->|<[^>]*>', '', 'gs') AS t FROM pages)
SELECT page_id, length(regexp_replace(replace(replace(replace(replace(t, '&amp;', '&'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '[\s ]', '', 'g')) > 0 AS has_text FROM h""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = pages.extract(load(spark, sf, "pages"), "page_id", "html")
    return e.where("kind = 'text'").select("page_id", (F.length(F.regexp_replace("text", "\\s", "")) > 0).alias("has_text"))


def season_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A navigation page per order: season options of its year and two pagination links."""
    return load(spark, sf, "orders").selectExpr(
        "o_orderkey AS page_id",
        "concat('https://stats', o_custkey, '.example.org/list?page=1') AS url",
        "concat('<select><option value=\"s', year(o_orderdate), '\">', year(o_orderdate), '/', year(o_orderdate) + 1, '</option><option value=\"none\">all</option></select>"
        "<a href=\"/list?page=', IF(o_orderstatus = 'F', 1, 2), '\">next</a><a href=\"https://other.example.org/list?page=2\">away</a><a href=\"/about\">about</a>') AS html",
    )


@query(
    "season_option_discovery",
    """SELECT o_orderkey AS page_id, 's1997' AS option_value, CASE WHEN o_orderstatus <> 'F' THEN 'https://stats' || o_custkey || '.example.org/list?page=2' END AS next_url
FROM orders WHERE year(o_orderdate) = 1997""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = season_pages(spark, sf)
    return pages.season_navigation(pages.extract(p, "page_id", "html"), p, "page_id", "url", "1997/1998", p.select("url").distinct())


@query(
    "asset_metadata_harvest",
    """WITH e AS (SELECT 'p_' || o_custkey AS id, o_orderkey, 'https://cdn.example.org/players/' || lpad(o_orderkey::VARCHAR, 8, '0') || '.webp' AS image_url FROM orders WHERE o_orderstatus <> 'P')
SELECT id, 'N' || max(o_orderkey) AS name, arg_max(image_url, o_orderkey) AS image_url FROM e GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "to_json(named_struct('data', named_struct('home', named_struct('id', concat('p_', o_custkey), 'name', concat('N', o_orderkey), 'image_url', "
        "concat(IF(o_orderstatus = 'P', 'http://bad/', 'https://cdn.example.org/players/'), lpad(o_orderkey, 8, '0'), '.webp')), "
        "'venue', named_struct('id', concat('v_', o_custkey), 'name', 'ground')))) AS body",
    )
    flat = nested.flatten_json(docs, ["o_orderkey"], "body").withColumn("seq", F.col("o_orderkey"))
    return nested.assets(flat, ["o_orderkey"], "seq", "p_", "^https://cdn[.]example[.]org/players/[0-9]{8}[.]webp$")


GOALS = (
    "CASE WHEN o_totalprice < 30000 THEN '-' WHEN o_totalprice < 60000 THEN 'N/A' WHEN o_totalprice < 90000 THEN 'injured' "
    "WHEN o_totalprice < 120000 THEN '0' ELSE '1,250' END"
)


@query(
    "html_table_inventory",
    f"""WITH o AS (SELECT o_orderpriority AS source, o_orderstatus AS league, {GOALS} AS g FROM orders)
SELECT source, 'stats.' || unnest(['Player', 'Club', 'Goals']) AS field, league, count(*) AS records,
  CASE WHEN league = 'P' THEN 0 ELSE unnest([count(*), 0, count(*) FILTER (g IN ('-', '0', '1,250'))]) END AS numeric,
  CASE WHEN league = 'P' THEN 0 ELSE unnest([0, 0, count(*) FILTER (g = 'N/A')]) END AS missing,
  CASE WHEN league = 'P' THEN 0 ELSE unnest([0, count(*), count(*) FILTER (g = 'injured')]) END AS categorical,
  CASE WHEN league = 'P' THEN count(*) ELSE 0 END AS invalid,
  CASE WHEN league = 'P' THEN 0 ELSE unnest([count(*) FILTER (FALSE), 0, count(*) FILTER (g IN ('-', '0'))]) END AS zero FROM o GROUP BY source, league""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    snaps = load(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "o_orderpriority AS source",
        "o_orderstatus AS league",
        "concat('<table><tr><th>Player</th><th>Club</th><th>Goals</th><th>More</th></tr><tr><td title=\"t\">', o_orderkey + 1, '</td><td><img alt=\"club\"/></td><td>', "
        f"{GOALS}, '</td>', IF(o_orderstatus = 'P', '', '<td>x</td>'), '</tr></table>') AS html",
    )
    # Every snapshot is stored twice; repeats must not count.
    doubled = snaps.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr(
        "o_orderkey * 2 + copy AS page_id", "source", "'stats' AS page", "league", "html", "sha2(html, 256) AS digest"
    )
    return pages.table_inventory(pages.extract(doubled, "page_id", "html"), doubled.drop("html"), "page_id")


@query(
    "panel_inventory",
    """SELECT o_orderpriority AS league, count(DISTINCT o_custkey) AS entities, count(DISTINCT o_orderstatus) AS columns, max(CAST(floor(o_totalprice) AS BIGINT)) AS announced FROM orders GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    cells = load(spark, sf, "orders").selectExpr(
        "o_orderpriority AS league", "o_custkey AS entity", "o_orderstatus AS field",
        "concat('Page 1/3 | Showing 1 - 10 of ', floor(o_totalprice)) AS text",
    )
    return nested.panel_inventory(cells)


# --- Other report layouts ---------------------------------------------------------------------------
@query(
    "report_player_totals",
    """WITH p AS (SELECT s_suppkey::VARCHAR AS entity, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey > 0),
f AS (SELECT entity, unnest(['id', 'player_name', 'time', 'xG', 'note', 'goals']) AS path,
  unnest([entity, s_name, s_nationkey::VARCHAR, CAST(floor(s_acctbal) AS BIGINT)::VARCHAR || '.5', CASE WHEN s_acctbal > 0 THEN 'n/a' END, (s_nationkey % 3)::VARCHAR]) AS value FROM p)
SELECT (entity::INT % 5) AS league, entity, 'aggregate' AS sample, 'players.' || path AS field, CASE WHEN path IN ('id', 'player_name') THEN 'identity' WHEN path = 'time' THEN 'context' ELSE 'metric' END AS kind,
  'aggregate' AS scope, value, CASE WHEN value IS NULL THEN 'missing' WHEN path IN ('id', 'player_name', 'note') THEN 'categorical' ELSE 'numeric' END AS status FROM f""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Season reports of five leagues, numbers as text, as one source gives them."""
    player = "named_struct('id', string(s_suppkey), 'player_name', s_name, 'time', string(s_nationkey), 'xG', concat(floor(s_acctbal), '.5'), 'note', IF(s_acctbal > 0, 'n/a', NULL), 'goals', s_nationkey % 3)"
    docs = load(spark, sf, "supplier").selectExpr("s_suppkey % 5 AS league", f"{player} AS p").groupBy("league").agg(
        F.to_json(F.struct(F.collect_list("p").alias("players")), {"ignoreNullFields": "false"}).alias("body")
    )
    return nested.player_totals(docs, ["league"], "body", ["id", "player_name"], ["games", "time"], "time")


@query(
    "report_shot_events",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_discount, l_tax, l_returnflag FROM lineitem),
f AS (SELECT l_orderkey, l_suppkey::VARCHAR AS entity, l_orderkey || ':s' || l_linenumber AS sample, unnest(['id', 'player.id', 'player.name', 'xg', 'on.target', 'team_id', 'blocked']) AS path,
  unnest(['s' || l_linenumber, l_suppkey::VARCHAR, 'P' || l_suppkey, CASE WHEN l_tax > 0.01 THEN CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) END, CAST(l_returnflag = 'R' AS VARCHAR), '7', '']) AS value FROM l)
SELECT l_orderkey % 4 AS league, entity, sample, 'shot.' || path AS field, CASE WHEN path IN ('id', 'player.id', 'player.name', 'team_id') THEN 'identity' ELSE 'event' END AS kind, 'event' AS scope, value,
  CASE WHEN value IS NULL OR value = '' THEN 'missing' WHEN path IN ('xg', 'team_id') THEN 'numeric' ELSE 'categorical' END AS status FROM f""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A shot report per match: odd lines in the first period, even ones in the second."""
    shot = (
        "named_struct('id', concat('s', l_linenumber), 'player', named_struct('id', string(l_suppkey), 'name', concat('P', l_suppkey)), 'xg', IF(l_tax > 0.01, int(round(l_discount * 100)), NULL), "
        "'on', named_struct('target', l_returnflag = 'R'), 'team_id', 7, 'blocked', '')"
    )
    period = lambda odd: f"named_struct('shots', collect_list(IF(l_linenumber % 2 = {odd}, {shot}, NULL)))"
    docs = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.expr(f"array({period(1)}, {period(0)}) AS periods"))
    docs = docs.select((F.col("l_orderkey") % 4).alias("league"), "l_orderkey", F.to_json(F.struct("periods"), {"ignoreNullFields": "false"}).alias("body"))
    return nested.shot_events(docs, ["league"], "l_orderkey", "body")


@query(
    "report_match_statistics",
    """WITH o AS (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice / 20000) AS INT) AS n, CAST(floor(o_totalprice / 30000) AS INT) AS d, o_orderstatus = 'F' AS played FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT o_orderkey, o_custkey::VARCHAR AS entity, unnest(['minutes_played.type', 'minutes_played.value', 'duels.type', 'duels.value', 'duels.total', 'duels.calculated_percentage', 'rating_title.value']) AS path,
  unnest(['integer', '90', 'fractionWithPercentage', n::VARCHAR, d::VARCHAR, NULL, 'good']) AS value, n, d, played FROM o),
g AS (SELECT o_orderkey, entity, 'stats.' || path AS field, CASE WHEN path IN ('minutes_played.type', 'minutes_played.value', 'duels.type') THEN 'context' ELSE 'metric' END AS kind, 'appearance' AS scope,
  CASE WHEN path = 'duels.calculated_percentage' AND d > 0 AND n <= d THEN 'x' ELSE value END AS value,
  CASE WHEN path = 'duels.value' AND n > d THEN 'invalid' WHEN path = 'duels.calculated_percentage' THEN CASE WHEN d > 0 AND n <= d THEN 'numeric' WHEN d = 0 AND n = 0 THEN 'na' ELSE 'invalid' END
    WHEN path LIKE '%.type' OR value = 'good' THEN 'categorical' ELSE 'numeric' END AS status, n, d FROM f WHERE played
  UNION ALL SELECT o_orderkey, o_custkey::VARCHAR, 'metadata.' || unnest(['player.id', 'player.name', 'team_id']), 'identity', 'identity', unnest([o_custkey::VARCHAR, 'N' || o_custkey, '3']), unnest(['categorical', 'categorical', 'numeric']), n, d FROM o WHERE played)
SELECT o_orderkey % 3 AS league, entity, o_orderkey::VARCHAR AS sample, field, kind, scope, CASE WHEN value = 'x' THEN NULL ELSE value END AS value, CASE WHEN value = 'x' THEN round(100.0 * n / d, 6) END AS percentage, status FROM g""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A report per match with one player, who did not play in open matches."""
    stat = lambda key, inner: f"named_struct('key', '{key}', 'stat', {inner})"
    body = (
        "to_json(array(named_struct('player', named_struct('id', string(o_custkey), 'name', concat('N', o_custkey)), 'team_id', 3, 'stats', array(named_struct('title', 'top', 'stats', named_struct("
        + "'Minutes', " + stat("minutes_played", "named_struct('type', 'integer', 'value', IF(o_orderstatus = 'F', 90, 0))")
        + ", 'Duels', " + stat("duels", "named_struct('type', 'fractionWithPercentage', 'value', int(floor(o_totalprice / 20000)), 'total', int(floor(o_totalprice / 30000)))")
        + ", 'Rating', " + stat("rating_title", "named_struct('value', 'good')") + ")))))) AS body"
    )
    docs = load(spark, sf, "orders").where("o_orderstatus <> 'P'").selectExpr("o_orderkey % 3 AS league", "o_orderkey", body)
    out = nested.match_statistics(docs, ["league"], "o_orderkey", "body")
    percent = F.col("field").endswith("calculated_percentage")
    return out.withColumn("percentage", F.when(percent, F.round(F.col("value").try_cast("double"), 6))).withColumn("value", F.when(~percent, F.col("value")))


@query(
    "embedded_json_inventory",
    """WITH o AS (SELECT o_custkey % 50 AS id, o_orderkey, o_orderstatus AS s, o_totalprice AS t FROM orders WHERE o_orderstatus <> 'P')
SELECT unnest(['id', 'name', 'stats.goals', 'stats.rank', 'tags[]']) AS field, unnest([count(DISTINCT id), count(DISTINCT id), count(DISTINCT id), count(DISTINCT id), count(DISTINCT id)]) AS entities,
  unnest([count(DISTINCT id), 0, count(DISTINCT id) FILTER (t >= 100000), count(DISTINCT id), 0]) AS numeric,
  unnest([count(DISTINCT id) FILTER (id = 0), 0, count(DISTINCT id) FILTER (t >= 100000 AND t < 200000), 0, 0]) AS zero,
  unnest([0, 0, count(DISTINCT id) FILTER (t < 100000), 0, 0]) AS missing FROM o""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a data script whose strings hold brackets; those of open seasons do not count."""
    row = "named_struct('id', o_custkey % 50, 'name', 'A }]\" b', 'stats', named_struct('goals', CASE WHEN o_totalprice >= 200000 THEN 2 WHEN o_totalprice >= 100000 THEN 0 END, 'rank', 5), 'tags', array('w', 'x', 'y', 'z'))"
    data = (
        "named_struct('currentSeasonId', IF(o_orderstatus = 'P', 8, 9), 'seasons', array(named_struct('id', '8', 'name', '2024/2025'), named_struct('id', '9', 'name', '2025/2026')), "
        f"'statsData', array({row}))"
    )
    html = f"concat('<html><script>var a = \"{{\";</script><script id=\"__NEXT_DATA__\" type=\"application/json\">', to_json(named_struct('props', {data}), map('ignoreNullFields', 'false')), '</script><p>after</p></html>') AS html"
    raw = load(spark, sf, "orders").selectExpr("o_orderkey AS page_id", html)
    bodies = pages.embedded_json(raw, "page_id", "html", script_id="__NEXT_DATA__")
    return pages.embedded_inventory(bodies, "page_id", "props.statsData", "id", "props.currentSeasonId", "props.seasons", "2025/2026")
