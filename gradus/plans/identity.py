"""Join, identity, interval and familiarity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import club_key, nfkd_key, plain_key
from ..operators import familiarity as P
from ..operators import identity as J
from ..operators import intervals as I
from ..operators import rating as R
from .aggregates import LINEUPS_SQL, lineups
from .bindings import APPEARANCES_SQL, ENTITIES_SQL, FEATURES, NAMED_SQL, appearances, entities, features_sql, load, named
from .registry import query

KEY_SQL = r"regexp_replace(strip_accents(replace(lower({c}), 'ß', 'ss')), '[^\p{{L}}\p{{N}}]', '', 'g')"

REPORTS_SQL = """
base AS (SELECT o_custkey AS player, o_orderstatus AS team, count(*) AS minutes FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
keep AS (SELECT o_custkey AS player, o_orderstatus AS team, count(*) AS minutes FROM orders WHERE o_totalprice > 300000 GROUP BY 1, 2),
rows0 AS (SELECT * FROM base UNION ALL SELECT k.* FROM keep k LEFT JOIN base b ON k.player = b.player AND k.team = b.team WHERE b.player IS NULL),
att AS (SELECT o_custkey AS player, o_orderstatus AS team, count(*) AS minutes, max(o_totalprice) AS best FROM orders GROUP BY 1, 2),
pas AS (SELECT o_custkey AS player, o_orderstatus AS team, count(*) AS minutes, min(o_totalprice) AS worst FROM orders WHERE o_totalprice > 40000 GROUP BY 1, 2)"""


@query(
    "multi_report_join",
    f"""WITH {REPORTS_SQL}
SELECT r.player, r.team, r.minutes, best, worst, concat_ws(';', CASE WHEN a.player IS NOT NULL AND a.minutes <> r.minutes THEN 'attack exposure' END,
  CASE WHEN p.player IS NOT NULL AND p.minutes <> r.minutes THEN 'passing exposure' END) AS reasons
FROM rows0 r LEFT JOIN att a ON a.player = r.player AND a.team = r.team LEFT JOIN pas p ON p.player = r.player AND p.team = r.team""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").selectExpr("o_custkey AS player", "o_orderstatus AS team", "o_totalprice AS price")
    counted = lambda df, *m: df.groupBy("player", "team").agg(F.count("*").alias("minutes"), *m)
    rows, _ = J.multi_report_join(
        counted(orders.where("team <> 'P'")),
        counted(orders.where("price > 300000")),
        {
            "attack": (counted(orders, F.max("price").alias("best")), ["best"]),
            "passing": (counted(orders.where("price > 40000"), F.min("price").alias("worst")), ["worst"]),
        },
        ["player", "team"],
        "minutes",
    )
    return rows.withColumn("reasons", F.array_join("reasons", ";"))


@query(
    "appearance_assembly",
    f"""WITH {APPEARANCES_SQL},
pl AS (SELECT match, player, min(team) AS team, sum(minutes) AS minutes, sum(CASE WHEN tax > 0 THEN price END) AS touches FROM b5 WHERE flag <> 'R' OR slot < 4 GROUP BY 1, 2),
adv AS (SELECT match, player, min(team) AS team, sum(minutes) AS minutes, sum(price) AS touches FROM b5 WHERE flag = 'A' GROUP BY 1, 2),
sh AS (SELECT match, player, count(*) AS shots, sum(xg) AS xg, min(team) AS lo, max(team) AS hi FROM b5 WHERE flag = 'R' GROUP BY 1, 2),
j AS (SELECT pl.match, pl.player, pl.team, coalesce(pl.minutes, adv.minutes) AS minutes, coalesce(pl.touches, adv.touches) AS touches, coalesce(shots, 0) AS shots,
  coalesce(xg, 0) AS xg, coalesce(adv.team <> pl.team, FALSE) OR coalesce(lo <> pl.team OR hi <> pl.team, FALSE) OR NOT coalesce(coalesce(pl.minutes, adv.minutes) BETWEEN 0.0001 AND 130, FALSE) AS bad
  FROM pl LEFT JOIN adv USING (match, player) LEFT JOIN sh USING (match, player)),
rej AS (SELECT match FROM j WHERE bad UNION SELECT match FROM (SELECT match, player FROM adv UNION SELECT match, player FROM sh) e WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.match = e.match AND pl.player = e.player))
SELECT match, player, team, minutes, round(touches, 2) AS touches, shots, round(xg, 2) AS xg, match IN (SELECT match FROM rej) AS rejected FROM j""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    kinds = "IF(flag <> 'R' OR slot < 4, 'players', NULL), IF(flag = 'A', 'advanced', NULL), IF(flag = 'R', 'shots', NULL)"
    rows = appearances(spark, sf).selectExpr("match", "player", "team", "minutes", "price", "tax", "xg", f"explode(array_compact(array({kinds}))) AS report")
    out = J.assemble_appearances(rows.withColumn("touches", F.expr("CASE WHEN report <> 'players' OR tax > 0 THEN price END")))
    return out.withColumn("touches", F.round("touches", 2)).withColumn("xg", F.round("xg", 2))


@query(
    "fixture_scoped_shots",
    f"""WITH {APPEARANCES_SQL}, s AS (SELECT player, count(*) AS n, sum(xg) FILTER (flag <> 'A') AS npxg_sum, sum(xg) FILTER (status = 'O') AS open_play_xg FROM b5 WHERE match_status = 'F' GROUP BY 1),
t AS (SELECT player, count(*) FILTER (match_status = 'F') + max((s_acctbal < 0)::INT) AS shots, round(sum(xg) FILTER (flag <> 'A' AND match_status = 'F') + max(CASE WHEN s_acctbal > 9000 THEN 0.01 ELSE 0 END), 2) AS npxg
  FROM b5 JOIN supplier ON player = s_suppkey GROUP BY 1)
SELECT player, shots, npxg, round(open_play_xg, 2) AS open_play_xg, shots = n AND abs(npxg - npxg_sum) <= 1e-5 * greatest(1, npxg) AS accepted FROM t JOIN s USING (player)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    app = appearances(spark, sf)
    shots = app.selectExpr("match", "player", "xg", "flag = 'A' AS penalty", "status = 'O' AS open_play")
    fixtures = load(spark, sf, "orders").selectExpr("o_orderkey AS match", "o_orderstatus = 'F' AS finished")
    totals = (
        app.where("match_status = 'F'")
        .groupBy("player")
        .agg(F.count("*").alias("shots"), F.expr("sum(CASE WHEN flag <> 'A' THEN xg END) AS npxg"))
        .join(load(spark, sf, "supplier"), F.expr("player = s_suppkey"))
        .selectExpr("player", "shots + int(s_acctbal < 0) AS shots", "round(npxg + IF(s_acctbal > 9000, 0.01D, 0D), 2) AS npxg")
    )
    out = J.scoped_shots(shots, fixtures, totals, "player")
    return out.select("player", "shots", "npxg", F.round("open_play_xg", 2).alias("open_play_xg"), "accepted")


@query("name_key", f"SELECT doc_id, md5({KEY_SQL.format(c='text')}) AS name_key FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.md5(nfkd_key("text").cast("binary")).alias("name_key"))


ALIASES = {"redwidget": "smallring", "bluebolt": "bluenut"}


@query(
    "alias_name_key",
    "WITH k AS (SELECT p_partkey, replace(lower(p_name), ' ', '') AS n FROM part) SELECT p_partkey, CASE n WHEN 'redwidget' THEN 'smallring' WHEN 'bluebolt' THEN 'bluenut' ELSE n END AS name_key FROM k",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    keyed = load(spark, sf, "part").select("p_partkey", plain_key(F.col("p_name")).alias("name_key"))
    return J.alias_key(keyed, "name_key", ALIASES)


@query(
    "name_candidate_groups",
    f"""WITH {NAMED_SQL}, k AS (SELECT *, replace(lower(name), ' ', '') AS name_key FROM b3),
g AS (SELECT league, name_key, count(DISTINCT provider) AS providers, count(*) AS members FROM k GROUP BY 1, 2 HAVING count(DISTINCT provider) > 1)
SELECT league, name_key, provider, row, providers, members FROM k JOIN g USING (league, name_key)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    keyed = named(spark, sf).withColumn("name_key", plain_key(F.col("name")))
    return J.candidate_groups(keyed, ["league", "name_key"], "provider", "row")


RECORD_COLUMNS = (
    "row",
    "provider",
    "league",
    "price AS minutes",
    "CASE WHEN size = 13 THEN NULL ELSE CAST(floor(size / 25.0) AS INT) END AS shots",
    "CASE WHEN size > 40 THEN 1 ELSE 0 END AS non_penalty_goals",
    "CASE WHEN size < 10 THEN NULL ELSE 3 END AS assists",
    "size = 7 OR size = 8 AS keeper",
)
RECORDS_SQL = f"""
rec AS (SELECT {', '.join(RECORD_COLUMNS)}, replace(lower(name), ' ', '') AS name_key,
  CASE WHEN size > 30 THEN 'north' ELSE 'south' END AS club_key FROM b3),
hit AS (SELECT c.row, c.provider, a.row AS anchor FROM rec c JOIN rec a ON a.league = c.league AND a.name_key = c.name_key
  AND a.provider = 'ECONOMY' AND c.provider <> 'ECONOMY' AND a.minutes > 0 AND c.minutes > 0 AND abs(a.minutes::DECIMAL(18, 6) - c.minutes::DECIMAL(18, 6)) <= greatest(45, 0.02 * a.minutes::DECIMAL(18, 6))
  AND CASE WHEN a.keeper THEN a.club_key = c.club_key ELSE
   (a.shots IS NOT NULL AND c.shots IS NOT NULL)::INT + 1 + (a.assists IS NOT NULL AND c.assists IS NOT NULL)::INT >= 2
   AND coalesce(a.shots = c.shots, TRUE) AND a.non_penalty_goals = c.non_penalty_goals AND coalesce(a.assists = c.assists, TRUE) END),
mt AS (SELECT rec.row, rec.provider, count(anchor) AS anchors, CASE WHEN count(anchor) = 1 THEN min(anchor) END AS anchor
  FROM rec LEFT JOIN hit ON rec.row = hit.row WHERE rec.provider <> 'ECONOMY' GROUP BY 1, 2)"""


def matched(spark: SparkSession, sf: str) -> DataFrame:
    n = named(spark, sf)
    records = n.selectExpr("name", "size", *RECORD_COLUMNS).select(
        *[c.split(" AS ")[-1] for c in RECORD_COLUMNS],
        plain_key(F.col("name")).alias("name_key"),
        club_key(F.expr("IF(size > 30, 'North FC', 'South')")).alias("club_key"),
    )
    return J.corroborated(records.where("provider = 'ECONOMY'"), records.where("provider <> 'ECONOMY'"), "row")


@query("corroborated_match", f"WITH {NAMED_SQL}, {RECORDS_SQL} SELECT * FROM mt")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf)


@query(
    "unique_match_accept",
    f"""WITH {NAMED_SQL}, {RECORDS_SQL}, u AS (SELECT *, count(*) OVER (PARTITION BY anchor, provider) AS n FROM mt WHERE anchors = 1)
SELECT row, provider, anchor FROM u WHERE n = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return J.accepted_links(matched(spark, sf), "row")


@query(
    "exposure_corroborated_match",
    f"""WITH {NAMED_SQL}, r AS (SELECT league, row AS id, replace(lower(name), ' ', '') AS name_key, ceil(price / 100) AS minutes, ceil(size / 12.0) AS apps FROM b3 WHERE provider = 'PROMO'),
t AS (SELECT row, league, replace(lower(name), ' ', '') AS name_key, ceil(price / 100) AS minutes, ceil(size / 12.0) AS apps FROM b3 WHERE provider <> 'PROMO'),
j AS (SELECT r.league, r.id, count(t.row) AS n, min(t.row) AS target FROM r LEFT JOIN t USING (league, name_key, minutes, apps) GROUP BY 1, 2)
SELECT league, id, CASE WHEN n = 1 THEN target::VARCHAR ELSE 'source:' || id || '|' || league END AS target, CASE WHEN n = 1 THEN 'corroborated' ELSE 'unresolved' END AS status FROM j""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = named(spark, sf).withColumn("name_key", plain_key(F.col("name"))).selectExpr(
        "*", "ceil(price / 100) AS minutes", "ceil(size / 12.0) AS apps"
    )
    web, known = n.where("provider = 'PROMO'"), n.where("provider <> 'PROMO'")
    return J.exposure_corroborated(
        web.selectExpr("league", "row AS id", "name_key", "minutes", "apps"),
        known.select("row", "league", "name_key"),
        known.selectExpr("row", "minutes AS value"),
        known.selectExpr("row", "apps AS value"),
    )


COMPONENTS_SQL = f"""
WITH RECURSIVE {NAMED_SQL}, k AS (SELECT row, league, 'n' || replace(lower(name), ' ', '') AS key FROM b3 UNION ALL SELECT row, league, 's' || provider || size FROM b3),
g AS (SELECT league, key, min(row) AS hub FROM k GROUP BY 1, 2),
e AS (SELECT DISTINCT row AS a, hub AS b FROM k JOIN g USING (league, key) UNION SELECT DISTINCT hub, row FROM k JOIN g USING (league, key)),
reach AS (SELECT row AS a, row AS b FROM b3 UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)"""


def component_labels(spark: SparkSession, sf: str) -> DataFrame:
    edges = named(spark, sf).select(
        "row",
        "league",
        F.explode(
            F.array(F.concat(F.lit("n"), plain_key(F.col("name"))), F.concat(F.lit("s"), F.col("provider"), F.col("size")))
        ).alias("key"),
    )
    return J.components(edges, "row", ["league", "key"])


@query("identity_components", COMPONENTS_SQL + " SELECT a AS row, min(b) AS label FROM reach GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return component_labels(spark, sf)


@query(
    "canonical_alias_view",
    """WITH a AS (SELECT c_custkey AS original_row, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS canonical_row FROM customer WHERE c_acctbal > 2000)
SELECT o_orderkey, coalesce(canonical_row, o_custkey) AS o_custkey, o_custkey AS original_row FROM orders LEFT JOIN a ON o_custkey = original_row""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    kept = load(spark, sf, "customer").where("c_acctbal > 2000")
    anchors = kept.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("canonical_row"))
    aliases = kept.join(anchors, ["c_nationkey", "c_mktsegment"]).selectExpr("c_custkey AS original_row", "canonical_row")
    return J.alias_view(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), aliases, "o_custkey")


@query(
    "canonical_map",
    f"""WITH {NAMED_SQL}, {RECORDS_SQL}, u AS (SELECT *, count(*) OVER (PARTITION BY anchor, provider) AS n FROM mt WHERE anchors = 1)
SELECT b3.provider, b3.league, b3.row, coalesce('ECONOMY:' || u.anchor, b3.provider || ':' || b3.row) AS canonical_id FROM b3 LEFT JOIN u ON b3.row = u.row AND u.n = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    links = J.accepted_links(matched(spark, sf), "row")
    return J.canonical_map(named(spark, sf), links, "row")


@query(
    "source_row_lookup",
    """WITH h AS (SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal > 7000)
SELECT c_custkey, CASE WHEN count(DISTINCT s_suppkey) = 1 THEN min(s_suppkey) END AS master_row, count(DISTINCT s_suppkey) AS rows FROM h GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    sources = load(spark, sf, "customer").selectExpr("c_custkey", "c_nationkey AS nation")
    rows = load(spark, sf, "supplier").where("s_acctbal > 7000").selectExpr("s_nationkey AS nation", "s_suppkey AS master_row")
    return J.source_row_lookup(sources, rows, "c_custkey", ["nation"])


@query(
    "reviewed_identity_join",
    """WITH m AS (SELECT DISTINCT o_custkey AS player, o_orderpriority AS team FROM orders), r AS (SELECT DISTINCT o_custkey AS player, o_orderpriority AS team FROM orders WHERE o_totalprice > 50000)
SELECT player, count(*) AS teams FROM m LEFT JOIN r USING (player, team) WHERE player IN (SELECT player FROM r) GROUP BY 1 HAVING count(*) = count(r.team)""".replace(
        "LEFT JOIN r USING (player, team) WHERE player IN", "LEFT JOIN r ON m.player = r.player AND m.team = r.team WHERE m.player IN"
    ).replace("SELECT player, count(*) AS teams", "SELECT m.player, count(*) AS teams"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    measured = load(spark, sf, "orders").selectExpr("o_custkey AS player", "o_orderpriority AS team", "o_totalprice")
    return J.reviewed_identities(measured, measured.where("o_totalprice > 50000"), "player")


@query(
    "mask_compatible_peers",
    f"""WITH {ENTITIES_SQL}, {features_sql()},
used AS (SELECT player, key, CASE WHEN minutes > 1000 THEN 'v1' ELSE 'v2' END AS version FROM feats WHERE status = 'observed'),
refs AS (SELECT player AS ref, key, 'v1' AS version FROM feats WHERE status = 'observed' AND minutes >= 900
  UNION ALL SELECT player, key, 'v2' FROM feats WHERE status = 'observed' AND minutes < 1100 AND league <> 'ASIA'),
need AS (SELECT player, count(*) AS n, max(version) AS version, string_agg(key, ',' ORDER BY key) AS sig FROM used GROUP BY 1),
sets AS (SELECT DISTINCT sig, version, n FROM need),
k AS (SELECT sig, version, n, unnest(string_split(sig, ',')) AS key FROM sets),
members AS (SELECT sig, k.version, ref FROM k JOIN refs ON k.key = refs.key AND k.version = refs.version GROUP BY 1, 2, 3 HAVING count(*) = max(n)),
size AS (SELECT sig, version, count(*) AS peers FROM members GROUP BY 1, 2)
SELECT player, coalesce(peers, 0) AS peers FROM need LEFT JOIN size ON need.sig = size.sig AND need.version = size.version""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    long = R.long_features(entities(spark, sf).persist(), FEATURES, ["player", "league", "minutes"]).withColumn("provider", F.lit("p"))
    used = long.where(F.col("status") == "observed").withColumn("version", F.expr("IF(minutes > 1000, 'v1', 'v2')"))
    refs = long.where("minutes >= 900").withColumn("version", F.lit("v1")).unionByName(
        long.where("minutes < 1100 AND league <> 'ASIA'").withColumn("version", F.lit("v2"))
    )
    # Who was measured twice is a reference by either measurement.
    found = R.compatible_peers(used, refs.withColumnRenamed("player", "ref"), "player", ["ref", "version"], [f.key for f in FEATURES])
    return found.signatures.join(found.counts(), "signature").select("player", "peers")


@query(
    "roster_left_mapping",
    f"""WITH {NAMED_SQL}, o AS (SELECT name, count(*) AS options, count(*) FILTER (provider = 'ECONOMY') AS primaries, min(row) FILTER (provider = 'ECONOMY') AS pr, min(row) AS anyone FROM b3 WHERE size > 44 GROUP BY 1)
SELECT b3.row, name, CASE WHEN primaries = 1 THEN pr WHEN options = 1 THEN anyone END AS mapped_id, coalesce(options, 0) AS options FROM b3 LEFT JOIN o USING (name)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = named(spark, sf)
    catalogue = n.where("size > 44").selectExpr("name", "row AS id", "provider")
    return J.roster_mapping(n.select("row", "name"), catalogue, "name", F.col("provider") == "ECONOMY")


TENURE_SQL = """
t AS (SELECT user_id AS player, event_type AS club, ts::DATE AS s, ts::DATE + CAST(ceil(value / 20) AS INT) AS e FROM events),
pairs AS (SELECT DISTINCT least(a.user_id, b.user_id) AS player_a, greatest(a.user_id, b.user_id) AS player_b FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.user_id <> b.user_id)"""


def user_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Users of consecutive events: a given list of pairs, linear in the events."""
    e = load(spark, sf, "events").select("event_id", "user_id")
    return (
        e.join(e.selectExpr("event_id - 1 AS event_id", "user_id AS other"), "event_id")
        .where("user_id <> other")
        .selectExpr("least(user_id, other) AS player_a", "greatest(user_id, other) AS player_b")
        .distinct()
    )


@query(
    "tenure_overlap_days",
    f"""WITH {TENURE_SQL}, d AS (SELECT DISTINCT player, club, unnest(generate_series(s, e - 1, INTERVAL 1 DAY)) AS day FROM t),
x AS (SELECT player_a, player_b, count(DISTINCT a.day) AS days FROM pairs JOIN d a ON a.player = player_a JOIN d b ON b.player = player_b AND a.club = b.club AND a.day = b.day GROUP BY 1, 2)
SELECT player_a, player_b, coalesce(days, 0) AS days FROM pairs LEFT JOIN x USING (player_a, player_b)""".replace("e - 1", "e - INTERVAL 1 DAY"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    tenures = load(spark, sf, "events").selectExpr(
        "user_id AS player", "event_type AS club", "date(ts) AS start", "date_add(date(ts), int(ceil(value / 20))) AS end"
    )
    return I.shared_days(tenures, user_pairs(spark, sf))


EDGES = [(1, 2), (2, 3), (3, 4), (1, 4)]


@query(
    "concurrent_minutes",
    f"""WITH {LINEUPS_SQL}, edges(slot_a, slot_b) AS (VALUES (1, 2), (2, 3), (3, 4), (1, 4)),
pairs AS (SELECT DISTINCT a.lineup AS match, least(a.player, b.player) AS player_a, greatest(a.player, b.player) AS player_b FROM edges JOIN lineups a ON a.slot = slot_a JOIN lineups b ON b.lineup = a.lineup AND b.slot = slot_b),
m AS (SELECT DISTINCT l_orderkey AS match, l_suppkey AS player, unnest(range(l_quantity::INT, l_quantity::INT + 10 * l_linenumber)) AS minute FROM lineitem),
bad AS (SELECT DISTINCT l_orderkey AS match, l_suppkey AS player FROM lineitem WHERE l_quantity > 48 AND l_linenumber = 2),
x AS (SELECT p.match, player_a, player_b, count(*) AS minutes FROM pairs p JOIN m a ON a.match = p.match AND a.player = player_a JOIN m b ON b.match = p.match AND b.player = player_b AND a.minute = b.minute GROUP BY 1, 2, 3)
SELECT p.match, p.player_a, p.player_b, CASE WHEN b.match IS NULL THEN coalesce(minutes, 0) END AS minutes, CASE WHEN b.match IS NULL THEN 'ok' ELSE 'invalid interval' END AS status
FROM pairs p LEFT JOIN x ON x.match = p.match AND x.player_a = p.player_a AND x.player_b = p.player_b
LEFT JOIN (SELECT DISTINCT p.match, player_a, player_b FROM pairs p JOIN bad ON bad.match = p.match AND player IN (player_a, player_b)) b
  ON b.match = p.match AND b.player_a = p.player_a AND b.player_b = p.player_b""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    intervals = load(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS match",
        "l_suppkey AS player",
        "int(l_quantity) AS start",
        # Some second lines reach past the match and must be refused.
        "int(l_quantity) + IF(l_quantity > 48 AND l_linenumber = 2, 120, 10 * l_linenumber) AS end",
    )
    pairs = J.edge_pairs(lineups(spark, sf), EDGES).withColumnRenamed("lineup", "match")
    return I.concurrent_minutes(intervals, pairs)


@query(
    "edge_pair_lookup",
    f"""WITH {LINEUPS_SQL}, edges(slot_a, slot_b) AS (VALUES (1, 2), (2, 3), (3, 4), (1, 4))
SELECT a.lineup, slot_a, slot_b, least(a.player, b.player) AS player_a, greatest(a.player, b.player) AS player_b
FROM edges JOIN lineups a ON a.slot = slot_a JOIN lineups b ON b.lineup = a.lineup AND b.slot = slot_b""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return J.edge_pairs(lineups(spark, sf), EDGES)


PAIRS_SQL = f"""
{LINEUPS_SQL}, edges(slot_a, slot_b) AS (VALUES (1, 2), (2, 3), (3, 4), (1, 4)),
ep AS (SELECT least(a.player, b.player) AS player_a, greatest(a.player, b.player) AS player_b, count(*) AS times
  FROM edges JOIN lineups a ON a.slot = slot_a JOIN lineups b ON b.lineup = a.lineup AND b.slot = slot_b WHERE a.player <> b.player GROUP BY 1, 2),
pp AS (SELECT player_a, player_b, x.s_nationkey = y.s_nationkey AS same_nation, x.s_acctbal > 2000 AS nations_complete,
  CASE WHEN x.s_acctbal < 0 OR y.s_acctbal < 0 THEN NULL ELSE floor(x.s_acctbal / 3000) = floor(y.s_acctbal / 3000) END AS same_language, y.s_acctbal > 5000 AS languages_complete,
  CASE WHEN x.s_acctbal > 8500 THEN NULL ELSE floor(abs(x.s_acctbal - y.s_acctbal) / 10) END AS club_days,
  floor(abs(x.s_acctbal - y.s_acctbal) / 700) AS age_gap, times * 90 AS minutes FROM ep JOIN supplier x ON player_a = x.s_suppkey JOIN supplier y ON player_b = y.s_suppkey),
pm AS (SELECT player_a, player_b, CASE WHEN same_nation THEN 10.0::DOUBLE WHEN nations_complete THEN 0 END AS nationality, CASE WHEN club_days IS NOT NULL THEN least(club_days / 365, 1) * 10 END AS club_tenure,
  CASE WHEN same_language THEN 10.0::DOUBLE WHEN NOT same_language AND languages_complete THEN 0 END AS language, greatest(0, 1 - age_gap / 10) * 10 AS age,
  least(minutes / 1800, 1) * 10 AS shared_minutes FROM pp)"""


def measured_pairs(spark: SparkSession, sf: str) -> DataFrame:
    ep = (
        J.edge_pairs(lineups(spark, sf), EDGES)
        .where("player_a <> player_b")
        .groupBy("player_a", "player_b")
        .agg(F.count("*").alias("times"))
    )
    s = load(spark, sf, "supplier")
    side = lambda p: s.selectExpr(f"s_suppkey AS player_{p}", f"s_nationkey AS n_{p}", f"s_acctbal AS b_{p}")
    pairs = ep.join(side("a"), "player_a").join(side("b"), "player_b").selectExpr(
        "player_a",
        "player_b",
        "array(n_a) AS nations_a",
        "array(n_b) AS nations_b",
        "b_a > 2000 AS nations_complete",
        "IF(b_a < 0, NULL, array(floor(b_a / 3000))) AS languages_a",
        "IF(b_b < 0, NULL, array(floor(b_b / 3000))) AS languages_b",
        "b_b > 5000 AS languages_complete",
        "IF(b_a > 8500, NULL, floor(abs(b_a - b_b) / 10)) AS club_days",
        "floor(abs(b_a - b_b) / 700) AS age_gap",
        "times * 90 AS minutes",
    )
    return P.pair_measures(pairs).select("player_a", "player_b", *P.COMPONENTS)


@query(
    "pair_measures",
    f"WITH {PAIRS_SQL} SELECT player_a, player_b, nationality, round(club_tenure, 6) AS club_tenure, language, round(age, 6) AS age, round(shared_minutes, 6) AS shared_minutes FROM pm",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = measured_pairs(spark, sf)
    return m.select("player_a", "player_b", *[F.round(c, 6).alias(c) for c in P.COMPONENTS])


SCORE_SQL = f"""WITH {PAIRS_SQL}, n AS (SELECT *, (nationality IS NOT NULL)::INT + (club_tenure IS NOT NULL)::INT + (language IS NOT NULL)::INT + 2 AS available FROM pm),
sc AS (SELECT player_a, player_b, available, CASE WHEN available >= 3 THEN
  CAST(round(CAST(round((coalesce(nationality, 0) + coalesce(club_tenure, 0) + coalesce(language, 0) + age + shared_minutes) / available, 9) AS DECIMAL(18, 9)), 2) AS DOUBLE) END AS score FROM n)"""


@query("pair_score", SCORE_SQL + " SELECT player_a, player_b, available, score FROM sc")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.pair_score(measured_pairs(spark, sf)).select("player_a", "player_b", "available", "score")


@query(
    "score_band",
    SCORE_SQL + " SELECT player_a, player_b, CASE WHEN score IS NULL THEN 'unknown' WHEN score <= 3.33 THEN 'red' WHEN score <= 6.66 THEN 'yellow' ELSE 'green' END AS band FROM sc",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.score_band(P.pair_score(measured_pairs(spark, sf))).select("player_a", "player_b", "band")
