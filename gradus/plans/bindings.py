"""Domain views over the given tables: entities, cells, named records, appearances, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import POSITION_WEIGHTS, Ability, Feature, Model
from ..operators import standardize as S


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """One row per ordering customer: exposure, counts, cohort labels.

    Lines are reduced per order before they meet the orders, so the join moves one row per
    order and reuses the aggregate's partitioning.
    """
    lines = (
        load(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("minutes"),
            F.count("*").alias("shots"),
            F.count_if(F.col("l_returnflag") == "R").alias("np_goals"),
            F.count_if(F.col("l_returnflag") != "N").alias("on_target"),
            F.sum("l_discount").alias("xg"),
            F.sum("l_tax").alias("tax"),
            F.count_if(F.col("l_linestatus") == "O").alias("open_items"),
        )
    )
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    per_customer = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(
            F.sum("minutes").alias("minutes"),
            F.sum("shots").alias("shots"),
            F.sum("np_goals").alias("np_goals"),
            F.sum("on_target").alias("on_target"),
            F.round(F.sum("xg"), 2).alias("xg"),
            F.round(F.sum("tax"), 2).alias("tax_total"),
            F.sum("open_items").alias("open_items"),
            F.count("*").alias("matches"),
        )
    )
    geo = (
        load(spark, sf, "nation")
        .join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.col("r_name").alias("league"))
    )
    return (
        load(spark, sf, "customer")
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("player"),
            F.col("c_name").alias("name"),
            F.col("c_nationkey").alias("team"),
            "league",
            F.col("c_mktsegment").alias("role"),
            F.when(F.col("c_acctbal") >= 0, (F.floor(F.col("c_acctbal") / 500) + 16).cast("int")).alias("age"),
            F.when(F.col("c_nationkey") < 8, "left")
            .when(F.col("c_nationkey") < 18, "right")
            .when(F.col("c_nationkey") < 22, "both")
            .alias("foot"),
            F.when(F.col("c_acctbal") > 6000, True).when(F.col("c_acctbal") > 3000, False).alias("high_line"),
            "minutes",
            "shots",
            "np_goals",
            "on_target",
            "xg",
            F.when(F.col("league") != "AFRICA", F.col("tax_total")).alias("tax"),
            "open_items",
            "matches",
            F.round(F.col("np_goals") - F.col("xg"), 2).alias("finishing"),
        )
    )


ENTITIES_SQL = """
b1 AS (
  SELECT c_custkey AS player, c_name AS name, c_nationkey AS team, r_name AS league, c_mktsegment AS role,
    CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 500) + 16 AS INTEGER) END AS age,
    CASE WHEN c_nationkey < 8 THEN 'left' WHEN c_nationkey < 18 THEN 'right' WHEN c_nationkey < 22 THEN 'both' END AS foot,
    CASE WHEN c_acctbal > 6000 THEN TRUE WHEN c_acctbal > 3000 THEN FALSE END AS high_line,
    sum(l_quantity) AS minutes, count(*) AS shots,
    count(*) FILTER (l_returnflag = 'R') AS np_goals, count(*) FILTER (l_returnflag <> 'N') AS on_target,
    round(sum(l_discount), 2) AS xg,
    CASE WHEN r_name <> 'AFRICA' THEN round(sum(l_tax), 2) END AS tax,
    count(*) FILTER (l_linestatus = 'O') AS open_items, count(DISTINCT o_orderkey) AS matches,
    round(count(*) FILTER (l_returnflag = 'R') - round(sum(l_discount), 2), 2) AS finishing
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY c_custkey, c_name, c_nationkey, r_name, c_mktsegment, c_acctbal
)"""

FEATURES = (
    Feature("goals90", "np_goals"),
    Feature("xg90", "xg"),
    Feature("finish90", "finishing"),
    Feature("shots90", "shots"),
    Feature("sot_pct", "on_target", "shots", "%"),
    Feature("goals_per_shot", "np_goals", "shots", "ratio"),
    Feature("xg_per_shot", "xg", "shots", "ratio"),
    Feature("matches90", "matches", direction=0),
    Feature("open90", "open_items", direction=-1),
    Feature("tax90", "tax"),
)
ABILITIES = (
    Ability("FIN", 0.27, {"goals90": 0.5, "finish90": 0.3, "goals_per_shot": 0.2}),
    Ability("BOX", 0.20, {"shots90": 0.6, "xg90": 0.4}),
    Ability("LNK", 0.17, {"sot_pct": 0.6, "xg_per_shot": 0.4}),
    Ability("CAR", 0.14, {"shots90": 0.5, "matches90": 0.2, "open90": 0.3}),
    Ability("PHY", 0.12, {"tax90": 0.5, "xg90": 0.5}),
    Ability("DEF", 0.10, {"open90": 0.7, "goals90": 0.3}),
)


def model(minimum_peers: int = 30, minimum_exposure: float = 900) -> Model:
    return Model(FEATURES, ABILITIES, minimum_exposure, minimum_peers)


def features_sql(provider: str = "'one'", special: dict[str, str] | None = None) -> str:
    """Long features of the entities: one row per (player, key); ``special`` names other providers by key."""
    rows = [
        f"SELECT player, role, league, minutes, {(special or {}).get(f.key, provider)} AS provider, '{f.key}' AS key, CAST({f.numerator} AS DOUBLE) AS num, "
        f"CAST({f.denominator} AS DOUBLE) AS den, CAST({f.scale} AS DOUBLE) AS scale, CAST({f.prior} AS DOUBLE) AS k, "
        f"{f.direction} AS dir, '{f.denominator}' AS den_key FROM b1"
        for f in FEATURES
    ]
    return (
        "feats AS (SELECT *, CASE WHEN num IS NOT NULL AND den > 0 THEN num / den * scale END AS value, "
        "CASE WHEN num IS NULL OR den IS NULL THEN 'unrecorded_zero' WHEN den > 0 THEN 'observed' "
        "WHEN den_key = 'minutes' THEN 'zero_exposure' ELSE 'not_applicable_zero_attempts' END AS status FROM ("
        + " UNION ALL ".join(rows)
        + "))"
    )


#: The registry position whose weights each bound segment takes, and segments whose features weigh the other way round.
SEGMENT_POSITIONS = {"AUTOMOBILE": "ST", "BUILDING": "GK", "FURNITURE": "CM", "HOUSEHOLD": "CAM", "MACHINERY": "CB"}
TURNED = ("BUILDING", "HOUSEHOLD")


def registry(minimum_peers: int = 30, minimum_exposure: float = 900) -> dict[str, Model]:
    """A model per segment: overall weights by position, feature weights of some turned round."""
    out = {}
    for segment, position in SEGMENT_POSITIONS.items():
        abilities = tuple(
            Ability(a.name, w, dict(zip(a.weights, list(a.weights.values())[:: -1 if segment in TURNED else 1])))
            for a, w in zip(ABILITIES, POSITION_WEIGHTS[position])
        )
        out[segment] = Model(FEATURES, abilities, minimum_exposure, minimum_peers)
    return out


def position_registry_sql() -> str:
    rows = [
        f"('{segment}', '{a.name}', CAST({a.overall_weight} AS DOUBLE), '{k}', CAST({w} AS DOUBLE))"
        for segment, m in registry().items()
        for a in m.abilities
        for k, w in a.weights.items()
    ]
    return f"registry(role, ability, overall_weight, key, weight) AS (VALUES {', '.join(rows)})"


def registry_sql() -> str:
    rows = [
        f"('{a.name}', CAST({a.overall_weight} AS DOUBLE), '{k}', CAST({w} AS DOUBLE))"
        for a in ABILITIES
        for k, w in a.weights.items()
    ]
    return f"registry(ability, overall_weight, key, weight) AS (VALUES {', '.join(rows)})"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Master cells: entity row, column, ordered source, value, sample."""
    return load(spark, sf, "orders").select(
        F.col("o_custkey").alias("master_row"),
        F.col("o_orderstatus").alias("column_id"),
        F.col("o_orderpriority").alias("provider"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("sample"),
    )


CELLS_SQL = """
b2 AS (SELECT o_custkey AS master_row, o_orderstatus AS column_id, o_orderpriority AS provider,
       o_totalprice AS value, o_orderkey AS sample FROM orders)"""

# The positions of the bound entities.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

# Source priority of the bound cells, best first.
PRIORITY = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def named(spark: SparkSession, sf: str) -> DataFrame:
    """Named records: row id, name, league, provider."""
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("row"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("league"),
        F.col("p_type").alias("provider"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


NAMED_SQL = """
b3 AS (SELECT p_partkey AS row, p_name AS name, p_brand AS league, p_type AS provider, p_size AS size,
       p_retailprice AS price FROM part)"""


def appearances(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as appearances of suppliers in dated matches."""
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return (
        load(spark, sf, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("match"),
            F.col("o_orderdate").alias("match_date"),
            F.col("o_orderstatus").alias("match_status"),
            F.col("l_suppkey").alias("player"),
            F.col("l_partkey").alias("team"),
            F.col("l_linenumber").alias("slot"),
            F.col("l_quantity").alias("minutes"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("xg"),
            F.col("l_tax").alias("tax"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            F.col("l_shipdate").alias("retrieved"),
        )
    )


APPEARANCES_SQL = """
b5 AS (SELECT l_orderkey AS match, o_orderdate AS match_date, o_orderstatus AS match_status, l_suppkey AS player,
       l_partkey AS team, l_linenumber AS slot, l_quantity AS minutes, l_extendedprice AS price, l_discount AS xg,
       l_tax AS tax, l_returnflag AS flag, l_linestatus AS status, l_shipdate AS retrieved
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ROLE_Z = """u AS (SELECT user_id, event_type AS role, sum(value) AS v FROM events GROUP BY 1, 2),
rz AS (SELECT user_id, role, round((v - avg(v) OVER c) / stddev_pop(v) OVER c, 6) AS z FROM u WINDOW c AS (PARTITION BY role))"""


def role_z(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's z in every event type."""
    u = load(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("role")).agg(F.sum("value").alias("v"))
    return S.zscores(u, ["role"], "v").select("user_id", "role", F.round("z", 6).alias("z"))
