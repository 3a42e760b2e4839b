"""The whole catalogue build over two sources derived from the entities."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_key
from ..operators import catalogue as K
from ..session import cut
from .bindings import ENTITIES_SQL, entities, features_sql, model, position_registry_sql, registry, registry_sql
from .rating import ASSIGNED_SQL, COMMON_SQL, SCORES_SQL
from .registry import query

# A second source saw the teams below 15; for teams from 10 on its goal counts differ by one.
SECOND = "team < 15"


def records(spark: SparkSession, sf: str) -> DataFrame:
    e = entities(spark, sf)
    shared = e.withColumn("name_key", plain_key(F.col("name"))).withColumn("club_key", F.lit(None).cast("string")).selectExpr(
        "*", "double(shots) AS _shots", "false AS keeper", "cast(NULL AS int) AS assists"
    )
    main = shared.withColumn("non_penalty_goals", F.col("np_goals")).selectExpr("concat('a', player) AS record", "'alpha' AS provider", "player AS provider_id", "*")
    second = (
        shared.where(SECOND)
        .withColumn("non_penalty_goals", F.expr("np_goals + int(team >= 10)"))
        .withColumn("tax", F.col("xg"))
        .selectExpr("concat('b', player) AS record", "'gamma' AS provider", "player AS provider_id", "*")
        .withColumn("minutes", F.expr("minutes * 1.01"))
    )
    return main.unionByName(second).withColumn("position", F.col("role")).drop("player", "_shots")


BUILD_SQL = (
    SCORES_SQL.replace("{min_peers}", "30")
    .replace(f"WITH {ENTITIES_SQL}, {features_sql()}, {registry_sql()}", "")
    .replace("key || ':' ||", "key || provider || ':' ||")
)
PLAYERS_SQL = f"""
WITH {ENTITIES_SQL.replace('b1 AS (', 'b0 AS (')},
b1 AS (SELECT 'a' || player AS player, * EXCLUDE (player, tax), CASE WHEN league = 'AFRICA' AND team < 10 THEN xg ELSE tax END AS tax, 'alpha' AS prov,
  CASE WHEN league = 'AFRICA' AND team < 10 THEN 'gamma' ELSE 'alpha' END AS tax_prov, CASE WHEN league = 'AFRICA' AND team < 10 THEN minutes * 1.01 ELSE minutes END AS tax_minutes FROM b0
  UNION ALL BY NAME SELECT 'b' || player AS player, * EXCLUDE (player, tax, minutes), minutes * 1.01 AS minutes, xg AS tax, 'gamma' AS prov, 'gamma' AS tax_prov, minutes * 1.01 AS tax_minutes
  FROM b0 WHERE team >= 10 AND team < 15),
{features_sql('prov', {'tax90': 'tax_prov'}).replace("'tax90' AS key, CAST(tax AS DOUBLE) AS num, CAST(minutes AS DOUBLE) AS den", "'tax90' AS key, CAST(tax AS DOUBLE) AS num, CAST(tax_minutes AS DOUBLE) AS den")}, {registry_sql()}"""


# The roster's players, all of the first source, in every position: names apart from those of the natural scores.
PLACED_SQL = re.sub(
    r"\b(registry|weighted|active|flags)\b",
    r"\1_p",
    f"""{position_registry_sql()},
seen AS (SELECT *, provider AS ver FROM feats),"""
    + ASSIGNED_SQL[ASSIGNED_SQL.index("\nplaces AS") :].replace("CASE WHEN player % 10 = 1 THEN player - 1 ELSE player END", "player").replace("(g.role = 'BUILDING') = (f.role = 'BUILDING')", "(g.role = 'BUILDING') = (f.role = 'BUILDING') AND f.player LIKE 'a%'")
    + COMMON_SQL,
)


@query(
    "catalogue_build",
    PLAYERS_SQL
    + BUILD_SQL
    + ", " + PLACED_SQL
    + """, rated AS (SELECT player FROM overall WHERE population >= 30)
SELECT 'players' AS section, role AS name, count(*) AS value FROM b1 GROUP BY role UNION ALL SELECT 'rated', role, count(r.player) FROM b1 LEFT JOIN rated r ON r.player = b1.player GROUP BY role
UNION ALL SELECT 'linked', 'records', count(*) FROM b0 WHERE team < 10 UNION ALL SELECT 'features', 'observed', count(value) FROM feats
UNION ALL SELECT 'assigned', position, count(*) FROM tup JOIN ps USING (position, cohort) GROUP BY position
UNION ALL SELECT 'roster', 'mapped', count(*) FROM b0""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rec = cut(records(spark, sf))
    built = K.build(rec, model(), "alpha", ["alpha", "gamma"])
    squad = rec.where("provider = 'alpha'").select("record", "name_key")
    mapped = cut(K.roster(built, squad, "alpha"))
    return K.summary(built, mapped, K.assigned(built, mapped, registry(), "alpha", "BUILDING"))
