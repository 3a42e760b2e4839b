"""The rated catalogue: links between sources, chosen features, scores, roster mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Model
from ..session import cut
from . import identity as J
from . import rating as R
from .ordered import finite
from .standardize import best_row


def build(records: DataFrame, model: Model, primary: str, priority: Sequence[str]) -> dict[str, DataFrame]:
    """Players, sources, features, ability scores, ratings and the link audit.

    ``records``: record, provider, provider_id, name, league, position, minutes, name_key, club_key, keeper,
    shots, non_penalty_goals, assists, and the model's numerators and denominators.
    """
    anchors = best_row(
        records.where(F.col("provider") == primary), ["provider_id"], [("minutes", True), ("record", True)]
    )
    others = records.where(F.col("provider") != primary)
    # The links decide who is a player at all, and everything below reads them.
    links = cut(J.accepted_links(J.corroborated(anchors, others, "record"), "record"))
    own = anchors.unionByName(others.join(links.select("record"), "record", "left_anti"))
    # Each stage is written: the plan of one that reads the others would hold all of theirs, several times.
    players = cut(own.select(
        F.col("record").alias("player"), "name", "name_key", "league", "position", F.col("provider").alias("main"), F.coalesce("minutes", F.lit(0.0)).alias("minutes")
    ))
    sources = own.selectExpr("record AS player", "record").unionByName(links.selectExpr("anchor AS player", "record"))
    measured = R.long_features(records, model.features, ["record", "provider", F.col("minutes").alias("window_minutes")], "missing_measurement").join(sources, "record")
    # A window that misses the player's season is no measurement of it; what nobody reports is a declared zero.
    picked = cut(R.attach_features(
        players.select("player", "minutes"),
        measured.select("player", "key", "provider", F.col("record").alias("id"), "window_minutes", "value", "numerator", "denominator", "status"),
        "player",
        [f.key for f in model.features],
        priority,
        "minutes",
    ))
    fields = []
    for f in model.features:
        mine = f"key = '{f.key}'"
        fields += [
            F.expr(f"max(IF({mine}, numerator, NULL)) AS num_{f.key}"),
            F.expr(f"max(IF({mine}, IF(status = 'partial_window', 0D, denominator), NULL)) AS den_{f.key}"),
            F.expr(f"max(IF({mine}, provider, NULL)) AS prov_{f.key}"),
        ]
    wide = cut(players.join(picked.groupBy("player").agg(*fields), "player"))
    chosen = replace(model, features=tuple(f.picked() for f in model.features))
    scores, overall = R.score_catalogue(
        wide, chosen, ["player", "position"], "position", "minutes", "position = 'ST'", "prov_{key}"
    )
    overall = cut(overall)
    return {"players": players, "sources": sources, "features": picked, "wide": wide, "scores": scores, "overall": overall, "links": links}


def assigned(built: dict[str, DataFrame], mapped: DataFrame, registry: Mapping[str, Model], primary: str, keeper: str) -> DataFrame:
    """Overall scores of the roster's players in every position of their class, by that position's registry."""
    chosen = {p: replace(m, features=tuple(f.picked() for f in m.features)) for p, m in registry.items()}
    only = mapped.where("mapped_id IS NOT NULL").select(F.col("mapped_id").alias("player"))
    found = R.assigned_positions(built["wide"], chosen, "player", "position", "minutes", "player", f"main = '{primary}'", keeper, "prov_{key}", only=only)
    return cut(R.assigned_overall(found._replace(scores=cut(found.scores)), "player"))


def roster(built: dict[str, DataFrame], names: DataFrame, primary: str) -> DataFrame:
    """Roster names mapped to catalogue players; ambiguous names stay unmapped."""
    catalogue = built["players"].select(F.col("player").alias("id"), "name_key", "main")
    return J.roster_mapping(names, catalogue, "name_key", F.col("main") == primary)


def summary(built: dict[str, DataFrame], mapped: DataFrame, placed: DataFrame) -> DataFrame:
    """Counts of the build: players and rated per position, links, supported features, roster, and the roster's players
    with a score in each position."""
    players, overall = built["players"], built["overall"]
    per = players.join(overall.select("player", F.lit(True).alias("_r")), "player", "left").groupBy("position").agg(
        F.count("*").alias("players"), F.count("_r").alias("rated")
    )
    linked = built["links"].agg(F.count("*").alias("value"))
    supported = built["features"].agg(F.count_if(R.supported(F.col("status")) & finite(F.col("value"))).alias("value"))
    found = mapped.agg(F.count("mapped_id").alias("value"))
    return (
        per.selectExpr("'players' AS section", "position AS name", "players AS value")
        .unionByName(per.selectExpr("'rated' AS section", "position AS name", "rated AS value"))
        .unionByName(linked.selectExpr("'linked' AS section", "'records' AS name", "value"))
        .unionByName(supported.selectExpr("'features' AS section", "'observed' AS name", "value"))
        .unionByName(found.selectExpr("'roster' AS section", "'mapped' AS name", "value"))
        .unionByName(placed.groupBy("position").agg(F.count("*").alias("value")).selectExpr("'assigned' AS section", "position AS name", "value"))
    )
