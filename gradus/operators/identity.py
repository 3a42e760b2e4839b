"""Joins that attach evidence to identities, and identity resolution itself.

No operator lists the pairs of a group: who corroborates whom is counted over sorted interval ends.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .lookup import beside_cohort
from .ordered import running
from .quality import validate


def multi_report_join(
    base: DataFrame, extra: DataFrame, reports: Mapping[str, tuple[DataFrame, Sequence[str]]], keys: Sequence[str], exposure: str
) -> tuple[DataFrame, DataFrame]:
    """(rows with reasons, reports that repeat a key).

    Rows are the base and those of the second inventory it lacks; each report joins on the exact
    key and must show the same exposure.
    """
    from .sets import base_plus_missing

    keys = list(keys)
    out = base_plus_missing(base, extra, keys)
    rules, repeated = {}, None
    for name, (report, measures) in reports.items():
        seen = report.groupBy(*keys).agg(
            F.count("*").alias("_copies"), F.max(exposure).alias(f"_{name}_exposure"), *[F.max(m).alias(m) for m in measures]
        )
        twice = seen.where("_copies > 1").select(F.lit(name).alias("report"), *keys)
        repeated = twice if repeated is None else repeated.unionByName(twice)
        out = out.join(seen.drop("_copies").withColumn(f"_{name}", F.lit(True)), keys, "left")
        rules[f"{name} exposure"] = f"_{name} AND NOT (_{name}_exposure <=> {exposure})"
    checked = validate(out, rules)
    return checked.drop(*[c for c in checked.columns if c.startswith("_")]), repeated


def assemble_appearances(reports: DataFrame) -> DataFrame:
    """Appearances (match, player) with the raw value before the advanced one.

    A match with a team mismatch, impossible minutes, or events of nobody who played is rejected whole.
    ``reports``: (match, player, report, team, minutes, touches, xg), the rows of the reports ``players``, ``advanced``
    and ``shots`` in one frame, so that they meet in one aggregate instead of joins.
    """
    of = lambda report, call, column: f"{call}(CASE WHEN report = '{report}' THEN {column} END)"
    sides = reports.groupBy("match", "player").agg(
        *[F.expr(f"count_if(report = '{r}') AS in_{r}") for r in ("players", "advanced", "shots")],
        F.expr(f"{of('players', 'min', 'team')} AS team"),
        F.expr(f"coalesce({of('players', 'sum', 'minutes')}, {of('advanced', 'sum', 'minutes')}) AS minutes"),
        F.expr(f"coalesce({of('players', 'sum', 'touches')}, {of('advanced', 'sum', 'touches')}) AS touches"),
        F.expr(f"{of('advanced', 'min', 'team')} AS adv_team"),
        F.expr(f"coalesce({of('shots', 'sum', 'xg')}, 0D) AS xg"),
        F.expr(f"{of('shots', 'min', 'team')} AS shot_lo"),
        F.expr(f"{of('shots', 'max', 'team')} AS shot_hi"),
    )
    stranger = "(in_players = 0 OR player IS NULL) AND in_advanced + in_shots > 0"
    mismatch = "coalesce(adv_team <> team, false) OR coalesce(shot_lo <> team OR shot_hi <> team, false)"
    bad = F.expr(f"{stranger} OR (in_players > 0 AND ({mismatch} OR NOT coalesce(minutes > 0 AND minutes <= 130, false)))")
    return (
        sides.withColumn("rejected", F.bool_or(bad).over(Window.partitionBy("match")))
        .where("in_players > 0")
        .select("match", "player", "team", "minutes", "touches", F.col("in_shots").alias("shots"), "xg", "rejected")
    )


def scoped_shots(shots: DataFrame, fixtures: DataFrame, totals: DataFrame, entity: str, tolerance: float = 1e-5) -> DataFrame:
    """Shots of completed fixtures only, reconciled with the season totals of each entity."""
    scoped = shots.join(fixtures.where("finished").select("match").distinct(), "match", "left_semi")
    sums = scoped.groupBy(entity).agg(
        F.count("*").alias("n"), F.sum(F.when(~F.col("penalty"), F.col("xg"))).alias("npxg_sum"), F.sum(F.when(F.col("open_play"), F.col("xg"))).alias("open_play_xg")
    )
    return totals.join(sums, entity, "left").withColumn(
        "accepted",
        F.expr(
            "shots = coalesce(n, 0) AND npxg IS NOT NULL AND abs(npxg - coalesce(npxg_sum, 0D)) "
            f"<= greatest({tolerance}, {tolerance} * greatest(abs(npxg), abs(coalesce(npxg_sum, 0D))))"
        ),
    )


def alias_key(df: DataFrame, key: str, aliases: Mapping[str, str]) -> DataFrame:
    table = df.sparkSession.createDataFrame(list(aliases.items()), "_from string, _to string")
    return (
        df.join(table, F.col(key) == F.col("_from"), "left")
        .withColumn(key, F.coalesce("_to", key))
        .drop("_from", "_to")
    )


def candidate_groups(df: DataFrame, keys: Sequence[str], provider: str, record: str) -> DataFrame:
    """Members of every group that spans providers, one row per member and never one list."""
    keys = list(keys)
    spans = df.groupBy(*keys).agg(F.count_distinct(provider).alias("providers"), F.count("*").alias("members")).where("providers > 1")
    return df.select(*keys, provider, record).join(spans, keys)


# --- Corroborated identity ------------------------------------------------------------------------
COUNTS = ("shots", "non_penalty_goals", "assists")


def _tags(anchor: bool) -> str:
    """SQL of the blocks a record belongs to, one text each, so that an anchor and a candidate that agree share exactly
    one. A keeper's block is its club. Another anchor's names the counts it has, those of them that both have and
    their values; a candidate does not know what an anchor has, so it asks for every case."""
    sets = [c for n in (2, 3) for c in combinations(COUNTS, n)]
    tags = []
    for has in sets:
        for shared in sets:
            if set(shared) <= set(has):
                values = "concat('" + "+".join(has) + ":', " + ", ' ', ".join(f"'{x}=', {x}" for x in shared) + ")"
                there = [f"{x} IS NOT NULL" for x in (has if anchor else shared)]
                # A candidate has none of the anchor's other counts; an anchor's other counts are null.
                gone = [f"{x} IS NULL" for x in (set(COUNTS) - set(has) if anchor else set(has) - set(shared))]
                tags.append(f"IF({' AND '.join([*there, *sorted(gone)])}, {values}, NULL)")
    club = "IF(club_key IS NOT NULL, concat('club=', club_key), NULL)"
    if anchor:
        return f"array_compact(IF(coalesce(keeper, false), array({club}), array({', '.join(tags)})))"
    return f"array_compact(array({', '.join(tags)}, {club}))"


def corroborated(anchors: DataFrame, candidates: DataFrame, record: str) -> DataFrame:
    """For each candidate record: how many anchors pass, and the anchor if exactly one does.

    Records carry league, name_key, minutes, shots, non_penalty_goals, assists, keeper, club_key.
    Names must agree, minutes (taken to millionths) must be positive and differ by at most max(45, 2% of the
    anchor's); then two or three comparable counts must all be equal, or, where the anchor is
    a keeper, the club.

    No pair is ever listed. An anchor is an interval of minutes in its blocks, a candidate a point in its own. Over a
    block's sorted ends, how many intervals hold a point is the starts up to it less the ends before it, and the same
    difference of summed record hashes is the hash of the one interval, where there is one.
    """
    block = ["league", "name_key", "tag"]
    exact = F.expr("try_cast(minutes AS decimal(20, 6))")
    usable = F.expr("at > 0 AND league IS NOT NULL AND name_key IS NOT NULL AND name_key <> ''")
    a = anchors.withColumn("at", exact).where(usable).withColumn("hash", F.xxhash64(record).cast("decimal(28, 0)"))
    reach = a.withColumn("_reach", F.expr("greatest(cast(45 AS decimal(24, 8)), at * 0.02)")).select(
        "league", "name_key", F.expr(f"explode({_tags(True)})").alias("tag"), F.expr("cast(at - _reach AS decimal(25, 8)) AS low"), F.expr("cast(at + _reach AS decimal(25, 8)) AS high"), "hash"
    )
    zero = F.lit(0).cast("long"), F.lit(0).cast("decimal(28, 0)")
    ends = reach.select(*block, F.expr("inline(array(named_struct('v', low, 's', 1L, 'e', 0L), named_struct('v', high, 's', 0L, 'e', 1L)))"), "hash").select(
        *block, "v", "s", "e", (F.col("s") * F.col("hash")).cast("decimal(28, 0)").alias("sh"), (F.col("e") * F.col("hash")).cast("decimal(28, 0)").alias("eh"), F.lit(False).alias("asked")
    )
    profile = ["league", "name_key", "at", *COUNTS, "club_key"]
    c = candidates.withColumn("at", exact)
    points = c.where(usable).select(*profile).distinct().withColumn("tag", F.expr(f"explode({_tags(False)})")).withColumn("v", F.expr("cast(at AS decimal(25, 8))"))
    asked = points.select(*block, "v", zero[0].alias("s"), zero[0].alias("e"), zero[1].alias("sh"), zero[1].alias("eh"), F.lit(True).alias("asked"))
    places = ends.unionByName(asked).groupBy(*block, "v").agg(*[F.sum(x).alias(x) for x in ("s", "e", "sh", "eh")], F.max("asked").alias("asked"))
    held = running(places, block, "v", ["s", "e", "sh", "eh"]).where("asked").select(
        *block, "v", F.expr("s_below + s - e_below AS anchors"), F.expr("sh_below + sh - eh_below AS hash")
    )
    # An anchor is in exactly one of a candidate's blocks, so counts and hashes add up.
    passed = (
        points.join(held.where("anchors > 0"), [*block, "v"])
        .groupBy(*profile)
        .agg(F.sum("anchors").alias("anchors"), F.sum("hash").cast("decimal(38, 0)").alias("hash"))
    )
    one = passed.where("anchors = 1").join(a.select("league", "name_key", F.col("hash").cast("decimal(38, 0)").alias("hash"), F.col(record).alias("anchor")), ["league", "name_key", "hash"])
    known = passed.where("anchors > 1").withColumn("anchor", F.lit(None).cast(anchors.schema[record].dataType)).unionByName(one).drop("hash")
    known = known.select(*[F.col(x).alias(f"_{x}") for x in profile], "anchors", "anchor")
    on = " AND ".join(f"{x} <=> _{x}" for x in profile)
    return c.join(known, F.expr(on), "left").selectExpr(record, "provider", "coalesce(anchors, 0L) AS anchors", "anchor")


def accepted_links(matches: DataFrame, record: str) -> DataFrame:
    """Links with exactly one anchor; a provider occurring twice at one anchor is dropped there."""
    unique = matches.where("anchors = 1")
    counts = unique.groupBy("anchor", "provider").agg(F.count("*").alias("_n"))
    return unique.join(counts, ["anchor", "provider"]).where("_n = 1").select(record, "provider", "anchor")


def exposure_corroborated(
    records: DataFrame, names: DataFrame, minutes: DataFrame, apps: DataFrame
) -> DataFrame:
    """Web records linked to the one row whose known minutes and appearances include theirs.

    ``records``: (league, id, name_key, minutes, apps), several rows per id; ``names``:
    (row, league, name_key); ``minutes`` and ``apps``: (row, value).
    """
    person = records.groupBy("league", "id").agg(
        F.min("name_key").alias("name_key"),
        F.expr("CASE WHEN count(DISTINCT minutes) = 1 THEN max(minutes) END AS minutes"),
        F.expr("CASE WHEN count(DISTINCT apps) = 1 THEN max(apps) END AS apps"),
    )
    index = (
        names.distinct()
        .join(minutes.selectExpr("row", "value AS minutes").distinct(), "row")
        .join(apps.selectExpr("row", "value AS apps").distinct(), "row")
        .where("minutes > 0 AND apps > 0")
        .groupBy("league", "name_key", "minutes", "apps")
        .agg(F.count_distinct("row").alias("_rows"), F.min("row").alias("_row"))
    )
    return person.join(index, ["league", "name_key", "minutes", "apps"], "left").selectExpr(
        "league",
        "id",
        "IF(_rows = 1, string(_row), concat('source:', id, '|', league)) AS target",
        "IF(_rows = 1, 'corroborated', 'unresolved') AS status",
    )


# --- Components ------------------------------------------------------------------------------------
def components(edges: DataFrame, row: str, group: Sequence[str]) -> DataFrame:
    """Smallest row id of each connected component of rows sharing a group, transitively.

    Each round gives nodes a new random order, and every node goes to the least one of all its groups' members, itself
    included; nodes of one choice become one node, and groups of one node are settled and never read again. A clique or
    a star is gone after one round, and of any other graph a share of the nodes in every round, a chain's too.
    The choices of all rounds, one after another, lead each row to its component. Every round is written to the
    checkpoint folder.
    """
    group = list(group)
    links = cut(edges.select(row, *group).distinct())
    known = " AND ".join(f"`{g}` IS NOT NULL" for g in group)
    shared = lambda held: held.join(held.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b"), "b", "left_semi").select("a", "b")
    level = cut(shared(links.where(known).select(F.col(row).alias("a"), F.struct(*group).alias("b"))))
    rounds: list[DataFrame] = []
    while not level.isEmpty():
        drawn = F.struct(F.xxhash64("a", F.lit(len(rounds))).alias("h"), F.col("a").alias("x"))
        least = level.groupBy("b").agg(F.min(drawn).alias("least"))
        chosen = cut(level.join(least, "b").groupBy("a").agg(F.min("least")["x"].alias("to")))
        level = cut(shared(level.join(chosen, "a").select(F.col("to").alias("a"), "b").distinct()))
        rounds.append(chosen)
    found = None
    for chosen in reversed(rounds):
        if found is not None:
            later = found.select(F.col("a").alias("to"), F.col("to").alias("last"))
            chosen = chosen.join(later, "to", "left").select("a", F.coalesce("last", "to").alias("to"))
        found = chosen
    rows = links.select(row).distinct()
    if found is None:
        return cut(rows.withColumn("label", F.col(row)))
    settled = cut(rows.join(found.withColumnRenamed("a", row), row, "left").select(row, F.coalesce("to", row).alias("to")))
    least = settled.groupBy("to").agg(F.min(row).alias("label"))
    return cut(settled.join(least, "to").select(row, "label"))


def alias_view(observations: DataFrame, aliases: DataFrame, row: str) -> DataFrame:
    """Observations under their canonical row, the original kept beside it."""
    a = aliases.select(F.col("original_row").alias("_original"), F.col("canonical_row").alias("_canonical"))
    return (
        observations.join(a, F.col(row) == F.col("_original"), "left")
        .withColumn("original_row", F.col(row))
        .withColumn(row, F.coalesce("_canonical", row))
        .drop("_original", "_canonical")
    )


def canonical_map(records: DataFrame, links: DataFrame, record: str) -> DataFrame:
    """Each source record's canonical id: its accepted anchor's, else its own."""
    named = records.select(record, "provider", "league", F.concat_ws(":", "provider", record).alias("own"))
    anchor = named.select(F.col(record).alias("anchor"), F.col("own").alias("anchored"))
    return (
        named.join(links.select(record, "anchor"), record, "left")
        .join(anchor, "anchor", "left")
        .select("provider", "league", record, F.coalesce("anchored", "own").alias("canonical_id"))
    )


def source_row_lookup(sources: DataFrame, rows: DataFrame, entity: str, keys: Sequence[str]) -> DataFrame:
    """The master row of an entity, if its sources lead to exactly one.

    Entities with the same sources have the same answer: each distinct set of sources meets the master rows once, so
    a source that many entities and many rows share lists no pairs.
    """
    held = sources.select(entity, F.struct(*keys).alias("key")).groupBy(entity).agg(F.sort_array(F.collect_set("key")).alias("held")).persist()
    found = (
        held.select("held").distinct()
        .select("held", F.explode("held").alias("key"))
        .select("held", "key.*")
        .join(rows.select(*keys, "master_row").distinct(), list(keys))
        .groupBy("held")
        .agg(F.count_distinct("master_row").alias("rows"), F.min("master_row").alias("master_row"))
    )
    return beside_cohort(held, cut(found), ["held"], "left").select(
        entity, F.expr("IF(rows = 1, master_row, NULL) AS master_row"), F.coalesce("rows", F.lit(0)).alias("rows")
    )


def reviewed_identities(measured: DataFrame, reviewed: DataFrame, entity: str) -> DataFrame:
    """Reviewed identities whose allowed teams cover every observed team.

    ``measured``: (entity, team), one row per observed team; ``reviewed``: (entity, team).
    """
    teams = measured.select(entity, "team").distinct()
    allowed = reviewed.select(entity, "team").distinct().withColumn("_ok", F.lit(1))
    known = reviewed.select(entity).distinct()
    return (
        teams.join(known, entity, "left_semi")
        .join(allowed, [entity, "team"], "left")
        .groupBy(entity)
        .agg(F.count("*").alias("teams"), F.count("_ok").alias("covered"))
        .where("teams = covered")
        .select(entity, "teams")
    )


def roster_mapping(roster: DataFrame, catalogue: DataFrame, key: str, primary: Column) -> DataFrame:
    """Each roster name's catalogue id: the primary source if alone, else the only candidate."""
    options = catalogue.groupBy(key).agg(
        F.count("*").alias("options"),
        F.count_if(primary).alias("primaries"),
        F.min(F.when(primary, F.col("id"))).alias("_primary"),
        F.min("id").alias("_any"),
    )
    return roster.join(options, key, "left").selectExpr(
        *roster.columns, "CASE WHEN primaries = 1 THEN _primary WHEN options = 1 THEN _any END AS mapped_id", "coalesce(options, 0) AS options"
    )


def edge_pairs(lineups: DataFrame, edges: Sequence[tuple[int, int]]) -> DataFrame:
    """Occupants of both ends of each edge, as an unordered pair; empty slots give none."""
    spark = lineups.sparkSession
    table = spark.createDataFrame(list(edges), "slot_a int, slot_b int")
    left = lineups.selectExpr("lineup", "slot AS slot_a", "player AS _a").join(F.broadcast(table), "slot_a")
    return left.join(lineups.selectExpr("lineup", "slot AS slot_b", "player AS _b"), ["lineup", "slot_b"]).selectExpr(
        "lineup", "slot_a", "slot_b", "least(_a, _b) AS player_a", "greatest(_a, _b) AS player_b"
    )
