"""Queries over whole tables, by brute force over the entities."""

from collections import defaultdict

import __spark_entry__ as contract
from gradus.operators import rating as R
from gradus.plans.bindings import FEATURES, entities
from gradus.plans.recruit import ROLES

SMALL = "/root/testdata/sf0.001"


def test_tactical_fit_of_every_team_and_role(spark):
    rows = contract.queries()["tactical_fit"](spark, SMALL).collect()
    e = entities(spark, SMALL).select("player", "role", "team").collect()
    role, teams = {r.player: r.role for r in e}, {r.team for r in e}
    briefs = {r.brief for r in rows}
    assert len(teams) > 2 and briefs == {f"team-{t}-{r}" for t in teams for r in ROLES if r in role.values()}
    assert all(r.brief.endswith("-" + role[r.player]) for r in rows)


def test_masks_of_all_features(spark):
    made = {r.player: r.peers for r in contract.queries()["mask_compatible_peers"](spark, SMALL).collect()}
    used, refs, minutes = defaultdict(set), defaultdict(set), {}
    for r in R.long_features(entities(spark, SMALL), FEATURES, ["player", "league", "minutes"]).where("status = 'observed'").collect():
        used[r.player].add(r.key)
        minutes[r.player] = r.minutes
        if r.minutes >= 900:
            refs["v1", r.player].add(r.key)
        if r.minutes < 1100 and r.league != "ASIA":
            refs["v2", r.player].add(r.key)
    version = {p: "v1" if m > 1000 else "v2" for p, m in minutes.items()}
    assert made == {p: sum(v == version[p] and keys <= have for (v, _), have in refs.items()) for p, keys in used.items()}
    assert max(map(len, used.values())) > 3


def test_compatible_members_are_listed_on_demand(spark):
    used = [(1, "a", "p", "1"), (1, "b", "q", "1"), (2, "b", "q", "1"), (3, "c", "p", "9")]
    refs = [(7, "a", "p", "1"), (7, "b", "q", "1"), (8, "b", "q", "1"), (9, "a", "p", "2"), (9, "b", "q", "1"), (6, "c", "p", "1")]
    asks = spark.createDataFrame(used, "who int, key string, provider string, version string")
    has = spark.createDataFrame([(*r, 1.0, 1.0, "observed") for r in refs], "ref int, key string, provider string, version string, value double, denominator double, status string")
    found = R.compatible_peers(asks, has, "who", ["ref"], ["a", "b", "c"])
    own = {r.who: r.signature for r in found.signatures.collect()}
    counts = {r.signature: r.peers for r in found.counts().collect()}
    assert {w: counts[s] for w, s in own.items()} == {1: 1, 2: 3, 3: 0}
    members = defaultdict(set)
    for r in found.members().collect():
        members[r.signature].add(r.ref)
    assert {w: members[s] for w, s in own.items()} == {1: {7}, 2: {7, 8, 9}, 3: set()}


def test_rosters_of_every_team(spark):
    whole = {(r.section, r.name): r.value for r in contract.queries()["catalogue_build"](spark, SMALL).collect()}
    assert whole["roster", "mapped"] == entities(spark, SMALL).count()
