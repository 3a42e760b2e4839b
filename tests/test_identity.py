"""Identity rules against brute force."""

import datetime as d
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions.text import club_key, nfkd_key, plain_key
from gradus.operators import identity as J
from gradus.operators import intervals as I
from gradus.operators import ordered

SCHEMA = (
    "record string, provider string, league string, name_key string, minutes double, shots int, non_penalty_goals int, "
    "assists int, keeper boolean, club_key string"
)


def passes(a, c):
    if a[2:4] != c[2:4] or not (a[4] and c[4] and a[4] > 0 and c[4] > 0) or abs(a[4] - c[4]) > max(45, 0.02 * a[4]):
        return False
    if a[8]:
        return a[9] is not None and a[9] == c[9]
    both = [(x, y) for x, y in zip(a[5:8], c[5:8]) if x is not None and y is not None]
    return len(both) >= 2 and all(x == y for x, y in both)


def test_corroboration_matches_all_pairs_on_a_hot_name(spark):
    rng = random.Random(1)
    pick = lambda *v: rng.choice(v)

    def row(i, provider):
        return (
            f"{provider}{i}", provider, "L", pick("smith", "smith", "smith", "jones"), pick(0.0, None, 100.0, 140.0, 2240.0, 2300.0, 4000.0, 4081.0) if i % 2 else rng.uniform(1, 5000),
            pick(None, 1, 2), pick(None, 0, 1), pick(None, 3), pick(False, False, True), pick(None, "north", "south"),
        )

    anchors = [row(i, "opta") for i in range(120)]
    anchors += [(f"copy{i}", *anchors[1][1:]) for i in range(5)]
    others = [row(i, "web") for i in range(150)]
    got = {
        r["record"]: (r["anchors"], r["anchor"])
        for r in J.corroborated(spark.createDataFrame(anchors, SCHEMA), spark.createDataFrame(others, SCHEMA), "record").collect()
    }
    assert len(got) == len(others)
    for c in others:
        hits = [a[0] for a in anchors if passes(a, c)]
        assert got[c[0]] == (len(hits), hits[0] if len(hits) == 1 else None), c


def test_corroboration_of_one_hot_name_is_linear(spark, monkeypatch):
    """100,000 records of one name with equal counts: intervals and points are counted, pairs never listed."""
    monkeypatch.setattr(ordered, "CELL", 20_000)
    minutes = "cast(1000 + id * 7 + id % 5 AS double)"
    one = ["'L' AS league", "'smith' AS name_key", "1 AS shots", "0 AS non_penalty_goals", "2 AS assists", "false AS keeper", "'north' AS club_key"]
    anchors = spark.range(50_000).selectExpr("concat('a', id) AS record", "'opta' AS provider", f"{minutes} AS minutes", *one)
    others = spark.range(50_000).selectExpr("concat('w', id) AS record", "'web' AS provider", "cast(900 + id * 7.5 AS double) AS minutes", *one)
    at = np.array([1000 + i * 7 + i % 5 for i in range(50_000)])
    reach = np.maximum(45, 0.02 * at)
    low, high = np.sort(at - reach), np.sort(at + reach)
    got = {r.record: (r.anchors, r.anchor) for r in J.corroborated(anchors, others, "record").collect()}
    assert len(got) == 50_000
    for i in range(0, 50_000, 97):
        c = 900 + i * 7.5
        n = int(np.searchsorted(low, c, "right") - np.searchsorted(high, c, "left"))
        own = [f"a{k}" for k in np.flatnonzero(abs(at - c) <= reach)] if n == 1 else [None]
        assert got[f"w{i}"] == (n, own[0])
    assert max(n for n, _ in got.values()) > 1000 and sum(n == 0 for n, _ in got.values()) > 0


def test_links_need_one_anchor_and_one_record_per_provider(spark):
    m = spark.createDataFrame([("w1", "web", 1, "a"), ("w2", "web", 1, "b"), ("w3", "web", 1, "b"), ("u1", "und", 1, "b"), ("w4", "web", 2, None)], "record string, provider string, anchors long, anchor string")
    assert {r["record"] for r in J.accepted_links(m, "record").collect()} == {"w1", "u1"}


def test_components_follow_long_chains(spark):
    n = 70
    edges = [(i, "L", f"k{i // 2}") for i in range(n)] + [(i, "L", f"m{(i + 1) // 2}") for i in range(n)]
    edges += [(1000, "L", "alone"), (2000, "M", "k0")]
    labels = {r["row"]: r["label"] for r in J.components(spark.createDataFrame(edges, "row int, league string, key string"), "row", ["league", "key"]).collect()}
    assert {labels[i] for i in range(n)} == {0}
    assert labels[1000] == 1000 and labels[2000] == 2000


def test_a_chain_of_ten_thousand_is_contracted_round_by_round(spark, monkeypatch):
    """Ids run along the chain, the worst order for labels that travel; the links left fall in every round."""
    sizes = []
    real = J.cut
    monkeypatch.setattr(J, "cut", lambda df: (lambda out: (sizes.append(out.count()) if out.columns == ["a", "b"] else None, out)[1])(real(df)))
    edges = spark.range(10_000).selectExpr("id", "explode(array(id, id + 1)) AS g").where("g < 10000")
    got = J.components(edges.unionByName(spark.sql("SELECT 20001L AS id, -1L AS g UNION ALL SELECT 20002L, -1L")), "id", ["g"])
    assert {(r.id, r.label) for r in got.collect()} == {(i, 0) for i in range(10_000)} | {(20001, 20001), (20002, 20001)}
    assert all(b < 0.75 * a for a, b in zip(sizes, sizes[1:]) if a > 100) and len(sizes) < 25


def test_components_against_union_find(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 300), f"g{rng.randint(0, 260)}") for _ in range(420)]
    parent = {r: r for r, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for g in {g for _, g in rows}:
        own = [r for r, h in rows if h == g]
        for r in own[1:]:
            a, b = sorted((root(own[0]), root(r)))
            parent[b] = a
    got = J.components(spark.createDataFrame(rows, "id int, g string"), "id", ["g"]).collect()
    assert {r.id: r.label for r in got} == {r: root(r) for r in parent} and len(got) == len(parent)
    assert J.components(spark.createDataFrame([], "id int, g string"), "id", ["g"]).count() == 0


def test_components_with_a_hot_group(spark):
    edges = spark.range(3000).selectExpr("int(id) AS row", "IF(id % 3 = 0, 'hot', string(id)) AS key", "'L' AS league")
    labels = J.components(edges, "row", ["league", "key"])
    assert labels.where("label = 0").count() == 1000 and labels.select("label").distinct().count() == 2001


def test_name_keys(spark):
    names = ["Álvaro  Núñez", "O'Brien-Smith", "Škriniar", "ALISSON", "Strauß", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [tuple(r) for r in df.select(nfkd_key("name"), plain_key(F.col("name"))).collect()]
    assert [g[0] for g in got] == ["alvaronunez", "obriensmith", "skriniar", "alisson", "strauss", None]
    assert [g[1] for g in got][:4] == ["alvaronunez", "obriensmith", "skriniar", "alisson"]
    assert df.sparkSession.createDataFrame([("Arsenal FC",)], "c string").select(club_key(F.col("c"))).first()[0] == "arsenal"


def test_shared_days_counts_a_day_once(spark):
    day = d.date.fromisoformat
    tenures = spark.createDataFrame(
        [
            ("a", "x", day("2024-01-01"), day("2024-07-03")), ("a", "x", day("2024-01-01"), day("2024-07-03")), ("a", "y", day("2024-02-01"), day("2024-03-01")),
            ("b", "x", day("2023-06-01"), day("2025-01-01")), ("b", "y", day("2024-02-10"), day("2024-02-20")), ("c", "x", day("2024-07-03"), day("2024-08-01")),
        ],
        "player string, club string, start date, end date",
    )
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "player_a string, player_b string")
    got = {(r["player_a"], r["player_b"]): r["days"] for r in I.shared_days(tenures, pairs).collect()}
    assert got == {("a", "b"): 184, ("a", "c"): 0, ("b", "c"): 29}


def test_shared_days_against_brute_force(spark):
    rng = random.Random(4)
    base = d.date(2023, 1, 1)
    rows = []
    for _ in range(300):
        s = rng.randint(0, 500)
        rows.append((rng.choice("abc"), rng.choice("xy"), base + d.timedelta(s), base + d.timedelta(s + rng.randint(0, 60))))
    days = {}
    for p, c, s, e in rows:
        days.setdefault(p, set()).update((c, s + d.timedelta(i)) for i in range((e - s).days))
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    got = I.shared_days(spark.createDataFrame(rows, "player string, club string, start date, end date"), spark.createDataFrame(pairs, "player_a string, player_b string"))
    for r in got.collect():
        assert r["days"] == len({x for _, x in days[r["player_a"]] & days[r["player_b"]]})


def test_shared_days_meet_years_instead_of_pieces(spark):
    """Every second day of three years is one row a year; leap days and the ends of words and years count."""
    base = d.date(2023, 1, 1)
    rows = [("a", "x", base + d.timedelta(i), base + d.timedelta(i + 1)) for i in range(0, 1096, 2)]
    rows += [("b", "x", base, d.date(2026, 1, 1)), ("c", "x", d.date(2024, 2, 29), d.date(2024, 3, 2)), ("c", "x", d.date(2024, 12, 31), d.date(2025, 1, 1))]
    tenures = spark.createDataFrame(rows, "player string, club string, start date, end date")
    assert I.year_days(tenures, ["player", "club"]).groupBy("player").count().orderBy("player").collect() == [("a", 3), ("b", 3), ("c", 1)]
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "player_a string, player_b string")
    found = I.shared_days(tenures, pairs)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.player_a, r.player_b): r.days for r in found.collect()} == {("a", "b"): 548, ("b", "c"): 3, ("a", "c"): 2}


def test_concurrent_minutes(spark):
    iv = spark.createDataFrame([(1, "a", 0, 30), (1, "a", 20, 45), (1, "b", 30, 90), (1, "c", 0, 200), (2, "a", 0, 90)], "match int, player string, start int, end int")
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (2, "a", "b")], "match int, player_a string, player_b string")
    got = {(r["match"], r["player_b"]): (r["minutes"], r["status"]) for r in I.concurrent_minutes(iv, pairs).collect()}
    # An interval past the match is refused; it is not an answer of no minutes.
    assert got == {(1, "b"): (15, "ok"), (1, "c"): (None, "invalid interval"), (2, "b"): (0, "ok")}
    assert I.invalid_intervals(iv).count() == 1


def test_reports_quarantine_exposure_and_name_repeats(spark):
    base = spark.createDataFrame([("a", "t", 90), ("b", "t", 45)], "player string, team string, minutes int")
    extra = spark.createDataFrame([("k", "t", 90), ("a", "t", 90)], "player string, team string, minutes int")
    report = spark.createDataFrame([("a", "t", 90, 3), ("b", "t", 44, 1), ("k", "t", 90, 2), ("k", "t", 90, 2)], "player string, team string, minutes int, duels int")
    rows, repeated = J.multi_report_join(base, extra, {"duels": (report, ["duels"])}, ["player", "team"], "minutes")
    got = {r["player"]: (r["duels"], list(r["reasons"])) for r in rows.collect()}
    assert got["a"] == (3, []) and got["b"][1] == ["duels exposure"] and set(got) == {"a", "b", "k"}
    assert [r["player"] for r in repeated.collect()] == ["k"]


@pytest.mark.parametrize("provider,mapped", [("opta", "p1"), ("none", None)])
def test_roster_prefers_the_primary_source(spark, provider, mapped):
    catalogue = spark.createDataFrame([("n", "p1", "opta"), ("n", "p2", "web")], "name string, id string, provider string")
    roster = spark.createDataFrame([("n",)], "name string")
    assert J.roster_mapping(roster, catalogue, "name", F.col("provider") == provider).first()["mapped_id"] == mapped
