"""Master cells, columns, merge, revisions and gates."""

import random
from difflib import SequenceMatcher
from threading import Barrier, Thread

import pytest
from pyspark.sql import functions as F

from gradus.operators import master as M
from gradus.operators import release as G
from gradus.session import new_folder
from gradus.sources.commit import names, put_if_absent, read_text

PRIORITY = ("opta", "pitchapi", "understat", "whoscored")
CELLS = "master_row string, column_id string, provider string, sample int, value double"


def test_cell_states(spark):
    rows = [
        ("r", "same", "opta", 1, 20.0), ("r", "same", "web", 2, 20.0 + 1e-7), ("r", "clash", "opta", 1, 20.0), ("r", "clash", "web", 2, 18.0),
        ("r", "none", "opta", 1, None), ("r", "none", "web", 2, float("nan")), ("r", "zero", "opta", 1, None), ("r", "zero", "web", 2, 0.0),
    ]
    got = {r["column_id"]: (r["status"], r["value"]) for r in M.coalesce_cells(spark.createDataFrame(rows, CELLS), ["provider", "sample"]).collect()}
    assert got == {"same": ("observed", 20.0), "clash": ("source_conflict", None), "none": ("unavailable", None), "zero": ("observed", 0.0)}


def test_priority_takes_zero_and_refuses_a_divided_source(spark):
    rows = [
        ("r", "a", "pitchapi", 1, 5.0), ("r", "a", "opta", 2, 0.0), ("r", "b", "opta", 1, 1.0), ("r", "b", "opta", 2, 2.0), ("r", "b", "pitchapi", 3, 2.0),
    ]
    df = spark.createDataFrame(rows, CELLS)
    got = {r["column_id"]: r for r in M.resolve(df, PRIORITY, ["provider", "sample"]).collect()}
    assert (got["a"]["value"], got["a"]["status"], got["a"]["selected_provider"]) == (0.0, "resolved_by_priority", "opta")
    assert got["b"]["status"] == "source_conflict" and got["b"]["value"] is None
    audit = M.resolution_audit(df, PRIORITY, ["provider", "sample"])
    assert audit.count() == 5 and audit.where("source_disagrees").count() == 3


def test_column_evidence(spark):
    rows = []
    for i in range(25):
        rows += [("opta", "goals", str(i), float(i)), ("web", "Goals", str(i), float(i)), ("und", "goals", str(i), 2.0 * i)]
    for i in range(10):
        rows.append(("thin", "Goals", str(i), float(i)))
    df = spark.createDataFrame(rows, "provider string, label string, row string, value double")
    groups = {}
    found, decisions = M.column_groups(df)
    for r in found.collect():
        groups.setdefault(r["group"], set()).add((r["provider"], r["label"]))
    members = sorted(map(sorted, groups.values()))
    # Exact names always merge; the thin and the scaled member keep the alias from joining them.
    assert members == [[("opta", "goals"), ("und", "goals")], [("thin", "Goals"), ("web", "Goals")]]
    merged = {(r["left"]["provider"], r["right"]["provider"]) for r in decisions.where("merged").collect()}
    assert merged == {("opta", "und"), ("thin", "web")} and decisions.count() == 6
    pairs = [(("opta", "goals"), ("web", "Goals")), (("opta", "goals"), ("und", "goals")), (("opta", "goals"), ("thin", "Goals"))]
    status = {r["right_provider"]: r["status"] for r in M.compare_columns(df, pairs).collect()}
    assert status == {"web": "equivalent", "und": "different_values", "thin": "insufficient_overlap"}


def test_grain_is_never_crossed(spark):
    columns = spark.createDataFrame([("a", "shots"), ("b", "per_game.shots"), ("c", "shots")], "provider string, label string")
    found = [(r["left"]["provider"], r["right"]["provider"], r["reason"]) for r in M.column_candidates(columns).collect()]
    assert found == [("a", "c", "exact_name")]


def test_merge_keeps_best_source_and_audits(spark):
    players = spark.createDataFrame([("w", "whoscored"), ("o", "opta"), ("u", "understat")], "row string, provider string")
    cells = spark.createDataFrame(
        [("o", "shots", "opta", 10.0, "observed"), ("w", "shots", "whoscored", 11.0, "observed"), ("u", "assists", "understat", 0.0, "observed"), ("w", "x", "whoscored", None, "unavailable")],
        "row string, column_id string, provider string, value double, status string",
    )
    labels = spark.createDataFrame([("w", "o"), ("o", "o"), ("u", "o")], "row string, label string")
    aliases, merged, audit = M.merge_identities(players, cells, labels, PRIORITY)
    assert {r["canonical_row"] for r in aliases.collect()} == {"o"}
    got = {r["column_id"]: (r["value"], r["status"]) for r in merged.collect()}
    assert got == {"shots": (10.0, "resolved_by_priority"), "assists": (0.0, "observed"), "x": (None, "unavailable")}
    assert [r["column_id"] for r in audit.collect()] == ["shots"]


def test_similar_labels_are_those_of_all_pairs(spark):
    """The join on rare characters finds exactly the pairs that comparing everything would."""
    rng = random.Random(3)
    words = ["shots", "goals", "passes", "key_pass", "xG", "duels won", "Minutes", "straße", "é", ""]
    labels = {"".join(rng.choice(words) + rng.choice(["", ".", "_", "s", "1"]) for _ in range(rng.randint(1, 3))) for _ in range(150)}
    labels |= {w[:k] + rng.choice("aeiou") + w[k + 1 :] for w in list(labels)[:60] for k in (1, 3) if len(w) > 4}
    rows = [(g, x) for g in ("total", "per_90.") for x in sorted(labels)]
    got = {(r.grain, r.l, r.r) for r in M.similar_labels(spark.createDataFrame(rows, "grain string, label string")).collect()}
    alike = lambda a, b: SequenceMatcher(None, a.casefold(), b.casefold()).ratio() >= M.SIMILARITY
    assert got == {(g, a, b) for g in ("total", "per_90.") for a in labels for b in labels if a != b and a and b and alike(a, b)}
    assert len(got) > 100


def test_candidates_of_a_wide_schema_are_not_all_pairs(spark):
    columns = spark.range(20_000).selectExpr("concat('p', id % 3) AS provider", "concat(md5(cast(id div 3 AS string)), '.Total') AS label")
    found = M.column_candidates(columns)
    assert found.where("reason = 'exact_name'").count() == 19_999
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_master_of_web_tables_and_observations(spark):
    """Linked people's cells join the columns they equal; who cannot be linked, and rows that miss their header, stay out."""
    rows = [(i, float(900 + i), i % 7 + 20, i * 3 + 1, i % 5) for i in range(40)]  # row, minutes, apps, shots, goals
    web = []
    for i, minutes, apps, shots, goals in rows:
        minutes = minutes + 1 if i == 5 else minutes  # nobody known has these minutes
        cells = ["n", str(apps), str(minutes), f"{shots:,}"][: 3 if i == 6 else 4]
        web.append(("L", f"k{i}", "stats", "shots", "2", ["Player", "Apps", "Mins", "Total"], f"/players/{500 + i}/show", cells))
        web.append(("L", f"k{i}", "stats", None, "2", ["Player", "Goals", "Rating"], f"/players/{500 + i}/show", ["n", str(goals + (i == 7)), "N/A"]))
    panels = spark.createDataFrame(web, "league string, name_key string, panel string, category string, accumulation string, headers array<string>, player string, cells array<string>")
    names = spark.createDataFrame([(r[0], "L", f"k{r[0]}") for r in rows], "row int, league string, name_key string")
    known = lambda at: spark.createDataFrame([(r[0], float(r[at])) for r in rows], "row int, value double")
    seen = [(r[0], "opta", label, f"o{r[0]}", float(r[at])) for r in rows for label, at in (("shots", 3), ("goals", 4))]
    observations = spark.createDataFrame(seen, "master_row int, provider string, label string, sample string, value double")
    columns = {"opta:shots": "shots", "opta:goals": "goals", "web:Goals": "web_goals", "web:Apps": "apps"}
    master, links, decisions = M.compose_master(panels, names, known(1), known(2), observations, "web", columns, ["opta", "web"], ["provider", "sample"])
    got = {r.master_row: r for r in master.collect()}
    assert len(got) == 40 and (got[9].shots, got[9].goals, got[9].web_goals, got[9].apps, got[9].unrecorded) == (28.0, 4.0, 4.0, 22.0, 0)
    assert (got[5].shots, got[5].web_goals, got[5].unrecorded) == (16.0, 0.0, 2)  # not linked
    assert (got[6].shots, got[6].web_goals, got[6].apps, got[6].unrecorded) == (19.0, 0.0, 0.0, 2)  # its minutes stood in the row that did not fit
    assert {r.id: r.status for r in links.collect()}["505"] == "unresolved"
    merged = {frozenset((r.left.label, r.right.label)): r.merged for r in decisions.collect()}
    assert merged[frozenset(("shots", "shots.Total"))] and not merged[frozenset(("goals", "Goals"))]


def test_digest_depends_on_rows_only(spark):
    df = spark.range(200).selectExpr("id", "id % 7 AS k", "string(id) AS s")
    assert G.digest(df) == G.digest(df.repartition(9).orderBy(F.desc("id"))) == G.digest(df.select("s", "k", "id"))
    assert G.digest(df) != G.digest(df.unionByName(df.limit(1))) != G.digest(df.where("id <> 3"))


def test_revisions_and_releases(spark):
    root, df = new_folder(spark, "t"), spark.range(50).withColumn("v", F.col("id") * 2)
    out, first = G.revise(spark, root, {"df": df}, "double", "v1", lambda df: df.withColumn("v", F.col("v") * 2))
    _, again = G.revise(spark, root, {"df": df.repartition(3)}, "double", "v1", lambda df: df)
    _, other = G.revise(spark, root, {"df": df}, "double", "v2", lambda df: df)
    assert (first["reused"], again["reused"], other["reused"]) == (False, True, False)
    assert out.where("v = 4 * id").count() == 50
    assert G.publish(spark, root, "r1", df)["written"] and not G.publish(spark, root, "r1", df.repartition(2))["written"]
    with pytest.raises(ValueError):
        G.publish(spark, root, "r1", df.where("id > 1"))
    assert G.differences(df, df.repartition(4)).count() == 0
    assert G.reconcile(df, df.where("id > 1")).first()["agrees"] is False


def test_one_of_two_publications_at_once_is_refused(spark):
    """Both see an empty folder, both write; the marker goes to one of them, and its data stays whole."""
    for turn in range(4):
        root, df = new_folder(spark, "race"), spark.range(2000).withColumn("v", F.col("id") * 3)
        other = df.withColumn("v", F.col("v") + 1)
        gate, done = Barrier(2), {}

        def write(name, content):
            gate.wait()
            try:
                done[name] = G.publish(spark, root, "r", content)
            except ValueError as error:
                done[name] = str(error)

        threads = [Thread(target=write, args=a) for a in (("one", df), ("two", other))]
        [t.start() for t in threads], [t.join() for t in threads]
        won = [n for n, r in done.items() if isinstance(r, dict) and r["written"]]
        assert len(won) == 1 and sum("immutable" in str(r) for r in done.values()) == 1
        assert G.differences(G.verified(spark, f"{root}/r"), {"one": df, "two": other}[won[0]]).count() == 0
        assert len([n for n in names(spark, f"{root}/r") if n.startswith("attempt-")]) == 1


def test_a_marker_is_put_once(spark):
    path = new_folder(spark, "marker") + "/x/COMMIT.json"
    gate, won = Barrier(8), []

    def put(k):
        gate.wait()
        won.append(put_if_absent(spark, path, str(k)) and k)

    threads = [Thread(target=put, args=(k,)) for k in range(1, 9)]
    [t.start() for t in threads], [t.join() for t in threads]
    winner = [k for k in won if k]
    assert len(winner) == 1 and read_text(spark, path) == str(winner[0])
    assert not put_if_absent(spark, path, "later") and read_text(spark, path + ".not") is None
    with pytest.raises(ValueError):
        G.verified(spark, new_folder(spark, "nothing"))


def test_active_release(spark):
    releases = spark.createDataFrame(
        [("s", "r1", 1, True, "real"), ("s", "r2", 2, True, "real"), ("s", "r3", 3, False, "real"), ("s", "r4", 4, True, "historical"), ("t", "t1", 1, True, "real"), ("t", "t2", 2, True, "real")],
        "slot string, release_id string, created int, approved boolean, kind string",
    )
    bad = spark.createDataFrame([("t2",)], "release_id string")
    back = spark.createDataFrame([("s", "r1", 9), ("s", "r4", 10)], "slot string, release_id string, at int")
    got = {r["slot"]: (r["release_id"], r["rolled_back"]) for r in G.active_release(releases, bad, back).collect()}
    assert got == {"s": ("r1", True), "t": ("t1", False)}
