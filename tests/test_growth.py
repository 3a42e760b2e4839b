"""What a plan may repeat or gather as tables grow, and results at the edges of it."""

from pyspark.sql import functions as F

from gradus.config import RoleSpec
from gradus.operators import aggregates
from gradus.operators import identity as J
from gradus.operators import quality, rating, recruit, research
from gradus.sources import nested, pages


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_references_stand_in_no_plan(spark):
    one = spark.createDataFrame([(1, '<a href="/x?a=1&amp;b=&eacute;">t&eacute;t</a><table><tr><td title="&lt;p&gt;"></td><td><img alt="a&amp;b"></td></tr></table>')], "page_id long, html string")
    found = pages.extract(one, "page_id", "html")
    assert "CounterClockwiseContourIntegral" not in plan(found)
    assert len(plan(found)) < 100_000
    assert "RepartitionByExpression" in plan(found)
    rows = {r.kind: r for r in found.collect()}
    assert rows["link"].value == "/x?a=1&b=é" and rows["link"].text == "tét"
    assert list(rows["row"].cells) == ["<p>", "a&b"]


def test_pieces_are_not_joined_with_the_names_nor_decoded_to_be_kept(spark):
    pages_ = spark.createDataFrame([(1, '<a href="/x?a=1&amp;b=2">t&eacute;t &bogus; &#65;</a><option value="v">o</option>')], "k long, html string")
    found = pages.extract(pages_, "k", "html").where("kind IN ('link', 'option')")
    assert "Join" not in plan(found)
    assert all("transform" not in line for line in plan(found).splitlines() if "Filter" in line)
    assert {(r.kind, r.value, r.text) for r in found.collect()} == {("link", "/x?a=1&b=2", "tét &bogus; A"), ("option", "v", "o")}


def test_embedded_json_walks_a_page_once(spark):
    text = '<script id="D" type="x">{"a": "}]\\"", "s": [1, {"b": 2}]} tail</script>'
    cut_off = '<script id="D">{"a": [1, 2}</script>'
    df = spark.createDataFrame([(1, text), (2, cut_off), (3, "<p>none</p>"), (4, None)], "k long, html string")
    found = pages.embedded_json(df, "k", "html", script_id="D")
    assert [(r.k, r.body) for r in found.collect()] == [(1, '{"a": "}]\\"", "s": [1, {"b": 2}]}')]
    assert plan(found).count("aggregate(") == 1 and "RepartitionByExpression" in plan(found)


def test_embedded_inventory_reads_the_wanted_season_without_a_join(spark):
    body = '{"now": "9", "seasons": [{"id": "8", "name": "old"}, {"id": "9", "name": "new"}], "rows": [{"id": 1, "g": 0}, {"id": 2, "g": null}]}'
    bodies = spark.createDataFrame([(1, body), (2, body.replace('"now": "9"', '"now": "8"')), (3, "{}")], "k long, body string")
    found = pages.embedded_inventory(bodies, "k", "rows", "id", "now", "seasons", "new")
    assert "Join" not in plan(found)
    assert {(r.field, r.entities, r.numeric, r.zero, r.missing) for r in found.collect()} == {("id", 2, 2, 0, 0), ("g", 2, 1, 1, 1)}


def test_nesting_walks_shapes_and_shots_are_parsed_once(spark):
    texts = ['{"a": [[], {}, [1, {"b": "}]"}]]}', "[1]", "3", None, '{"x": "[[[[[["}']
    assert nesting_of(spark, texts) == 4
    assert nesting_of(spark, ["7"]) == 0
    body = '{"periods": [{"shots": [{"id": "s1", "player": {"id": 5}, "x": 0}]}, {"shots": []}, {}]}'
    docs = spark.createDataFrame([(1, body), (2, "{}")], "m long, body string")
    found = nested.shot_events(docs, ["m"], "m", "body")
    assert {(r.entity, r.sample, r.field, r.value) for r in found.collect()} == {
        ("5", "1:s1", "shot.id", "s1"), ("5", "1:s1", "shot.player.id", "5"), ("5", "1:s1", "shot.x", "0")
    }
    # The shots are kept, so what made them is not run again for each level.
    assert "InMemoryRelation" in found._jdf.queryExecution().withCachedData().toString()


def nesting_of(spark, texts):
    return nested.nesting(spark.createDataFrame([(t,) for t in texts], "t string"), "t")


def test_a_hot_group_is_one_round_of_components(spark, monkeypatch):
    rounds = []
    kept = J.cut
    monkeypatch.setattr(J, "cut", lambda df: rounds.append(1) or kept(df))
    hot = spark.range(3000).select((F.col("id") + 7).alias("row"), F.lit("g").alias("group"))
    odd = spark.createDataFrame([(1, None), (2, "h"), (3, "h"), (3, "i"), (4, "i"), (5, "j")], "row long, group string")
    labels = {r.row: r.label for r in J.components(hot.union(odd), "row", ["group"]).collect()}
    assert {labels[i + 7] for i in range(3000)} == {7}
    assert {i: labels[i] for i in range(1, 6)} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5}
    assert len(rounds) <= 15


def test_row_lookup_lists_no_pairs_of_a_shared_source(spark):
    """30,000 entities and 30,000 rows of one source: 900 million pairs if they met."""
    many = spark.range(30_000).selectExpr("id AS who", "'hot' AS nation")
    odd = spark.createDataFrame([(-1, "a"), (-1, "b"), (-2, "a"), (-2, None), (-3, None), (-4, "c")], "who long, nation string")
    rows = spark.range(30_000).selectExpr("'hot' AS nation", "id AS master_row").union(
        spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 5), ("c", 6), (None, 9)], "nation string, master_row long")
    )
    found = {r.who: (r.master_row, r.rows) for r in J.source_row_lookup(many.union(odd), rows, "who", ["nation"]).collect()}
    assert len(found) == 30_004 and found[0] == found[29_999] == (None, 30_000)
    assert [found[-i] for i in (1, 2, 3, 4)] == [(1, 1), (1, 1), (None, 0), (None, 2)]


def test_percentiles_meet_values_whose_prior_differs_between_readings(spark):
    """A mean of doubles may come out differently whenever it is computed; here it always does."""

    def noisy(batches):
        import os

        for batch in batches:
            batch["value"] += int.from_bytes(os.urandom(2), "little") * 1e-7
            yield batch

    rows = [(i, "r", "L", 900.0, "m", "per90", float(i), float(i % 7), 900.0) for i in range(40)]
    schema = "player int, role string, league string, minutes double, metric string, unit string, value double, numerator double, denominator double"
    df = spark.createDataFrame(rows, schema).mapInPandas(noisy, schema)
    found = recruit.role_profiles(df, {"r": RoleSpec(("m",), {"m": 1})}).collect()
    assert len(found) == 40 and all(r.percentile is not None for r in found)


def test_keeper_samples_hold_little_of_each_sample(spark):
    rows = [("k", "s1", "m", 90.0), ("k", "s1", "r", 70.0), ("k", "s1", "a", 10.0), ("k", "s2", "m", 45.0), ("k", "s2", "m", None), ("k", "s3", "m", 30.0), ("k", "s3", "r", None), ("k", "s3", "a", None), ("k", "s4", "m", 20.0), ("k", "s4", "x", None)]
    obs = spark.createDataFrame(rows, "player string, sample string, field string, value double")
    found = aggregates.window_rollup(obs, ["player"], "sample", "m", "r", "a")
    assert [tuple(r) for r in found.collect()] == [("k", 3, 140.0, None, None)]
    full = aggregates.window_rollup(obs.where("sample = 's1'"), ["player"], "sample", "m", "r", "a")
    assert [tuple(r) for r in full.collect()] == [("k", 1, 90.0, 10.0, 70.0)]
    assert plan(found).count("count(CASE") == 0


def test_lineups_and_links_are_one_grouping(spark):
    rows = [(1, 1, "a", 4.0), (1, 2, "b", 2.0), (1, 4, "c", None), (2, 1, "a", 4.0), (2, 2, "b", 1.0), (3, 3, "z", None), (3, 4, "y", 1.0)]
    placed = spark.createDataFrame(rows, "lineup int, slot int, player string, score double")
    found = aggregates.lineup_summary(aggregates.neighbour_links(placed, "score - score_b"), 2)
    assert "Join" not in plan(found)
    assert {r.lineup: tuple(r)[1:] for r in found.collect()} == {1: (3, None, 2.0, 1, 1), 2: (2, 2.5, 3.0, 1, 1), 3: (2, None, None, 0, 1)}


def test_measurements_read_a_bundle_once(spark):
    rows = [(1, 4.0, 2.0, 90.0), (2, 0.0, 1.0, None), (3, 0.0, 0.0, 0.0), (4, 1.0, 3.0, 10.0), (5, -1.0, None, 10.0)]
    bundles = spark.createDataFrame(rows, "row int, goals double, keep double, minutes double")
    measures = [rating.Measure("g90", ["goals"], "per90"), rating.Measure("k", ["keep", "goals"], "%"), rating.Measure("s", ["goals", "keep", "keep"], "%", "share")]
    found = rating.provider_measurements(bundles, measures, ["row"])
    assert "Union" not in plan(found)
    got = {(r.row, r.key): (r.value, r.denominator, r.status) for r in found.collect()}
    assert got == {
        (1, "g90"): (4.0, 90.0, "observed"), (1, "k"): (50.0, 4.0, "observed"), (1, "s"): (4.0, 4.0, "observed"),
        (3, "g90"): (None, 0.0, "zero_exposure"), (3, "k"): (None, 0.0, "not_applicable_zero_attempts"),
        (4, "g90"): (9.0, 10.0, "observed"), (4, "k"): (None, 1.0, "invalid"), (4, "s"): (1.0, 6.0, "observed"), (5, "g90"): (None, 10.0, "invalid"),
    }


def test_appearances_meet_their_reports_in_one_grouping(spark):
    rows = [
        (1, "a", "players", 7, 60.0, 5.0, 0.1), (1, "a", "players", 7, 30.0, None, 0.1), (1, "a", "advanced", 7, 80.0, 9.0, 0.1), (1, "a", "shots", 7, 1.0, 1.0, 0.5),
        (2, "a", "players", 7, 90.0, None, 0.1), (2, "a", "advanced", 8, 90.0, 3.0, 0.1), (2, "b", "players", 7, 10.0, 2.0, 0.1),
        (3, "a", "players", 7, 90.0, 1.0, 0.1), (3, "x", "shots", 7, 1.0, 1.0, 0.2), (4, "a", "players", 7, 131.0, 1.0, 0.1), (5, "a", "players", 7, 130.0, 1.0, 0.1),
    ]
    reports = spark.createDataFrame(rows, "match int, player string, report string, team int, minutes double, touches double, xg double")
    found = J.assemble_appearances(reports)
    assert "Join" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {
        (1, "a", 7, 90.0, 5.0, 1, 0.5, False), (2, "a", 7, 90.0, 3.0, 0, 0.0, True), (2, "b", 7, 10.0, 2.0, 0, 0.0, True),
        (3, "a", 7, 90.0, 1.0, 0, 0.0, True), (4, "a", 7, 131.0, 1.0, 0, 0.0, True), (5, "a", 7, 130.0, 1.0, 0, 0.0, False),
    }


def test_match_reports_are_dealt_and_parsed_once(spark):
    minutes = '{"key": "minutes_played", "stat": {"type": "integer", "value": %d}}'
    body = f'[{{"player": {{"id": "a"}}, "team_id": 4, "stats": [{{"stats": {{"m": {minutes % 0}}}}}]}}, {{"player": {{"id": "a"}}, "team_id": 5, "stats": [{{}}, {{"stats": {{"m": {minutes % 9}}}}}]}}, {{"player": {{"id": "b"}}, "stats": null}}]'
    docs = spark.createDataFrame([(1, body), (2, "[]")], "m long, body string")
    found = nested.match_statistics(docs, [], "m", "body")
    assert sorted((r.entity, r.field, r.value) for r in found.collect()) == [
        ("a", "metadata.player.id", "a"), ("a", "metadata.player.id", "a"), ("a", "metadata.team_id", "4"), ("a", "metadata.team_id", "5"),
        ("a", "stats.minutes_played.type", "integer"), ("a", "stats.minutes_played.type", "integer"), ("a", "stats.minutes_played.value", "0"), ("a", "stats.minutes_played.value", "9"),
    ]
    assert "InMemoryRelation" in plan(found) and "Join" not in plan(found)


def test_lineup_rules_repeat_a_line_twice(spark):
    rows = [(1, 1, "k"), (1, 2, "a"), (1, 3, "b"), (2, 1, "a"), (2, 1, "k"), (2, 3, "k"), (3, 1, "k"), (3, 2, None), (3, 4, "zz"), (4, None, "k"), (4, 2, "a"), (4, 3, "b")]
    lineups = spark.createDataFrame(rows, "lineup int, slot int, player string")
    squad = spark.createDataFrame([("k", True), ("a", False), ("b", False)], "player string, keeper boolean")
    found = quality.lineup_problems(lineups, squad, [1, 2, 3], 1)
    assert "Expand" not in plan(found)
    assert {r.lineup: r.problems for r in found.collect()} == {
        2: "slots;repeated player;keeper exchange", 3: "slots;unknown player;repeated player", 4: "slots"
    }


def test_boosted_trees_learn_from_cells(spark, monkeypatch):
    seen = []
    fit = research.GBTClassifier.fit
    monkeypatch.setattr(research.GBTClassifier, "fit", lambda self, df: seen.append((df.count(), df.agg(F.sum("rows")).first()[0])) or fit(self, df))
    folds = spark.range(1200).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'train' WHEN id % 3 = 1 THEN 'validation' ELSE 'test' END AS fold", "double(id % 5) AS x", "double(id % 2) AS z", "int((id % 5 >= 3) = (id % 2 = 0)) AS goal"
    )
    scores, _, fitted = research.train_models(folds, ["x", "z"], "goal", trees=12, step=0.5, epochs=5)
    assert seen == [(10, 400.0)]
    brier = {(r.model, r.fold): r.brier for r in scores.collect()}
    assert brier["boosted_trees", "test"] < 0.01 < brier["logistic", "test"]


def test_boosted_trees_see_a_rare_value(spark):
    folds = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'train' WHEN id % 3 = 1 THEN 'validation' ELSE 'test' END AS fold", "double(id * 7919 % 3000) AS x", "double(id < 30) AS z", "int(id < 30) AS goal"
    )
    scores, _, _ = research.train_models(folds, ["x", "z"], "goal", trees=8, step=0.5, epochs=3)
    assert max(r.brier for r in scores.collect() if r.model == "boosted_trees") < 0.001


def test_structs_of_many_fields_are_projected_once_and_not_made_by_a_generator(spark):
    from gradus.config import Ability, Feature, Model
    from gradus.operators.moments import moments

    model = Model((Feature("goals90", "goals"), Feature("shots90", "shots")), (Ability("A", 0.6, {"goals90": 0.5, "shots90": 0.5}), Ability("B", 0.4, {"shots90": 1.0})), 900, 1)
    df = spark.createDataFrame([(1, "ST", 900.0, 5.0, 10.0), (2, "ST", 900.0, None, 10.0)], "player int, position string, minutes double, goals double, shots double")
    rows = rating.ability_rows(df, model, ["player", "position"], "minutes")
    sums = moments(rows.where("eligible"), ["position", "ability"], 2)
    for made in (rows, sums):
        text = plan(made)
        assert "inline(array(" not in text and "size(" not in text
        assert "Generate inline" in text
    # Of the code of a stage no method is longer than the JVM compiles, else it runs as split projections.
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
    got = {(r.player, r.ability): (r.eligible, r.w0, r.w1) for r in rows.collect()}
    assert got == {(1, "A"): (True, 0.5, 0.5), (1, "B"): (True, 1.0, 0.0), (2, "A"): (True, 0.0, 1.0), (2, "B"): (True, 1.0, 0.0)}
    assert {(r.ability, r.n) for r in sums.where("pair = 'v0'").collect()} == {("A", 2), ("B", 2)}


def test_entities_of_a_recommendation_are_read_once(spark):
    from gradus.plans import recruit as plans
    from gradus.plans.bindings import entities

    sf = "/root/testdata/sf0.001"
    for made in (plans.briefs, plans.metrics):
        spark.catalog.clearCache()
        rows = made(spark, sf)
        assert entities(spark, sf).storageLevel.useMemory
        assert "InMemoryRelation" in rows._jdf.queryExecution().withCachedData().toString()
    spark.catalog.clearCache()


def test_rows_of_pages_are_not_broadcast_however_small_their_files(spark, tmp_path):
    html = (
        '</table><table><p>no row</p></table><table><tr><th>Player</th><th>Goals</th></tr><tr><td>A</td><td>0<table><tr><td>in</td></tr></table></td></tr>'
        "<tr><td>B</td></tr></table></table><table><tr><td>open</td></tr>"
    )
    made = [(1, "s", "p", "l", html, "d1"), (2, "s", "p", "l", html, "d1"), (3, "s", "p", "m", html.replace("A", "C"), "d2"), (None, "s", "p", "l", html, "d3"), (4, "s", "p", "l", None, "d4")]
    spark.createDataFrame(made, "k long, source string, page string, league string, html string, digest string").write.parquet(f"{tmp_path}/pages")
    stored = spark.read.parquet(f"{tmp_path}/pages")
    elements = pages.extract(stored, "k", "html")
    rows = {(r.k, r.table_no, r.row_no): (list(r.cells), list(r.headings)) for r in elements.where("kind = 'row'").collect()}
    head = ["Player", "Goals"]
    assert {at[1:]: found for at, found in rows.items() if at[0] == 1} == {(1, 0): (["in"], ["in"]), (2, 0): (head, head), (2, 1): (["A", "0"], head), (2, 2): (["B"], head)}
    assert {at[0] for at in rows} == {1, 2, 3} and len(rows) == 12
    found = pages.table_inventory(elements, stored.drop("html"), "k")
    run = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in run and run.count("posexplode") == 1
    assert {(r.field, r.league, r.records, r.numeric, r.zero, r.categorical, r.invalid) for r in found.collect()} == {
        (f"p.{field}", league, 2, zero, zero, 1 - zero, 1) for league in "lm" for field, zero in (("Player", 0), ("Goals", 1))
    }
