"""Nested provider documents as long rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.status import ratio_status, scalar_status
from ..operators.ordered import finite


def nesting(df: DataFrame, text: str) -> int:
    """How deep the containers of JSON texts nest, from their brackets outside strings: each shape is walked once."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(\\.|[^"\\])*+"', ""), r"[^\[\]{}]++", "")
    # Innermost containers side by side are as deep as one.
    shape = F.regexp_replace(bare, r"(?:\[\]|\{\})++", "{}")
    steps = F.transform(F.split("shape", ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    walk = lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most"))
    shapes = df.select(shape.alias("shape")).distinct()
    return shapes.agg(F.max(F.aggregate(steps, start, walk)["most"]).alias("d")).first()["d"] or 0


def flatten_json(df: DataFrame, key: Sequence[str], text: str, kinds: bool = False) -> DataFrame:
    """Every scalar path of a JSON document as (key, path, value), with ``kinds`` also its ``kind``: null, boolean,
    string or number.

    Members of lists of at most three keep their index, longer lists share ``[]``. Levels are opened down to
    the deepest document's, so what one document holds never depends on the others. A document that is no JSON
    is one row without a path, its text the value.
    """
    spark = df.sparkSession
    key = list(key)
    parsed = df.withColumn("v", F.try_parse_json(text))
    broken = parsed.where(F.col("v").isNull() & F.col(text).isNotNull()).select(*key, F.lit(None).cast("string").alias("path"), F.col(text).alias("value"))
    level = parsed.where(F.col("v").isNotNull()).select(*key, F.lit("").alias("path"), "v", F.lit(False).alias("done"))
    depth = nesting(df, text)
    names = ", ".join(f"t.{k}" for k in key)
    for _ in range(depth):
        # A scalar yields one row without a position and stays; an empty container goes.
        level = spark.sql(
            f"""SELECT {names}, CASE WHEN e.pos IS NULL THEN t.path WHEN e.key IS NOT NULL THEN concat(t.path, IF(t.path = '', '', '.'), e.key)
              WHEN try_variant_get(t.v, '$[3]') IS NOT NULL THEN concat(t.path, '[]') ELSE concat(t.path, '[', e.pos, ']') END AS path,
              IF(e.pos IS NULL, t.v, e.value) AS v, e.pos IS NULL AS done
            FROM {{docs}} t, LATERAL variant_explode_outer(t.v) e
            WHERE t.done OR e.pos IS NOT NULL OR NOT schema_of_variant(t.v) RLIKE '^(OBJECT|ARRAY)'""",
            docs=level,
        )
    kind = "CASE schema_of_variant(v) WHEN 'VOID' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'STRING' THEN 'string' ELSE 'number' END AS kind"
    scalars = level.where("done OR NOT schema_of_variant(v) RLIKE '^(OBJECT|ARRAY)'").selectExpr(*key, "path", "cast(v AS string) AS value", *([kind] if kinds else []))
    return scalars.unionByName(broken.withColumn("kind", F.lit("string")) if kinds else broken)


def members(df: DataFrame, key: Sequence[str], text: str, path: str) -> DataFrame:
    """(key, place, item) of the list at a path of a JSON document, each member's JSON a row; without the list no row."""
    names = ", ".join(f"t.{k}" for k in key)
    listed = df.select(*key, F.try_variant_get(F.try_parse_json(text), f"$.{path}" if path else "$", "array<variant>").alias("held"))
    return df.sparkSession.sql(f"SELECT {names}, e.pos AS place, to_json(e.col) AS item FROM {{docs}} t, LATERAL posexplode(t.held) e", docs=listed)


def text_at(item: str, path: str) -> Column:
    """The scalar at a path of a JSON text, as text."""
    return F.try_variant_get(F.try_parse_json(item), f"$.{path}", "string")


def stat_groups(df: DataFrame, key: Sequence[str], groups: str, known: Sequence[str]) -> DataFrame:
    """Nested statistic groups as (key, stat, part, value).

    ``groups``: array of (name, stats map of struct(type, value, total)). The same statistic may be
    repeated; identical repeats collapse, different ones reject it.
    """
    key = list(key)
    stats = (
        df.select(*key, F.explode(groups).alias("g"))
        .select(*key, F.explode("g.stats").alias("stat", "s"))
        .where(F.col("stat").isin(*known))
    )
    text = F.to_json("s")
    merged = stats.groupBy(*key, "stat").agg(F.min(text).alias("lo"), F.max(text).alias("hi"), F.first("s").alias("s"))
    checked = merged.selectExpr(
        *key,
        "stat",
        "s",
        "CASE WHEN lo <> hi THEN 'conflicting repeat' WHEN s.type = 'fraction' AND s.value > s.total THEN 'numerator exceeds denominator' "
        "WHEN NOT s.type IN ('integer', 'double', 'fraction') THEN 'unsupported shape' END AS reason",
    )
    return checked.selectExpr(
        *key,
        "stat",
        "reason",
        "inline(IF(reason IS NULL AND s.type = 'fraction', "
        "array(named_struct('part', 'value', 'value', s.value), named_struct('part', 'total', 'value', s.total)), "
        "array(named_struct('part', 'value', 'value', IF(reason IS NULL, s.value, NULL)))))",
    )


def report_sections(df: DataFrame, doc: str, identity: Sequence[str], exposure: Sequence[str]) -> DataFrame:
    """{group: {section: [rows]}} as (group, section, entity, field, kind, value).

    ``doc``: map<group, map<section, array<map<field, string>>>>; ``entity`` is the first identity field.
    """
    ids = ", ".join(f"'{c}'" for c in identity)
    exp = ", ".join(f"'{c}'" for c in exposure)
    return (
        df.select(F.explode(doc).alias("group", "sections"))
        .select("group", F.explode("sections").alias("section", "rows"))
        .select("group", "section", F.explode("rows").alias("r"))
        .select("group", "section", F.col("r")[identity[0]].alias("entity"), F.explode("r").alias("field", "value"))
        .withColumn("kind", F.expr(f"CASE WHEN field IN ({ids}) THEN 'identity' WHEN field IN ({exp}) THEN 'exposure' ELSE 'metric' END"))
    )


#: Where and how a field of a report stands: identity, context (exposure), metric, event; one value, a match, an event.
REPORT_COLUMNS = ("entity", "sample", "field", "kind", "scope", "value", "status")


def player_totals(df: DataFrame, key: Sequence[str], body: str, identity: Sequence[str], exposure: Sequence[str], minutes: str) -> DataFrame:
    """A season report {players: [{field: value}]} as (key, ``REPORT_COLUMNS``): a value per player and field.

    Players without minutes are left out. Numbers that come as text are numbers; identities stay text.
    """
    rows = members(df, key, body, "players").withColumn("entity", text_at("item", "id")).where(F.coalesce(text_at("item", minutes).try_cast("double"), F.lit(0.0)) > 0)
    flat = flatten_json(rows, [*key, "entity"], "item", kinds=True)
    names = lambda c: ", ".join(f"'{x}'" for x in c)
    marked = flat.selectExpr("*", f"CASE WHEN path IN ({names(identity)}) THEN 'identity' WHEN path IN ({names(exposure)}) THEN 'context' ELSE 'metric' END AS role")
    number = (F.col("kind") == "string") & (F.col("role") != "identity") & finite(F.col("value").try_cast("double"))
    status = F.when(number, "numeric").otherwise(scalar_status(F.col("value"), F.col("kind")))
    return marked.select(
        *key, "entity", F.lit("aggregate").alias("sample"), F.concat(F.lit("players."), "path").alias("field"), F.col("role").alias("kind"), F.lit("aggregate").alias("scope"), "value", status.alias("status")
    )


def shot_events(df: DataFrame, key: Sequence[str], match: str, body: str) -> DataFrame:
    """A shot report {periods: [{shots: [{id, player: {id}, ...}]}]} as (key, ``REPORT_COLUMNS``): a value per shot and path."""
    own = list(dict.fromkeys([*key, match]))
    periods = df.select(*own, F.explode(F.try_variant_get(F.try_parse_json(body), "$.periods", "array<variant>")).alias("p"))
    shots = periods.select(*own, F.explode(F.try_variant_get("p", "$.shots", "array<variant>")).alias("s"))
    sample = F.concat_ws(":", F.col(match).cast("string"), F.try_variant_get("s", "$.id", "string"))
    named = shots.select(*key, F.try_variant_get("s", "$.player.id", "string").alias("entity"), sample.alias("sample"), F.to_json("s").alias("item"))
    named = named.persist()  # read for its depth and for its values
    flat = flatten_json(named.where("entity IS NOT NULL"), [*key, "entity", "sample"], "item", kinds=True)
    kind = F.when(F.col("path").rlike(r"^(player|keeper)\.|^(id|team_id)$"), "identity").otherwise("event")
    return flat.select(
        *key, "entity", "sample", F.concat(F.lit("shot."), "path").alias("field"), kind.alias("kind"), F.lit("event").alias("scope"), "value", scalar_status(F.col("value"), F.col("kind")).alias("status")
    )


def match_statistics(df: DataFrame, key: Sequence[str], match: str, body: str) -> DataFrame:
    """A match report [{player: {id}, team_id, stats: [{stats: {name: {key, stat: {type, value, total}}}}]}] as (key,
    ``REPORT_COLUMNS``): who it is about, and of every statistic its parts and, of a fraction, the percentage.

    Players without minutes are left out. A fraction whose value exceeds its total or is negative is invalid and has no
    percentage; 0 of 0 is not applicable.
    """
    own = list(dict.fromkeys([*key, match]))
    # Reports are dealt before they are parsed, a small file may hold many; each is parsed once and its players kept.
    dealt = df.select(*own, body).repartition(match)
    rows = dealt.select(*own, F.explode(F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")).alias("v"))
    empty = F.expr("cast(array() AS array<struct<stat string, type string, value string, total string, type_kind string, value_kind string, total_kind string>>)")

    def statistic(entry: Column) -> Column:
        return F.struct(
            F.coalesce(F.try_variant_get(entry, "$.key", "string"), F.lit("unnamed")).alias("stat"),
            *[F.try_variant_get(entry, f"$.stat.{c}", "string").alias(c) for c in ("type", "value", "total")],
            *[F.schema_of_variant(F.try_variant_get(entry, f"$.stat.{c}", "variant")).alias(f"{c}_kind") for c in ("type", "value", "total")],
        )

    named = F.transform(
        F.try_variant_get("v", "$.stats", "array<variant>"),
        lambda g: F.transform(F.map_values(F.try_variant_get(g, "$.stats", "map<string,variant>")), statistic),
    )
    who = F.to_json(F.struct(F.try_variant_get("v", "$.player", "variant").alias("player"), F.try_variant_get("v", "$.team_id", "variant").alias("team_id")))
    seen = rows.select(*own, F.try_variant_get("v", "$.player.id", "string").alias("entity"), who.alias("who"), F.coalesce(F.flatten(F.array_compact(named)), empty).alias("held")).where("entity IS NOT NULL")
    # A player of a match has a row or two.
    anywhere = F.bool_or(F.expr("exists(held, e -> coalesce(e.stat = 'minutes_played' AND try_cast(e.value AS double) > 0, false))")).over(Window.partitionBy(*own, "entity"))
    played = seen.withColumn("played", anywhere).where("played").select(*own, "entity", "who", "held").persist()
    entries = played.select(*own, "entity", F.inline("held"))
    number = lambda c: F.col(c).try_cast("double")
    fraction = F.col("type") == "fractionWithPercentage"
    both = finite(number("value")) & finite(number("total")) & ~F.col("value_kind").isin("STRING") & ~F.col("total_kind").isin("STRING")
    wrong = fraction & both & ((number("value") < 0) | (number("total") < 0) | (number("value") > number("total")))
    sound = both & ~wrong & (number("total") > 0)
    kind_of = lambda c: F.when(F.col(f"{c}_kind") == "VOID", "null").when(F.col(f"{c}_kind") == "BOOLEAN", "boolean").when(F.col(f"{c}_kind") == "STRING", "string").otherwise("number")
    context = F.col("stat").isin("unnamed", "minutes_played")

    def part(name: str, value: Column, status: Column, kind: Column, there: Column) -> Column:
        return F.when(there, F.struct(F.concat(F.lit("stats."), "stat", F.lit(f".{name}")).alias("field"), kind.alias("kind"), value.alias("value"), status.alias("status")))

    metric = F.when(context, "context").otherwise("metric")
    parts = [
        part(c, F.col(c), F.when(wrong, "invalid").otherwise(scalar_status(F.col(c), kind_of(c))) if c == "value" else scalar_status(F.col(c), kind_of(c)), F.lit("context") if c == "type" else metric, F.col(f"{c}_kind").isNotNull())
        for c in ("type", "value", "total")
    ]
    nothing = F.when(sound, "numeric").when(both, F.coalesce(ratio_status(number("value"), number("total")), F.when(wrong, "invalid"), F.lit("missing"))).otherwise("missing")
    parts.append(part("calculated_percentage", F.when(sound, (F.lit(100.0) * number("value") / number("total")).cast("string")), nothing, F.lit("metric"), fraction))
    stats = entries.select(*own, "entity", F.explode(F.array_compact(F.array(*parts))).alias("p")).select(*own, "entity", "p.*")
    about = flatten_json(played.select(*own, "entity", "who"), [*own, "entity"], "who", kinds=True)
    identity = about.select(*own, "entity", F.concat(F.lit("metadata."), "path").alias("field"), F.lit("identity").alias("kind"), "value", scalar_status(F.col("value"), F.col("kind")).alias("status"))
    return stats.withColumn("scope", F.lit("appearance")).unionByName(identity.withColumn("scope", F.lit("identity"))).select(
        *key, "entity", F.col(match).cast("string").alias("sample"), "field", "kind", "scope", "value", "status"
    )


# Accumulation selector to field prefix; per-game overview columns.
ACCUMULATION = {"0": "per_game.", "1": "per_90.", "2": "", "4": "every_x_minutes."}
PER_GAME_COLUMNS = (
    "SpG", "KeyP", "AvgP", "AerialsWon", "Tackles", "Inter", "Fouls", "Offsides", "Clear", "Drb", "Blocks", "Crosses",
    "LongB", "ThrB", "Fouled", "Disp", "UnsTch",
)
SHARED_COLUMNS = ("Apps", "Mins", "Rating")


def table_panels(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Web table panels as (key, entity, field, cell); a row that does not fit its header is marked.

    Columns read: panel, category (null on overview panels), accumulation, headers, player (link), cells.
    The field name carries category and grain.
    """
    shared = ", ".join(f"'{c}'" for c in SHARED_COLUMNS)
    per_game = ", ".join(f"'{c}'" for c in PER_GAME_COLUMNS)
    prefix = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACCUMULATION.items())
    rows = df.selectExpr(
        *key,
        "panel",
        "category",
        "coalesce(accumulation, '0') AS accumulation",
        "regexp_extract(player, '/players/([0-9]+)', 1) AS entity",
        "size(headers) <> size(cells) AS mismatch",
        "explode(arrays_zip(headers, cells)) AS c",
    ).where("entity <> ''")
    named = rows.selectExpr(
        *key,
        "entity",
        f"CASE WHEN c.headers IN ({shared}) THEN c.headers "
        f"WHEN category IS NOT NULL THEN concat(CASE accumulation {prefix} END, category, '.', c.headers) "
        f"WHEN c.headers IN ({per_game}) THEN concat('per_game.', substring_index(panel, '-', -1), '.', c.headers) ELSE c.headers END AS field",
        "c.headers AS header",
        "c.cells AS cell",
        "mismatch",
    )
    return named.where("coalesce(header, '') NOT IN ('', 'Player')").drop("header")


def assets(flat: DataFrame, key: Sequence[str], order: str, prefix: str, url_pattern: str) -> DataFrame:
    """Entities with an id prefix, a name and a whitelisted image anywhere in the documents; last one wins.

    ``flat``: flattened documents (key, path, value, order).
    """
    parts = flat.selectExpr(
        *key, order, "regexp_replace(path, '[.]?[^.]+$', '') AS parent", "regexp_extract(path, '([^.]+)$', 1) AS leaf", "value"
    ).where("leaf IN ('id', 'name', 'image_url')")
    nodes = parts.groupBy(*key, order, "parent").agg(
        *[F.expr(f"max(IF(leaf = '{c}', value, NULL)) AS {c}") for c in ("id", "name", "image_url")]
    )
    good = nodes.where(F.col("id").startswith(prefix) & F.col("name").isNotNull() & F.col("image_url").rlike(url_pattern))
    return good.groupBy("id").agg(F.max_by(F.struct("name", "image_url"), F.struct(order, "parent")).alias("r")).select("id", "r.*")


def panel_inventory(df: DataFrame) -> DataFrame:
    """Per league: distinct entities, distinct qualified columns and the total the pages announce.

    ``df``: (league, entity, field, text) long panel cells.
    """
    total = F.regexp_extract("text", "Page [0-9]+/[0-9]+ \\| Showing [0-9]+ - [0-9]+ of ([0-9]+)", 1)
    return df.groupBy("league").agg(
        F.count_distinct("entity").alias("entities"),
        F.count_distinct("field").alias("columns"),
        F.max(total.try_cast("long")).alias("announced"),
    )
