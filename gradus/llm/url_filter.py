"""URL verdicts by rules, and beyond them by a tree of path templates learnt per host (DataFrame functions only).

Level by level, the segments under a host and a template so far are counted. Where they are many and mostly
different the level is variable: its segments become ``*``, but for those with enough rows of their own or whose
labelled share differs significantly. On other levels, segments whose labelled share does not differ significantly
from that of all their siblings are merged into one branch ``~``; the rest keep their names. Under a template with
few rows all that follows is ``**``. A template is rejected if its share of good labels, smoothed towards its host's and the host's towards all, falls
below ``LEAST``. A hot host is split by its segments, and all counts are partial sums before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import beside_cohort
from .common import named, written

#: (verdict, host and path); a rule also holds for all subdomains of its host.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
MANY = 20
DIFFERENT = 0.2
#: Normal quantile beyond which a branch differs from its siblings.
DISTINCT = 1.96
#: Good and bad labels a rare segment of a variable level must expect before that quantile is trusted.
EXPECTED = 5
SMOOTHING = 5.0
LEAST = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null or a text without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (a struct of rule and verdict) that fits, else null. Rules are a parameter, not data."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string,host:string,path:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    parts = [(verdict, rule, *rule.split("/", 1)) for verdict, rule in ordered]
    known = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit("/" + p).alias("path")) for v, r, h, p in parts])
    fits = F.filter(known, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.get(fits, F.lit(0))


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path, good: 1, 0 or null) with the ``template`` of each path.

    Paths of any depth are read to their end, as long as they share their template with enough others: where fewer
    than ``MANY`` rows go on under a template, what follows is ``**``, and those rows are done.
    """
    segments = F.filter(F.split("path", "/", -1), lambda s: s != "")
    rows = written(urls.withColumn("segments", segments).withColumn("template", F.lit("")), "url-segments")
    done = rows.where(F.size("segments") == 0)
    rows, level = rows.where(F.size("segments") > 0), 0
    while not rows.isEmpty():
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        children = rows.groupBy("host", "template", "segment").agg(
            F.count("*").alias("n"), F.count("good").alias("labelled"), F.sum(F.coalesce("good", F.lit(0))).alias("right")
        )
        children = written(children, "url-children")
        parents = children.groupBy("host", "template").agg(
            F.count("*").alias("branches"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("right").alias("all_right")
        )
        share = F.try_divide("all_right", "all_labelled")
        spread = F.sqrt(F.try_divide(share * (1 - share), "labelled"))
        differs = F.abs(F.try_divide("right", "labelled") - share) > DISTINCT * spread  # null without labels
        variable = (F.col("branches") >= MANY) & (F.col("branches") >= DIFFERENT * F.col("all_n"))
        enough = F.col("labelled") * F.least(share, 1 - share) >= EXPECTED
        stands_out = (F.col("n") >= MANY) | (differs & enough)
        branch = F.when(F.col("all_n") < MANY, "**").when(variable, F.when(stands_out, F.col("segment"))).when(differs, F.col("segment")).otherwise(F.lit("~"))
        # One host may have most branches, and one branch most rows: neither is gathered for its parent's numbers.
        judged = beside_cohort(children, parents, ["host", "template"]).select("host", "template", "segment", branch.alias("branch")).where("branch IS NOT NULL")
        rows = beside_cohort(rows, judged, ["host", "template", "segment"], "left")
        rows = rows.withColumn("branch", F.coalesce("branch", F.lit("*"))).withColumn("template", F.concat("template", F.lit("/"), "branch")).drop("segment")
        rows, level = written(rows, "url-level"), level + 1
        more = (F.size("segments") > level) & (F.col("branch") != "**")
        done = done.unionByName(rows.where(~more).drop("branch"))
        rows = rows.where(more).drop("branch")
    return done.drop("segments")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    keep: Sequence[str] = ("page_id",),
    url: str = "url",
    page_id: str = "page_id",
    rules: Sequence[tuple[str, str]] = RULES,
) -> DataFrame:
    """``keep``, host, path, rule, verdict, template and purity of every url, repeated rows too.

    ``labels`` (page_id, good) marks pages 1 or 0; other values, nulls and ids without a page count for nothing;
    of several labels the smallest holds. A url without a host and path belongs to the empty host. Kept columns
    named like a result give way to it.
    """
    made = ("host", "path", "rule", "verdict", "template", "purity")
    keep = [c for c in dict.fromkeys(keep) if c not in made]
    host, path = split_url(named(url))
    marks = labels.where(F.col("good").isin(0, 1)).groupBy(F.col(page_id).alias("__page")).agg(F.min("good").alias("good"))
    kept = [named(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = pages.select(*kept, named(page_id).alias("__id"), host.alias("host"), path.alias("path"))
    rows = rows.join(marks, F.col("__id") == F.col("__page"), "left").drop("__id", "__page")
    grown = templates(rows)
    count = lambda *by: grown.groupBy(*by).agg(F.count("good").alias("labelled"), F.sum(F.coalesce("good", F.lit(0))).alias("right"))
    every = count().select(((F.col("right") + SMOOTHING * LEAST) / (F.col("labelled") + SMOOTHING)).alias("base"))
    base = every.first()["base"]
    base = 0.5 if base is None else float(base)
    own = count("host", "template")
    hosts = own.groupBy("host").agg(((F.sum("right") + SMOOTHING * base) / (F.sum("labelled") + SMOOTHING)).alias("prior"))
    purity = own.join(hosts, "host").select("host", "template", ((F.col("right") + SMOOTHING * F.col("prior")) / (F.col("labelled") + SMOOTHING)).alias("purity"))
    found = grown.join(purity, ["host", "template"], "left").withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    learnt = F.when(F.col("purity") < LEAST, F.lit("block")).otherwise(F.lit("allow"))
    return found.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", learnt).alias("verdict"),
        F.concat("host", "template").alias("template"),
        "purity",
    )


def _level_sql(level: int) -> str:
    last, now = f"rows{level - 1}", f"rows{level}"
    return f"""
    child{level} AS (
        SELECT host, template, segments[{level}] AS segment, count(*) AS n, count(good) AS labelled, sum(coalesce(good, 0)) AS right_n
        FROM {last} WHERE len(segments) >= {level} AND NOT ends_with(template, '/**') GROUP BY ALL
    ),
    parent{level} AS (
        SELECT host, template, count(*) AS branches, sum(n) AS all_n, sum(labelled) AS all_labelled, sum(right_n) AS all_right
        FROM child{level} GROUP BY ALL
    ),
    known{level} AS (
        SELECT host, template, segment, n, labelled, all_n, branches >= {MANY} AND branches >= {DIFFERENT} * all_n AS variable,
               coalesce(labelled > 0 AND abs(right_n / labelled - all_right / all_labelled)
                    > {DISTINCT} * sqrt(all_right / all_labelled * (1 - all_right / all_labelled) / labelled), FALSE) AS differs,
               coalesce(labelled * least(all_right / all_labelled, 1 - all_right / all_labelled) >= {EXPECTED}, FALSE) AS enough
        FROM child{level} JOIN parent{level} USING (host, template)
    ),
    branch{level} AS (
        SELECT host, template, segment,
               CASE WHEN all_n < {MANY} THEN '**' WHEN variable THEN CASE WHEN n >= {MANY} OR (differs AND enough) THEN segment ELSE '*' END
                    WHEN differs THEN segment ELSE '~' END AS branch
        FROM known{level}
    ),
    {now} AS (
        SELECT r.* REPLACE (CASE WHEN b.branch IS NULL THEN r.template ELSE r.template || '/' || b.branch END AS template)
        FROM {last} r LEFT JOIN branch{level} b ON len(r.segments) >= {level} AND r.host = b.host AND r.template = b.template AND r.segments[{level}] = b.segment
    ),"""


def sql(labels: str, depth: int = 3, rules: Sequence[tuple[str, str]] = RULES) -> str:
    """DuckDB SQL for ``judge_urls`` over ``pages`` whose paths have at most ``depth`` segments where their templates are shared."""
    listed = ", ".join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in rules)
    return f"""
    WITH mark AS (SELECT page_id, min(good) AS good FROM ({labels}) WHERE good IN (0, 1) GROUP BY page_id),
    rest AS (
        SELECT page_id, good, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages LEFT JOIN mark USING (page_id)
    ),
    rows0 AS (
        SELECT page_id, good, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, '' AS template,
               list_filter(string_split(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segments
        FROM rest
    ),{"".join(_level_sql(k) for k in range(1, depth + 1))}
    grown AS (SELECT page_id, host, path, template, good FROM rows{depth}),
    base AS (SELECT (sum(coalesce(good, 0)) + {SMOOTHING * LEAST}) / (count(good) + {SMOOTHING}) AS base FROM grown),
    own AS (SELECT host, template, count(good) AS labelled, sum(coalesce(good, 0)) AS right_n FROM grown GROUP BY ALL),
    prior AS (SELECT host, (sum(right_n) + {SMOOTHING} * any_value(base)) / (sum(labelled) + {SMOOTHING}) AS prior FROM own, base GROUP BY host),
    rule AS (SELECT * FROM (VALUES {listed}) AS t (verdict, rule, rule_host, rule_path)),
    place AS (SELECT DISTINCT host, path FROM grown),
    hit AS (
        SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
        FROM place JOIN rule ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY ALL
    )
    SELECT page_id, host, path, rule,
           coalesce(verdict, CASE WHEN (right_n + {SMOOTHING} * prior) / (labelled + {SMOOTHING}) < {LEAST} THEN 'block' ELSE 'allow' END) AS verdict,
           host || template AS template, (right_n + {SMOOTHING} * prior) / (labelled + {SMOOTHING}) AS purity
    FROM grown LEFT JOIN own USING (host, template) LEFT JOIN prior USING (host) LEFT JOIN hit USING (host, path)
    """
