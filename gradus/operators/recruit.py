"""Role profiles, similarity and candidate ranking for batches of briefs.

Briefs, role specs and targets are short parameter tables; stints and profiles are the data.
A brief meets only the stints of its role, and rankings are cut to the limit before they move.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RATE_STRENGTH, RATIO_STRENGTH, ROLE_SPECS, RoleSpec
from ..functions.posterior import beta_interval, gamma_interval
from ..session import cut
from .ordered import quantiles, value_counts
from .quality import reasons
from .rating import top_per
from .sets import topk_jaccard
from .standardize import percentile_ranks

COMPONENTS = ("similarity", "quality", "tactical_fit", "replacement_fit", "coverage")


def canonical_stints(snapshots: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics, quarantine) from nested provider statistics; the latest retrieval of a stint wins.

    ``snapshots``: retrieved_at, league, season, response array of (player, statistics array);
    ``overrides``: reviewed (player, role).
    """
    flat = (
        snapshots.select("retrieved_at", "league", "season", F.explode("response").alias("r"))
        .select("retrieved_at", "league", "season", F.col("r.player").alias("player"), F.explode("r.statistics").alias("s"))
        .where("s.league = league AND s.season = season")
        .select("player", F.col("s.team").alias("team"), "league", "season", "retrieved_at", "s.minutes", "s.position", "s.counts")
    )
    key = ["player", "team", "league", "season"]
    latest = flat.groupBy(*key).agg(
        F.max_by(F.struct("minutes", "position", "counts"), F.struct("retrieved_at", "minutes")).alias("r")
    ).select(*key, "r.*")
    known = latest.join(overrides, "player", "left").withColumn(
        "role", F.expr("coalesce(role, IF(position = 'Goalkeeper', 'GK', NULL))")
    )
    checked = known.withColumn(
        "reason",
        F.expr(
            "CASE WHEN NOT coalesce(minutes > 0, false) THEN 'no minutes' WHEN role IS NULL THEN 'role unresolved' END"
        ),
    )
    good = checked.where("reason IS NULL")
    rates = good.select(*key, "role", "minutes", F.explode("counts").alias("metric", "numerator")).where(
        "numerator IS NOT NULL AND metric NOT IN ('saves', 'conceded')"
    ).selectExpr(*key, "role", "concat(metric, '_p90') AS metric", "'per90' AS unit", "numerator * 90 / minutes AS value", "double(numerator) AS numerator", "double(minutes) AS denominator")
    saves = good.where("role = 'GK' AND counts['saves'] + counts['conceded'] > 0").selectExpr(
        *key, "role", "'save_pct' AS metric", "'ratio' AS unit",
        "counts['saves'] / (counts['saves'] + counts['conceded']) AS value",
        "double(counts['saves']) AS numerator", "double(counts['saves'] + counts['conceded']) AS denominator",
    )
    return rates.unionByName(saves), checked.where("reason IS NOT NULL").select(*key, "reason")


def posterior_sql() -> dict[str, str]:
    """Posterior parameters of a metric row with its cohort mean ``prior``."""
    return {
        "alpha": f"IF(unit = 'ratio' AND numerator IS NOT NULL AND denominator IS NOT NULL, numerator + greatest(prior, 0.01D) * {RATIO_STRENGTH}, NULL)",
        "beta": f"IF(unit = 'ratio' AND numerator IS NOT NULL AND denominator IS NOT NULL, denominator - numerator + greatest(1 - prior, 0.01D) * {RATIO_STRENGTH}, NULL)",
        "shape": f"IF(unit = 'per90' AND numerator IS NOT NULL AND minutes > 0, numerator + greatest(prior, 0.001D) * {RATE_STRENGTH}, NULL)",
        "rate": f"IF(unit = 'per90' AND numerator IS NOT NULL AND minutes > 0, minutes / 90 + {RATE_STRENGTH}, NULL)",
    }


def posterior_means(metrics: DataFrame, cohort: Sequence[str]) -> DataFrame:
    """Add prior, posterior parameters and the posterior mean of each metric row.

    The priors are written: a mean of doubles depends on the order in which partial sums arrive, and percentiles join
    a posterior to itself by equality, so every reader must see the same prior.
    """
    cohort = [*cohort, "metric"]
    priors = cut(metrics.where("minutes > 0").groupBy(*cohort).agg(F.avg("value").alias("prior")))
    usable = metrics.where("NOT (minutes = 0 AND unit = 'per90')")
    return (
        usable.join(priors, cohort)
        .selectExpr("*", *[f"{e} AS {n}" for n, e in posterior_sql().items()])
        .selectExpr(
            "*",
            "CASE WHEN alpha IS NOT NULL THEN alpha / (alpha + beta) WHEN shape IS NOT NULL THEN shape / rate ELSE value END AS posterior",
        )
    )


def with_intervals(posteriors: DataFrame) -> DataFrame:
    """5-95% intervals; a ratio without counts spans (0, 1), any other bare value is its own interval."""
    return (
        posteriors.withColumn("_b", beta_interval("alpha", "beta"))
        .withColumn("_g", gamma_interval("shape", "rate"))
        .selectExpr(
            *posteriors.columns,
            "CASE WHEN alpha IS NOT NULL THEN _b.lo WHEN shape IS NOT NULL THEN _g.lo WHEN unit = 'ratio' THEN 0D ELSE value END AS lo",
            "CASE WHEN alpha IS NOT NULL THEN _b.hi WHEN shape IS NOT NULL THEN _g.hi WHEN unit = 'ratio' THEN 1D ELSE value END AS hi",
        )
    )


def spec_frame(spark, specs: Mapping[str, RoleSpec]) -> DataFrame:
    rows = [
        (role, k, k in s.style, int(s.quality.get(k, 0)), len(s.keys)) for role, s in specs.items() for k in s.keys
    ]
    return spark.createDataFrame(rows, "role string, metric string, is_style boolean, direction int, role_metrics int")


def role_profiles(metrics: DataFrame, specs: Mapping[str, RoleSpec] = ROLE_SPECS) -> DataFrame:
    """Posterior value and percentile of every role metric, one row per (stint, role, metric).

    ``metrics``: (player, role, league, minutes, metric, unit, value, numerator, denominator).
    """
    spec = spec_frame(metrics.sparkSession, specs)
    cohort = ["role", "league"]
    return percentile_ranks(
        posterior_means(metrics.join(spec, ["role", "metric"]), cohort)
        .withColumn("posterior", F.round("posterior", 10))
        .select("player", "role", "league", "minutes", "metric", "posterior", "is_style", "direction", "role_metrics"),
        [*cohort, "metric"],
        "posterior",
        "minutes > 0",
    )


def evidence(profiles: DataFrame) -> DataFrame:
    """Coverage of the role's metrics, and quality: the mean direction-adjusted percentile."""
    return profiles.groupBy("player", "role").agg(
        F.expr("100D * count(posterior) / max(role_metrics) AS coverage"),
        F.expr("avg(CASE WHEN direction > 0 THEN percentile WHEN direction < 0 THEN 100 - percentile END) AS quality"),
    )


def style_stats(profiles: DataFrame) -> DataFrame:
    """Per role and style metric: robust scale and the 65th percentile, one small table.

    It is written to the checkpoint folder, as every brief and evaluation reads it again.
    """
    key = ["role", "metric"]
    q = quantiles(value_counts(profiles.where("is_style"), key, "posterior"), key, "posterior", [0.25, 0.5, 0.65, 0.75])
    at = lambda p: f"max(IF(probability = {p}D, quantile, NULL))"
    return cut(
        q.groupBy(*key).agg(
            F.expr(f"greatest({at(0.75)} - {at(0.25)}, abs({at(0.5)}) * 0.1, 0.01D) AS scale"), F.expr(f"{at(0.65)} AS target")
        )
    )


def similarity(profiles: DataFrame, targets: DataFrame, stats: DataFrame, preferences: DataFrame) -> DataFrame:
    """100·exp(-½·weighted rms distance) of entities to targets over shared style metrics.

    ``targets``: (brief, kind, role, metric, target), one result column per kind;
    ``preferences``: (brief, metric, weight), 1 where absent.
    """
    wanted = (
        targets.join(stats.select("role", "metric", "scale"), ["role", "metric"])
        .join(preferences, ["brief", "metric"], "left")
        .withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    )
    return (
        profiles.where("is_style")
        .select("player", "role", "metric", "posterior")
        .join(wanted, ["role", "metric"])
        .groupBy("brief", "player", "kind")
        .agg(F.expr("sum(weight * pow((posterior - target) / scale, 2)) AS _d"), F.sum("weight").alias("_w"))
        .selectExpr("brief", "player", "kind", "IF(_w > 0, 100 * exp(-sqrt(_d / _w) / 2), NULL) AS fit")
    )


def brief_targets(briefs: DataFrame, profiles: DataFrame, stats: DataFrame) -> DataFrame:
    """Each brief's target: its replacement's values, else the role's 65th percentiles."""
    own = (
        profiles.select("player", "role", "metric", "posterior")
        .join(briefs.where("replacement IS NOT NULL").select("brief", "role", F.col("replacement").alias("player")), ["role", "player"])
        .select("brief", "role", "metric", F.col("posterior").alias("target"))
    )
    default = briefs.where("replacement IS NULL").select("brief", "role").join(stats, "role").select("brief", "role", "metric", "target")
    return own.unionByName(default).withColumn("kind", F.lit("similarity"))


def replacement_changes(profiles: DataFrame, briefs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per metric: the change against the replaced entity and what it means."""
    wanted = briefs.where("replacement IS NOT NULL").select("brief", "replacement").join(targets, "brief")
    return (
        profiles.select("player", "role", "metric", "posterior", "direction")
        .join(wanted, ["role", "metric"])
        .where("player <> replacement")
        .selectExpr(
            "brief",
            "player",
            "metric",
            "posterior - target AS change",
            "CASE WHEN abs(posterior - target) <= greatest(abs(target) * 0.1, 0.02) THEN 'preserved' "
            "WHEN direction = 0 THEN 'redistributed' WHEN (posterior - target) * direction > 0 THEN 'improved' ELSE 'compromised' END AS function",
        )
    )


def components(
    stints: DataFrame, profiles: DataFrame, briefs: DataFrame, team_targets: DataFrame, preferences: DataFrame
) -> DataFrame:
    """Score components of every candidate a brief's constraints leave, before any weighting.

    ``stints``: (player, role, minutes, age, foot, inferred, attributes), the last a map from name to true or false;
    ``briefs``: brief, role, min_minutes, min_age, max_age, foot, attributes (names a candidate must not lack),
    allow_unknown, replacement, team and, if there is one, intended (a map from style metric to target, before the
    team's); ``team_targets``: (team, metric, target).
    """
    stats = style_stats(profiles)
    by_team = briefs.select("brief", "role", "team").join(team_targets, "team").select("brief", "role", "metric", "target")
    if "intended" in briefs.columns:
        # An intended style, where a brief names one, takes the place of its team's.
        own = briefs.select("brief", "role", F.explode("intended").alias("metric", "target"))
        by_team = by_team.join(own.select("brief").distinct(), "brief", "left_anti").unionByName(own)
    tactical = by_team.withColumn("kind", F.lit("tactical_fit"))
    # Briefs x metrics: a parameter table, packed into one row per brief.
    targets = cut(brief_targets(briefs, profiles, stats).unionByName(tactical))
    terms = (
        targets.join(stats.select("role", "metric", "scale"), ["role", "metric"])
        .join(preferences, ["brief", "metric"], "left")
        .groupBy("brief")
        .agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct("metric", "target", "scale", F.coalesce("weight", F.lit(1.0)).alias("weight")))).alias(f"{k}_terms") for k in ("similarity", "tactical_fit")])
    )
    asked = briefs.select(
        "brief", "role", "min_minutes", "min_age", "max_age", F.col("foot").alias("want_foot"), F.expr("coalesce(attributes, array())").alias("wanted"), "allow_unknown", "replacement"
    )
    candidates = (
        stints.join(asked, "role")
        .where(
            "minutes >= min_minutes AND NOT coalesce(player = replacement, false) AND coalesce(age BETWEEN min_age AND max_age, true) "
            "AND (want_foot IS NULL OR coalesce(foot IN (want_foot, 'both'), true)) "
            "AND NOT exists(wanted, a -> coalesce(attributes[a] = false, false))"
        )
        .withColumn(
            "unknowns",
            reasons(
                {
                    "Age must be verified": "age IS NULL",
                    "Preferred foot must be verified": "want_foot IS NOT NULL AND foot IS NULL",
                }
            ),
        )
        .withColumn(
            "unknowns",
            F.expr(
                "concat(unknowns, transform(filter(wanted, a -> attributes[a] IS NULL), a -> concat("
                "upper(left(a, 1)), replace(lower(substring(a, 2)), '_', ' '), ' must be verified by scouting')))"
            ),
        )
        .where("allow_unknown OR size(unknowns) = 0")
    )
    # A profile is one row per player and role, joined for the survivors only; a fit needs no further shuffle.
    styles = profiles.where("is_style").groupBy("player", "role").agg(F.map_from_entries(F.collect_list(F.struct("metric", "posterior"))).alias("style"))
    fit = (
        "aggregate(filter({k}_terms, t -> style[t.metric] IS NOT NULL), named_struct('d', 0D, 'w', 0D), "
        "(a, t) -> named_struct('d', a.d + t.weight * pow((style[t.metric] - t.target) / t.scale, 2), 'w', a.w + t.weight), "
        "a -> IF(a.w > 0, 100 * exp(-sqrt(a.d / a.w) / 2), NULL)) AS {k}"
    )
    return (
        candidates.join(evidence(profiles), ["player", "role"], "left")
        .join(styles, ["player", "role"], "left")
        .join(terms, "brief", "left")
        .selectExpr("*", *[fit.format(k=k) for k in ("similarity", "tactical_fit")])
        .selectExpr(
            "brief",
            "player",
            "similarity",
            "quality",
            "tactical_fit",
            "IF(replacement IS NULL, NULL, similarity) AS replacement_fit",
            "coalesce(coverage, 0D) AS coverage",
            # An inferred role is named only now: it never drops a candidate.
            "IF(inferred, array_append(unknowns, 'Inferred role must be verified'), unknowns) AS unknowns",
        )
    )


def brief_violations(briefs: DataFrame, stints: DataFrame, most: int = 100) -> DataFrame:
    """(brief, reason): limits out of range, and replacements that are unknown or play another role."""
    known = stints.select(F.col("player").alias("replacement"), "role", F.lit(True).alias("known")).distinct()
    wrong = briefs.where("replacement IS NOT NULL").join(known, ["replacement", "role"], "left").where("known IS NULL")
    return limit_violations(briefs, most).select("brief", "reason").unionByName(wrong.select("brief", F.lit("replacement is unknown or has another role").alias("reason")))


def recommend(parts: DataFrame, briefs: DataFrame) -> DataFrame:
    """Weigh the components by each brief's weights, scale by coverage, rank, keep its limit."""
    weights = briefs.select("brief", "max_results", *[f"w_{c}" for c in COMPONENTS])
    total = " + ".join(f"IF(w_{c} > 0 AND {c} IS NOT NULL, w_{c} * {c}, 0D)" for c in COMPONENTS)
    weight = " + ".join(f"IF(w_{c} > 0 AND {c} IS NOT NULL, w_{c}, 0D)" for c in COMPONENTS)
    ranked = parts.join(weights, "brief").selectExpr(
        "brief",
        "player",
        "max_results",
        *COMPONENTS,
        "unknowns",
        f"round(coalesce(({total}) / nullif({weight}, 0D), 0D) * (0.5 + 0.5 * coverage / 100), 8) AS score",
        "CASE WHEN coverage < 25 THEN 'insufficient_evidence' WHEN size(unknowns) > 0 THEN 'verification_required' ELSE 'eligible' END AS status",
    )
    # The largest limit asked for bounds the ranking before rows move; each brief then keeps its own.
    most = briefs.agg(F.max("max_results")).first()[0] or 0
    return top_per(ranked, ["brief"], [F.desc("score"), F.asc("player")], most).where("position <= max_results").drop("max_results")


def limit_violations(briefs: DataFrame, most: int = 100) -> DataFrame:
    """Briefs whose limit is missing or outside 1 to ``most``, with the reason; what to do with them is the caller's."""
    bad = briefs.where(F.coalesce((F.col("max_results") < 1) | (F.col("max_results") > most), F.lit(True)))
    return bad.select("brief", "max_results", F.lit(f"limit must be between 1 and {most}").alias("reason"))


def brief_suite(stints: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Six variants per role; variant 4 replaces the role's first entity."""
    spark = stints.sparkSession
    rows = [
        (f"{role}-{i}", role, i, "development" if i <= 2 else "test") for role in roles for i in range(1, 7)
    ]
    grid = spark.createDataFrame(rows, "brief string, role string, variant int, split string")
    first = stints.groupBy("role").agg(F.min("player").alias("first"))
    return grid.join(first, "role", "left").selectExpr(
        "brief",
        "role",
        "variant",
        "split",
        "450D AS min_minutes",
        "15 AS min_age",
        "IF(variant = 3, 24, 40) AS max_age",
        "IF(variant = 2, 'left', NULL) AS foot",
        "IF(variant = 5, array('high_line'), cast(array() AS array<string>)) AS attributes",
        "true AS allow_unknown",
        "IF(variant = 4, first, NULL) AS replacement",
        "cast(NULL AS int) AS team",
        "IF(variant = 6, 0D, 1D) AS w_similarity",
        "IF(variant = 6, 2D, 1D) AS w_quality",
        "IF(variant = 6, 0D, 1D) AS w_tactical_fit",
        "IF(variant = 6, 0D, 1D) AS w_replacement_fit",
        "IF(variant = 6, 1D, 0.5D) AS w_coverage",
        "20 AS max_results",
    )


def perturbed(briefs: DataFrame) -> DataFrame:
    out = briefs
    for c in COMPONENTS:
        out = out.withColumn(f"w_{c}", F.col(f"w_{c}") * (1.1 if c == "quality" else 0.95))
    return out


def evaluate_rankings(ranked: DataFrame, varied: DataFrame, briefs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Per brief: size, top-10 stability, NDCG@10 if all returned are judged, digest of the ranking.

    ``judgments``: (player, relevance). A ranking has at most its limit of rows.
    """
    top = lambda df: df.where("position <= 10")
    stable = topk_jaccard(top(ranked), top(varied), ["brief"], "player")
    judged = ranked.join(judgments, "player", "left")
    ideal_order = top_per(judged.drop("position"), ["brief"], [F.desc_nulls_last("relevance"), F.asc("player")], 10).groupBy("brief").agg(
        F.sum(F.col("relevance") / F.log2(F.col("position") + 1)).alias("_ideal")
    )
    shape = judged.groupBy("brief").agg(
        F.count("*").alias("returned"),
        F.count("relevance").alias("_judged"),
        F.max("relevance").alias("_best"),
        F.sum(F.when(F.col("position") <= 10, F.col("relevance") / F.log2(F.col("position") + 1))).alias("_gain"),
        F.count_if(F.col("status") == "verification_required").alias("verification_required"),
        F.sha2(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "player"))), lambda x: x["player"].cast("string")), "|"), 256
        ).alias("ranking_sha256"),
    )
    return (
        briefs.select("brief", "split", "role")
        .join(shape, "brief", "left")
        .join(ideal_order, "brief", "left")
        .join(stable, "brief", "left")
        .selectExpr(
            "brief",
            "split",
            "role",
            "coalesce(returned, 0L) AS returned",
            "coalesce(jaccard, 1D) AS stability",
            "IF(returned > 1 AND _judged = returned AND _best > 0, _gain / _ideal, NULL) AS ndcg_at_10",
            "coalesce(verification_required, 0L) AS verification_required",
            "coalesce(ranking_sha256, sha2('', 256)) AS ranking_sha256",
        )
    )


def mean_stability(evaluated: DataFrame) -> DataFrame:
    """One row: briefs and their mean stability."""
    return evaluated.agg(F.count("*").alias("briefs"), F.avg("stability").alias("mean_stability"))
