"""Features, reliability shrinkage, cohort calibration and composites.

An entity is one row until its abilities are expanded (a fixed, small number of rows); the
features of an ability stay side by side in slots. One partial aggregate per cohort gives the
moments from which every level of its calibration follows (``moments``). Cohort statistics are
written to the shared checkpoint folder: they are small, all rows read the same numbers, and a
lost executor recomputes rows only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import NOT_APPLICABLE, OBSERVED, UNRECORDED, Feature, Model
from ..functions.status import feature_value, measurement_status, rating
from ..session import beside, cut, each, unfold
from .lookup import beside_cohort
from .moments import merged, moments, statistics
from .ordered import finite
from .standardize import EPSILON, best_row, member_z, ranks, subject_z


# --- Features -----------------------------------------------------------------------------------
def derive_features(df: DataFrame, features: Sequence[Feature], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[feature_value(f).alias(f.key) for f in features])


def long_features(df: DataFrame, features: Sequence[Feature], keep: Sequence[str], missing: str = UNRECORDED) -> DataFrame:
    """One row per (entity, feature): value, numerator, denominator, unit, status."""
    items = [
        F.struct(
            F.lit(f.key).alias("key"),
            F.lit(f.unit).alias("unit"),
            feature_value(f).alias("value"),
            F.col(f.numerator).cast("double").alias("numerator"),
            F.col(f.denominator).cast("double").alias("denominator"),
            measurement_status(f, missing).alias("status"),
        )
        for f in features
    ]
    return df.select(*keep, F.inline(F.array(*items)))


def effective_weights(long: DataFrame, keys: Sequence[str], weight: str = "weight", status: str = "status") -> DataFrame:
    """Drop declared zeros and scale the rest back to the original total.

    ``keys`` names one subject and ability: its group has as many rows as the ability has
    features, so the aggregate is joined back on a narrow key.
    """
    keys = list(keys)
    kept = F.when(F.col(status) != UNRECORDED, F.col(weight)).otherwise(F.lit(0.0))
    totals = long.groupBy(*keys).agg(F.sum(weight).alias("_all"), F.sum(kept).alias("_kept"))
    return (
        long.join(totals, keys)
        .withColumn(
            "active_weight",
            F.when((F.col("_kept") > 0) & (F.col(status) != UNRECORDED), F.col(weight) * F.col("_all") / F.col("_kept"))
            .otherwise(F.lit(0.0)),
        )
        .drop("_all", "_kept")
    )


# --- Calibration --------------------------------------------------------------------------------
def _observed(value: Column, exposure: Column, status: Column) -> Column:
    return (status == OBSERVED) & finite(value) & (exposure > 0)


def registered(model: Model | Mapping[str, Model]) -> tuple[dict[str, Model], int]:
    """The models by position (one of them for every position has no name), and the slots they need."""
    models = dict(model) if isinstance(model, Mapping) else {"": model}
    if len({tuple(a.name for a in m.abilities) for m in models.values()}) > 1:
        raise ValueError("every position needs the same abilities")
    if len({m.minimum_peers for m in models.values()}) > 1:
        raise ValueError("every position needs the same least number of peers")
    return models, max(m.slots for m in models.values())


def ability_rows(
    df: DataFrame,
    model: Model | Mapping[str, Model],
    keep: Sequence[str],
    exposure: str,
    version: str = "''",
    extra_ok: str = "true",
    position: str = "position",
    masks: bool = False,
    slots: int | None = None,
) -> DataFrame:
    """One row per (entity, ability): slots of value/exposure/prior/weight, eligibility, signature.

    The signature is the set of scored features with their active weights and measurement
    version (SQL, ``{key}`` stands for the feature): only entities measured alike are compared.
    With a registry of models by position, an entity is weighed by that of its ``position``; positions
    outside the registry have no rows. With ``masks`` also the slots that are used and those that are observed, as
    bits, and each slot's feature and measurement version.
    """
    models, least = registered(model)
    slots = least if slots is None else slots
    features = {f.key: f for m in models.values() for f in m.features}
    if any(features[f.key] != f for m in models.values() for f in m.features):
        raise ValueError("a feature means the same in every position")
    if "" not in models:
        # Each position's expressions stand alone: all in one would be too long to be compiled.
        df = df.persist()
        parts = [ability_rows(df.where(F.col(position) == name), m, keep, exposure, version, extra_ok, position, masks, slots) for name, m in models.items()]
        return reduce(DataFrame.unionByName, parts)
    measured = df.selectExpr(
        *keep,
        f"{exposure} AS _exposure",
        f"({extra_ok}) AS _ok",
        *[
            f"CASE WHEN {f.denominator} > 0 THEN CAST({f.numerator} AS DOUBLE) / {f.denominator} * {f.scale}D END AS v_{f.key}"
            for f in features.values()
        ],
        *[f"CAST({f.denominator} AS DOUBLE) AS n_{f.key}" for f in features.values()],
        *[f"({version.format(key=f.key)}) AS p_{f.key}" for f in features.values()],
        *[
            f"CASE WHEN {f.numerator} IS NULL OR {f.denominator} IS NULL THEN 'u' WHEN {f.denominator} > 0 THEN 'o' ELSE 'z' END AS s_{f.key}"
            for f in features.values()
        ],
    )
    kept = measured.selectExpr(
        "*",
        *[
            " + ".join(f"IF(s_{k} = 'u', 0D, {float(w)}D)" for k, w in a.weights.items()) + f" AS kept_{i}_{a.name}"
            for i, m in enumerate(models.values())
            for a in m.abilities
        ],
    )

    def struct(number: int, model: Model, a) -> str:
        total = sum(a.weights.values())
        whole = f"kept_{number}_{a.name}"
        scored, fields, used_bits, seen_bits, measured_by = [], [], [], [], []
        for i, (k, w) in enumerate(a.weights.items()):
            f = model.feature(k)
            # An untouched mask keeps the given weights exactly.
            active = (
                f"CASE WHEN s_{k} = 'u' OR {whole} <= 0 THEN 0D WHEN {whole} >= {total - EPSILON}D "
                f"THEN {float(w)}D ELSE {float(w)}D * {float(total)}D / {whole} END"
            )
            is_scored = f"s_{k} <> 'u' AND {whole} > 0" if f.direction else "false"
            if f.direction:
                scored.append((k, f, active, is_scored))
            fields.append(
                f"'v{i}', IF({is_scored}, v_{k}, NULL), 'n{i}', n_{k}, 'k{i}', {f.prior}D, 'w{i}', ({active}) * {float(f.direction)}D"
            )
            used_bits.append(f"IF({is_scored}, {1 << i}L, 0L)")
            seen_bits.append(f"IF(s_{k} = 'o' AND NOT isnan(v_{k}) AND abs(v_{k}) < double('Infinity') AND n_{k} > 0, {1 << i}L, 0L)")
            measured_by.append(f"concat('{k}|', p_{k})")
        for i in range(len(a.weights), slots):
            fields.append(f"'v{i}', CAST(NULL AS DOUBLE), 'n{i}', CAST(NULL AS DOUBLE), 'k{i}', CAST(NULL AS DOUBLE), 'w{i}', 0D")
        if masks:
            fields.append(f"'used', {' + '.join(used_bits)}, 'seen', {' + '.join(seen_bits)}, 'marks', array({', '.join(measured_by)})")
        usable = " AND ".join(
            f"(NOT ({on}) OR (s_{k} = 'o' AND NOT isnan(v_{k}) AND abs(v_{k}) < double('Infinity') AND n_{k} > 0))"
            for k, _, _, on in scored
        ) or "false"
        used = " OR ".join(f"({on})" for _, _, _, on in scored) or "false"
        marks = ", ".join(
            f"IF({on}, concat('{k}@', round({active}, 12), '|', p_{k}), NULL)" for k, _, active, on in scored
        )
        available = " + ".join(f"IF(s_{k} = 'o', 1, 0)" for k in a.weights)
        excluded = " + ".join(f"IF(s_{k} = 'u', 1, 0)" for k in a.weights)
        return (
            f"named_struct('ability', '{a.name}', 'overall_weight', {float(a.overall_weight)}D, 'defined', {len(a.weights)}, "
            f"'available', {available}, 'excluded', {excluded}, 'exposed', coalesce(_exposure >= {model.minimum_exposure}, false), "
            f"'eligible', coalesce(({usable}) AND ({used}) AND _exposure >= {model.minimum_exposure} AND _ok, false), "
            f"'signature', sha2(concat_ws(';', {marks or 'NULL'}), 256), " + ", ".join(fields) + ")"
        )

    one = models[""]
    return unfold(kept, keep, [struct(0, one, a) for a in one.abilities])


def withheld(rows: DataFrame, scores: DataFrame, subject: Sequence[str], cohort: Sequence[str], minimum: int) -> DataFrame:
    """(subject, ability, reason) of every ability row without a score: why it has none."""
    subject, cohort = list(subject), list(cohort)
    peers = rows.where("eligible").groupBy(*cohort).agg(F.count("*").alias("_peers"))
    missing = rows.select(*dict.fromkeys([*subject, *cohort]), "exposed", "eligible").join(scores.select(*subject, "ability"), [*subject, "ability"], "left_anti")
    return missing.join(peers, cohort, "left").selectExpr(
        *subject,
        "ability",
        f"CASE WHEN NOT exposed THEN 'below exposure' WHEN NOT eligible THEN 'missing feature' WHEN _peers < {minimum} THEN 'too few peers' ELSE 'no spread' END AS reason",
    )


def cohort_numbers(rows: DataFrame, cohort: Sequence[str], slots: int, minimum: int) -> DataFrame:
    """The calibration numbers of every large enough cohort of ``eligible`` rows, in one pass, written."""
    return cut(statistics(moments(rows.where("eligible"), cohort, slots), cohort, slots, minimum))


def calibrate(rows: DataFrame, cohort: Sequence[str], slots: int, minimum: int, keep_flat: str = "false") -> DataFrame:
    """Shrink, standardise, weigh and re-standardise inside each cohort of ``eligible`` rows.

    Returns the peers of cohorts that are large enough, with ``raw`` and ``z``. A cohort whose
    composite has no spread is withheld unless ``keep_flat`` (SQL) holds.
    """
    n = range(slots)
    rows = rows.where("eligible").persist()
    stable = beside_cohort(rows, cohort_numbers(rows, cohort, slots, minimum), cohort).selectExpr(
        "*", *[f"n{i} / (n{i} + k{i}) * v{i} + (1 - n{i} / (n{i} + k{i})) * m{i} AS s{i}" for i in n]
    )
    raw = " + ".join(f"coalesce(IF(d{i} > {EPSILON}, w{i} * (s{i} - a{i}) / d{i}, 0D), 0D)" for i in n)
    return (
        stable.selectExpr("*", f"{raw} AS raw")
        .selectExpr("*", f"IF(raw_sd > {EPSILON}, (raw - raw_mean) / raw_sd, 0D) AS z")
        .where(f"raw_sd > {EPSILON} OR ({keep_flat})")
    )


def compose(
    scores: DataFrame, subject: Sequence[str], position: str, abilities: int, minimum: int, keep_flat: str = "false"
) -> DataFrame:
    """Overall score from one z per ability, re-standardised among the peers sharing every cohort.

    The common peers of an entity are those with the same cohort in all abilities: an exact
    intersection when cohorts are disjoint, which signatures guarantee.
    """
    subject = list(subject)
    overall = (
        scores.groupBy(*subject)
        .agg(
            F.count("*").alias("abilities"),
            F.sum(F.round(F.col("overall_weight") * F.col("z"), 12)).alias("_raw"),
            # At most one short entry per ability.
            F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "ability", "signature"))), ";"), 256).alias("cohort"),
        )
        .where(F.col("abilities") == abilities)
        .withColumn("overall_raw", F.round("_raw", 11))
        .drop("_raw", "abilities")
        .persist()
    )
    key = [position, "cohort"]
    stats = cut(
        overall.groupBy(*key)
        .agg(F.avg("overall_raw").alias("_m"), F.stddev_pop("overall_raw").alias("_s"), F.count("*").alias("peers"))
        .where(f"peers >= {minimum} AND (_s > {EPSILON} OR ({keep_flat}))")
    )
    return (
        beside_cohort(overall, stats, key)
        .withColumn("overall_z", F.round(member_z(F.col("overall_raw"), F.col("_m"), F.col("_s")), 10))
        .drop("_m", "_s")
    )


def rated(overall: DataFrame, position: str) -> DataFrame:
    """Display rating, rank and percentile of composed scores."""
    return (
        ranks(overall, [position, "cohort"], "overall_z")
        .withColumn("overall", rating(F.col("overall_z")))
        .withColumn("unclipped", F.lit(50.0) + F.lit(15.0) * F.col("overall_z"))
    )


def score_catalogue(
    df: DataFrame,
    model: Model | Mapping[str, Model],
    subject: Sequence[str],
    position: str,
    exposure: str,
    keep_flat: str = "false",
    version: str = "''",
) -> tuple[DataFrame, DataFrame]:
    """(ability scores, overall ratings) of every entity inside its position; ``model`` may name one per position."""
    models, slots = registered(model)
    one = next(iter(models.values()))
    rows = ability_rows(df, model, list(subject), exposure, version, position=position)
    scores = calibrate(rows, [position, "ability", "signature"], slots, one.minimum_peers, keep_flat)
    overall = compose(scores, subject, position, len(one.abilities), one.minimum_peers, keep_flat)
    return scores, rated(overall, position)


# --- Containment of masks ---------------------------------------------------------------------------
def measured_in(marks: str, mask: str) -> str:
    """SQL for the marks of the slots in a bit mask, as one text."""
    return f"concat_ws(';', filter({marks}, (x, i) -> shiftright({mask}, i) & 1 = 1))"


def containing(asked: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seen, have, used, need): the groups that hold every asked mask, measured alike.

    ``asked`` has the distinct masks (keys, used, need), ``groups`` the distinct sets of observed slots (keys, seen,
    have); rows of either kind never meet. Of a group's subsets only those that are asked for by bits are made, and
    they meet the asked ones on bits and measurements, so no key is hot.
    """
    keys = list(keys)
    asked = asked.select(*keys, "used", "need").distinct()
    # A few distinct integers for each of ``keys``.
    index = asked.groupBy(*keys).agg(F.collect_set("used").alias("_asked"))
    met = groups.select(*keys, "seen", "have").join(index, keys) if keys else beside(groups.select("seen", "have"), index)
    subsets = met.selectExpr(*keys, "seen", "have", "explode(filter(_asked, m -> (m & seen) = m)) AS used")
    return subsets.withColumn("need", F.expr(measured_in("have", "used"))).join(asked, [*keys, "used", "need"])


class Compatible(NamedTuple):
    """Subjects with their signature; the references of each group; and which groups satisfy which signature."""

    signatures: DataFrame
    references: DataFrame
    groups: DataFrame
    satisfied: DataFrame

    def counts(self) -> DataFrame:
        """(signature, peers): counts of groups are added up, no reference is listed."""
        sizes = self.satisfied.join(self.groups, ["seen", "have"]).groupBy("signature").agg(F.sum("n").alias("peers"))
        every = self.signatures.select("signature").distinct()
        return every.join(sizes, "signature", "left").select("signature", F.coalesce("peers", F.lit(0)).alias("peers"))

    def members(self) -> DataFrame:
        """(signature, reference): as long as the answer is."""
        return self.references.join(self.satisfied, ["seen", "have"]).drop("seen", "have")


def compatible_peers(used: DataFrame, references: DataFrame, subject: str, reference: Sequence[str], keys: Sequence[str]) -> Compatible:
    """Relational division: references observed in every feature a subject uses, by the same provider and version.

    ``keys`` names the features (at most 62), one measurement each. Observed features become bits; subjects are
    reduced to distinct requirements and references to distinct groups before anything is joined.
    """
    if len(keys) > 62:
        raise ValueError("a mask has at most 62 features")
    mark = F.concat_ws("|", "key", "provider", "version")

    def marked(long: DataFrame, by: Sequence[str], mask: str, marks: str) -> DataFrame:
        each_key = F.array(*[F.max(F.when(F.col("key") == k, mark)) for k in keys])
        bits = " + ".join(f"IF({marks}[{i}] IS NOT NULL, {1 << i}L, 0L)" for i in range(len(keys)))
        return long.groupBy(*by).agg(each_key.alias(marks)).withColumn(mask, F.expr(bits))

    needs = marked(used, [subject], "used", "_marks").withColumn("need", F.expr(measured_in("_marks", "used")))
    needs = needs.select(subject, "used", "need", F.sha2(F.col("need"), 256).alias("signature")).persist()
    seen = references.where(_observed(F.col("value"), F.col("denominator"), F.col("status")))
    held = marked(seen, reference, "seen", "have").persist()
    groups = cut(held.groupBy("seen", "have").agg(F.count("*").alias("n")))
    satisfied = cut(containing(needs, groups, []).select("seen", "have", F.sha2(F.col("need"), 256).alias("signature")))
    return Compatible(needs.select(subject, "signature"), held, groups, satisfied)


def hybrid(scores: Sequence[tuple[DataFrame, float]], subject: str, keys: Sequence[str], minimum: int = 30) -> DataFrame:
    """Weighted role z of entities present in every role, re-standardised on the joint peers."""
    keys = list(keys)
    joined = None
    for i, (df, _) in enumerate(scores):
        part = df.select(subject, *keys, F.col("z").alias(f"z{i}"))
        joined = part if joined is None else joined.join(part, [subject, *keys])
    raw = sum((F.lit(w) * F.col(f"z{i}") for i, (_, w) in enumerate(scores)), F.lit(0.0))
    joined = joined.withColumn("raw", raw).where(F.col("raw").isNotNull())
    stats = joined.groupBy(*keys).agg(F.avg("raw").alias("_m"), F.stddev_pop("raw").alias("_s"), F.count("*").alias("joint_peers"))
    return (
        joined.join(stats, keys)
        .where(F.col("joint_peers") >= minimum)
        .withColumn("z", F.round(subject_z(F.col("raw"), F.col("_m"), F.col("_s"), F.col("joint_peers")), 10))
        .drop("_m", "_s")
    )


def versatility(roles: DataFrame, subject: str, order: str, excluded: Sequence[str] = ("ST",)) -> DataFrame:
    """Breadth, quality and consistency of the roles other than an entity's best one."""
    valid = roles.where(F.col("z").isNotNull() & ~F.col("role").isin(*excluded))
    primary = best_row(valid.select(subject, "role", "z", order), [subject], [("z", True), (order, False)]).select(
        subject, F.col("role").alias("primary_role"), F.col("z").alias("primary_z")
    )
    secondary = valid.join(primary, subject).where(F.col("role") != F.col("primary_role"))
    z, zp = F.col("z"), F.col("primary_z")
    return (
        secondary.groupBy(subject, "primary_role", "primary_z")
        .agg(
            F.avg((z >= 0).cast("double")).alias("breadth"),
            F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (z + 1) / 3))).alias("secondary_quality"),
            F.avg(F.greatest(F.lit(0.0), 1 - F.abs(zp - z) / 3)).alias("consistency"),
        )
        .withColumn(
            "versatility",
            100 * (0.4 * F.col("breadth") + 0.4 * F.col("secondary_quality") + 0.2 * F.col("consistency")),
        )
    )


def priority_pick(
    candidates: DataFrame, keys: Sequence[str], priority: Sequence[str], tie: str, usable: Column
) -> DataFrame:
    """First usable source by priority, then id; the number of alternatives is kept.

    The alternatives stay rows of ``candidates``: join on the keys to list them.
    """
    keys = list(keys)
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("provider"))
    order = F.struct((~F.coalesce(usable, F.lit(False))).alias("u"), F.when(rank == 0, len(priority) + 1).otherwise(rank).alias("r"), F.col(tie).alias("t"))
    rest = [c for c in candidates.columns if c not in keys]
    return (
        candidates.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("_row"), (F.count("*") - 1).alias("alternatives"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], "alternatives")
    )


def ranked_candidates(candidates: DataFrame, keys: Sequence[str], priority: Sequence[str], tie: str, usable: Column) -> DataFrame:
    """Every candidate with its ``place``: 0 is the one that counts, 1 and more are its alternatives in their order.

    Usable ones first, then by source priority, then by ``tie``; a key has as many candidates as sources report it.
    """
    listed = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("provider"))
    rank = F.when(listed == 0, len(priority) + 1).otherwise(listed)
    by = Window.partitionBy(*keys).orderBy(~F.coalesce(usable, F.lit(False)), rank, F.col(tie))
    return candidates.withColumn("place", (F.row_number().over(by) - 1).cast("int"))


def combined_profile(candidates: DataFrame, subject: Sequence[str], priority: Sequence[str], tie: str) -> DataFrame:
    """The features of an identity's linked records: for each the value that counts and its alternatives as rows, whether
    several definitions stand side by side, and how many features of the identity are numbers and how many supported.

    ``candidates``: (subject, key, provider, tie, status, ...).
    """
    subject = list(subject)
    ranked = ranked_candidates(candidates, [*subject, "key"], priority, tie, supported(F.col("status")))
    several = candidates.groupBy(*subject, "key").agg(F.when(F.count("*") > 1, "source_specific_not_equivalent").otherwise("single_source").alias("definition_reconciliation"))
    ranked = ranked.persist()
    counts = ranked.where("place = 0").groupBy(*subject).agg(
        F.count_if(F.col("status") == OBSERVED).alias("numeric_features"), F.count_if(supported(F.col("status"))).alias("supported_features")
    )
    return ranked.join(several, [*subject, "key"]).join(counts, subject)


def supported(status: Column) -> Column:
    return status.isin(OBSERVED, NOT_APPLICABLE)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Top k rows per key; Spark limits each partition to k before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def score_subjects(rows: DataFrame, numbers: DataFrame, cohort: Sequence[str], slots: int) -> DataFrame:
    """Scores of subjects against cohorts' frozen numbers, which they need not belong to; null if a feature lacks."""
    n = range(slots)
    joined = beside_cohort(rows, numbers, cohort).selectExpr(
        "*", *[f"IF(n{i} > 0, n{i} / (n{i} + k{i}) * v{i} + (1 - n{i} / (n{i} + k{i})) * m{i}, NULL) AS s{i}" for i in n]
    )
    term = (
        "CASE WHEN w{i} = 0 THEN 0D WHEN d{i} > {e} THEN w{i} * (s{i} - a{i}) / d{i} "
        "WHEN abs(s{i} - a{i}) <= {e} THEN 0D END"
    )
    raw = " + ".join(term.format(i=i, e=EPSILON) for i in n)
    return joined.selectExpr("*", f"{raw} AS raw").selectExpr(
        "*", f"CASE WHEN raw_sd > {EPSILON} THEN (raw - raw_mean) / raw_sd WHEN abs(raw - raw_mean) <= {EPSILON} THEN 0D END AS z"
    )


class Assigned(NamedTuple):
    """Ability scores of subjects in the positions they are asked about, and what their references say.

    ``numbers``: the calibration of each (position, ability, signature). ``references``: one ability row per reference
    of a position. ``satisfied``: which groups of references (seen, have) are peers under which signature.
    """

    scores: DataFrame
    asked: DataFrame
    numbers: DataFrame
    references: DataFrame
    satisfied: DataFrame
    position: str
    slots: int
    minimum: int
    abilities: int

    def peers(self, wanted: DataFrame | None = None) -> DataFrame:
        """Reference scores under every signature (of ``wanted``): a row per reference and mask it satisfies."""
        cohort = [self.position, "ability", "signature"]
        satisfied = self.satisfied if wanted is None else self.satisfied.join(wanted.select(*cohort).distinct(), cohort, "left_semi")
        weights = [f"w{i}" for i in range(self.slots)]
        masked = beside_cohort(self.references.drop("signature", *weights), cut(satisfied), [self.position, "ability", "seen", "have"])
        return score_subjects(masked, self.numbers, cohort, self.slots)


def assigned_positions(
    entities: DataFrame,
    registry: Mapping[str, Model],
    subject: str,
    position: str,
    exposure: str,
    identity: str | None = None,
    preferred: str = "true",
    keeper: str = "GK",
    version: str = "''",
    keep: Sequence[str] = (),
    only: DataFrame | None = None,
) -> Assigned:
    """Every subject in every position it may be asked about, by that position's weights, against the position's
    natural entities.

    Keepers are asked about the keeper position only, all others about every other one; with ``only`` (subject) just
    these are asked. A position counts each ``identity`` once: the ``preferred`` (SQL) record, then the smallest subject. A reference is a subject's peer if it
    is observed, by the same measurement, in each feature the subject uses; it may use more. Peers depend on the
    subject's mask only: references are reduced to the moments of their distinct sets of observed features, masks
    meet those sets, and a mask's cohort is the merged moments of the sets that hold it.
    """
    models, slots = registered(registry)
    one = next(iter(models.values()))
    keep = list(dict.fromkeys([subject, *keep]))
    natural = entities.where(f"{exposure} >= {one.minimum_exposure}").withColumn("_preferred", F.expr(f"int({preferred})"))
    if identity is not None:
        natural = best_row(natural, [position, identity], [("_preferred", True), (subject, False)])
    have = "transform(marks, (x, i) -> IF(shiftright(seen, i) & 1 = 1, x, NULL))"
    values = {f"v{i}": F.expr(f"IF(shiftright(seen, {i}) & 1 = 1, v{i}, NULL)") for i in range(slots)}
    references = ability_rows(natural, registry, [subject, position], exposure, version, position=position, masks=True)
    references = references.withColumn("have", F.expr(have)).drop("marks", "eligible", "exposed", "used").withColumns(values).persist()
    at = [position, "ability"]
    groups = cut(moments(references, [*at, "seen", "have"], slots))

    of_keeper = F.coalesce(F.col(position) == keeper, F.lit(False))
    subjects = entities if only is None else entities.join(only.select(subject).distinct(), subject, "left_semi")
    subjects = subjects.withColumn("_keeper", of_keeper).persist()
    asked = reduce(
        DataFrame.unionByName,
        [
            ability_rows(subjects.where("_keeper" if name == keeper else "NOT _keeper").withColumn(position, F.lit(name)), m, [*keep, position], exposure, version, position=position, masks=True, slots=slots)
            for name, m in models.items()
        ],
    ).where("eligible")
    asked = asked.withColumn("need", F.expr(measured_in("marks", "used"))).drop("marks", "seen").persist()
    masks = cut(asked.select(*at, "signature", "used", "need", *[f"w{i}" for i in range(slots)]).distinct())
    pairs = cut(containing(masks, groups.select(*at, "seen", "have").distinct(), at))
    cohorts = merged(groups.join(pairs, [*at, "seen", "have"]), [*at, "used", "need"])
    cohort = [*at, "signature"]
    numbers = cut(statistics(cohorts, [*at, "used", "need"], slots, one.minimum_peers, masks).drop("used", "need").where(f"raw_sd > {EPSILON}"))
    scores = score_subjects(asked, numbers, cohort, slots).where("z IS NOT NULL")
    satisfied = pairs.join(masks, [*at, "used", "need"]).select(*cohort, "seen", "have", *[f"w{i}" for i in range(slots)])
    return Assigned(scores, asked, numbers, references, satisfied, position, slots, one.minimum_peers, len(one.abilities))


def assigned_overall(assigned: Assigned, subject: str) -> DataFrame:
    """Overall score of subjects in every position against the references common to all their abilities' cohorts."""
    position, count = assigned.position, assigned.abilities
    overall = overall_of(assigned.scores, [subject, position], count).persist()
    # The distinct tuples of cohorts that subjects have, one row per ability.
    tuples = overall.select(subject, position, "cohort").join(assigned.scores.select(subject, position, "ability", "signature"), [subject, position])
    wanted = cut(tuples.select(position, "cohort", "ability", "signature").distinct())
    key = [position, "cohort"]
    peers = assigned.peers(wanted).select(F.col(subject).alias("_ref"), position, "ability", "signature", "overall_weight", "z")
    reference = (
        beside_cohort(peers, wanted, [position, "ability", "signature"])
        .groupBy(*key, "_ref")
        .agg(F.count("z").alias("n"), F.sum(F.round(F.col("overall_weight") * F.col("z"), 12)).alias("raw"))
        .where(F.col("n") == count)
    )
    stats = cut(
        reference.groupBy(*key)
        .agg(F.avg("raw").alias("_m"), F.stddev_pop("raw").alias("_s"), F.count("*").alias("common_peers"))
        .where(f"common_peers >= {assigned.minimum} AND _s > {EPSILON}")
    )
    return (
        beside_cohort(overall, stats, key)
        .withColumn("overall_z", F.round((F.col("overall_raw") - F.col("_m")) / F.col("_s"), 10))
        .withColumn("overall", rating(F.col("overall_z")))
        .drop("_m", "_s")
    )


def overall_of(scores: DataFrame, subject: Sequence[str], abilities: int) -> DataFrame:
    """Weighted sum of ability z for subjects scored in every ability."""
    return (
        scores.groupBy(*subject)
        .agg(
            F.count("z").alias("_n"),
            F.sum(F.round(F.col("overall_weight") * F.col("z"), 12)).alias("_raw"),
            F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "ability", "signature"))), ";"), 256).alias("cohort"),
        )
        .where(F.col("_n") == abilities)
        .withColumn("overall_raw", F.round("_raw", 11))
        .drop("_raw", "_n")
    )


def feature_rows(df: DataFrame, features: Sequence[Feature], keep: Sequence[str]) -> DataFrame:
    """Long features of source aggregates; an aggregate with a contradiction is flagged whole."""
    contradictions = []
    for f in features:
        a, b = f.numerator, f.denominator
        if b != "minutes":
            contradictions.append(f"({b} = 0 AND {a} <> 0)")
        if f.unit in ("%", "ratio"):
            contradictions.append(f"({a} > {b})")
    rejected = f"coalesce({' OR '.join(contradictions) or 'false'}, false)"
    flagged = df.withColumn("rejected", F.expr(rejected))
    return long_features(flagged, features, [*keep, "rejected"], "missing_measurement")


def complete_pairs(won: str, lost: str, attempted: str) -> tuple[str, str]:
    """SQL for (lost, attempted), each completed from the other two where it is missing."""
    return (
        f"coalesce({lost}, {attempted} - {won})",
        f"coalesce({attempted}, {won} + {lost})",
    )


class Measure(NamedTuple):
    """A measurement from inputs of a single bundle.

    ``kind``: ``ratio`` divides the first input by the second or by minutes; ``share`` keeps the
    provider's percentage with saves + conceded as exposure; ``given`` keeps it with its second
    input as exposure.
    """

    key: str
    inputs: Sequence[str]
    unit: str
    kind: str = "ratio"
    signed: bool = False


def _measured(m: Measure) -> str:
    """SQL of a measurement's struct, null where an input is missing."""
    a = f"cast({m.inputs[0]} AS double)"
    if m.kind == "share":
        b = f"cast(coalesce({m.inputs[1]}, 0) + coalesce({m.inputs[2]}, 0) AS double)"
    else:
        b = f"cast({m.inputs[1] if len(m.inputs) > 1 else 'minutes'} AS double)"
    factor = 100 if m.unit == "%" else 90
    value = a if m.kind in ("share", "given") else f"IF({b} > 0, {a} / {b} * {factor}, NULL)"
    present = " AND ".join(f"{i} IS NOT NULL" for i in [*m.inputs, "minutes"])
    if m.kind == "share":
        present += f" AND {b} > 0"
    bad = ["isnan(x)", "abs(x) = double('Infinity')"]
    if m.unit == "%":
        bad.append("x < 0 OR x > 100")
    if not m.signed:
        bad.append("x < 0")
    absent = "not_applicable_zero_attempts" if m.unit == "%" else "zero_exposure"
    wrong = " OR ".join(bad)
    return (
        f"IF({present}, transform(array({value}), x -> named_struct('key', '{m.key}', 'unit', '{m.unit}', 'value', IF({wrong}, NULL, x), "
        f"'numerator', {a}, 'denominator', {b}, 'status', CASE WHEN x IS NULL THEN '{absent}' WHEN {wrong} THEN 'invalid' ELSE 'observed' END))[0], NULL)"
    )


def provider_measurements(bundles: DataFrame, measures: Sequence[Measure], keep: Sequence[str]) -> DataFrame:
    """(keep, key, unit, value, numerator, denominator, status) of every measurement; a bundle is read once for all."""
    return bundles.selectExpr(*keep, f"inline(array_compact(array({', '.join(_measured(m) for m in measures)})))")


def bundle_build(obs: DataFrame, keys: Sequence[str], fields: Sequence[str], minutes_field: str) -> DataFrame:
    """Numeric observations of one (row, provider, sample) side by side.

    The fields are the configured inputs; ``minutes_field`` (SQL over ``provider``) names the
    exposure column of each provider.
    """
    wide = obs.where(finite(F.col("value"))).groupBy(*keys).agg(
        *[F.expr(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}") for f in fields]
    )
    pick = " ".join(f"WHEN '{f}' THEN {f}" for f in fields)
    return wide.withColumn("minutes", F.expr(f"CASE ({minutes_field}) {pick} END"))


def attach_features(
    entities: DataFrame, candidates: DataFrame, subject: str, keys: Sequence[str], priority: Sequence[str], exposure: str
) -> DataFrame:
    """The best candidate of every (entity, feature); a feature nobody reports is a declared zero.

    ``candidates``: (subject, key, provider, window_minutes, value, numerator, denominator, status, id).
    A window that misses the season's exposure by more than max(45, 2%) is only partial.
    """
    checked = (
        candidates.join(entities.select(subject, F.col(exposure).alias("_season")), subject)
        .withColumn(
            "status",
            F.expr(
                "IF(window_minutes IS NOT NULL AND abs(window_minutes - _season) > greatest(45D, 0.02 * _season), 'partial_window', status)"
            ),
        )
        .drop("_season")
    )
    best = priority_pick(checked, [subject, "key"], priority, "id", supported(F.col("status")))
    grid = each(entities.select(subject), "key", keys)
    return grid.join(best, [subject, "key"], "left").selectExpr(
        subject,
        "key",
        "IF(status IS NULL, 0D, value) AS value",
        "numerator",
        "denominator",
        f"coalesce(status, '{UNRECORDED}') AS status",
        "coalesce(provider, 'none') AS provider",
        "coalesce(alternatives, 0) AS alternatives",
        "id",
    )


def unrated_view(features: DataFrame, overall: DataFrame, subject: str) -> DataFrame:
    """Measurements of entities without a rating: every value kept, every score null."""
    null = F.lit(None).cast("double")
    return features.join(overall.select(subject).distinct(), subject, "left_anti").select(
        "*", null.alias("z"), null.alias("rating"), null.alias("percentile")
    )


def skill_composite(long: DataFrame, subject: str, cohort: Sequence[str], emphasised: Sequence[str], multiplier: float) -> DataFrame:
    """Emphasised skills weigh ``multiplier``, others 1, over the skills an entity has.

    Needs 70% of all skills and half of the emphasised ones; composites are re-standardised among
    the entities measured in the same skills.
    """
    cohort = list(cohort)
    stats = long.where("value IS NOT NULL").groupBy(*cohort, "key").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    names = ", ".join(f"'{k}'" for k in emphasised)
    z = long.join(stats, [*cohort, "key"]).selectExpr(
        "*",
        f"IF(_s > {EPSILON}, (value - _m) / _s, IF(value IS NULL, NULL, 0D)) * IF(direction < 0, -1, 1) AS fz",
        f"IF(key IN ({names}), {float(multiplier)}D, 1D) AS weight",
        f"key IN ({names}) AS emphasised",
    )
    per = z.groupBy(subject, *cohort).agg(
        F.expr("100D * count(fz) / count(*) AS coverage"),
        F.expr("100D * count_if(emphasised AND fz IS NOT NULL) / count_if(emphasised) AS role_coverage"),
        F.expr("sum(IF(fz IS NULL, 0D, weight)) AS total_weight"),
        F.expr("sum(weight * fz) / sum(IF(fz IS NULL, 0D, weight)) AS raw"),
        # At most one short entry per skill.
        F.expr("array_join(sort_array(collect_list(IF(fz IS NULL, NULL, key))), ',') AS mask"),
    )
    group = [*cohort, "mask"]
    enough = per.where("coverage >= 70 AND role_coverage >= 50 AND total_weight > 0")
    spread = enough.groupBy(*group).agg(F.avg("raw").alias("_m"), F.stddev_pop("raw").alias("_s"), F.count("*").alias("_n"))
    return (
        per.join(spread, group, "left")
        .withColumn(
            "z",
            F.when(
                F.expr("coverage >= 70 AND role_coverage >= 50 AND total_weight > 0"),
                subject_z(F.col("raw"), F.col("_m"), F.col("_s"), F.col("_n")),
            ),
        )
        .withColumn("rating", rating(F.col("z")))
        .drop("_m", "_s", "_n", "mask")
    )


def archetype_scores(scores: DataFrame, subject: Sequence[str], archetypes: DataFrame, cohort: Sequence[str], minimum: int) -> DataFrame:
    """The same abilities under several weight vectors, each re-standardised on its own peers.

    ``archetypes``: (archetype, ability, weight), a fixed registry. ``scores`` needs one z per
    (subject, ability) and a cohort shared by all abilities of a subject.
    """
    cohort = ["archetype", *cohort]
    abilities = archetypes.select("ability").distinct().count()
    composite = (
        scores.join(archetypes, "ability")
        .groupBy(*subject, *[c for c in cohort if c not in subject])
        .agg(F.count("z").alias("_n"), F.sum(F.round(F.col("weight") * F.col("z"), 12)).alias("raw"))
        .where(F.col("_n") == abilities)
        .drop("_n")
    )
    stats = composite.groupBy(*cohort).agg(F.avg("raw").alias("_m"), F.stddev_pop("raw").alias("_s"), F.count("*").alias("peers"))
    return (
        composite.join(stats, cohort)
        .where(F.col("peers") >= minimum)
        .withColumn("z", F.round(member_z(F.col("raw"), F.col("_m"), F.col("_s")), 10))
        .withColumn("rating", rating(F.col("z")))
        .drop("_m", "_s")
    )


def map_positions(df: DataFrame, column: str, mappings: Sequence[Mapping[str, str]], out: str = "position") -> DataFrame:
    """Source labels to registry ids by one mapping after another; a label that a mapping does not name stays itself."""
    for mapping in mappings:
        table = df.sparkSession.createDataFrame(list(mapping.items()), "_label string, _id string")
        mapped = df.join(F.broadcast(table), F.col(column) == F.col("_label"), "left").withColumn(out, F.coalesce("_id", column))
        df, column = mapped.drop("_label", "_id"), out
    return df
