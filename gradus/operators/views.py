"""What lies behind a rating: each feature's place in its cohort, the cohort's distribution, and the role as a whole."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Model
from ..functions.status import rating
from ..session import cut, unfold
from .lookup import beside_cohort
from .ordered import running
from .rating import overall_of, registered
from .standardize import EPSILON, density_curve, percentile_ranks, quantile_curve, subject_z


def _slots(model: Model | Mapping[str, Model], spark, position: str) -> DataFrame:
    """(position, ability, slot, key, direction, base_weight) of a registry; without positions that column is null."""
    models, _ = registered(model)
    rows = [
        (name or None, a.name, i, k, m.feature(k).direction, float(w))
        for name, m in models.items()
        for a in m.abilities
        for i, (k, w) in enumerate(a.weights.items())
    ]
    return spark.createDataFrame(rows, f"{position} string, ability string, slot int, key string, direction int, base_weight double")


def _long(rows: DataFrame, model: Model | Mapping[str, Model], keep: Sequence[str], position: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row per (subject, ability, feature): its slot's columns, named without their number, and the registry's."""
    models, slots = registered(model)
    fields = ["v", "n", "k", "w", *extra]
    items = [f"named_struct('slot', {i}, " + ", ".join(f"'{c}', {c}{i}" for c in fields) + ")" for i in range(slots)]
    table = F.broadcast(_slots(model, rows.sparkSession, "_position"))  # as long as the registry
    on = (F.col("ability") == F.col("_ability")) & (F.col("slot") == F.col("_slot"))
    if "" not in models:
        on &= F.col(position) == F.col("_position")
    table = table.withColumnsRenamed({"ability": "_ability", "slot": "_slot"})
    return unfold(rows, keep, items).join(table, on).drop("_position", "_ability", "_slot", "slot")


def feature_views(
    rows: DataFrame, numbers: DataFrame, model: Model | Mapping[str, Model], subject: Sequence[str], cohort: Sequence[str], position: str = "position"
) -> DataFrame:
    """Each scored feature of a subject against its cohort's frozen numbers: value, stabilised value, reliability,
    directed z, directed mid-rank percentile among the cohort's eligible peers, base and active weight, peer mean, peer
    count.

    ``rows`` are ability rows of peers and subjects alike, ``numbers`` the cohorts' (``cohort_numbers``). Features that
    carry no active weight have no row: nothing measures them here.
    """
    models, slots = registered(model)
    cohort = list(cohort)
    joined = beside_cohort(rows, numbers, cohort)
    long = _long(joined, model, [*dict.fromkeys([*subject, *cohort]), "eligible", "peer_count"], position, ("m", "a", "d")).where("w <> 0")
    stable = "IF(n > 0 AND v IS NOT NULL, n / (n + k) * v + (1 - n / (n + k)) * m, NULL)"
    seen = long.selectExpr("*", f"{stable} AS stabilised", "IF(n > 0 AND v IS NOT NULL, n / (n + k), NULL) AS reliability").persist()
    ranked = percentile_ranks(seen, [*cohort, "key"], "v", "eligible")
    z = f"CASE WHEN d > {EPSILON} THEN direction * (stabilised - a) / d WHEN abs(stabilised - a) <= {EPSILON} THEN 0D END"
    return ranked.selectExpr(
        *subject, *[c for c in cohort if c not in subject], "key", "direction", "base_weight", "abs(w) AS weight", "v AS value", "stabilised", "m AS peer_mean",
        "reliability", f"{z} AS z", "IF(direction < 0, 100 - percentile, percentile) AS percentile", "peer_count",
    )


def feature_distributions(rows: DataFrame, numbers: DataFrame, model: Model | Mapping[str, Model], cohort: Sequence[str], position: str = "position", quantiles: int = 101, points: int = 65) -> DataFrame:
    """(cohort, key, curve, point, x, y): ``quantiles`` of the peers' values (y null) and ``points`` of their density, a
    row each, of every feature that is scored in a cohort."""
    cohort = list(cohort)
    peers = beside_cohort(rows.where("eligible"), numbers.select(*cohort), cohort)
    long = _long(peers, model, list(dict.fromkeys([*cohort, position] if "" not in registered(model)[0] else cohort)), position).where("w <> 0").select(*cohort, "key", "v").persist()
    keys = [*cohort, "key"]
    q = quantile_curve(long, keys, "v", quantiles).select(
        *keys, F.lit("quantile").alias("curve"), F.round(F.col("probability") * (quantiles - 1)).cast("int").alias("point"), F.col("quantile").alias("x"), F.lit(None).cast("double").alias("y")
    )
    d = density_curve(long, keys, "v", points).select(*keys, F.lit("density").alias("curve"), F.col("point").cast("int").alias("point"), "x", F.col("density").alias("y"))
    return q.unionByName(d)


def population_hash(members: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """(keys, population, size): a name of each group that follows from its members alone, in whatever order.

    The first 60 bits of the members' SHA-256 are added up, so groups of any size need one partial aggregate."""
    bits = F.conv(F.substring(F.sha2(F.col(member).cast("string"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    sums = members.groupBy(*keys).agg(F.count("*").alias("size"), F.sum(bits).alias("_sum"))
    return sums.select(*keys, F.substring(F.sha2(F.concat_ws("|", F.col("size").cast("string"), F.col("_sum").cast("string")), 256), 1, 12).alias("population"), "size")


def role_view(scores: DataFrame, subject: Sequence[str], position: str, abilities: int, minimum: int) -> DataFrame:
    """The whole role of subjects with every ability scored: raw composite, z, rating, percentile, rank and the gaps to
    the nearest peers below and above, among the peers that share all of the subject's cohorts.

    ``scores``: (subject, position, ability, signature, overall_weight, z, eligible). A subject that is not eligible in
    every ability is measured against the peers without being one.
    """
    subject = list(subject)
    all_in = scores.groupBy(*subject, position).agg(F.every("eligible").alias("is_peer"))
    whole = overall_of(scores, [*subject, position], abilities).join(all_in, [*subject, position]).persist()
    key = [position, "cohort"]
    stats = cut(
        whole.where("is_peer").groupBy(*key)
        .agg(F.avg("overall_raw").alias("_m"), F.stddev_pop("overall_raw").alias("_s"), F.count("*").alias("population_size"))
        .where(f"population_size >= {minimum} AND _s > {EPSILON}")
    )
    z = F.round(subject_z(F.col("overall_raw"), F.col("_m"), F.col("_s"), F.col("population_size")), 10)
    scored = beside_cohort(whole, stats, key).withColumn("role_z", z).drop("_m", "_s").where("role_z IS NOT NULL").persist()
    counts = scored.groupBy(*key, "role_z").agg(F.expr("count_if(is_peer) AS n"))
    placed = running(counts, key, "role_z", ["n"]).select(*key, "role_z", "n", F.col("n_below").alias("below"), F.col("n_total").alias("total")).persist()
    # The peers' next lower value ends where this one's peers begin; their next higher begins where these end.
    peers = placed.where("n > 0")
    lower = peers.select(*key, (F.col("below") + F.col("n")).alias("below"), F.col("role_z").alias("lower"))
    higher = peers.select(*key, F.col("below").alias("upto"), F.col("role_z").alias("higher"))
    places = placed.withColumn("upto", F.col("below") + F.col("n")).join(lower, [*key, "below"], "left").join(higher, [*key, "upto"], "left")
    views = places.select(
        *key,
        "role_z",
        (F.lit(100.0) * (F.col("below") + F.lit(0.5) * F.col("n")) / F.col("total")).alias("percentile"),
        (F.col("total") - F.col("upto") + 1).alias("rank"),
        (F.col("role_z") - F.col("lower")).alias("gap_to_next_z"),
        (F.col("higher") - F.col("role_z")).alias("gap_to_previous_z"),
    )
    return scored.join(views, [*key, "role_z"]).select(
        *subject, position, F.col("overall_raw").alias("role_raw"), "role_z", rating(F.col("role_z")).alias("rating"), "percentile", "rank", "population_size",
        "gap_to_next_z", "gap_to_previous_z", "is_peer",
    )
