"""Means and co-moments of an ability's slots, from which a whole calibration follows without another pass.

Slot i holds a value v, an exposure n and a prior k; r = n / (n + k) is its reliability and x = r v. A cohort's
shrunk value is s = m + x - m r, m being the cohort's mean of v. So the mean and the spread of s, the covariance of
two slots' s, and with given weights the spread of their weighted sum, are sums of central moments of r and x times
powers of m. Those moments are partial aggregates, and they merge: a cohort put together from groups has the moments
that follow from its groups' moments, and the groups' rows are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, unfold
from .standardize import EPSILON

#: A composite whose spread is below this share of its weights has none: the rest is rounding of the algebra.
FLAT = 1e-6


def _pairs(slots: int) -> list[tuple[str, str, str]]:
    """(name, one, other) of what is averaged together: each value with its weight, and xx, xr, rx and rr of i <= j."""
    out = [(f"v{i}", f"v{i}", f"w{i}") for i in range(slots)]
    for i in range(slots):
        for j in range(i, slots):
            out += [(f"xx{i}_{j}", f"x{i}", f"x{j}"), (f"xr{i}_{j}", f"x{i}", f"r{j}"), (f"rr{i}_{j}", f"r{i}", f"r{j}")]
            if i != j:
                out.append((f"rx{i}_{j}", f"r{i}", f"x{j}"))
    return out


def moments(rows: DataFrame, keys: Sequence[str], slots: int) -> DataFrame:
    """(keys, pair, n, one, other, cov, low, high, weight): count, means, covariance and extremes of each pair of a group.

    A group's rows have the same slots filled. A row becomes one short row per pair, which the first aggregate takes
    in at once, so the aggregate stays small in code and in shuffled rows however many slots there are."""
    n, keys = range(slots), list(keys)
    ready = rows.selectExpr(*keys, *[f"{c}{i}" for i in n for c in "vw"], *[f"IF(v{i} IS NULL, NULL, n{i} / (n{i} + k{i})) AS r{i}" for i in n])
    ready = ready.selectExpr("*", *[f"r{i} * v{i} AS x{i}" for i in n])
    pairs = [f"named_struct('pair', '{name}', 'a', {a}, 'b', {b})" for name, a, b in _pairs(slots)]
    each_pair = unfold(ready, keys, pairs).where("a IS NOT NULL OR pair = 'v0'")
    return each_pair.groupBy(*keys, "pair").agg(
        F.count("*").alias("n"), F.avg("a").alias("one"), F.avg("b").alias("other"), F.covar_pop("a", "b").alias("cov"), F.min("a").alias("low"), F.max("a").alias("high"), F.max("b").alias("weight")
    )


def merged(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The moments of cohorts put together from groups: ``groups`` has a row for each pair of each group of a cohort."""
    whole = Window.partitionBy(*keys, "pair")  # as many rows as a cohort has groups
    mean = lambda c: F.sum(F.col("n") * F.col(c)).over(whole) / F.sum("n").over(whole)
    centred = groups.withColumn("_one", mean("one")).withColumn("_other", mean("other"))
    within = "n * (cov + (one - _one) * (other - _other))"
    return centred.groupBy(*keys, "pair").agg(
        F.sum("n").alias("n"), F.max("_one").alias("one"), F.max("_other").alias("other"), F.expr(f"sum({within}) / sum(n) AS cov"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("weight").alias("weight"),
    )


def statistics(moments: DataFrame, keys: Sequence[str], slots: int, minimum: int, weights: DataFrame | None = None) -> DataFrame:
    """What calibration needs of each cohort of at least ``minimum``: m (mean of values), a and d (mean and spread of
    shrunk values) of every slot, raw_mean and raw_sd of the composite by the weights w, and peer_count.

    The weights are those of the cohort's rows, or of ``weights`` (any keys that hold ``keys``, w of every slot)."""
    n, keys = range(slots), list(keys)
    held = F.map_from_entries(F.collect_list(F.struct("pair", F.struct("n", "one", "other", "cov", "low", "high", "weight"))))
    wide = moments.groupBy(*keys).agg(held.alias("_held")).where(f"_held['v0'].n >= {minimum}")
    # By place, which is far less code than by name.
    names = [name for name, _, _ in _pairs(slots)]
    at = {name: f"get(p, {i})" for i, name in enumerate(names)}
    listed = ", ".join(f"'{name}'" for name in names)
    wide = wide.selectExpr(*keys, f"transform(array({listed}), k -> _held[k]) AS p")
    if weights is None:
        wide = wide.selectExpr("*", *[f"coalesce({at[f'v{i}']}.weight, 0D) AS w{i}" for i in n])
    else:
        wide = cut(weights.join(wide, keys))  # what follows is too much code for one stage with the join
        keys = [c for c in weights.columns if c not in {f"w{i}" for i in n}]

    def covariance(i: int, j: int) -> str:
        """Of the shrunk values of slots i <= j."""
        rx = f"rx{i}_{j}" if i != j else f"xr{i}_{j}"
        return f"({at[f'xx{i}_{j}']}.cov - m{j} * {at[f'xr{i}_{j}']}.cov - m{i} * {at[rx]}.cov + m{i} * m{j} * {at[f'rr{i}_{j}']}.cov)"

    means = wide.selectExpr("*", *[f"{at[f'v{i}']}.one AS m{i}" for i in n])
    spread = means.selectExpr("*", *[f"IF({at[f'v{i}']}.high - {at[f'v{i}']}.low > {EPSILON}, sqrt(greatest({covariance(i, i)}, 0D)), 0D) AS d{i}" for i in n])
    scaled = spread.selectExpr("*", *[f"IF(w{i} <> 0 AND d{i} > {EPSILON}, w{i} / d{i}, 0D) AS q{i}" for i in n])
    parts = [f"coalesce({'' if i == j else '2 * '}q{i} * q{j} * {covariance(i, j)}, 0D)" for i in n for j in range(i, slots)]
    used = " + ".join(f"IF(q{i} <> 0, abs(w{i}), 0D)" for i in n)
    whole = scaled.selectExpr("*", f"sqrt(greatest({' + '.join(parts)}, 0D)) AS _sd", f"{used} AS _used")
    return whole.selectExpr(
        *keys,
        "get(p, 0).n AS peer_count",
        *[f"m{i}" for i in n],
        *[f"m{i} + {at[f'xx{i}_{i}']}.one - m{i} * {at[f'rr{i}_{i}']}.one AS a{i}" for i in n],
        *[f"d{i}" for i in n],
        "0D AS raw_mean",
        f"IF(_sd > {FLAT} * _used, _sd, 0D) AS raw_sd",
    )
