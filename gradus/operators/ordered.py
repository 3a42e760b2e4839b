"""Order statistics inside groups of any size.

A plain window sorts a whole group in one task. Here a group is first reduced to its distinct values. Where a group
has more of them than a task should sort, it is cut into cells at its own sampled quantiles, so its cells hold about
as many values each, however the values lie; only the small per-cell totals are accumulated per group, and the
remaining work is one window per (group, cell). The quantiles are written once, so every reader and every recomputed
task cuts at the same values; the results are exact wherever the cuts fall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .lookup import beside_cohort

#: Distinct values that one task sorts, and the most cells of a group.
CELL = 250_000
CELLS = 4096
#: Splitters that are compared at a time: a value finds its run of so many first.
RUN = 64


def finite(column: Column) -> Column:
    """True only for a number that is neither null, NaN nor infinite."""
    c = column.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def value_counts(df: DataFrame, keys: Sequence[str], value: str, out: str = "n") -> DataFrame:
    return df.where(finite(F.col(value))).groupBy(*keys, value).agg(F.count("*").alias(out))


def splitters(rows: DataFrame, keys: Sequence[str], value: str, size: int) -> DataFrame | None:
    """(keys, _splits): ascending cuts of every group of more than ``size`` rows, about one per ``size`` rows; None if
    there is no such group. ``rows`` is read twice."""
    keys = list(keys)
    crowded = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where(f"_rows > {size}")
    if crowded.isEmpty():
        return None
    crowded = cut(crowded)
    shares = F.array(*[F.lit(k / CELLS) for k in range(1, CELLS)])
    found = beside_cohort(rows, crowded, keys).groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), shares, 4 * CELLS).alias("_all"), F.max("_rows").alias("_rows")
    )
    step = f"greatest(1, {CELLS} div cast(ceil(_rows / {size}) AS int))"
    return cut(found.selectExpr(*keys, f"array_distinct(filter(_all, (x, i) -> (i + 1) % {step} = 0)) AS _splits"))


def in_cells(rows: DataFrame, splits: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``_cell``: how many of its group's splitters a row's value reaches."""
    at = f"double(`{value}`)"
    joined = beside_cohort(rows, splits, keys, "left").withColumn("_splits", F.expr("coalesce(_splits, array())"))
    runs = f"filter(_splits, (x, i) -> (i + 1) % {RUN} = 0 AND x <= {at})"
    joined = joined.withColumn("_run", F.expr(f"size({runs}) * {RUN}"))
    return joined.withColumn("_cell", F.expr(f"_run + size(filter(slice(_splits, _run + 1, {RUN}), x -> x <= {at}))")).drop("_run", "_splits")


def _cell_sums(celled: DataFrame, keys: Sequence[str], value: str, columns: Sequence[str]) -> DataFrame:
    """One row per cell: what lies before it and in its whole group, and the neighbouring cells' nearest values.

    The windows over a group see its cells only."""
    by = Window.partitionBy(*keys)
    across = by.orderBy("_cell")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.groupBy(*keys, "_cell").agg(*[F.sum(c).alias(f"_in_{c}") for c in columns], F.min(value).alias("_first"), F.max(value).alias("_last"))
    return cells.select(
        *keys,
        "_cell",
        *[F.col(f"_in_{c}") for c in columns],
        *[F.coalesce(F.sum(f"_in_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in columns],
        *[F.sum(f"_in_{c}").over(by).alias(f"{c}_total") for c in columns],
        F.lag("_last").over(across).alias("_prev"),
        F.lead("_first").over(across).alias("_next"),
    )


def running(rows: DataFrame, keys: Sequence[str], value: str, columns: Sequence[str], size: int | None = None) -> DataFrame:
    """Add for each of ``columns`` its sum at smaller values of the group (``<c>_below``) and in the whole group
    (``<c>_total``), and the neighbouring values ``previous`` and ``following``.

    ``rows`` holds one row per (keys, value); keys must not be null. Groups of more than ``size`` rows are cut into
    cells.
    """
    keys = list(keys)
    rows = rows.persist()  # read for the sizes of groups and for the values
    splits = splitters(rows, keys, value, CELL if size is None else size)
    if splits is None:
        by = Window.partitionBy(*keys)
        inside = by.orderBy(value)
        before = inside.rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(
            *rows.columns,
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_below") for c in columns],
            *[F.sum(c).over(by).alias(f"{c}_total") for c in columns],
            F.lag(value).over(inside).alias("previous"),
            F.lead(value).over(inside).alias("following"),
        )
    celled = in_cells(rows, splits, keys, value)
    inside = Window.partitionBy(*keys, "_cell").orderBy(value)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    inner = celled.select(
        *rows.columns, "_cell", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_inner_{c}") for c in columns],
        F.lag(value).over(inside).alias("_lag"), F.lead(value).over(inside).alias("_lead"),
    )
    # Cells are as many as the crowded groups' tasks, and one for every other group.
    both = inner.join(_cell_sums(celled, keys, value, columns), [*keys, "_cell"])
    return both.select(
        *rows.columns,
        *[(F.col(f"_before_{c}") + F.col(f"_inner_{c}")).alias(f"{c}_below") for c in columns],
        *[f"{c}_total" for c in columns],
        F.coalesce("_lag", "_prev").alias("previous"),
        F.coalesce("_lead", "_next").alias("following"),
    )


def cumulative(counts: DataFrame, keys: Sequence[str], value: str, weight: str = "n") -> DataFrame:
    """Add ``below`` (weight at smaller values), ``total``, ``previous`` and ``following``.

    ``counts`` holds one row per (keys, value); keys must not be null.
    """
    return running(counts, keys, value, [weight]).withColumnsRenamed({f"{weight}_below": "below", f"{weight}_total": "total"})


def quantiles(counts: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], size: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles per group as rows (keys, probability, quantile).

    In a crowded group whole cells tell which of them hold a wanted rank; only the values of those are sorted.
    """
    keys = list(keys)
    counts = counts.persist()
    # The probabilities are a fixed parameter list, so the array stays small.
    probs = F.expr("array(" + ", ".join(f"{float(p)!r}D" for p in probabilities) + ")")

    def touching(wanted: Column, start: Column, width: Column) -> Column:
        def touches(p: Column) -> Column:
            at = p * (F.col("total") - 1)
            return ((F.floor(at) >= start) & (F.floor(at) < start + width)) | (
                (F.ceil(at) >= start) & (F.ceil(at) < start + width)
            )

        return F.filter(wanted, touches)

    def near(below: Column) -> Column:
        """The few probabilities that may fall on a value, where they are many at even distances."""
        steps = len(probabilities) - 1
        if steps < 8 or any(abs(p - i / steps) > 1e-12 for i, p in enumerate(probabilities)):
            return probs
        scale = F.lit(float(steps)) / F.greatest(F.col("total") - 1, F.lit(1))
        first = F.greatest(F.floor((below - 1) * scale).cast("int"), F.lit(1))
        last = F.least(F.ceil((below + F.col("n")) * scale).cast("int") + 2, F.lit(steps + 1))
        return F.slice(probs, first, F.greatest(last - first + 1, F.lit(1)))

    splits = splitters(counts, keys, value, CELL if size is None else size)
    if splits is None:
        by = Window.partitionBy(*keys)
        before = by.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.select(*keys, value, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"), F.sum("n").over(by).alias("total"))
        placed = placed.withColumn("_wanted", near(F.col("below")))
    else:
        celled = in_cells(counts, splits, keys, value)
        cells = _cell_sums(celled, keys, value, ["n"]).withColumnRenamed("n_total", "total")
        useful = cells.select(
            *keys, "_cell", "_before_n", "total", touching(probs, F.col("_before_n"), F.col("_in_n")).alias("_wanted")
        ).where(F.size("_wanted") > 0)
        before = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        placed = celled.join(useful, [*keys, "_cell"]).withColumn("below", F.col("_before_n") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    hits = placed.select(
        *keys, value, "below", "n", "total", F.explode(touching(F.col("_wanted"), F.col("below"), F.col("n"))).alias("probability")
    ).withColumn("_at", F.col("probability") * (F.col("total") - 1))
    hit = lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n"))
    return (
        hits.groupBy(*keys, "probability")
        .agg(
            F.max(F.when(hit(F.floor("_at")), F.col(value))).alias("_low"),
            F.max(F.when(hit(F.ceil("_at")), F.col(value))).alias("_high"),
            F.max(F.col("_at") - F.floor("_at")).alias("_f"),
        )
        .select(
            *keys,
            "probability",
            (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_f")).alias("quantile"),
        )
    )
