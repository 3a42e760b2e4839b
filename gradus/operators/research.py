"""Chronological event models, probability metrics, archetypes and action value."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, Imputer, QuantileDiscretizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import beside, cut
from .ordered import cumulative

MARGIN = 0.002  # a model replaces the logistic one only if its Brier score is better by this
GRID = (16, 12)


# --- Event models ---------------------------------------------------------------------------------
#: Rows of a partition of training data: boosting starts hundreds of jobs over it, each as short as its data allow.
FITTED_ROWS = 40_000
#: Bins of a feature that boosted trees may split at: as many as Spark's trees bin a feature into by themselves.
BINS = 32


def _prepared(features: Sequence[str], wide: Sequence[str]) -> list:
    """``wide`` are binned for the trees; features of few values keep them, so that no rare value is lost in a bin."""
    filled = [f"{f}_filled" for f in features]
    bins = [QuantileDiscretizer(numBuckets=BINS, inputCols=[f"{f}_filled" for f in wide], outputCols=[f"{f}_bin" for f in wide])] if wide else []
    return [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
        *bins,
        VectorAssembler(inputCols=[f"{f}_bin" if f in wide else f"{f}_filled" for f in features], outputCol="bins"),
    ]


def train_models(
    folds: DataFrame, features: Sequence[str], label: str, trees: int = 120, step: float = 0.05, epochs: int = 80, seed: int = 42
):
    """Logistic regression, boosted trees and a small network, fitted on the training fold only.

    The fold is prepared once for all three, in as many partitions as its rows are worth, and all models are
    evaluated in one pass over the other folds. Trees see a feature by its bin only, so rows alike in bins and label
    are one row with their number as weight: hundreds of passes go over the cells, not over the rows. Returns (scores per model and fold, chosen model name, fitted models).
    """
    data = folds.select("fold", F.col(label).cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]).persist()
    train = data.where("fold = 'train'")
    wide = [f for f in features if train.select(f).distinct().limit(BINS + 1).count() > BINS]
    prepare = Pipeline(stages=_prepared(features, wide)).fit(train)
    many = train.count()
    ready = prepare.transform(train).select("label", "features", "bins").repartition(max(1, -(-many // FITTED_ROWS))).persist()
    cells = cut(ready.groupBy("label", "bins").agg(F.count("*").cast("double").alias("rows")))
    cells = cells.repartition(max(1, -(-cells.count() // FITTED_ROWS))).persist()
    estimators = {
        "logistic": LogisticRegression(),
        # The lineage of the residuals is cut a few times only.
        "boosted_trees": GBTClassifier(featuresCol="bins", weightCol="rows", maxBins=BINS, maxIter=trees, maxDepth=4, stepSize=step, seed=seed, checkpointInterval=40),
        "network": MultilayerPerceptronClassifier(layers=[len(features), 16, 8, 2], maxIter=epochs, seed=seed),
    }
    fitted = {name: estimator.fit(cells if name == "boosted_trees" else ready) for name, estimator in estimators.items()}
    ready.unpersist()
    cells.unpersist()
    held = prepare.transform(data.where("fold <> 'train'")).select("fold", "label", "features", "bins")
    for name, model in fitted.items():
        own = model.transform(held).drop("rawPrediction", "prediction")
        held = own.withColumn(name, vector_to_array("probability")[1]).drop("probability")
    names = ", ".join(f"named_struct('model', '{n}', 'p', {n})" for n in fitted)
    scored = held.selectExpr("fold", "label", f"inline(array({names}))")
    scores = cut(scored.groupBy("model", "fold").agg(F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"), F.count("*").alias("rows")))
    # Three models x two folds.
    table = {(r["model"], r["fold"]): r["brier"] for r in scores.collect()}
    data.unpersist()
    chosen = "logistic"
    for name in ("boosted_trees", "network"):
        if table[(name, "validation")] < table[("logistic", "validation")] - MARGIN and table[(name, "validation")] < table[(chosen, "validation")]:
            chosen = name
    return scores.withColumn("chosen", F.col("model") == chosen), chosen, fitted


def probability_metrics(df: DataFrame, keys: Sequence[str], label: str, probability: str) -> DataFrame:
    """Brier score, log loss and ROC AUC (null with one class) per group.

    AUC comes from mid-ranks of the distinct probabilities, so no group is sorted whole.
    """
    keys = list(keys)
    p = f"least(greatest({probability}, 1e-15D), 1 - 1e-15D)"
    basic = df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.expr(f"avg(pow({probability} - {label}, 2)) AS brier"),
        F.expr(f"avg(-({label} * ln({p}) + (1 - {label}) * ln(1 - {p}))) AS log_loss"),
        F.expr(f"sum({label}) AS positives"),
    )
    counts = df.groupBy(*keys, probability).agg(F.count("*").alias("n"), F.expr(f"sum({label}) AS pos"))
    rank_sum = cumulative(counts, keys, probability).groupBy(*keys).agg(F.expr("sum(pos * (below + (n + 1) / 2)) AS rank_sum"))
    return basic.join(rank_sum, keys).selectExpr(
        *keys,
        "rows",
        "brier",
        "log_loss",
        "IF(positives > 0 AND positives < rows, (rank_sum - positives * (positives + 1) / 2) / (positives * (rows - positives)), NULL) AS roc_auc",
    )


def calibration_bins(df: DataFrame, keys: Sequence[str], label: str, probability: str, bins: int = 10) -> DataFrame:
    """Count, mean prediction and observed rate per bin; the last bin is closed."""
    return (
        df.withColumn("bin", F.expr(f"least(cast(floor({probability} * {bins}) AS int), {bins - 1})"))
        .groupBy(*keys, "bin")
        .agg(F.count("*").alias("count"), F.avg(probability).alias("predicted"), F.avg(label).alias("observed"))
    )


def archetypes(df: DataFrame, key: str, vector: str, components: int, seed: int = 42) -> DataFrame:
    """Standardise, reduce to at most three components and fit a Gaussian mixture."""
    rows = df.select(key, array_to_vector(F.col(vector)).alias("_v")).persist()
    if rows.count() < 10 * components:
        raise ValueError("needs at least ten rows per component")
    width = len(rows.first()["_v"])
    reduced = Pipeline(
        stages=[
            StandardScaler(inputCol="_v", outputCol="_s", withMean=True),
            PCA(k=min(3, width), inputCol="_s", outputCol="features"),
        ]
    ).fit(rows).transform(rows)
    model = GaussianMixture(k=components, seed=seed).fit(reduced)
    return model.transform(reduced).select(key, F.col("prediction").alias("archetype"))


# --- Action value --------------------------------------------------------------------------------
def zone(x: str, y: str, length: float, width: float) -> str:
    """SQL of the grid cell 0..191 of a location; the far edges belong to the last cells."""
    cols, rows = GRID
    return (
        f"cast(least(floor({x} / {length} * {cols}), {cols - 1}) + {cols} * least(floor({y} / {width} * {rows}), {rows - 1}) AS int)"
    )


def threat_surface(actions: DataFrame, tolerance: float = 1e-5) -> np.ndarray:
    """Expected threat of each zone.

    ``actions``: (kind shot|move, success, start_zone, end_zone). Spark reduces the actions to counts
    of 192 zones and 192 x 192 transitions; only those fixed-size tables reach the driver.
    """
    size = GRID[0] * GRID[1]
    starts = actions.groupBy("start_zone").agg(
        F.expr("count_if(kind = 'shot') AS shots"),
        F.expr("count_if(kind = 'shot' AND success) AS goals"),
        F.expr("count_if(kind = 'move') AS moves"),
    )
    moves = actions.where("kind = 'move' AND success").groupBy("start_zone", "end_zone").agg(F.count("*").alias("n"))
    shots, goals, moved = (np.zeros(size) for _ in range(3))
    for r in starts.collect():
        shots[r["start_zone"]], goals[r["start_zone"]], moved[r["start_zone"]] = r["shots"], r["goals"], r["moves"]
    transition = np.zeros((size, size))
    for r in moves.collect():
        transition[r["start_zone"], r["end_zone"]] = r["n"]
    with np.errstate(divide="ignore", invalid="ignore"):
        transition = np.nan_to_num(transition / moved[:, None])
        shot_share = np.nan_to_num(shots / (shots + moved))
        move_share = np.nan_to_num(moved / (shots + moved))
        scoring = np.nan_to_num(goals / shots)
    surface = np.zeros(size)
    while True:
        new = shot_share * scoring + move_share * (transition @ surface)
        if np.max(np.abs(new - surface)) <= tolerance:
            return new
        surface = new


def action_values(actions: DataFrame, surface: np.ndarray) -> DataFrame:
    """Value of each successful move: threat where it ends minus threat where it began."""
    spark = actions.sparkSession
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(surface)], "zone int, threat double")  # 192 rows
    return (
        actions.where("kind = 'move' AND success")
        .join(F.broadcast(table.selectExpr("zone AS start_zone", "threat AS _from")), "start_zone")
        .join(F.broadcast(table.selectExpr("zone AS end_zone", "threat AS _to")), "end_zone")
        .withColumn("value", F.expr("_to - _from"))
        .drop("_from", "_to")
    )


def held_out_value(actions: DataFrame, date: str, share: float = 0.8, match: str | None = None) -> DataFrame:
    """One row: actions fitted, actions held out, moves scored and their mean value.

    The surface is fitted on the earlier dates only. Fewer than five dates, or twenty matches where ``match``
    names them, are refused.
    """
    seen = actions.agg(F.count_distinct(F.to_date(date)).alias("dates"), F.count_distinct(match if match else F.lit(1)).alias("matches")).first()
    if seen["dates"] < 5 or (match and seen["matches"] < 20):
        raise ValueError("at least 20 matches and 5 dates are needed")
    from pyspark.sql import Window

    dates = actions.select(F.to_date(date).alias("_d")).distinct()
    w = Window.orderBy("_d")  # distinct calendar days only
    cut_date = (
        dates.select("_d", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))
        .where(f"i = greatest(1, cast(floor(n * {share}) AS int))")
        .first()["_d"]
    )
    train, test = actions.where(F.to_date(date) <= F.lit(cut_date)), actions.where(F.to_date(date) > F.lit(cut_date))
    values = action_values(test, threat_surface(train)).agg(F.count("*").alias("scored_actions"), F.avg("value").alias("mean_value"))
    counts = beside(train.agg(F.count("*").alias("train_actions")), test.agg(F.count("*").alias("test_actions")))
    return beside(counts, values)


def normalise_source(df: DataFrame, key: str, columns: Sequence[str], minutes: str = "minutes") -> tuple[DataFrame, DataFrame]:
    """(totals, quarantine) of text-typed aggregates: every present number plain decimal digits, finite and not
    negative; signs, exponents, hexadecimal and type suffixes are refused."""
    from .quality import split

    rules = {}
    typed = df
    texts = {n for n, t in df.dtypes if t == "string"}
    for c in columns:
        plain = "{c} RLIKE '^[0-9]+([.][0-9]+)?$'" if c in texts else "NOT isnan(_{c})"
        typed = typed.withColumn(f"_{c}", F.col(c).try_cast("double"))
        rules[f"{c} invalid"] = (
            f"{c} IS NOT NULL AND NOT coalesce({plain.format(c=c)} AND _{c} >= 0 AND _{c} < double('Infinity'), false)"
        )
    valid, bad = split(typed, rules, [key])
    others = [c for c in df.columns if c not in columns]
    return valid.select(*others, *[F.col(f"_{c}").alias(c) for c in columns]), bad
