"""Evaluation of scored tables ``(line_id, model, y, p)``.

Every curve first collapses the rows to distinct scores, then runs over those.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelwise.functions.columns import all_present, ratio, when_count
from parcelwise.functions.small import attach_small, checkpointed
from parcelwise.operators.crosstab import filled
from parcelwise.operators.prefix import running_totals
from parcelwise.operators.split import stratified_split


def cell_rate_scores(
    df: DataFrame,
    cell: tuple[str, ...] = ("shipping_mode", "order_status"),
    label: str = "late_risk",
    key: str = "line_id",
    carry: tuple[str, ...] = ("profit_ratio",),
) -> DataFrame:
    """A scorer without a fitting library: p is the training rate of the row's cell. Test rows only."""
    # the split, the rates and the scores read the same few columns: derive them once
    parts = stratified_split(checkpointed(df.select(key, label, *cell, *carry)), label, key)
    rates = parts.where("split = 'train'").where(all_present(*cell)).groupBy(*cell).agg(F.avg(label).alias("p"))
    test = attach_small(parts.where("split = 'test'"), rates, cell)
    return test.select(key, F.lit("cell_rate").alias("model"), F.col(label).alias("y"), "p", *carry)


def confusion_matrix(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts ``(model, y, predicted, n)``, all four cells of each model."""
    cell = (F.col("y") * 2 + (F.col("p") > threshold).cast("int")).alias("_cell")
    counts = scores.groupBy("model", cell).agg(F.count("*").alias("n"))
    full = filled(counts, "model", "_cell", "n", F.sequence(F.lit(0), F.lit(3)))
    out = full.select("model", F.floor(F.col("_cell") / 2).cast("int").alias("y"), (F.col("_cell") % 2).alias("predicted"), "n")
    return out.orderBy("model", "y", "predicted")


def classification_metrics(scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class, p above the threshold; an undefined ratio is null."""
    late, flagged = F.col("y") == 1, F.col("p") > threshold
    counts = scores.groupBy(*by).agg(
        F.count("*").alias("n"),
        when_count(late & flagged).alias("tp"),
        when_count(~late & flagged).alias("fp"),
        when_count(late & ~flagged).alias("fn"),
        when_count(late == flagged).alias("right"),
    )
    return metrics_of_counts(counts, by).orderBy(*by)


def metrics_of_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics from counts ``n, tp, fp, fn, right``."""
    return counts.select(
        *by,
        ratio("right", "n").alias("accuracy"),
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        ratio("tp", F.col("tp") + F.col("fn")).alias("recall"),
        ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")).alias("f1"),
    )


def _ladder(scores: DataFrame) -> DataFrame:
    """Per distinct score, from the top: true and false positives when flagging everything at or above it."""
    distinct = scores.groupBy("model", "p").agg(
        F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg")
    )
    ladder = running_totals(distinct, "p", ["pos", "neg"], by=["model"], descending=True)
    ladder = ladder.withColumnsRenamed({"upto_pos": "tp", "upto_neg": "fp"})
    totals = distinct.groupBy("model").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    # one row per model
    return ladder.join(totals, "model")


def roc_curve(scores: DataFrame) -> DataFrame:
    """``(model, threshold, fp, tp, fpr, tpr)`` from (0, 0), which has no threshold, to (1, 1)."""
    points = _ladder(scores).select("model", F.col("p").alias("threshold"), "fp", "tp", "all_neg", "all_pos")
    zero = F.lit(0).cast("long")
    origin = scores.groupBy("model").agg(
        F.lit(None).cast("double").alias("threshold"),
        zero.alias("fp"),
        zero.alias("tp"),
        when_count(F.col("y") == 0).alias("all_neg"),
        when_count(F.col("y") == 1).alias("all_pos"),
    )
    curve = origin.unionByName(points).select(
        "model", "threshold", "fp", "tp", ratio("fp", "all_neg").alias("fpr"), ratio("tp", "all_pos").alias("tpr")
    )
    return curve.orderBy("model", F.desc_nulls_first("threshold"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve, tied pairs counting half; null if one class is missing."""
    below = F.col("all_neg") - F.col("fp")
    won = F.sum(F.col("pos") * (below.cast("double") + F.col("neg") / 2))
    area = F.try_divide(won, F.max(F.col("all_pos").cast("double") * F.col("all_neg")))
    return _ladder(scores).groupBy("model").agg(area.alias("roc_auc")).orderBy("model")


def pr_curve(scores: DataFrame) -> DataFrame:
    """``(model, threshold, recall, precision)``, ending in (0, 1), which has no threshold."""
    points = _ladder(scores).select(
        "model",
        F.col("p").alias("threshold"),
        ratio("tp", "all_pos").alias("recall"),
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
    )
    end = scores.select("model").distinct().select(
        "model",
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0).cast("double").alias("recall"),
        F.lit(1).cast("double").alias("precision"),
    )
    return points.unionByName(end).orderBy("model", F.asc_nulls_last("threshold"))


def average_precision(scores: DataFrame) -> DataFrame:
    """Sum of recall steps times precision, without interpolation."""
    step = ratio("pos", "all_pos") * ratio("tp", F.col("tp") + F.col("fp"))
    return _ladder(scores).groupBy("model").agg(F.sum(step).alias("average_precision")).orderBy("model")


def cost_curve(
    scores: DataFrame,
    miss_cost: str = "profit_ratio",
    alarm_cost: float = 0.15,
    low: float = 0.05,
    high: float = 0.95,
    points: int = 50,
) -> DataFrame:
    """Cost of flagging p >= t on an even grid of thresholds: ``(model, grid_index, threshold, cost)``.

    A missed row costs its ``miss_cost``, which may be negative; a false alarm costs ``alarm_cost``. Each row only
    counts how many thresholds it reaches; the curve comes from sums over those counts, at most ``points + 1`` per model.
    """
    thresholds = F.array(*[F.lit(float(t)) for t in np.linspace(low, high, points)])
    # the position on an even grid, put right against the exact grid values next to it
    guess = F.floor((F.col("p") - low) * ((points - 1) / (high - low)))
    guess = F.greatest(F.lit(-1), F.least(guess, F.lit(points - 1))).cast("int")
    t_here = F.get(thresholds, guess)
    t_next = F.get(thresholds, guess + 1)
    reached = guess + 1 - F.when(F.col("p") < t_here, 1).otherwise(0) + F.when(F.col("p") >= t_next, 1).otherwise(0)
    per_reach = scores.groupBy("model", reached.alias("reached")).agg(
        F.coalesce(F.sum(F.when(F.col("y") == 1, F.col(miss_cost))), F.lit(0).cast("double")).alias("miss"),
        when_count(F.col("y") == 0).alias("alarms"),
    )
    # maps of at most points + 1 entries per model
    maps = per_reach.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct("reached", F.struct("miss", "alarms")))).alias("m")
    )
    full = maps.select("model", "m", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("reached"))
    full = full.select(
        "model",
        "reached",
        F.coalesce(F.col("m")[F.col("reached")]["miss"], F.lit(0).cast("double")).alias("miss"),
        F.coalesce(F.col("m")[F.col("reached")]["alarms"], F.lit(0).cast("long")).alias("alarms"),
    )
    # a row that reaches r thresholds is flagged at grid points 0..r-1 and missed at the others
    up = W.partitionBy("model").orderBy("reached").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("model").orderBy("reached").rowsBetween(1, W.unboundedFollowing)
    cost = F.sum("miss").over(up) + F.coalesce(F.sum("alarms").over(down), F.lit(0)) * alarm_cost
    curve = full.select("model", F.col("reached").alias("grid_index"), cost.alias("cost")).where(F.col("grid_index") < points)
    return curve.select("model", "grid_index", thresholds[F.col("grid_index")].alias("threshold"), "cost").orderBy(
        "model", "grid_index"
    )


def cost_optimal_threshold(curve: DataFrame) -> DataFrame:
    """The threshold of least cost per model, the lowest one among equals."""
    best = F.min(F.struct(F.round("cost", 9).alias("c"), "threshold", "cost"))
    out = curve.groupBy("model").agg(best.alias("b"))
    return out.select("model", F.col("b.threshold").alias("threshold"), F.col("b.cost").alias("cost")).orderBy("model")


def calibration_curve(scores: DataFrame, bins: int = 10, skip: tuple[str, ...] = ()) -> DataFrame:
    """Mean score and share of positives in right-closed bins; empty bins stay out."""
    index = F.least(F.greatest(F.ceil(F.col("p") * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    rows = scores.where(~F.col("model").isin(*skip)) if skip else scores
    return (
        rows.groupBy("model", index.alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.avg("p").alias("mean_predicted"),
            F.avg(F.col("y").cast("double")).alias("fraction_positive"),
        )
        .orderBy("model", "bin")
    )


def with_residual(scores: DataFrame) -> DataFrame:
    return scores.withColumn("residual", F.col("y") - F.col("p"))


def model_results(scores: DataFrame) -> DataFrame:
    """One row of metrics per model."""
    # three passes over scores that may come straight from fitted models
    scores = checkpointed(scores.select("model", "y", "p"))
    return (
        classification_metrics(scores)
        .join(roc_auc(scores), "model")
        .join(average_precision(scores).withColumnRenamed("average_precision", "avg_precision"), "model")
        .orderBy("model")
    )
