"""k-means over cells of order lines, and how well the clusters separate."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.parallel import side_by_side
from parcelwise.functions.small import checkpointed
from parcelwise.operators.features import standardized

POINTS_PER_TASK = 5_000
MEASURES = ("late_risk_rate", "avg_scheduled_days", "avg_sales", "order_volume")


def cell_features(cells: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Standardised measures of each cell, the volume as its logarithm."""
    logged = cells.withColumn("order_volume", F.log1p("order_volume")) if "order_volume" in measures else cells
    return standardized(logged, measures, keep=keys)


def _assembled(features: DataFrame, measures: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(measures), outputCol="features").transform(features)


def _dealt(points: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """As many sorted partitions as the number of points asks for, so that fits are repeatable and spread."""
    return points.repartition(max(1, -(-rows // POINTS_PER_TASK)), *keys).sortWithinPartitions(*keys)


def best_kmeans(points: DataFrame, k: int, restarts: int = 10, seed: int = 42):
    """The fit of least cost over several starts."""

    def start(i: int):
        return lambda: KMeans(k=k, seed=seed + i, maxIter=300, tol=1e-4, featuresCol="features").fit(points)

    fits = side_by_side(points.sparkSession, [start(i) for i in range(restarts)])
    return min(fits, key=lambda m: m.summary.trainingCost)


def kmeans_assignment(
    cells: DataFrame,
    keys: Sequence[str] = ("order_region", "category_name"),
    k: int = 4,
    measures: Sequence[str] = MEASURES,
    restarts: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Cells with their cluster. Clusters are numbered by their mean of the first measure, so numbers are stable."""
    cells = checkpointed(cells)
    points = _dealt(_assembled(cell_features(cells, keys, measures), measures), keys, cells.count()).persist()
    try:
        points.count()
        model = best_kmeans(points, k, restarts, seed)
    finally:
        points.unpersist()
    centres = model.clusterCenters()
    order = sorted(range(len(centres)), key=lambda i: (float(centres[i][0]), [float(v) for v in centres[i]]))
    number = F.array(*[F.lit(order.index(i)) for i in range(len(centres))])
    labels = model.transform(points).select(*keys, number[F.col("prediction")].alias("cluster"))
    return cells.join(labels, list(keys)).orderBy(*keys)


def cluster_summary(assignment: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Unweighted means over the cells of each cluster."""
    return (
        assignment.groupBy("cluster")
        .agg(F.count("*").alias("cells"), *[F.avg(m).alias(m) for m in measures])
        .orderBy("cluster")
    )


def elbow(
    cells: DataFrame,
    keys: Sequence[str] = ("order_region", "category_name"),
    ks: Sequence[int] = tuple(range(2, 11)),
    measures: Sequence[str] = MEASURES,
    restarts: int = 10,
) -> DataFrame:
    """Cost of the best fit for each number of clusters."""
    points = _dealt(_assembled(cell_features(cells, keys, measures), measures), keys, cells.count()).persist()
    try:

        def cost(k: int):
            return lambda: (k, float(best_kmeans(points, k, restarts).summary.trainingCost))

        points.count()
        costs = side_by_side(cells.sparkSession, [cost(k) for k in ks], 3)
    finally:
        points.unpersist()
    return cells.sparkSession.createDataFrame(costs, "k int, cost double")


def silhouette(
    features: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    cluster: str = "cluster",
    block_rows: int = 2_000,
) -> DataFrame:
    """Silhouette of every point with Euclidean distances: ``(keys..., cluster, a, b, silhouette)``.

    Points are dealt into blocks; a task takes two blocks and sends on, per point, one sum of distances for each
    cluster. Distances themselves never leave a task.
    """
    points = features.select(
        F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys]).alias("_id"),
        *keys,
        F.col(cluster).alias("_c"),
        F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"),
    )
    points = checkpointed(points)
    n = points.count()
    blocks = max(1, math.ceil(n / block_rows))
    dealt = points.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_partner")
    left = dealt.select("_id", "_x", F.col("_block").alias("_a"), partner.alias("_b"))
    right = dealt.select(
        F.col("_c").alias("_other"), F.col("_x").alias("_y"), F.col("_block").alias("_b"), partner.alias("_a")
    )

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"_id": [], "_other": [], "_sum": []})
        x, y = np.stack(a["_x"].to_numpy()), np.stack(b["_y"].to_numpy())
        out = []
        for c, index in sorted(b.groupby("_other").indices.items()):
            total = np.zeros(len(x))
            for start in range(0, len(x), 256):
                gap = x[start : start + 256, None, :] - y[None, index, :]
                total[start : start + 256] = np.sqrt((gap * gap).sum(axis=2)).sum(axis=1)
            out.append(pd.DataFrame({"_id": a["_id"], "_other": c, "_sum": total}))
        return pd.concat(out, ignore_index=True)

    kind = features.schema[cluster].dataType.simpleString()
    partial = (
        left.groupBy("_a", "_b")
        .cogroup(right.groupBy("_a", "_b"))
        .applyInPandas(sums, f"_id string, _other {kind}, _sum double")
    )
    totals = partial.groupBy("_id", "_other").agg(F.sum("_sum").alias("_sum"))
    sizes = points.groupBy("_c").agg(F.count("*").alias("_size"))
    facts = points.select("_id", *keys, "_c")
    joined = totals.join(sizes.withColumnRenamed("_c", "_other"), "_other").join(facts, "_id")
    own = F.col("_other") == F.col("_c")
    per_point = joined.groupBy("_id", *keys, "_c").agg(
        F.max(F.when(own, F.try_divide(F.col("_sum"), F.col("_size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("_sum") / F.col("_size"))).alias("b"),
        F.max(F.when(own, F.col("_size"))).alias("_size"),
    )
    value = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    value = F.when(F.col("_size") > 1, F.coalesce(value, F.lit(0).cast("double"))).otherwise(F.lit(0).cast("double"))
    return per_point.select(*keys, F.col("_c").alias(cluster), "a", "b", value.alias("silhouette")).orderBy(*keys)


def mean_silhouette(values: DataFrame) -> DataFrame:
    return values.agg(F.count("*").alias("points"), F.avg("silhouette").alias("mean_silhouette"))


def scatter_series(assignment: DataFrame) -> DataFrame:
    """Positions, clusters and mark sizes of the cells; size grows with volume relative to the largest cell."""
    largest = assignment.agg(F.max("order_volume")).scalar()
    return assignment.select(
        "avg_scheduled_days",
        "late_risk_rate",
        "cluster",
        (F.col("order_volume") / largest * 300 + 20).alias("mark_size"),
    )
