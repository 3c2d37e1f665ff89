"""Histograms, box statistics, descriptive statistics, correlations and row samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.columns import all_present, when_count
from parcelwise.functions.small import attach_small, checkpointed
from parcelwise.operators.crosstab import filled
from parcelwise.operators.gramian import masked_gramian
from parcelwise.operators.quantiles import exact_quantiles, quartiles
from parcelwise.operators.split import hash_cuts, within_cut


def histogram(
    df: DataFrame,
    column: str,
    bins: int,
    low: float | None = None,
    high: float | None = None,
    by: str | None = None,
) -> DataFrame:
    """Equal-width bins ``(by, bin, bin_low, bin_high, n)``, empty bins included; the last bin is closed.

    Without ``low`` and ``high`` the bins span the whole range of the column; rows outside given limits are left out.
    """
    keys = [by] if by else ["_all"]
    rows = df.where(all_present(column, *([by] if by else [])))
    rows = rows.select((F.col(by) if by else F.lit(0)).alias(keys[0]), F.col(column).cast("double").alias("_x"))
    if low is None or high is None:
        # as in the usual histogram routines, a column with one value gets a bin range of width 1 around it
        flat = F.min("_x") == F.max("_x")
        span = rows.agg(
            F.struct(
                F.when(flat, F.min("_x") - 0.5).otherwise(F.min("_x")).alias("low"),
                F.when(flat, F.max("_x") + 0.5).otherwise(F.max("_x")).alias("high"),
            )
        ).scalar()
        lo, hi = span["low"], span["high"]
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
    width = hi - lo
    index = F.least(F.floor((F.col("_x") - lo) * bins / width), F.lit(bins - 1)).cast("int")
    counts = rows.where((F.col("_x") >= lo) & (F.col("_x") <= hi)).groupBy(keys[0], index.alias("bin"))
    counts = counts.agg(F.count("*").alias("n"))
    full = filled(counts, keys[0], "bin", "n", F.sequence(F.lit(0), F.lit(bins - 1)))
    out = full.select(
        *keys,
        "bin",
        (lo + F.col("bin") * width / bins).alias("bin_low"),
        (lo + (F.col("bin") + 1) * width / bins).alias("bin_high"),
        "n",
    )
    return (out if by else out.drop("_all")).orderBy(*([by] if by else []), "bin")


def box_stats(df: DataFrame, column: str, by: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the outermost values within ``reach`` IQR of the box, and the number of outliers."""
    by = list(by)
    rows = df.where(all_present(column, *by)).select(*by, F.col(column).cast("double").alias("_x"))
    boxes = attach_small(rows, quartiles(rows, "_x", by), by)
    spread = (F.col("q3") - F.col("q1")) * reach
    inside = F.col("_x").between(F.col("q1") - spread, F.col("q3") + spread)
    return (
        boxes.groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.first("q1").alias("q1"),
            F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
            when_count(~inside).alias("outliers"),
        )
        .orderBy(*by)
    )


def describe_by(df: DataFrame, columns: Sequence[str], by: str = "late_risk") -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of each numeric column per class."""
    # moments, sketches and quantiles each read these columns: derive them once
    rows = checkpointed(df.where(all_present(by)).select(by, *[F.col(c).cast("double").alias(c) for c in columns]))
    moments = rows.groupBy(by).agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
            ).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    moments = moments.select(by, F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))
    quants = exact_quantiles(rows, columns, by=[by])
    quants = quants.groupBy("column_name", by).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    )
    out = moments.join(quants, ["column_name", by], "left")
    return out.select("column_name", by, "count", "mean", "std", "min", "p25", "p50", "p75", "max").orderBy(
        "column_name", by
    )


STATISTICS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_wide(described: DataFrame, by: str = "late_risk") -> DataFrame:
    """The table of :func:`describe_by` with a row for each column and statistic and a column for each class."""
    entries = [F.struct(F.lit(i).alias("place"), F.lit(s).alias("statistic"), F.col(s).cast("double").alias("v")) for i, s in enumerate(STATISTICS)]
    long = described.select("column_name", by, F.inline(F.array(*entries)))
    # eight rows for each column and class
    wide = long.groupBy("column_name", "place", "statistic").pivot(by).agg(F.first("v"))
    return wide.orderBy("column_name", "place").drop("place")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every two columns over rows where both are present.

    A constant column has null correlations. Output is long, ``(column_a, column_b, corr)``, with both halves. The sums
    of all pairs come from one pass (:func:`masked_gramian`); values are taken relative to the column means so that large
    magnitudes do not cancel. Not-a-number counts as missing. A table without rows gives null correlations.
    """
    columns = list(columns)
    spark = df.sparkSession
    numbers = [F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(columns)]
    rows = checkpointed(df.select(*numbers))  # both passes read these columns: derive them once
    names = rows.columns
    stats = rows.agg(*[F.struct(F.avg(c).alias("mean"), (F.min(c) < F.max(c)).alias("varies")) for c in names]).first()
    # a constant column becomes exactly 0
    zero = F.lit(0).cast("double")
    levelled = [F.col(c) if s["varies"] else F.when(F.col(c).isNotNull(), zero).alias(c) for c, s in zip(names, stats)]
    origin = [s["mean"] if s["varies"] else 0.0 for s in stats]
    sums = masked_gramian(rows.select(*levelled), names, origin)
    covariance = F.col("sum_ab") - F.col("sum_a") * F.col("sum_b") / F.col("n")
    spread_a = F.col("sum_aa") - F.col("sum_a") * F.col("sum_a") / F.col("n")
    spread_b = F.col("sum_bb") - F.col("sum_b") * F.col("sum_b") / F.col("n")
    corr = F.when((F.col("n") > 0) & (spread_a > 0) & (spread_b > 0), covariance / F.sqrt(spread_a * spread_b))
    half = sums.select("a", "b", corr.alias("corr"))
    # one row for each pair
    pairs = spark.createDataFrame([(a, b, min(i, j), max(i, j)) for i, a in enumerate(columns) for j, b in enumerate(columns)], "column_a string, column_b string, a long, b long")
    return pairs.join(half, ["a", "b"], "left").select("column_a", "column_b", "corr").orderBy("column_a", "column_b")


def correlation_wide(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The long matrix with a column for each of ``columns``, as correlation tables are published."""
    wide = matrix.groupBy("column_a").pivot("column_b", list(columns)).agg(F.first("corr"))
    return wide.withColumnRenamed("column_a", "column_name").orderBy("column_name")


def sample_rows(df: DataFrame, n: int, key: str = "line_id", seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer), the same ones in every run.

    The n-th smallest hash is found first, so that drawing the sample is a filter on each row.
    """
    cut = hash_cuts(df, key, lambda size: [min(n, size)], seed=seed).get(None)
    return df.where(within_cut(key, cut[0], seed)) if cut else df.limit(0)
