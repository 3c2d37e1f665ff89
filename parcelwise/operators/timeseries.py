"""Calendar series and rolling statistics.

The rows are reduced to one per day or month first; the windows below run over that calendar, whose length is bounded by
the number of days covered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelwise.functions.columns import all_present
from parcelwise.operators.prefix import running_totals


def _calendar(series: DataFrame, day: str, step: str) -> DataFrame:
    ends = series.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr(step))).alias(day))


def daily_rolling_rate(
    df: DataFrame, ts: str = "order_ts", measure: str = "late_risk", window: int = 7
) -> DataFrame:
    """Daily mean on an unbroken calendar and its rolling mean; null if any day of the window has no rows."""
    daily = df.where(all_present(ts)).groupBy(F.to_date(ts).alias("day")).agg(F.avg(measure).alias("daily_rate"))
    full = _calendar(daily, "day", "interval 1 day").join(daily, "day", "left")
    last = W.orderBy("day").rowsBetween(-(window - 1), 0)
    rolling = F.when(F.count("daily_rate").over(last) == window, F.avg("daily_rate").over(last))
    return full.withColumn("rolling_rate", rolling).orderBy("day")


def daily_rolling_variance(
    df: DataFrame, ts: str = "order_ts", measure: str = "sales", window: int = 7
) -> DataFrame:
    """Daily sums of the days that occur and the sample variance over the last ``window`` of them."""
    daily = df.where(all_present(ts)).groupBy(F.to_date(ts).alias("day")).agg(F.sum(measure).alias("daily_total"))
    last = W.orderBy("day").rowsBetween(-(window - 1), 0)
    variance = F.when(F.count("daily_total").over(last) == window, F.var_samp("daily_total").over(last))
    return daily.withColumn("rolling_variance", variance).orderBy("day")


def monthly_count(df: DataFrame, value: str, column: str = "order_status", ts: str = "order_ts") -> DataFrame:
    """Rows with one status per month, labelled by the month's last day; months without any count 0."""
    month = F.trunc(F.to_date(ts), "month").alias("month")
    counts = df.where((F.col(column) == value) & F.col(ts).isNotNull()).groupBy(month).agg(F.count("*").alias("n"))
    full = _calendar(counts, "month", "interval 1 month").join(counts, "month", "left")
    return full.select(
        F.last_day("month").alias("month_end"), F.coalesce("n", F.lit(0).cast("long")).alias("n")
    ).orderBy("month_end")


CHUNK = 100_000


def cumulative_share(df: DataFrame, measure: str = "profit_ratio") -> DataFrame:
    """Curve of the running sum, largest first, over the sum of the positive values: ``(position, rows_share, share)``.

    Rows with equal values are interchangeable, so the sums run over distinct values and each value is laid out over
    its ranks afterwards, in chunks spread over the cluster.
    """
    values = (
        df.where(all_present(measure))
        .groupBy(F.col(measure).cast("double").alias("_v"))
        .agg(F.count("*").alias("_c"))
        .withColumn("_t", F.col("_v") * F.col("_c"))
    )
    totals = values.agg(
        F.struct(F.sum("_c").alias("n"), F.sum(F.when(F.col("_v") > 0, F.col("_t"))).alias("positive"))
    ).scalar()
    ladder = running_totals(values, "_v", ["_c", "_t"], descending=True)
    before = ladder.select(
        "_v", "_c", (F.col("upto__c") - F.col("_c")).alias("_c0"), (F.col("upto__t") - F.col("_t")).alias("_t0")
    )
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / CHUNK))).alias("_chunk")
    chunks = before.select("*", chunk).repartition("_v", "_chunk")
    last = F.least((F.col("_chunk") + 1) * CHUNK, F.col("_c"))
    ranks = chunks.select("_v", "_c0", "_t0", F.explode(F.sequence(F.col("_chunk") * CHUNK + 1, last)).alias("_j"))
    position = F.col("_c0") + F.col("_j")
    return ranks.select(
        position.alias("position"),
        F.coalesce(F.try_divide((position - 1).cast("double"), totals["n"] - 1), F.lit(0).cast("double")).alias("rows_share"),
        F.try_divide(F.col("_t0") + F.col("_j") * F.col("_v"), totals["positive"]).alias("share"),
    )
