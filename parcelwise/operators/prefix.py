"""Running sums over a global order, without sending all rows through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelwise.functions.small import attach_small

ROWS_PER_BUCKET = 50_000
MAX_BUCKETS = 10_000
FEWEST = 8


def running_totals(
    df: DataFrame,
    order: str,
    totals: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``upto_<t>``: the sum of ``t`` over all rows of the same ``by`` key up to and including this one.

    ``order`` is a numeric column, unique per ``by`` key (collapse ties first). The rows of each key are cut into
    buckets at quantiles of their own ``order``; each bucket is summed inside by its own task and starts from the sum of
    the buckets before it, which is a table of at most ``buckets`` rows per key. Their number follows from the number of
    rows; it decides how the work is dealt, never the result.
    """
    by = list(by)
    df = df.withColumn(order, F.col(order).cast("double"))
    if buckets is None:
        buckets = min(MAX_BUCKETS, max(FEWEST, -(-df.count() // ROWS_PER_BUCKET)))
    steps = [i / buckets for i in range(1, buckets)]
    cut = df.groupBy(*by).agg(F.percentile_approx(order, steps, F.lit(max(1000, 4 * buckets))).alias("_cuts"))
    pieces = attach_small(df, cut, by)
    # the place a value takes among the sorted cuts
    bucket = F.array_position(F.sort_array(F.array_append("_cuts", F.col(order))), F.col(order))
    pieces = pieces.withColumn("_bucket", -bucket if descending else bucket).drop("_cuts")

    per_bucket = pieces.groupBy(*by, "_bucket").agg(*[F.sum(t).alias(f"_sum_{t}") for t in totals])
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = per_bucket.select(*by, "_bucket", *[F.sum(f"_sum_{t}").over(earlier).alias(f"_start_{t}") for t in totals])

    # the window below needs this very partitioning, so the join adds no shuffle of the rows
    joined = pieces.join(starts, [*by, "_bucket"])
    direction = F.desc(order) if descending else F.asc(order)
    inside = W.partitionBy(*by, "_bucket").orderBy(direction).rowsBetween(W.unboundedPreceding, 0)
    sums = {f"upto_{t}": F.sum(t).over(inside) + F.coalesce(F.col(f"_start_{t}"), F.lit(0)) for t in totals}
    return joined.withColumns(sums).drop("_bucket", *[f"_start_{t}" for t in totals])
