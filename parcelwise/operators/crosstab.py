"""Two-way tables: means, counts and shares, long or wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelwise.functions.columns import all_present
from parcelwise.functions.small import checkpointed


def mean_by_pair(df: DataFrame, row: str, column: str, measure: str = "late_risk") -> DataFrame:
    """Mean per pair of keys that occurs; empty pairs stay out (null in the wide form)."""
    return (
        df.where(all_present(row, column))
        .groupBy(row, column)
        .agg(F.count("*").alias("n"), F.avg(measure).alias("rate"))
        .orderBy(row, column)
    )


def mean_wide(
    df: DataFrame, row: str, column: str, measure: str = "late_risk", values: Sequence | None = None
) -> DataFrame:
    """The same means with one column per value of ``column``. Passing the values saves the pass that finds them."""
    present = df.where(all_present(row, column))
    # the pivot runs over the small long table, not over the rows; without values it reads that table twice
    long = present.groupBy(row, column).agg(F.avg(measure).alias("rate"))
    long = long if values else checkpointed(long)
    return long.groupBy(row).pivot(column, list(values) if values else None).agg(F.first("rate")).orderBy(row)


def filled(counts: DataFrame, row: str, column: str, n: str, levels: Column) -> DataFrame:
    """Complete a count table: each row key gets every level of ``column``, 0 where there were no rows.

    Works on each row key's own map of counts, so nothing is crossed with anything.
    """
    maps = counts.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(column, n))).alias("_m"))
    exploded = maps.select(row, "_m", F.explode(levels).alias(column))
    return exploded.select(row, column, F.coalesce(F.col("_m")[F.col(column)], F.lit(0).cast("long")).alias(n))


def dense_counts(df: DataFrame, row: str, column: str) -> DataFrame:
    """Rows per pair of keys, over every pair of a row key and a column key that occur at all."""
    counts = df.where(all_present(row, column)).groupBy(row, column).agg(F.count("*").alias("n"))
    levels = counts.agg(F.array_sort(F.collect_set(column))).scalar()
    return filled(counts, row, column, "n", levels).orderBy(row, column)


def with_row_share(counts: DataFrame, row: str, column: str, n: str = "n") -> DataFrame:
    """Add each count's share of its row; rows sum to 1."""
    # one row per pair of keys: the window holds the levels of one row key, not its rows
    share = F.col(n) / F.sum(n).over(W.partitionBy(row))
    return counts.select(row, column, n, share.alias("share")).orderBy(row, column)


def row_shares(df: DataFrame, row: str, column: str) -> DataFrame:
    return with_row_share(dense_counts(df, row, column), row, column)


def counts_in_top(df: DataFrame, row: str, column: str, k: int) -> DataFrame:
    """Counts of row key by the k most frequent column keys, dense; equal counts in key order.

    The top keys come from the count table itself, so the rows are read once.
    """
    counts = df.where(all_present(column)).groupBy(row, column).agg(F.count("*").alias("n"))
    top = counts.groupBy(column).agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), column).limit(k)
    levels = top.agg(F.array_sort(F.collect_list(column))).scalar()
    inside = counts.where(F.col(row).isNotNull() & F.array_contains(levels, F.col(column)))
    return filled(inside, row, column, "n", levels).orderBy(row, column)


def transition_matrix(df: DataFrame, state: str = "days_scheduled", next_state: str = "days_real") -> DataFrame:
    """P(next state | state) over rows where both day counts are valid."""
    valid = df.where((F.col(state) >= 0) & (F.col(next_state) >= 0))
    return row_shares(valid, state, next_state)
