"""Writing cleaned tables and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Persist a cleaned or encoded table as Parquet, so that later jobs read only the columns they use."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_result(df: DataFrame, path: str) -> None:
    """Persist a result table as CSV with a header. Results of any size are written by the executors."""
    df.write.mode("overwrite").option("header", True).csv(path)
