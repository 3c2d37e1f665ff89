"""Joining large data with tables of statistics whose size is checked first."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 20_000


def fetch_small(df: DataFrame, limit: int = SMALL_ROWS) -> list | None:
    """Rows of a table of at most ``limit`` rows, or None if it is larger. Never fetches more than limit + 1."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def localized(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """The same table, computed once and marked for broadcast if it proves to be small, unchanged otherwise."""
    rows = fetch_small(df, limit)
    return df if rows is None else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema).coalesce(1))


def attach_small(df: DataFrame, small: DataFrame, keys: Sequence[str], limit: int = SMALL_ROWS) -> DataFrame:
    """Inner join on keys: broadcast when ``small`` proves to be small, a shuffle join otherwise.

    The small table is computed once, here, so its own scan is not repeated inside the join. Without keys it must be
    the one row of a global aggregate.
    """
    small = localized(small, limit)
    return df.join(small, list(keys)) if keys else df.join(small, F.lit(True))


def scratch_folder(spark: SparkSession) -> str:
    """Where this application keeps intermediate tables: below ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, below the warehouse, which they share as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The table as Parquet in the application's scratch folder, read back.

    The lineage is cut, later reads take only the columns they use, and lost executors cost nothing.
    """
    return checkpointed_at(df)[0]


def checkpointed_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The table of :func:`checkpointed` and where it lies."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid4().hex}"
    # Parquet takes fewer characters in a name than a frame does
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`checkpointed_at` that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def sweep(spark: SparkSession) -> None:
    """Have the driver look for shuffles and cached tables that nothing refers to any more; their files go.

    Spark deletes them when the driver's memory is collected, which may be half an hour away.
    """
    spark.sparkContext._jvm.java.lang.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Delete the application's intermediate tables. Results that were not written yet can't be computed any more."""
    discard(spark, scratch_folder(spark))
