"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder in the warehouse, which is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table written as Parquet to the shared folder and read back, and where it lies.

    Cuts the lineage: a lost executor costs the rows of its running tasks only, and random or row-numbering expressions
    keep the values they had when the table was written. An empty table stays a table with the same columns.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """The table of :func:`written_at`."""
    return written_at(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of :func:`written_at` that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
