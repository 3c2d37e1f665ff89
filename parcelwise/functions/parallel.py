"""Running independent Spark jobs side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

PARALLEL_FITS = 8


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], object]], at_once: int = PARALLEL_FITS) -> list:
    """Results of the tasks, in order. Each one submits its own jobs, so a cluster stays busy between their rounds."""
    if len(tasks) < 2:
        return [task() for task in tasks]
    pool = ThreadPool(min(at_once, len(tasks)))
    try:
        return pool.map(lambda task: task(), [inheritable_thread_target(spark)(task) for task in tasks])
    finally:
        pool.close()
