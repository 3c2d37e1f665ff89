"""Sums of products of columns with gaps, over all rows at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_NUMBERS = 1 << 18  # values that are multiplied at once
SUMS = ("n", "sum_a", "sum_b", "sum_aa", "sum_bb", "sum_ab")


def masked_gramian(df: DataFrame, columns: Sequence[str], origin: Sequence[float]) -> DataFrame:
    """Sums over the rows where both of two columns are present: a row ``(a, b, n, sum_a, ... sum_ab)`` for each pair.

    ``a`` and ``b`` are positions, a <= b. Values are measured from ``origin``. With X the values, 0 where one is
    missing, and M the marks of those present, the products M'M, X'M, (X^2)'M and X'X hold the sums of all pairs; a task
    adds them up block by block and sends on a row for each pair. Null and not-a-number are missing. An empty table
    gives no rows.
    """
    columns, origin = list(columns), np.array(origin, dtype=float)
    size = len(columns)
    a, b = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares, products = (np.zeros((size, size)) for _ in range(4))
        rows, step = 0, max(1, BLOCK_NUMBERS // max(size, 1))
        for batch in batches:
            rows += len(batch)
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                x = np.column_stack([part[k].to_numpy(zero_copy_only=False) for k in range(size)]).astype(float) - origin
                present = ~np.isnan(x)
                x = np.where(present, x, 0.0)
                present = present.astype(float)
                n += present.T @ present
                sums += x.T @ present
                squares += (x * x).T @ present
                products += x.T @ x
        if rows:
            values = (n[a, b], sums[a, b], sums[b, a], squares[a, b], squares[b, a], products[a, b])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *map(pa.array, values)], names=["a", "b", *SUMS])

    numbers = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    parts = numbers.mapInArrow(run, "a long, b long, " + ", ".join(f"{s} double" for s in SUMS))
    return parts.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])
