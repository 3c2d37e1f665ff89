"""Many logistic regressions over parts of one table, fitted in passes that they share.

Vectors lie in blocks of rows. A pass evaluates the loss and gradient of every fit that is still running, as one matrix
product a block, and adds them over the tasks; what a fit asks for next is decided on the driver, from its own numbers
only. So the passes are as many as the slowest fit needs, whatever the number of fits.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.small import checkpointed

BLOCK_NUMBERS = 1 << 17  # entries of a block as a dense matrix; Parquet holds a hundred blocks before it looks at their size
MEMORY = 12  # steps that a fit remembers
TOLERANCE = 1e-6  # of the largest entry of the mean gradient
MAX_STEPS = 1000
FULL_WIDTH = 2_000  # entries up to which blocks are dense matrices and the curvature between all pairs of them is known
SPARSE_ROWS = 4_096  # of a block of wider vectors
DRIVER_NUMBERS = 2_000_000  # entries of all tasks' sums that the driver adds up
COLUMNS = ("at", "value", "y", "marks")  # of a block

#: From a block's marks, (rows, marks), whether each row belongs to each fit, (rows, fits).
Member = Callable[[np.ndarray], np.ndarray]


class SparseRows:
    """A matrix by its entries, with the products that the passes take."""

    def __init__(self, row: np.ndarray, place: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.place, self.value, self.shape = row, place, value, shape

    @property
    def T(self) -> SparseRows:
        return SparseRows(self.place, self.row, self.value, self.shape[::-1])

    def __mul__(self, other: SparseRows) -> SparseRows:
        """Entry by entry, with a matrix that has its entries in the same places."""
        return SparseRows(self.row, self.place, self.value * other.value, self.shape)

    def __matmul__(self, other: np.ndarray) -> np.ndarray:
        columns = [np.bincount(self.row, self.value * c[self.place], self.shape[0]) for c in other.astype(float).T]
        return np.column_stack(columns) if columns else np.zeros((self.shape[0], 0))

    def sum(self, axis: int) -> np.ndarray:
        """Of each column; ``axis`` is 0."""
        return np.bincount(self.place, self.value, self.shape[1])


class Room:
    """Arrays that a task uses again for each of its blocks: new memory for every block takes a third of a pass."""

    def __init__(self) -> None:
        self.arrays: dict[str, np.ndarray] = {}

    def array(self, name: str, rows: int, width: int) -> np.ndarray:
        """An array of this shape with any numbers in it; it holds what was there last under this name."""
        size = rows * width
        if name not in self.arrays or len(self.arrays[name]) < size:
            self.arrays[name] = np.empty(size)
        return self.arrays[name][:size].reshape(rows, width)

    def product(self, name: str, a: np.ndarray | SparseRows, b: np.ndarray) -> np.ndarray:
        return a @ b if isinstance(a, SparseRows) else np.matmul(a, b, out=self.array(name, len(a), b.shape[1]))


@dataclass
class Blocks:
    """Rows of vectors: ``table`` has for each block the places and values of its entries, labels and marks.

    ``kept`` has the same blocks as tuples of bytes, while they are :func:`held`.
    """

    table: DataFrame
    width: int
    marks: int
    kept: RDD | None = None

    @cached_property
    def pieces(self) -> int:
        """Tasks of a pass."""
        return self.table.rdd.getNumPartitions()


@contextmanager
def held(blocks: Blocks) -> Iterator[Blocks]:
    """The blocks for many passes: executors keep their bytes in memory, as far as they fit, until the context ends.

    A pass then neither scans Parquet nor makes Arrow batches; what doesn't fit is read from the table, so nothing lies on
    the disks twice. Partitions stay those of the table, and so do the sums.
    """
    kept = blocks.table.select(*COLUMNS).rdd.map(lambda row: tuple(bytes(c) for c in row)).persist(StorageLevel.MEMORY_ONLY)
    try:
        yield replace(blocks, kept=kept)
    finally:
        kept.unpersist()


def opened(batch: pa.RecordBatch, width: int, marks: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(x, y, marks)`` of the blocks of an Arrow batch."""
    for i in range(len(batch)):
        # the batch's own memory, not a copy
        yield unpacked([batch[c][i].as_buffer() for c in COLUMNS], width, marks)


def unpacked(block: Sequence, width: int, marks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(x, y, marks)`` of a block's columns as buffers."""
    at, value, y, marked = block
    at = np.frombuffer(at, np.int32 if 2 * len(at) == len(value) else np.int64)
    value, y = np.frombuffer(value), np.frombuffer(y)
    if width > FULL_WIDTH:
        x = SparseRows(at // width, at % width, value, (len(y), width))
    else:
        x = np.zeros(len(y) * width)
        x[at] = value
        x = x.reshape(len(y), width)
    return x, y, np.frombuffer(marked, np.int32).reshape(len(y), marks)


def entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, place, value)`` of the entries of unwrapped vectors, sparse or dense."""
    sizes = vectors.field("values").value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(vectors)), sizes)
    # a dense vector has no places of its own
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sparse = np.repeat(vectors.field("type").to_numpy(zero_copy_only=False) == 0, sizes)
    place[sparse] = vectors.field("indices").flatten().to_numpy()
    return row, place, vectors.field("values").flatten().to_numpy()


def feature_blocks(df: DataFrame, marks: Sequence[str], features: str = "features", y: str = "y") -> Blocks:
    """The vectors of a table, written as blocks. ``marks`` are integer columns that say which fits a row is for.

    A null mark is -1. Vectors may be sparse or dense; a table without rows has width 0.
    """
    first = df.select(features).first()
    return _blocks(df, F.unwrap_udt(features), entries, first[0].size if first else 0, marks, y)


def sparse_blocks(df: DataFrame, places: str, values: str, width: int, marks: Sequence[str] = (), y: str = "y") -> Blocks:
    """The same of vectors that are arrays of places and of values."""

    def listed(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = vectors.field("values").value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(vectors)), sizes)
        return row, vectors.field("places").flatten().to_numpy(), vectors.field("values").flatten().to_numpy()

    vector = F.struct(F.col(places).cast("array<long>").alias("places"), F.col(values).cast("array<double>").alias("values"))
    return _blocks(df, vector, listed, width, marks, y)


def _blocks(df: DataFrame, vector: Column, read: Callable, width: int, marks: Sequence[str], y: str) -> Blocks:
    marks = list(marks)
    step = SPARSE_ROWS if width > FULL_WIDTH else max(1, BLOCK_NUMBERS // max(width, 1))
    kind = np.int32 if step * width < 1 << 31 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.slice(start, step)
                row, place, value = read(part["v"])
                kept = [part[m].fill_null(-1).to_numpy() for m in marks]
                columns = [
                    (row * width + place).astype(kind),
                    value,
                    part["y"].to_numpy(),
                    np.column_stack(kept).astype(np.int32) if kept else np.zeros((len(part), 0), np.int32),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["at", "value", "y", "marks"])

    rows = df.select(vector.alias("v"), F.col(y).cast("double").alias("y"), *[F.col(m).cast("int").alias(m) for m in marks])
    return Blocks(checkpointed(rows.mapInArrow(run, "at binary, value binary, y binary, marks binary")), width, len(marks))


def added(blocks: Blocks, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all blocks of a matrix made of each.

    The driver adds up the tasks' matrices, one row from each, while they have at most ``DRIVER_NUMBERS`` entries together;
    more are added by a shuffle, with a row for each entry from every task.
    """
    width, marks, size = blocks.width, blocks.marks, shape[0] * shape[1]
    whole = blocks.pieces * size <= DRIVER_NUMBERS

    def summed(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray | None:
        total = None
        for block in parts:
            made = part(*block)
            total = made if total is None else total + made
        return None if total is None else total.astype(float).ravel()

    def run_kept(rows: Iterator[tuple]) -> Iterator[bytes]:
        sums = summed(unpacked(row, width, marks) for row in rows)
        if sums is not None:
            yield sums.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = summed(block for batch in batches for block in opened(batch, width, marks))
        if sums is not None:
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["v"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["place", "v"])

    out = np.zeros(size)
    if whole:  # a row from each task
        if blocks.kept is not None:
            sums = blocks.kept.mapPartitions(run_kept).collect()
        else:
            sums = [v for (v,) in blocks.table.mapInArrow(run, "v binary").collect()]
        for v in sums:
            out += np.frombuffer(v)
        return out.reshape(shape)
    sums = blocks.table.mapInArrow(run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v"))
    for place, v in sums.collect():  # as many rows as the matrix has entries
        out[place] = v
    return out.reshape(shape)


@dataclass
class Scale:
    """How each fit sees the vectors: entries less ``centre``, times ``factor``; both (width, fits)."""

    centre: np.ndarray
    factor: np.ndarray


def standard_scale(blocks: Blocks, member: Member, fits: int, numbers: int) -> Scale:
    """Population standardisation over each fit's own rows. The first ``numbers`` entries are centred, others only scaled.

    A constant entry becomes 0.
    """
    w = blocks.width

    def part(x: np.ndarray, y: np.ndarray, marks: np.ndarray) -> np.ndarray:
        inside = member(marks).astype(float)
        return np.vstack([x.T @ inside, (x * x).T @ inside, inside.sum(axis=0)[None]])

    sums = added(blocks, part, (2 * w + 1, fits))
    n = np.maximum(sums[-1], 1)
    mean, square = sums[:w] / n, sums[w : 2 * w] / n
    variance = square - mean**2
    varies = variance > 1e-12 * square
    factor = np.where(varies, 1 / np.sqrt(np.where(varies, variance, 1)), 0)
    centre = np.where(np.arange(w)[:, None] < numbers, mean, 0)
    return Scale(centre, factor)


@dataclass
class Fitted:
    weights: np.ndarray  # (width, fits), of unscaled entries
    intercept: np.ndarray
    n: np.ndarray  # rows of each fit
    gradient: np.ndarray  # largest entry of each mean gradient
    passes: int


@dataclass
class Curvature:
    """Mean products of entries, and their means, over all rows of the blocks: (width, width), or the squares alone."""

    products: np.ndarray
    mean: np.ndarray

    def metric(self, centre: np.ndarray, factor: np.ndarray, share: float, penalty: float) -> Callable[[np.ndarray], np.ndarray]:
        """Divides a gradient by about the curvature of a loss, as a fit's scale sees the entries; the intercept is last."""
        weight = max(share * (1 - share), 1e-3)
        if self.products.ndim == 1:
            square = factor**2 * (self.products - 2 * centre * self.mean + centre**2)
            diagonal = np.append(weight * square + penalty, weight)
            return lambda g: g / diagonal
        rest = self.products - np.outer(centre, self.mean) - np.outer(self.mean, centre) + np.outer(centre, centre)
        mean = factor * (self.mean - centre)
        whole = np.block([[rest * np.outer(factor, factor), mean[:, None]], [mean[None], np.ones((1, 1))]]) * weight
        whole[np.diag_indices(len(whole))] += np.append(np.full(len(mean), penalty), 1e-9)
        inverse = np.linalg.pinv(whole, hermitian=True)
        return lambda g: inverse @ g


def curvature(blocks: Blocks) -> Curvature:
    w = blocks.width
    if w > FULL_WIDTH:
        sums = added(blocks, lambda x, y, marks: np.vstack([(x * x).sum(axis=0), x.sum(axis=0), np.full(w, float(len(y)))]), (3, w))
        n = max(sums[2].max(initial=0), 1)
        return Curvature(sums[0] / n, sums[1] / n)
    sums = added(blocks, lambda x, y, marks: np.vstack([x.T @ x, x.sum(axis=0), np.full(w, float(len(y)))]), (w + 2, w))
    n = max(sums[w + 1].max(initial=0), 1)
    return Curvature(sums[:w] / n, sums[w] / n)


def minimised(
    x: np.ndarray, metric: Callable[[np.ndarray], np.ndarray]
) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """L-BFGS as a generator: yields points, is sent their loss and gradient, returns the best point and its gradient.

    ``metric`` stands for the inverse curvature where the remembered steps say nothing.
    """
    loss, g = yield x
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(MAX_STEPS):
        if np.abs(g).max() <= TOLERANCE:
            break
        d = -g
        used = []
        for s, y in reversed(steps):
            a = s @ d / (s @ y)
            d = d - a * y
            used.append(a)
        d = metric(d)
        for (s, y), a in zip(steps, reversed(used)):
            d = d + s * (a - y @ d / (s @ y))
        slope = g @ d
        # a step that is long enough and falls enough, by halving and doubling
        low, high, step = 0.0, np.inf, 1.0
        for _ in range(40):
            at = x + step * d
            new_loss, new_g = yield at
            if not new_loss <= loss + 1e-4 * step * slope:
                high = step
            elif new_g @ d < 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if high < np.inf else 2 * low
        if not new_loss < loss:  # nothing left to gain in doubles
            break
        if (at - x) @ (new_g - g) > 0:
            steps = [*steps, (at - x, new_g - g)][-MEMORY:]
        x, loss, g = at, new_loss, new_g
    return x, g


def logistic_fits(blocks: Blocks, member: Member, fits: int, c: float = 1.0, scale: Scale | None = None) -> Fitted:
    """L2-penalised logistic regressions, with free intercepts, over each fit's rows.

    Each minimises the mean loss of its rows plus a penalty of ``1 / (2 c n)`` on the squared weights of the scaled
    entries. One pass over all rows tells the curvature that the steps of every fit start from. A fit ends when no entry of its gradient is above ``TOLERANCE``; the others go on. A fit without rows has
    weights of 0.
    """
    w = blocks.width
    scale = scale or Scale(np.zeros((w, fits)), np.ones((w, fits)))

    def sizes(x: np.ndarray, y: np.ndarray, marks: np.ndarray) -> np.ndarray:
        inside = member(marks)
        return np.vstack([inside.sum(axis=0), (inside & (y[:, None] == 1)).sum(axis=0)]).astype(float)

    n, late = added(blocks, sizes, (2, fits))
    share = np.clip(np.divide(late, n, out=np.full(fits, 0.5), where=n > 0), 1e-6, 1 - 1e-6)
    runs, asked, best, passes = {}, {}, {}, 0
    curved = curvature(blocks)
    for k in range(fits):
        start = np.append(np.zeros(w), np.log(share[k] / (1 - share[k])))
        best[k] = (start, np.zeros(w + 1))
        if n[k]:
            metric = curved.metric(scale.centre[:, k], scale.factor[:, k], share[k], 1 / (c * n[k]))
            runs[k] = minimised(start, metric)
            asked[k] = next(runs[k])
    while asked:
        chosen = sorted(asked)
        points = np.column_stack([asked[k] for k in chosen])
        centre, factor = scale.centre[:, chosen], scale.factor[:, chosen]
        weights = factor * points[:w]
        intercept = points[w] - (centre * weights).sum(axis=0)

        def part(x, y, marks, weights=weights, intercept=intercept, chosen=chosen):
            inside = member(marks)[:, chosen]
            z = x @ weights + intercept
            small = np.exp(-np.abs(z))
            loss = np.where(inside, np.maximum(z, 0) + np.log1p(small) - y[:, None] * z, 0).sum(axis=0)
            rest = np.where(inside, np.where(z >= 0, 1, small) / (1 + small) - y[:, None], 0)
            return np.vstack([x.T @ rest, rest.sum(axis=0), loss])

        sums = added(blocks, part, (w + 2, len(chosen)))
        passes += 1
        penalty = 1 / (c * n[chosen])
        gradient = factor * (sums[:w] - centre * sums[w]) / n[chosen] + penalty * points[:w]
        gradient = np.vstack([gradient, sums[w] / n[chosen]])
        loss = sums[w + 1] / n[chosen] + penalty / 2 * (points[:w] ** 2).sum(axis=0)
        asked = {}
        for j, k in enumerate(chosen):
            try:
                asked[k] = runs[k].send((float(loss[j]), gradient[:, j]))
            except StopIteration as end:
                best[k] = end.value
    points = np.column_stack([best[k][0] for k in range(fits)])
    weights = scale.factor * points[:w]
    return Fitted(
        weights,
        points[w] - (scale.centre * weights).sum(axis=0),
        n,
        np.array([np.abs(best[k][1]).max() for k in range(fits)]),
        passes,
    )


def confusion(blocks: Blocks, fitted: Fitted, parts: dict[str, Member]) -> list[tuple]:
    """``(fit, part, n, tp, fp, fn, right)``: how each fit's predictions meet the labels of each part of the rows.

    A row is predicted late if its probability is above a half. A part without rows has none.
    """
    fits = len(fitted.n)

    def part(x: np.ndarray, y: np.ndarray, marks: np.ndarray) -> np.ndarray:
        flagged, late = x @ fitted.weights + fitted.intercept > 0, (y == 1)[:, None]
        made = []
        for member in parts.values():
            inside = member(marks)
            made += [inside, inside & late & flagged, inside & ~late & flagged, inside & late & ~flagged, inside & (late == flagged)]
        return np.vstack([m.sum(axis=0) for m in made]).astype(float)

    sums = added(blocks, part, (5 * len(parts), fits)).astype(int)
    rows = []
    for p, name in enumerate(parts):
        for k in range(fits):
            counts = [int(v) for v in sums[5 * p : 5 * p + 5, k]]
            if counts[0]:
                rows.append((k, name, *counts))
    return rows
