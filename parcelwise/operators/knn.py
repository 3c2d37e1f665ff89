"""Exact k nearest neighbours by trees of bounding boxes.

Training rows are dealt into groups of bounded size by a tree whose splits come from a sample; every row is in a group,
whatever the sample. A task holds a group as a tree of its own, whose leaves have bounding boxes, and searches it for the
queries that visit it: nearest boxes first, and only boxes that come closer than the k-th neighbour so far. A query first
visits the group that it falls into, which bounds how far its neighbours can be, and then the groups whose boxes come at
least that close.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelwise.functions.small import checkpointed, checkpointed_at, discard, localized

GROUP_ROWS = 50_000  # of a group, about; a task holds one
MAX_GROUPS = 4_000  # of the tree that deals rows out; larger tables have larger groups, which are cut by hash
LEAF_ROWS = 256
TURN_ROWS = 8_192  # queries that a task searches a group for, where groups are few; each turn builds its tree anew
MOST_TURN_ROWS = 65_536  # the same where there are groups enough for all cores
TASKS = 16  # of a search for each core, up to which groups are searched in more turns
BLOCK_QUERIES = 64  # that go through a tree together
FOUND = 16  # times k: points a query may have found before the farther ones go
SPLIT_ROWS = 512  # looked at to find a split
SAMPLE_NUMBERS = 4_000_000  # entries of the sample that the driver holds
CANDIDATES = "q string, id string, d double, label double"


@dataclass
class Splits:
    """A binary tree: node i sends a row left if ``x[feature] <= threshold``. A feature of -1 is a leaf, numbered by ``left``."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The number of the leaf of each row."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            i, rows = stack.pop()
            if self.feature[i] < 0:
                out[rows] = self.left[i]
            elif len(rows):
                low = x[rows, self.feature[i]] <= self.threshold[i]
                stack += [(self.left[i], rows[low]), (self.right[i], rows[~low])]
        return out


def best_split(x: np.ndarray) -> tuple[int, float] | None:
    """Feature and threshold that part the rows with the most variance between both sides; None if all rows are equal.

    A dummy's two values part best, a continuous feature near its median.
    """
    n = len(x)
    if n < 2:
        return None
    ordered = np.sort(x, axis=0)
    many = np.arange(1, n)[:, None]
    before = ordered.cumsum(axis=0)
    total = before[-1]
    gap = before[:-1] / many - (total - before[:-1]) / (n - many)
    score = np.where(ordered[:-1] < ordered[1:], many * (n - many) * gap * gap, -1.0)
    at, feature = np.unravel_index(score.argmax(), score.shape)
    if score[at, feature] <= 0:
        return None
    low, high = ordered[at, feature], ordered[at + 1, feature]
    middle = low + (high - low) / 2
    return int(feature), float(middle if low <= middle < high else low)


def grown(x: np.ndarray, leaf_rows: int) -> tuple[Splits, list[np.ndarray]]:
    """A tree over the rows, split until a leaf has at most ``leaf_rows`` or only equal rows, and the rows of its leaves."""
    nodes: list[list] = [[-1, 0.0, 0, 0]]
    leaves: list[np.ndarray] = []
    stack = [(0, np.arange(len(x)))]
    while stack:
        i, rows = stack.pop()
        few = rows[:: -(-len(rows) // SPLIT_ROWS)] if len(rows) else rows
        split = best_split(x[few]) or best_split(x[rows]) if len(rows) > leaf_rows else None
        if split is None:
            nodes[i][2] = len(leaves)
            leaves.append(rows)
            continue
        feature, threshold = split
        low = x[rows, feature] <= threshold
        nodes[i] = [feature, threshold, len(nodes), len(nodes) + 1]
        stack += [(len(nodes), rows[low]), (len(nodes) + 1, rows[~low])]
        nodes += [[-1, 0.0, 0, 0], [-1, 0.0, 0, 0]]
    feature, threshold, left, right = zip(*nodes)
    return Splits(np.array(feature), np.array(threshold), np.array(left), np.array(right)), leaves


class BoxTree:
    """Points in leaves with bounding boxes."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.splits, leaves = grown(points, leaf_rows)
        self.order = np.concatenate(leaves)
        self.bounds = np.cumsum([0, *map(len, leaves)])
        self.points = points[self.order]
        self.norms = (self.points**2).sum(axis=1)
        self.low = np.stack([points[rows].min(axis=0) for rows in leaves])
        self.high = np.stack([points[rows].max(axis=0) for rows in leaves])
        self.compared = 0  # pairs of a query and a point whose distance was computed

    def nearest(self, queries: np.ndarray, rank: np.ndarray, k: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, point, d)`` of each query's k nearest points, by query, squared distance and ``rank`` of the point.

        Distances are rounded to nine digits, so that equal ones are ties. A query with a ``reach`` needs no points that
        are farther away, and may be given less than k.
        """
        reach = np.full(len(queries), np.inf) if reach is None else reach
        parts = []
        order = np.argsort(self.splits.leaf(queries), kind="stable")
        for start in range(0, len(order), BLOCK_QUERIES):
            rows = order[start : start + BLOCK_QUERIES]
            found = self._block(queries[rows], rank, k, reach[rows])
            parts.append((rows[found[0]], *found[1:]))
        query, point, d = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, int),) * 3
        by = np.lexsort((rank[point], d, query))
        return query[by], point[by], d[by]

    def _gaps(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each query from each leaf's box."""
        out = np.empty((len(q), len(self.low)))
        under, over = np.empty_like(self.low), np.empty_like(self.low)
        for i, x in enumerate(q):
            np.subtract(self.low, x, out=under)
            np.subtract(x, self.high, out=over)
            np.maximum(under, over, out=under)
            np.maximum(under, 0.0, out=under)
            np.einsum("ij,ij->i", under, under, out=out[i])
        return out

    def _block(self, q: np.ndarray, rank: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = (q**2).sum(axis=1)
        slack = 1e-9 * (1.0 + self.norms.max() + lengths.max())
        near = self._gaps(q)
        least = np.full((len(q), k), np.inf)  # distances of the k nearest so far
        farthest = reach.copy()  # the k-th of them, or the reach
        found: list[tuple[np.ndarray, ...]] = []
        many = 0

        def best() -> tuple[np.ndarray, ...]:
            query, point, d = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            kept = np.flatnonzero(d <= farthest[query])
            kept = kept[np.lexsort((rank[point[kept]], d[kept], query[kept]))]
            query = query[kept]
            first = np.arange(len(query)) - np.searchsorted(query, query) < k
            return query[first], point[kept[first]], d[kept[first]]

        nearest = near.min(axis=0)
        for leaf in np.argsort(nearest, kind="stable"):
            if nearest[leaf] > farthest.max() + slack:
                break  # as are all leaves that follow
            active = np.flatnonzero(near[:, leaf] <= farthest + slack)
            if not len(active):
                continue
            a, b = self.bounds[leaf], self.bounds[leaf + 1]
            self.compared += len(active) * (b - a)
            rough = lengths[active, None] + self.norms[None, a:b] - 2.0 * q[active] @ self.points[a:b].T
            kth = np.partition(np.hstack([least[active], rough]), k - 1, axis=1)[:, k - 1]
            i, j = np.nonzero(rough <= np.minimum(farthest[active], kth)[:, None] + slack)
            if not len(i):
                continue
            d = np.round(((self.points[a + j] - q[active[i]]) ** 2).sum(axis=1), 9)
            found.append((active[i], self.order[a + j], d))
            many += len(d)
            rough.fill(np.inf)
            rough[i, j] = d
            least[active] = np.partition(np.hstack([least[active], rough]), k - 1, axis=1)[:, :k]
            farthest[active] = np.minimum(farthest[active], least[active].max(axis=1))
            if many > FOUND * k * len(q):
                found = [best()]
                many = len(found[0][0])
        return best()


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def limits(column) -> np.ndarray:
    """Squared distances; null is no limit."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null(np.inf).to_numpy(zero_copy_only=False)


def dealt(df: DataFrame, splits: Splits, keep: str) -> DataFrame:
    """The rows with ``leaf``, the leaf that each falls into; ``keep`` is the schema of the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.append_column("leaf", pa.array(splits.leaf(matrix(batch["x"]))))

    return df.mapInArrow(run, f"{keep}, leaf long")


def turn_rows(queries: int, spare: int) -> int:
    """Queries of a turn, so that the turns beyond the first of each group are about ``spare``, within both bounds."""
    return max(TURN_ROWS, min(MOST_TURN_ROWS, -(-queries // max(spare, 1))))


def _search(queries: DataFrame, points: DataFrame, k: int, leaf_rows: int) -> DataFrame:
    """The k best candidates of queries ``(q, x, part, reach)`` among points ``(id, x, label, part)`` of the same part.

    None is given that is farther away than a query's ``reach``, which may be null.
    """
    # a group's points go to each of its turns: no more turns than the queries' size or idle cores ask for
    sizes = queries.groupBy("part").agg(F.count("*").alias("n"))
    sizes = localized(sizes)
    rows, parts = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    turn = turn_rows(rows, TASKS * queries.sparkSession.sparkContext.defaultParallelism - parts)
    asking = sizes.select("part", F.ceil(F.col("n") / turn).cast("int").alias("turns"))
    q = queries.join(asking, "part").withColumn("turn", F.pmod(F.xxhash64("q"), F.col("turns")).cast("int"))
    p = points.join(asking, "part").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            none = np.zeros(0)
            return pa.table({"q": pa.array([], pa.string()), "id": pa.array([], pa.string()), "d": none, "label": none})
        held = held.sort_by("id")
        tree = BoxTree(matrix(held["x"]), leaf_rows)
        query, point, d = tree.nearest(matrix(asked["x"]), np.arange(len(held)), k, limits(asked["reach"]))
        return pa.table({"q": asked["q"].take(query), "id": held["id"].take(point), "d": d, "label": held["label"].take(point)})

    # fresh columns: queries may come from the points themselves
    left = q.select(*[F.col(c).alias(c) for c in ("part", "turn", "q", "x", "reach")]).groupBy("part", "turn")
    right = p.select("part", "turn", "id", "x", "label").groupBy("part", "turn")
    return left.cogroup(right).applyInArrow(compare, CANDIDATES)


def _best(candidates: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("q").orderBy("d", "id"))
    return candidates.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def boxes(points: DataFrame) -> DataFrame:
    """Bounding box of each part: ``(part, low, high)``. A task merges its rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            part, low, high = batch["part"].to_numpy(), matrix(batch["low"]), matrix(batch["high"])
            for p in np.unique(part):
                own = part == p
                ends = low[own].min(axis=0), high[own].max(axis=0)
                if p in found:
                    ends = np.minimum(ends[0], found[p][0]), np.maximum(ends[1], found[p][1])
                found[p] = ends
        if found:
            columns = [pa.array([e[side].tolist() for e in found.values()], pa.list_(pa.float64())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int64()), *columns], names=["part", "low", "high"])

    shape = "part long, low array<double>, high array<double>"
    ends = points.select("part", F.col("x").alias("low"), F.col("x").alias("high"))
    return ends.mapInArrow(run, shape).repartition("part").mapInArrow(run, shape)


def neighbours(
    points: DataFrame,
    queries: DataFrame,
    k: int = 15,
    block_rows: int = GROUP_ROWS,
    max_cells: int = MAX_GROUPS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The k nearest points of every query: ``(q, id, d, label)``, d squared, equal distances in id order.

    ``points`` is ``(id, x array<double>, label)``, ``queries`` is ``(q, x)``; other columns aren't used. Groups have
    about ``block_rows`` rows; the tree that deals them out has at most ``max_cells`` leaves. Neither these numbers nor
    the sample change the result. Fewer than k points give all of them. Ids must be unique.
    """
    points, path = checkpointed_at(points.select("id", "x", F.col("label").cast("double").alias("label")))
    queries = checkpointed(queries.select("q", "x"))
    rows = points.count()
    groups = max(1, min(max_cells, -(-rows // block_rows)))
    width = len(points.select("x").first()["x"]) if rows else 0
    size = min(rows, 16 * groups, max(groups, SAMPLE_NUMBERS // max(width, 1))) if groups > 1 else 0
    # the rows with the least hashes: a bounded sample, the same one in every run
    sample = [r["x"] for r in points.select("x", F.xxhash64("id").alias("h")).orderBy("h").limit(size).collect()] if size else []
    splits, _ = grown(np.array(sample, dtype=float).reshape(len(sample), width), max(1, size // groups))
    placed = dealt(points, splits, "id string, x array<double>, label double")
    if groups > 1:
        placed = checkpointed(placed)
        discard(points.sparkSession, path)  # every point has its group now
    # a leaf that holds more rows than a group, as of many equal points, is cut by hash; a part is a piece of a leaf
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * block_rows)).alias("pieces"))
    sizes = localized(sizes)
    piece = F.pmod(F.xxhash64("id"), F.col("pieces"))
    parts = placed.join(sizes, "leaf").select("id", "x", "label", (F.col("leaf") + piece * F.lit(1 << 32)).alias("part"))
    asked = dealt(queries, splits, "q string, x array<double>").select("q", "x", F.col("leaf").alias("part"))
    home = checkpointed(_best(_search(asked.withColumn("reach", F.lit(None).cast("double")), parts, k, leaf_rows), k))
    if groups == 1 and rows <= 2 * block_rows:
        return home
    reach = home.groupBy("q").agg(F.when(F.count("*") == k, F.max("d")).alias("reach"))
    # a box for each part: at most as many as the tree has leaves, and the pieces of crowded ones
    found = boxes(parts).orderBy("part").collect()
    name = np.array([r["part"] for r in found])
    low, high = np.array([r["low"] for r in found]), np.array([r["high"] for r in found])
    shared = points.sparkSession.sparkContext.broadcast((name, low, high))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, low, high = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x, own = matrix(batch["x"]), batch["part"].to_numpy()
            limit = limits(batch["reach"])
            limit = limit + 1e-9 * (1.0 + np.where(np.isfinite(limit), limit, 0.0))
            for j in range(len(name)):
                gap = np.maximum(np.maximum(low[j] - x, x - high[j]), 0.0)
                near = ((gap * gap).sum(axis=1) <= limit) & (own != name[j])
                if near.any():
                    some = batch.filter(pa.array(near))
                    columns = [some["q"], some["x"], some["reach"], pa.array(np.full(near.sum(), name[j]))]
                    yield pa.RecordBatch.from_arrays(columns, names=["q", "x", "reach", "part"])

    going = asked.join(reach, "q", "left").mapInArrow(visits, "q string, x array<double>, reach double, part long")
    return _best(home.unionByName(_search(checkpointed(going), parts, k, leaf_rows)), k)


def knn_scores(
    train: DataFrame,
    test: DataFrame,
    key: str,
    k: int = 15,
    carry: Sequence[str] = (),
    features: str = "features",
    name: str = "KNN",
    block_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Share of positives among the k nearest training rows: ``(key, carry..., model, y, p)``."""
    x = vector_to_array(F.col(features))
    points = train.select(F.col(key).cast("string").alias("id"), x.alias("x"), F.col("y").alias("label"))
    queries = test.select(F.col(key).cast("string").alias("q"), x.alias("x"))
    near = neighbours(points, queries, k, block_rows)
    votes = near.groupBy("q").agg(F.avg("label").alias("p"))
    facts = test.select(key, *carry, F.col("y").cast("int").alias("y"), F.col(key).cast("string").alias("q"))
    return facts.join(votes, "q").select(key, *carry, F.lit(name).alias("model"), "y", "p")
