"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from decimal import Decimal, localcontext
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

SCALE = 256  # a unit of an entry in steps of its integer
LARGEST = 2.0**53  # integers from here on aren't taken: a double holds no finer ones
LIMB = 16  # bits of the parts that are multiplied exactly in doubles
BATCH_ROWS = 1 << 16  # whose sums of such products stay exact
ROOT_BITS = 160  # leading bits of an eigenvalue
DIGITS = 80  # decimal digits of the null space's elimination
SHAPE = "id long, component int, n long, deviation long, whitened double, explained double"


def integer_vectors(df: DataFrame, id: str, vector: str) -> DataFrame:
    """``(id, x)``: entries as integers, ``floor(256 c)``, of the rows whose vectors are whole.

    A vector is whole if it has the most frequent number of entries (of equally frequent ones the largest), all of them
    finite numbers that fit.
    """
    rows = df.select(df[id].cast("long").alias("id"), df[vector].cast("array<double>").alias("v"))
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / SCALE))
    rows = rows.where(F.coalesce(fits & (F.size("v") > 0), F.lit(False)))
    rows = rows.select("id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))
    # one row for each number of entries
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == usual["d"]) if usual else rows


def block(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def exact_products(x: np.ndarray) -> np.ndarray:
    """``x' x`` in Python's integers, for long integers below ``LARGEST``."""
    count = max(1, -(-(int(np.abs(x).max(initial=0)).bit_length() + 1) // LIMB))
    limbs = [(x >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(count - 1)] + [x >> (LIMB * (count - 1))]
    limbs = [part.astype(float) for part in limbs]
    total = np.zeros((x.shape[1],) * 2, object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def scatter(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Number and exact sums of the vectors of ``fit (x)``, and their scatter ``n sum(x x') - sum(x) sum(x)'``.

    A task adds the products of its vectors, with a 1 behind each, and sends on a row for each pair of entries. The
    driver receives a number for each pair of entries, however many vectors there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, len(batch), BATCH_ROWS):
                x = block(batch["x"].slice(at, BATCH_ROWS))
                part = exact_products(np.column_stack([x, np.ones(len(x), np.int64)]))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            high, low = zip(*[divmod(v, 1 << 60) for v in total[i, j]])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (i, j, high, low)], names=["i", "j", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "i long, j long, high long, low long")
    whole = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    rows = parts.groupBy("i", "j").agg(*whole).collect()
    if not rows:
        return 0, [], np.zeros((0, 0), object)
    d = max(r["j"] for r in rows)
    g = np.zeros((d + 1, d + 1), object)
    for r in rows:
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = (int(r["high"]) << 60) + int(r["low"])
    n, sums = g[d, d], g[d, :d]
    return n, list(sums), n * g[:d, :d] - np.outer(sums, sums)


def primes(count: int, below: int = 1 << 31) -> list[int]:
    """The largest primes below a bound."""
    small = np.ones(math.isqrt(below) + 1, bool)
    small[:2] = False
    for k in range(2, math.isqrt(len(small)) + 1):
        small[k * k :: k] = False
    found: list[int] = []
    width = 1 << 16
    while len(found) < count:
        first = below - width
        piece = np.ones(width, bool)
        for p in np.flatnonzero(small).tolist():
            piece[-first % p :: p] = False
        found += (first + np.flatnonzero(piece)[::-1]).tolist()
        below = first
    return found[:count]


def characteristic(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, the constant first, of the characteristic polynomial modulo a prime, by Hessenberg reduction."""
    h = matrix % p
    n = len(h)
    for m in range(1, n - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + below[0]
        h[[i, m]] = h[[m, i]]
        h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    of = np.zeros((n + 1, n + 1), np.int64)  # of the leading blocks
    of[0, 0] = 1
    for k in range(n):
        weight, product = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weight[i] = product * int(h[i, k]) % p
            product = product * int(h[i, i - 1]) % p if i else 0
        of[k + 1, 1:] = of[k, :-1]
        of[k + 1] = (of[k + 1] - (weight[:, None] * of[: k + 1] % p).sum(axis=0)) % p
    return of[n]


def symmetric_sums(spark, matrix: np.ndarray) -> list[int]:
    """``e_0 ... e_d`` of a positive semidefinite matrix of integers: its characteristic polynomial is the sum of
    ``(-1)^k e_k t^(d-k)``.

    Tasks take the polynomial modulo one prime each, as many as a bound of its coefficients asks for; their residues, a
    number for each prime and coefficient, are joined by the Chinese remainder theorem.
    """
    d, trace = len(matrix), int(np.trace(matrix))
    bound = max(math.comb(d, k) * trace**k // d**k for k in range(d + 1)) + 1  # by the means of the eigenvalues
    chosen = primes(bound.bit_length() // 30 + 1)  # each is over 2^30
    entries = matrix.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(entries, object)
        for batch in batches:
            for p in batch["p"].to_pylist():
                residues = characteristic((whole % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([residues.tolist()])], names=["p", "residues"])

    tasks = min(len(chosen), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(tasks).mapInArrow(run, "p long, residues array<long>")
    found = {r["p"]: r["residues"] for r in rows.collect()}
    product = math.prod(chosen)
    parts = [(p, product // p * pow(product // p, -1, p)) for p in chosen]
    return [(-1) ** k * sum(found[p][d - k] * one for p, one in parts) % product for k in range(d + 1)]


class Roots:
    """The real, non-negative roots of the polynomial with the symmetric sums ``e``, the largest first."""

    def __init__(self, e: Sequence[int]):
        self.e = list(e)
        while self.e and not self.e[-1]:  # roots at zero
            self.e.pop()
        self.positive = len(self.e) - 1

    def _scaled(self, shift: int) -> list[int]:
        """Coefficients, the highest first, of the polynomial whose roots are 2^shift times as large."""
        return [(-1) ** k * (c << (shift * k)) for k, c in enumerate(self.e)]

    def _above(self, scaled: list[int], at: int) -> int:
        """How many roots lie above a number: exactly the changes of sign after a shift, as all roots are real."""
        c = list(scaled)
        for end in range(len(c), 1, -1):
            for i in range(1, end):
                c[i] += at * c[i - 1]
        signs = [x > 0 for x in c if x]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def root(self, k: int, bits: int = ROOT_BITS) -> tuple[int, int]:
        """``(r, shift)``: the k-th largest root lies above ``(r - 1) / 2^shift`` and at ``r / 2^shift`` or below.

        Halving by counts of roots isolates it; then its sign at the middle is enough. Equal roots are halved by counts
        to the end.
        """
        shift = 0
        scaled = self._scaled(shift)
        low, high, many, few = 0, self.e[1] + 1, self.positive, 0  # roots above each end
        while high - low > 1 or high.bit_length() < bits:
            if high - low == 1:
                more = bits - high.bit_length()
                shift, low, high = shift + more, low << more, high << more
                scaled = self._scaled(shift)
            middle = (low + high) // 2
            if many - few == 1:
                value = 0
                for c in scaled:
                    value = value * middle + c
                above = few if value == 0 or (value > 0) == (few % 2 == 0) else many
            else:
                above = self._above(scaled, middle)
            if above >= k:
                low, many = middle, above
            else:
                high, few = middle, above
        return high, shift


def null_vector(matrix: np.ndarray, root: tuple[int, int], others: list[np.ndarray]) -> np.ndarray:
    """A unit vector that the matrix stretches by the root, at right angles to ``others``, by inverse iteration.

    ``matrix - root`` is eliminated once, in long decimals, with the largest pivots first.
    """
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        shifted = np.array([[Decimal(v) for v in row] for row in matrix.tolist()], object)
        value = Decimal(root[0]) / Decimal(1 << root[1])
        shifted[np.diag_indices(d)] -= value
        tiny = value.scaleb(-DIGITS // 2)
        order = np.arange(d)
        for i in range(d):
            j = i + max(range(d - i), key=lambda k: abs(shifted[i + k, i]))
            shifted[[i, j]], order[[i, j]] = shifted[[j, i]], order[[j, i]]
            if abs(shifted[i, i]) < tiny:
                shifted[i, i] = tiny
            shifted[i + 1 :, i] /= shifted[i, i]
            shifted[i + 1 :, i + 1 :] -= np.outer(shifted[i + 1 :, i], shifted[i, i + 1 :])

        def upright(v: np.ndarray) -> np.ndarray:
            for _ in range(2):
                for other in others:
                    v = v - other * (other @ v)
                v = v / (v @ v).sqrt()
            return v

        # equal roots share a null space, so each starts elsewhere in it
        chance = np.random.default_rng(len(others)).integers(1, 1 << 30, d)
        v = upright(np.array([Decimal(c) for c in chance.tolist()], object))
        for _ in range(3):
            v = v[order]
            for i in range(1, d):
                v[i] -= shifted[i, :i] @ v[:i]
            for i in range(d - 1, -1, -1):
                v[i] = (v[i] - shifted[i, i + 1 :] @ v[i + 1 :] if i + 1 < d else v[i]) / shifted[i, i]
            v = upright(v / max(abs(c) for c in v))
        return v if max(v) >= -min(v) else -v


def components(spark, matrix: np.ndarray, count: int) -> list[tuple[float, float, list[float] | None]]:
    """``(eigenvalue, share of the trace, unit vector)`` of the largest eigenvalues; at zero the vector is None."""
    trace = int(np.trace(matrix)) if len(matrix) else 0
    if not trace:
        return [(0.0, math.nan, None)] * min(count, len(matrix))
    roots = Roots(symmetric_sums(spark, matrix))
    out, vectors = [], []
    for k in range(1, min(count, len(matrix)) + 1):
        if k > roots.positive:
            out.append((0.0, 0.0, None))
            continue
        r, shift = roots.root(k)
        vectors.append(null_vector(matrix, (r, shift), vectors))
        out.append((float(r / (1 << shift)), float(r / (trace << shift)), [float(c) for c in vectors[-1]]))
    return out


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", count: int = 4) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` of each whole row and component.

    Entries become integers, ``floor(256 c)``. Mean and covariance are those of the distinct vectors, ``n`` of them,
    with divisor n. Components are the covariance's unit eigenvectors by falling eigenvalue: exact roots of the
    characteristic polynomial of the integer scatter, their null spaces in long decimals. ``deviation`` is the exact sum
    of ``(n x - sums)^2``, null where it doesn't fit a long. ``whitened`` is the centred vector along the component over
    the root of its eigenvalue. ``identity_error`` is the largest distance between an entry of the covariance of the
    whitened distinct vectors and the identity.

    Left out are rows whose vector is null, empty, of another length than most, or holds nulls or numbers that aren't
    finite or reach 2^45. Repeated rows get a row each, but count once. A null id stays null. Vectors of fewer entries
    than ``count`` have as many components as entries. A component of eigenvalue zero has null ``whitened``, and
    ``explained`` is null if all are; ``identity_error`` is of the others, null without any. An empty table, or one
    without whole rows, gives an empty table. Other columns aren't used, whatever their names.
    """
    rows = integer_vectors(df, id, vector)
    # equal vectors meet after partial aggregation, so many copies of one cost a row for each task
    fit = written(rows.select("x").distinct(), "distinct-vectors")
    n, sums, matrix = scatter(fit)
    found = components(df.sparkSession, matrix, count)
    real = [k for k, c in enumerate(found) if c[2]]
    axes = [(found[k][0], found[k][2]) for k in real]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            size = len(batch)
            centred = times_n_centred(block(batch["x"]), n, sums)
            small = centred.dtype != object and centred.shape[1] * int(np.abs(centred).max()) ** 2 < 1 << 63
            squares = (centred if small else centred.astype(object)) ** 2
            deviation = pa.array([v if v < 1 << 63 else None for v in squares.sum(axis=1).tolist()], pa.int64())
            white = projected(centred, axes)
            for k, (_, share, _) in enumerate(found):
                columns = [
                    batch["id"],
                    pa.array(np.full(size, k + 1, np.int32)),
                    pa.array(np.full(size, n, np.int64)),
                    deviation,
                    pa.array(white[:, real.index(k)]) if k in real else pa.nulls(size, pa.float64()),
                    pa.nulls(size, pa.float64()) if math.isnan(share) else pa.array(np.full(size, share)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SHAPE.split(", ")])

    error = identity_error(fit, n, sums, axes) if axes else None
    return rows.mapInArrow(run, SHAPE).withColumn("identity_error", F.lit(error).cast("double"))


def times_n_centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - sums``, exactly: long integers where they are enough, Python's elsewhere."""
    most = n * int(np.abs(x).max()) + max(abs(s) for s in sums)
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def projected(centred: np.ndarray, axes: list[tuple[float, list[float]]]) -> np.ndarray:
    """``n`` times centred vectors along each axis, over the root of its eigenvalue of the scatter, n^2 times that of
    the covariance."""
    if not axes:
        return np.zeros((len(centred), 0))
    return centred.astype(float) @ np.array([[c / math.sqrt(e) for c in v] for e, v in axes]).T


def identity_error(fit: DataFrame, n: int, sums: list[int], axes: list[tuple[float, list[float]]]) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                white = projected(times_n_centred(block(batch["x"]), n, sums), axes)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in white.T], names=names)

    names = [f"w{k}" for k in range(len(axes))]
    white = fit.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    pairs = list(combinations_with_replacement(names, 2))
    values = white.agg(*[F.covar_pop(a, b) for a, b in pairs]).first()  # centred before multiplying
    return max(abs(v - (a == b)) for v, (a, b) in zip(values, pairs))
