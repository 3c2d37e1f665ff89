"""Exact whitening against fractions, numpy's eigenvectors and hand-made vectors."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import whitening
from parcelwise.llm.queries import llm_queries

SMALL = "/root/testdata/sf0.001"
SHAPE = "vec_id long, embedding array<double>"


def polynomial(matrix):
    """Symmetric sums by Faddeev and LeVerrier's recursion, in fractions."""
    d = len(matrix)
    a = np.array([[Fraction(int(v)) for v in row] for row in matrix], object)
    one = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    m, out = one, [1]
    for k in range(1, d + 1):
        am = a @ m
        c = -sum(am[i, i] for i in range(d)) / k
        out.append(int((-1) ** k * c))
        m = am + c * one
    return out


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(5)
    for d, size in ((1, 10), (2, 10**6), (5, 10**9), (12, 1000)):
        x = rng.integers(-size, size, (d + 3, d)).astype(object)
        matrix = x.T @ x
        assert whitening.symmetric_sums(spark, matrix) == polynomial(matrix)


def test_modular_polynomial_with_zero_pivots():
    matrix = np.zeros((6, 6), np.int64)
    matrix[0, 5] = matrix[5, 0] = 3
    matrix[2, 4] = matrix[4, 2] = 1
    got = whitening.characteristic(matrix, 10_007)
    want = np.round(np.poly(matrix.astype(float)))[::-1].astype(np.int64) % 10_007
    assert got.tolist() == want.tolist()


def test_roots_with_repeats_and_zeros():
    # (t-7)^2 (t-5) (t-2)^3 t^2
    c = np.poly([7, 7, 5, 2, 2, 2, 0, 0])
    roots = whitening.Roots([int(round((-1) ** k * v)) for k, v in enumerate(c)])
    assert roots.positive == 6
    for k, want in enumerate([7, 7, 5, 2, 2, 2], 1):
        r, shift = roots.root(k)
        assert r == want << shift
    third = whitening.Roots([9, 6, 1])  # 9 t^2 - 6 t + 1
    r, shift = third.root(1)
    assert abs(Fraction(r, 1 << shift) - Fraction(1, 3)) < Fraction(1, 10**40)


def test_primes():
    got = whitening.primes(20)
    assert got[0] == 2**31 - 1 and all(pow(2, p - 1, p) == 1 and all(p % q for q in range(3, 2000, 2)) for p in got)


def expected(rows, count=4):
    """(n, sums, eigenvalues, vectors, trace) over the distinct integer vectors."""
    x = {tuple(math.floor(256 * float(c)) for c in v) for _, v in rows}
    x = np.array(sorted(x), object)
    n, s = len(x), x.sum(axis=0)
    centred = x.astype(float) - s.astype(float) / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    return n, s, e[::-1][:count], v[:, ::-1][:, :count], e.sum()


def check(got, rows, count=4):
    n, s, e, v, trace = expected(rows, count)
    by_id = dict(rows)
    assert len(got) == len(rows) * count
    signs = {}
    for r in got:
        x = np.array([math.floor(256 * float(c)) for c in by_id[r["vec_id"]]], object)
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s))
        want = (x.astype(float) - s.astype(float) / n) @ v[:, k] / math.sqrt(e[k])
        if abs(want) > 1e-3:
            assert signs.setdefault(k, np.sign(r["whitened"] / want)) == np.sign(r["whitened"] / want)
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-6
        assert abs(r["explained"] - e[k] / trace) < 1e-9
        assert r["identity_error"] < 1e-8


def test_query_equals_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = llm_queries()["op12_embedding_whitening"](spark, SMALL)
    assert got.columns[:6] == ["vec_id", "component", "n", "deviation", "whitened", "explained"]
    check(got.collect(), rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    good += [(100 + i, v) for i, v in good[:5]]  # repeats count once
    odd = [
        (200, None), (201, []), (202, [1.0, None, 2.0]), (203, [math.nan, 1.0, 1.0]), (204, [math.inf, 0.0, 0.0]),
        (205, [1.0]), (206, [1.0, 2.0, 3.0, 4.0]), (207, [1e300, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(good + odd, SHAPE).withColumns({c: F.lit("clash") for c in ("id", "x", "n", "component", "v")})
    check(whitening.whiten(df).withColumnRenamed("id", "vec_id").collect(), good, count=3)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame(odd[:2], SHAPE)).count() == 0


def test_flat_and_equal_directions(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, SHAPE)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 6
    # a cross: two equal eigenvalues, and a third of zero
    cross = [(1, [1.0, 0.0, 5.0]), (2, [-1.0, 0.0, 5.0]), (3, [0.0, 1.0, 5.0]), (4, [0.0, -1.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(cross, SHAPE)).collect()
    assert {r["identity_error"] < 1e-12 for r in got} == {True}
    assert [r["explained"] for r in sorted(got, key=lambda r: (r["component"], r["id"]))] == [0.5] * 8 + [0.0] * 4
    assert {r["whitened"] for r in got if r["component"] == 3} == {None}


@pytest.mark.parametrize("size", [3.0e4, 1.0e12])
def test_large_numbers_stay_exact(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, (size * rng.normal(size=2)).tolist()) for i in range(300)]
    n, s, e, v, trace = expected(rows, 2)
    got = whitening.whiten(spark.createDataFrame(rows, SHAPE), count=2).collect()
    for r in got:
        x = [math.floor(256 * c) for c in dict(rows)[r["id"]]]
        exact = sum((n * a - b) ** 2 for a, b in zip(x, s))
        assert r["deviation"] == (exact if exact < 1 << 63 else None)
        assert abs(r["explained"] - e[r["component"] - 1] / trace) < 1e-6 and r["identity_error"] < 1e-8
