"""Periodic runs against a search of every stretch, and the query against plain Python."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelwise.llm import runs
from parcelwise.llm.queries import llm_queries

SMALL = "/root/testdata/sf0.001"


def brute_force(words, exponent=4, least=6):
    """(start, end, period): for each period the stretches that equal themselves a period further on."""
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e, p) for (s, e), p in found.items())


def as_numbers(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=6))
def test_runs_of_few_letters(texts):
    got = runs.runs([np.array(t, np.int64) for t in texts])
    want = [(k, *r) for k, t in enumerate(texts) for r in brute_force(t)]
    assert [tuple(r) for r in got.tolist()] == want


def test_runs_of_long_repeats():
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        t = [rng.randrange(50) for _ in range(rng.randrange(200))]
        for _ in range(3):
            piece = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
            t += piece * rng.randrange(1, 9) + piece[: rng.randrange(len(piece))]
        texts.append(t)
    texts += [[1] * 5000, [1, 2, 3] * 1000 + [1], [], [4] * 5, [4] * 6]
    got = runs.runs([np.array(t, np.int64) for t in texts])
    assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in brute_force(t)]


def test_extensions_both_ways():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(0, 2, 500), np.tile(rng.integers(0, 2, 37), 20), rng.integers(0, 2, 300)])
    line = np.concatenate([[2], text, [3]])
    grammar = runs.Grammar(line, 2)
    a = rng.integers(1, len(text), 2000)
    b = np.minimum(a + rng.integers(1, 400, 2000), len(text) + 1)
    a, b = a[a < b], b[a < b]

    def length(x, y, step):
        n = 0
        while line[x] == line[y]:
            x, y, n = x + step, y + step, n + 1
        return n

    assert grammar.extension(a, b).tolist() == [length(x, y, 1) for x, y in zip(a, b)]
    assert grammar.extension(a, b, back=True).tolist() == [length(x - 1, y - 1, -1) for x, y in zip(a, b)]


def wanted(id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_force(words)
    digest = hashlib.sha256("".join(f"{s},{e - s},{p}\n" for s, e, p in found).encode()).hexdigest()
    gone = {i for s, e, p in found for i in range(s + p, e)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = [None] * 4
    if found:
        from fractions import Fraction

        s, e, p = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]))
        best = [s, e - s, p, 1000 * (e - s) // p]
    return (id, len(found), *best, digest, hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = llm_queries()["op11_periodic_runs"](spark, SMALL)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted(*r) for r in docs)


def test_odd_texts(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a"), (4, "a a a a a a"), (5, "a b " * 5 + "x" + " y" * 9),
        (None, "b " * 40_000), (6, " ".join(f"w{i}" for i in range(300_000))), (7, "É   É " * 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "runs", "collapsed")})
    got = {(r["id"], len(r["collapsed"])): [tuple(x) for x in r["runs"]] for r in runs.periodic_runs(docs).collect()}
    assert got[(4, 1)] == [(0, 6, 1)] and got[(None, 1)] == [(0, 40_000, 1)]
    assert got[(1, 0)] == got[(2, 0)] == got[(3, 0)] == []
    assert got[(5, len("a b x y"))] == [(0, 10, 2), (11, 9, 1)]
    assert [v for (k, _), v in got.items() if k == 6] == [[]]
    assert [v for (k, _), v in got.items() if k == 7] == [[(0, 27, 3)]]
    assert runs.periodic_runs(docs).count() == len(rows)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
