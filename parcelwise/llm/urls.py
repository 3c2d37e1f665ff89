"""Exact URL lists as Bloom filter cascades."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, log, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

MAX_FILTER_BYTES = 256 << 20  # of a cascade; it is broadcast
MAX_LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for a null or a text without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Every key that could fit: each end of the host with a number of labels in use, with each path start of a length in use.

    Longest keys come first; of equally long ones, that with the longer host. A host of many labels makes no more keys
    than the list has numbers of labels.
    """
    size = F.size(F.split(host, r"\."))
    ends = F.array_compact(F.array(*[F.when(size >= n, F.substring_index(host, ".", -n)) for n in labels], F.lit(None).cast("string")))
    starts = F.filter(F.array(*[F.lit(n) for n in lengths], F.lit(None).cast("int")), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda n: F.struct((-F.length(e) - n).alias("size"), n.alias("n"), F.concat(e, F.substring(path, F.lit(1), n)).alias("rule")))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(pairs), lambda p: p["rule"]))


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # 64-bit words
    size: int  # bits in use
    hashes: int

    def holds(self, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        """True where all bits of a key, given by its two hashes, are set."""
        found = np.ones(len(a), bool)
        for at in positions(a, b, level, self.hashes, self.size):
            found &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def positions(a: np.ndarray, b: np.ndarray, level: int, hashes: int, size: int) -> Iterator[np.ndarray]:
    """The bits of a key at a level; the two hashes mix anew at each level."""
    x = a ^ np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + b
    step = ((b ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    for _ in range(hashes):
        x = x + step
        y = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        yield (y ^ (y >> np.uint64(32))) % np.uint64(size)


class Cascade:
    """Exact membership for every key of a universe, in a few bits a listed key.

    Level 0 encodes the listed keys, level 1 the universe's keys that level 0 takes for listed, level 2 the listed keys
    that level 1 takes for such, and so on until none is left. The first level that a key isn't in decides.
    """

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        member, left = np.zeros(len(a), bool), np.arange(len(a))
        for k, level in enumerate(self.levels):
            passed = level.holds(a[left], b[left], k)
            member[left[~passed]] = k % 2 == 1
            left = left[passed]
        member[left] = len(self.levels) % 2 == 1
        return member


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit("second")).alias("b")]


def _unsigned(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _level(keys: DataFrame, n: int, k: int, rate: float) -> Level:
    """A filter over ``n`` keys ``(a, b)`` with about the given rate of false positives, its bits set in the tasks."""
    hashes = max(1, round(-log2(rate)))
    size = max(64, ceil(-n * log(rate) / log(2) ** 2 / 64) * 64)
    if size > 8 * MAX_FILTER_BYTES:
        raise ValueError(f"a list of {n} keys needs more than {MAX_FILTER_BYTES} bytes: split it by host, or join instead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate([*positions(_unsigned(batch["a"]), _unsigned(batch["b"]), k, hashes, size)]))
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    words = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = np.zeros(size // 64, np.int64)
    for word, value in words.collect():  # bounded by MAX_FILTER_BYTES
        bits[word] = value
    return Level(bits.view(np.uint64), size, hashes)


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of ``listed`` keys over all keys of ``universe``, both ``(key)`` with repeats allowed.

    Only hashes of keys that pass a level are kept for the next; the universe itself is read, not stored. Keys are told
    apart by 128 bits of hashes. If two of them could not be told apart the levels would not end, which raises.
    """
    keys = written(listed.where("key is not null").select(*_hashes(F.col("key"))).distinct(), "listed")
    n = keys.count()
    if not n:
        return Cascade([])
    others = universe.where("key is not null").agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, n / max(others, 1) / sqrt(2))
    levels = [_level(keys, n, 0, rate)]

    def passing(some: DataFrame, k: int) -> DataFrame:
        level = levels[k]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(level.holds(_unsigned(batch["a"]), _unsigned(batch["b"]), k)))

        return some.mapInArrow(run, "a long, b long")

    false = passing(universe.where("key is not null").select(*_hashes(F.col("key"))), 0).distinct()
    mine, theirs = keys, written(false.join(keys, ["a", "b"], "left_anti"), "false")
    while left := theirs.count():
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("two keys have the same hashes")
        levels.append(_level(theirs, left, len(levels), 0.5))
        mine, theirs = theirs, written(passing(mine, len(levels) - 1), "false")
    return Cascade(levels)


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    listed: DataFrame | None = None,
    id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, listed)`` of every row of ``pages``.

    ``rules``: ``(verdict, host, path)``, verdict ``allow`` or ``block``. A rule fits its host and all subdomains if the
    url's path starts with the rule's; the longest fitting one wins, and of a rule given with both verdicts, ``block``.
    Where none fits, the url is blocked if its host or a parent domain is in ``listed``, a table ``(key)`` of any length,
    else allowed. Each url makes the keys that could be listed, and cascades over all these keys of the whole table say
    which are: no table is joined.

    A null url or one without ``://`` has an empty host and path, fits no rule and is allowed. Repeated rows each get a
    row. An empty table gives an empty table. Other columns of ``pages`` aren't used.
    """
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, _, path in rules})
    labels = sorted({host.count(".") + 1 for _, host, _ in rules})
    listed_labels: list[int] = []
    if listed is not None:  # as many rows as listed hosts have different numbers of labels
        counts = listed.where("key is not null").select(F.size(F.split("key", r"\.")).alias("n")).distinct()
        listed_labels = sorted(r["n"] for r in counts.collect())
    some = pages.select(pages[id].alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    keys = {"rules": candidates(F.col("host"), F.col("path"), labels, lengths), "hosts": candidates(F.col("host"), F.lit(""), listed_labels, [0])}
    some = some.withColumns(keys)
    possible = some.select(F.explode("rules").alias("key"))
    by_verdict = {v: [(h + p,) for x, h, p in rules if x == v] for v in ("block", "allow")}
    found = {v: cascade(spark.createDataFrame(keys, "key string"), possible) for v, keys in by_verdict.items()}
    if listed is not None:
        found["listed"] = cascade(listed, some.select(F.explode("hosts").alias("key")))
    sent = spark.sparkContext.broadcast({k: c.levels for k, c in found.items()})

    def first(names: tuple[str, ...]):
        @F.arrow_udf("int")
        def at(a: pa.Array, b: pa.Array) -> pa.Array:
            offsets = a.offsets.to_numpy()
            member = np.zeros(len(a.values), bool)
            for name in names:
                if name in sent.value:
                    member |= Cascade(sent.value[name]).holds(_unsigned(a.values), _unsigned(b.values))
            hits = np.flatnonzero(member)
            nearest = np.searchsorted(hits, offsets[:-1])
            place = np.append(hits, len(member))[nearest]
            inside = place < offsets[1:]
            return pa.array(np.where(inside, place - offsets[:-1], -1), pa.int32())

        return at

    def hashed(keys: str) -> list[Column]:
        return [F.transform(keys, lambda x: F.xxhash64(x)), F.transform(keys, lambda x: F.xxhash64(x, F.lit("second")))]

    judged = some.withColumns(
        {
            "rule_at": first(("block", "allow"))(*hashed("rules")),
            "block_at": first(("block",))(*hashed("rules")),
            "listed_at": first(("listed",))(*hashed("hosts")),
        }
    )
    rule = F.when(F.col("rule_at") >= 0, F.get("rules", F.col("rule_at")))
    blocked = F.when(F.col("rule_at") >= 0, F.col("rule_at") == F.col("block_at")).otherwise(F.col("listed_at") >= 0)
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"), (F.col("listed_at") >= 0).alias("listed")
    )
