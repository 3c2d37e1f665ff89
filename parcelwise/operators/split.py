"""Exact, replayable splits, folds and subsamples.

The order of a hash of the row key stands in for a random order. Where a share of the rows ends in that order is found
by counting hash prefixes, so nothing is sorted but the last few rows around a cut; after that a row's part is decided
by its own hash, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelwise.functions.columns import all_present, hash_text
from parcelwise.functions.small import checkpointed, fetch_small

LEAF_ROWS = 100_000
PREFIX_STEP = 3  # hex digits that a pass adds, where there are few enough parts
FETCHED_ROWS = 400_000  # counts that one pass sends to the driver, at most
MAX_STRATA = 1_000  # strata of one table, however many rows each has


class TooManyStrata(ValueError):
    """More strata than a plan has branches for."""


class Cut(NamedTuple):
    """Where a share of the rows ends: the hash and key of its last row; no hash for an empty share."""

    digest: str | None
    key: str | None


def hash_cuts(
    df: DataFrame,
    key: str,
    ranks: Callable[[int], Sequence[int]],
    stratum: str | None = None,
    seed: int = 42,
    leaf_rows: int = LEAF_ROWS,
    max_strata: int = MAX_STRATA,
) -> dict[object, list[Cut]]:
    """For each stratum of size n, the rows at ``ranks(n)`` (counted from 1) in hash order.

    Keys must be unique and present. Every pass is an aggregation or touches at most ``leaf_rows`` rows per cut. More
    than ``max_strata`` strata are an error, at any number of rows: a plan has a branch for each (see :func:`cut_table`).
    """
    rows = df.where(all_present(key, *([stratum] if stratum else []))).select(
        (F.col(stratum) if stratum else F.lit(None).cast("string")).alias("_s"),
        F.col(key).cast("string").alias("_k"),
        hash_text(key, seed).alias("_h"),
    )
    sized = rows.groupBy("_s").agg(F.count("*").alias("n"))
    found = fetch_small(sized.withColumn("t", F.col("_s").cast("string")), max_strata)
    if found is None:
        raise TooManyStrata(f"more than {max_strata} strata")
    sizes = {r["_s"]: r["n"] for r in found}

    def in_parts(parts, depth: int) -> Column:
        """Rows of some (stratum, prefix of this depth) parts."""
        name = F.concat_ws("|", F.substring("_h", 1, depth), F.coalesce(F.col("_s").cast("string"), F.lit("")))
        return name.isin([f"{p}|{'' if s is None else labels[s]}" for s, p in parts])

    def counts(part_rows: DataFrame, depth: int) -> dict:
        """Rows per hash prefix of this depth, in order, by stratum."""
        prefix = F.substring("_h", 1, depth).alias("p")
        by_part: dict = {}
        for r in sorted(part_rows.groupBy("_s", prefix).agg(F.count("*").alias("n")).collect(), key=lambda r: r["p"]):
            by_part.setdefault(r["_s"], []).append((r["p"], r["n"]))
        return by_part

    def narrowed(by_part: dict, asked: dict) -> dict:
        """For every prefix that holds an asked rank: its rows and the (answer position, rank under it) pairs."""
        out: dict = {}
        for (s, start), wanted in asked.items():
            passed, pending = 0, sorted(wanted, key=lambda w: w[1])
            for prefix, n in by_part.get(s, []):
                if not prefix.startswith(start):
                    continue
                while pending and pending[0][1] <= passed + n:
                    i, rank = pending.pop(0)
                    out.setdefault((s, prefix), (n, []))[1].append((i, rank - passed))
                passed += n
        return out

    labels = {r["_s"]: r["t"] for r in found}  # the text by which a filter knows a stratum
    cuts: dict = {s: [Cut(None, None)] * len(ranks(n)) for s, n in sizes.items()}
    asked = {(s, ""): [(i, rank) for i, rank in enumerate(ranks(n)) if rank > 0] for s, n in sizes.items()}
    open_parts = {part: (sizes[part[0]], wanted) for part, wanted in asked.items() if wanted}
    depth = 0
    while any(n > leaf_rows for n, _ in open_parts.values()):
        step = max(s for s in range(1, PREFIX_STEP + 1) if s == 1 or len(open_parts) * 16**s <= FETCHED_ROWS)
        by_part = counts(rows.where(in_parts(open_parts, depth)) if depth else rows, depth + step)
        open_parts = narrowed(by_part, {part: wanted for part, (_, wanted) in open_parts.items()})
        depth += step

    if open_parts:
        position = F.row_number().over(W.partitionBy("_s", "_p").orderBy("_h", "_k"))
        ranked = rows.where(in_parts(open_parts, depth)).withColumn("_p", F.substring("_h", 1, depth)).withColumn("_rank", position)
        wanted_ranks = sorted({rank for _, wanted in open_parts.values() for _, rank in wanted})
        # at most one row for each part and asked rank
        answers = {
            (r["_s"], r["_p"], r["_rank"]): Cut(r["_h"], r["_k"]) for r in ranked.where(F.col("_rank").isin(wanted_ranks)).collect()
        }
        for (s, p), (_, wanted) in open_parts.items():
            for i, rank in wanted:
                cuts[s][i] = answers[(s, p, rank)]
    return cuts


def within_cut(key: str, cut: Cut, seed: int = 42) -> Column:
    """True for the rows up to and including the cut."""
    if cut.digest is None:
        return F.lit(False)
    h = hash_text(key, seed)
    return (h < cut.digest) | ((h == cut.digest) & (F.col(key).cast("string") <= cut.key))


def _per_stratum(stratum: str, cuts: dict, value: Callable[[list[Cut]], Column], default) -> Column:
    branches = F
    for s, c in cuts.items():
        branches = branches.when(F.col(stratum) == s, value(c))
    return branches.otherwise(default) if cuts else F.lit(default)


Ranks = Callable[[object, Callable], list]  # from a stratum's size and a function that rounds down


def cut_table(df: DataFrame, key: str, ranks: Ranks, stratum: str, seed: int = 42, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(_s, cuts)``: the cuts of :func:`hash_cuts` as a table, a row for each stratum, however many there are.

    ``cuts`` is an array of ``(cut, digest, key)``, without those of empty shares. Ranks are narrowed down by counts of
    hash prefixes, at most 4,096 of a stratum's part at a time, until no part has more than ``leaf_rows`` rows.
    """
    rows = df.where(all_present(key, stratum)).select(
        F.col(stratum).alias("_s"), F.col(key).cast("string").alias("_k"), hash_text(key, seed).alias("_h")
    )
    rows = checkpointed(rows)
    n = F.col("_n")
    asked = rows.groupBy("_s").agg(F.count("*").alias("_n"))
    asked = asked.select("_s", "_n", F.posexplode(F.array(*[r.cast("long") for r in ranks(n, F.floor)])).alias("_cut", "_rank"))
    # a row for each stratum and cut
    asked = checkpointed(asked.where("_rank > 0").withColumn("_p", F.lit("")))
    depth = 0
    while (asked.agg(F.max("_n")).first()[0] or 0) > leaf_rows:
        open_parts = asked.where(F.col("_n") > leaf_rows).select("_s", "_p").distinct()
        inside = rows.withColumn("_p", F.substring("_h", 1, depth)).join(open_parts, ["_s", "_p"])
        counts = inside.groupBy("_s", "_p", F.substring("_h", 1, depth + PREFIX_STEP).alias("_q")).agg(F.count("*").alias("_m"))
        order = W.partitionBy("_s", "_p").orderBy("_q").rowsBetween(W.unboundedPreceding, 0)
        counts = counts.withColumn("_end", F.sum("_m").over(order))
        near = asked.where(F.col("_n") > leaf_rows).join(counts, ["_s", "_p"])
        near = near.where((F.col("_rank") <= F.col("_end")) & (F.col("_rank") > F.col("_end") - F.col("_m")))
        near = near.select("_s", F.col("_m").alias("_n"), "_cut", (F.col("_rank") - F.col("_end") + F.col("_m")).alias("_rank"), F.col("_q").alias("_p"))
        asked = checkpointed(near.unionByName(asked.where(F.col("_n") <= leaf_rows)))
        depth += PREFIX_STEP
    # parts may have stopped at several depths
    found = None
    for size in range(0, depth + 1, PREFIX_STEP):
        some = asked.where(F.length("_p") == size)
        inside = rows.withColumn("_p", F.substring("_h", 1, size)).join(some.select("_s", "_p").distinct(), ["_s", "_p"])
        position = F.row_number().over(W.partitionBy("_s", "_p").orderBy("_h", "_k"))
        ranked = inside.withColumn("_rank", position.cast("long")).join(some.drop("_n"), ["_s", "_p", "_rank"])
        ends = ranked.select("_s", F.struct(F.col("_cut").alias("cut"), F.col("_h").alias("digest"), F.col("_k").alias("key")).alias("x"))
        found = ends if found is None else found.unionByName(ends)
    return checkpointed(found.groupBy("_s").agg(F.collect_list("x").alias("cuts")))


def with_part(df: DataFrame, name: str, ranks: Ranks, stratum: str, key: str, seed: int, max_strata: int = MAX_STRATA) -> DataFrame:
    """Add the number of a row's part: how many of its stratum's cuts at ``ranks`` come before it in hash order.

    Up to ``max_strata`` strata the cuts are branches of an expression, beyond they are a table that is joined. Both
    give the same parts. Rows without a stratum or key drop out.
    """
    df = df.where(all_present(stratum, key))
    try:
        cuts = hash_cuts(df, key, lambda n: ranks(n, math.floor), stratum, seed, max_strata=max_strata)
    except TooManyStrata:
        return _with_joined_part(df, name, ranks, stratum, key, seed)

    def passed(c: list[Cut]) -> Column:
        return reduce(lambda a, b: a + b, [(~within_cut(key, cut, seed)).cast("int") for cut in c], F.lit(0))

    return df.withColumn(name, _per_stratum(stratum, cuts, passed, 0))


def _with_joined_part(df: DataFrame, name: str, ranks: Ranks, stratum: str, key: str, seed: int) -> DataFrame:
    number = len(ranks(0, math.floor))
    table = cut_table(df, key, ranks, stratum, seed)
    h, k = hash_text(key, seed), F.col(key).cast("string")
    # a share without rows has no cut: it lies before every row
    inside = F.size(F.filter("_cuts", lambda c: (h < c["digest"]) | ((h == c["digest"]) & (k <= c["key"]))))
    joined = df.join(table.select(F.col("_s").alias(stratum), F.col("cuts").alias("_cuts")), stratum, "left")
    part = F.lit(number) - F.when(F.col("_cuts").isNull(), 0).otherwise(inside)
    return joined.withColumn(name, part.cast("int")).select(*df.columns, name)


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def stratified_split(
    df: DataFrame, stratum: str = "late_risk", key: str = "line_id", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split``: "test" for an exact share of every class, "train" for the rest. Rows without a class drop out."""
    parts = with_part(df, "split", lambda n, floor: [floor(n * test_share + 0.5)], stratum, key, seed)
    return parts.withColumn("split", F.when(F.col("split") == 0, "test").otherwise("train"))


def stratified_subsample(
    df: DataFrame, size: int = 40_000, stratum: str = "late_risk", key: str = "line_id", seed: int = 42
) -> DataFrame:
    """About ``size`` rows with the class shares of the whole; all rows if there are no more than that."""
    df = df.where(all_present(stratum, key))
    total = df.count()
    share = min(1.0, size / total) if total else 1.0
    name = unused(df, "_part")
    return with_part(df, name, lambda n, floor: [floor(n * share + 0.5)], stratum, key, seed).where(F.col(name) == 0).drop(name)


def stratified_folds(
    df: DataFrame, k: int = 5, stratum: str = "late_risk", key: str = "line_id", seed: int = 42
) -> DataFrame:
    """Add ``fold`` 0..k-1: equal runs of the hash order within each class."""
    return with_part(df, "fold", lambda n, floor: [floor((n * i + k - 1) / k) for i in range(1, k)], stratum, key, seed)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def prefix_step(
    df: DataFrame, shares: Sequence[float], stratum: str = "late_risk", key: str = "line_id", seed: int = 7
) -> Column:
    """The first of the growing shares of a table (0-based) that a row of it belongs to; share i holds steps 0..i."""
    cuts = hash_cuts(df.where(all_present(stratum, key)), key, lambda n: [half_up(s * n) for s in shares], stratum, seed)

    def step(c: list[Cut]) -> Column:
        passed = [(~within_cut(key, cut, seed)).cast("int") for cut in c]
        return reduce(lambda a, b: a + b, passed, F.lit(0))

    return _per_stratum(stratum, cuts, step, 0)


def stratified_prefixes(
    df: DataFrame, shares: Sequence[float], stratum: str = "late_risk", key: str = "line_id", seed: int = 7
) -> DataFrame:
    """Add ``step``, see :func:`prefix_step`. Rows without a class drop out."""
    return with_part(df, "step", lambda n, floor: [floor(n * s + 0.5) for s in shares], stratum, key, seed)
