"""Rate and volume tables over one or more dimensions.

Every table is one hash aggregation: partial sums are combined before the shuffle, so a dimension value that holds most
of the rows still sends one row per input partition.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.columns import all_present, col

LABEL = "late_risk"
BOOTSTRAP_ROWS = 64  # whose weights in all draws are one matrix, which stays in the cache
# fixed values: multipliers of the public hash function XXH64
XXH64_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def overall_rate(df: DataFrame, measure: str = LABEL) -> DataFrame:
    return df.agg(F.count(measure).alias("n"), F.avg(measure).alias("rate"))


def rate_by(df: DataFrame, dims: str | Sequence[str], measure: str = LABEL, order: str = "key") -> DataFrame:
    """Rows and mean of ``measure`` per key; order "key", "rate" or "rate_desc"."""
    dims = [dims] if isinstance(dims, str) else list(dims)
    out = (
        df.where(all_present(*dims))
        .groupBy(*dims)
        .agg(F.count("*").alias("n"), F.avg(measure).alias("rate"))
    )
    first = {"key": [], "rate": [F.asc("rate")], "rate_desc": [F.desc("rate")]}[order]
    return out.orderBy(*first, *dims)


def published_rate(table: DataFrame, name: str = "late_risk_rate") -> DataFrame:
    """A rate table as it is published: the key and its rate under the measure's own name, without the count."""
    return table.drop("n").withColumnRenamed("rate", name)


def mean_by(df: DataFrame, dim: str, measure: str, name: str) -> DataFrame:
    """Mean of a measure per key, largest first."""
    return df.where(all_present(dim)).groupBy(dim).agg(F.avg(measure).alias(name)).orderBy(F.desc(name), dim)


def volume_by(df: DataFrame, dim: str) -> DataFrame:
    return df.where(all_present(dim)).groupBy(dim).agg(F.count("*").alias("n")).orderBy(F.desc("n"), dim)


def share_by(df: DataFrame, dim: str) -> DataFrame:
    """Rows per key and their share of all rows with a key."""
    counts = df.where(all_present(dim)).groupBy(dim).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), dim)


def rate_of_top(df: DataFrame, dim: str, k: int, measure: str = LABEL, ascending: bool = False) -> DataFrame:
    """Rates of the k most frequent keys, equal counts in key order.

    A key's rate depends on its own rows only, so one aggregation and a top-k of its result replace filtering the rows
    to the top keys and aggregating again.
    """
    per_key = df.where(all_present(dim)).groupBy(dim).agg(F.count("*").alias("n"), F.avg(measure).alias("rate"))
    top = per_key.orderBy(F.desc("n"), dim).limit(k)
    return top.orderBy(F.asc("rate") if ascending else F.desc("rate"), dim)


def rate_by_every(df: DataFrame, dims: Sequence[str], measure: str = LABEL) -> DataFrame:
    """The rate tables of many dimensions from one scan: ``(dimension, key, n, rate)``."""
    dims = list(dims)
    # cast once so that the keys of all dimensions share a column
    texts = df.select(*[F.col(d).cast("string").alias(d) for d in dims], F.col(measure))
    sets = texts.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims])
    out = sets.agg(
        F.count("*").alias("n"), F.avg(measure).alias("rate"), *[F.grouping(d).alias(f"_{i}") for i, d in enumerate(dims)]
    )
    dimension = F.coalesce(*[F.when(F.col(f"_{i}") == 0, F.lit(d)) for i, d in enumerate(dims)])
    out = out.select(dimension.alias("dimension"), F.coalesce(*[F.col(d) for d in dims]).alias("key"), "n", "rate")
    return out.where(all_present("key")).orderBy("dimension", "key")


def cells(
    df: DataFrame,
    dims: Sequence[str] = ("order_region", "category_name"),
    label: str = LABEL,
    scheduled: str = "days_scheduled",
    sales: str = "sales",
    min_volume: int = 10,
) -> DataFrame:
    """Rate, mean promised days, mean sales and volume per cell; cells below ``min_volume`` are left out."""
    return (
        df.where(all_present(*dims))
        .groupBy(*dims)
        .agg(
            F.avg(label).alias("late_risk_rate"),
            F.avg(scheduled).alias("avg_scheduled_days"),
            F.avg(sales).alias("avg_sales"),
            F.count(sales).alias("order_volume"),
        )
        .where(F.col("order_volume") >= min_volume)
    )


def bootstrap_rates(
    df: DataFrame, dim: str, label: str = LABEL, draws: int = 1000, level: float = 0.95, seed: int = 42
) -> DataFrame:
    """Mean of a 0/1 label per key with a bootstrap interval.

    Resampling n rows of which k are 1 draws Binomial(n, k/n) ones, so the table of (n, k) is all that is resampled:
    its size is the number of keys, whatever the number of rows.
    """
    low, high = (1 - level) / 2, (1 + level) / 2

    def intervals(batches):
        for pdf in batches:
            bounds = []
            for key, n, k in zip(pdf["_key"], pdf["n"], pdf["k"]):
                rng = np.random.default_rng([seed, zlib.crc32(key.encode())])
                means = rng.binomial(n, k / n, size=draws) / n
                bounds.append(np.quantile(means, [low, high]))
            pdf["rate"] = pdf["k"] / pdf["n"]
            both = np.array(bounds).reshape(-1, 2)
            yield pd.concat([pdf[[dim, "n", "rate"]], pd.DataFrame(both, columns=["ci_low", "ci_high"])], axis=1)

    counts = (
        df.where(all_present(dim, label))
        .groupBy(dim)
        .agg(F.count("*").alias("n"), F.sum(col(label).cast("long")).alias("k"))
        .withColumn("_key", F.col(dim).cast("string"))
    )
    kind = df.schema[dim].dataType.simpleString()
    out = counts.mapInPandas(intervals, f"`{dim}` {kind}, n long, rate double, ci_low double, ci_high double")
    return out.orderBy(dim)


def hashed_onwards(seed: np.ndarray, number: np.ndarray) -> np.ndarray:
    """XXH64 of 32-bit integers with 64-bit seeds, as signed 64-bit integers; both arrays are broadcast."""
    p1, p2, p3, p5 = (np.uint64(p) for p in XXH64_PRIMES)
    h = (seed.astype(np.int64).view(np.uint64) + (p5 + np.uint64(4))) ^ (number.astype(np.uint32).astype(np.uint64) * p1)
    high = h >> np.uint64(41)
    h <<= np.uint64(23)
    h |= high
    h *= p2
    h += p3
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def poisson_weights(hashes: np.ndarray, steps: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How many of ``steps`` a hash, as a number from 0 to 1, reaches; ``table`` is :func:`weight_table` of the steps."""
    weight = table[(hashes >> 48) + (1 << 15)]
    open_ = np.nonzero(weight < 0)
    weight[open_] = np.searchsorted(steps, hashes[open_] / 2.0**64 + 0.5, "right")
    return weight


def weight_table(steps: np.ndarray) -> np.ndarray:
    """The weight that all hashes with the same first 16 bits have, or -1 where a step lies between them."""
    ends = np.searchsorted(steps, np.arange((1 << 16) + 1) / (1 << 16), "right")
    return np.where(ends[:-1] == ends[1:], ends[:-1], -1).astype(np.int8)


def bootstrap_means(
    df: DataFrame,
    dim: str,
    measure: str,
    key: str = "line_id",
    draws: int = 1000,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Poisson bootstrap of the mean of any measure per key: ``(dim, n, mean, ci_low, ci_high)``.

    A row's weight in a draw is a Poisson(1) number found from a hash of its key and the draw, so replays agree. A task
    has the weights of a block of rows in all draws as one matrix and adds up its products with the measure; it sends on
    a row for each key and draw. Rows without a key value or measure are left out.
    """
    rows = df.where(all_present(dim, measure)).select(F.col(dim).alias("_dim"), F.col(measure).cast("double").alias("_x"), F.col(key).alias("_k"))
    kind = rows.schema["_dim"].dataType.simpleString()
    # P(weight <= w) for w = 0, 1, ...; beyond the last the chance is below 1e-15
    steps = np.cumsum([math.exp(-1) / math.factorial(w) for w in range(18)])
    numbers, table = np.arange(draws), weight_table(steps)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        type = None
        for batch in batches:
            type = batch["_dim"].type
            coded = batch["_dim"].dictionary_encode()
            place, values = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            x, hashes = batch["_x"].to_numpy(), batch["_h"].to_numpy()
            for at in range(0, len(batch), BOOTSTRAP_ROWS):
                part = slice(at, at + BOOTSTRAP_ROWS)
                weight = poisson_weights(hashed_onwards(hashes[part, None], numbers[None]), steps, table)
                found, own = np.unique(place[part], return_inverse=True)
                # of each key the rows and their measures
                shares = np.zeros((len(found), 2, len(own)))
                rows_of = np.arange(len(own))
                shares[own, 0, rows_of], shares[own, 1, rows_of] = 1, x[part]
                added = (shares.reshape(-1, len(own)) @ weight.astype(float)).reshape(len(found), 2, draws)
                for p, more in zip(found, added):
                    total = totals.setdefault(values[p], np.zeros((2, draws)))
                    total += more
        for value, (w, wx) in totals.items():
            some = np.flatnonzero(w > 0)
            columns = [pa.array([value] * len(some), type), pa.array(some, pa.int64()), pa.array(w[some]), pa.array(wx[some])]
            yield pa.RecordBatch.from_arrays(columns, names=["_dim", "draw", "w", "wx"])

    # the hash goes on over the draws where this one ends
    hashed = rows.select("_dim", "_x", F.xxhash64(F.lit(seed), "_k").alias("_h"))
    parts = hashed.mapInArrow(sums, f"_dim {kind}, draw long, w double, wx double")
    per_draw = parts.groupBy("_dim", "draw").agg((F.sum("wx") / F.sum("w")).alias("mean"))
    low, high = (1 - level) / 2, (1 + level) / 2
    # draws rows per key, whatever the size of the data
    bounds = per_draw.groupBy("_dim").agg(F.percentile("mean", F.array(F.lit(low), F.lit(high))).alias("q"))
    means = rows.groupBy("_dim").agg(F.count("*").alias("n"), F.avg("_x").alias("mean"))
    return (
        means.join(bounds, "_dim")
        .select(F.col("_dim").alias(dim), "n", "mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
        .orderBy(dim)
    )
