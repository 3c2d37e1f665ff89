"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import unused, written

WORD = r"[^\x20\x09-\x0D]+"
BLOCKS_PER_DOCUMENT = 8
ROWS_PER_BUCKET = 5_000  # rows or slots that one window sorts, about
MODULUS = 2**31  # of the golden-ratio points
GOLDEN = 1_327_217_885  # odd, nearest to MODULUS / 1.618...
MAX_SOURCES = 10_000  # more raise an error; what is sent to the driver and broadcast has a row for each source


def _sized(docs: DataFrame, id: str, text: str, source: str, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(
        docs[id].alias("id"),
        docs[source].alias("source"),
        size.alias("size"),
        F.xxhash64(F.lit(seed), docs[id]).alias("place"),
        F.monotonically_increasing_id().alias("row"),
    )


def targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """``(source, source_size, number, weight, target)`` from ``(source, source_size)``, a row for each source.

    Sources in code-point order, null last, get the weights in turn. Targets share the sum of all sizes by weight; none
    exceeds ``cap`` times its source's size, and what that leaves over goes to the others by weight. So target =
    min(cap x size, level x weight), and the level follows from running sums over sources in order of cap x size /
    weight. The windows hold one row for each source.
    """
    given = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").isNull(), "source")
    named = sizes.withColumn("number", F.row_number().over(order) - 1)
    named = named.withColumn("weight", F.get(given, F.pmod("number", F.lit(len(weights))).cast("int")))
    named = named.withColumn("most", cap * F.col("source_size"))
    everything, by_ratio = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("weight"), "number")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # the level at the first source that isn't capped; if all are, the last one's share is what is left
    found = named.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("most"))
    found = found.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), "number", "level"))).over(everything)["level"])
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return found.select("source", "source_size", "number", "weight", target.alias("target"))


def _prefix(rows: DataFrame, key: str, bucket: str, order: Sequence[str | Column], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the key's rows before each row. No window holds more than a bucket or the
    key's buckets, so a hot key is spread."""
    totals = rows.groupBy(key, bucket).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, bucket, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(totals, [key, bucket]).withColumn(out, (F.col("_ahead") + F.col("_inside")).cast("long")).drop("_ahead", "_inside")


def schedule(quotas: DataFrame, slots: int) -> DataFrame:
    """``(number, slot, rank)``: which source each slot of the mix takes its next block from.

    ``quotas``: ``(number, blocks)`` for each source, adding up to ``slots``. Slot k's golden-ratio point, mapped through
    the cumulative quotas, names its source; ``rank`` counts the source's earlier slots. Every stretch of the schedule
    holds the sources close to their shares. A source that the points give less than its quota gets the rest at the
    end; what they give beyond it is left out.
    """
    spark = quotas.sparkSession
    ahead = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    cuts = quotas.where("blocks > 0").withColumn("low", F.coalesce(F.sum("blocks").over(ahead), F.lit(0)))
    cuts = cuts.orderBy("number").limit(MAX_SOURCES + 1).collect()
    if len(cuts) > MAX_SOURCES:
        raise ValueError(f"a mix has at most {MAX_SOURCES} sources")
    if not slots:
        return spark.createDataFrame([], "number int, slot long, rank long")
    point = F.pmod(F.pmod("id", F.lit(MODULUS)) * GOLDEN + MODULUS // 2, F.lit(MODULUS)) / MODULUS * slots
    lows, numbers = (F.array(*[F.lit(int(c[k])) for c in cuts]) for k in ("low", "number"))
    index = F.size(F.filter(lows, lambda x: x <= F.col("point"))) - 1
    rows = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"))
    rows = rows.select("slot", F.get(numbers, index).alias("number"), F.floor(F.col("slot") / ROWS_PER_BUCKET).alias("bucket"))
    ranked = _prefix(rows.withColumn("one", F.lit(1)), "number", "bucket", ["slot"], "one", "rank")
    ranked = ranked.join(quotas, "number").where("rank < blocks").select("number", "slot", "rank")
    short = quotas.join(rows.groupBy("number").agg(F.count("*").alias("n")), "number", "left").where("coalesce(n, 0) < blocks")
    rest = short.select("number", F.explode(F.sequence(F.coalesce("n", F.lit(0)), F.col("blocks") - 1)).alias("rank"))
    return ranked.unionByName(rest.withColumn("slot", slots + F.col("rank")))


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    cap: int = 3,
    seed: int = 0,
) -> DataFrame:
    """What the mix takes of every row of ``docs``: ``(doc_id, source, size, source_size, target, taken)``.

    Size is the number of words. A source's documents, in an order that follows a hash of id and seed, are one stream
    of words, cut into equal blocks; the n-th slot that the schedule gives a source takes the stream's n-th block, from
    the start again when the stream is over, until the source's target is reached. ``taken`` counts a document's words
    in all blocks taken: at most ``cap`` times its size, and in all the target, rounded. Reruns take the same.

    Block lengths follow from the table (about eight blocks to a document), so work grows in proportion to it. Null and
    empty texts have size 0 and nothing is taken of them. Null sources are a source of their own, ranked last. Rows that
    repeat, ids included, are documents of their own. An empty table gives an empty table. Other columns aren't used.
    """
    rows = written(_sized(docs, id, text, source, seed), "sizes")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    block = max(1, -(-total // max(1, BLOCKS_PER_DOCUMENT * count)))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    words = F.round("target").cast("long")
    whole = F.greatest("source_size", F.lit(1))
    passes, rest = F.floor(F.col("words") / whole), F.pmod("words", whole)
    per_pass = F.ceil(F.col("source_size") / block)
    needed = F.when(F.col("source_size") > 0, passes * F.col("per_pass") + F.ceil(rest / block)).otherwise(0)
    sources = sources.withColumns({"words": words, "per_pass": per_pass}).withColumn("blocks", needed.cast("long"))
    sources = written(sources, "sources")
    slots = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    taken = schedule(sources.select("number", "blocks"), slots).join(sources.drop("blocks", "source", "weight", "target"), "number")
    start = F.pmod("rank", "per_pass") * block
    done = F.floor(F.col("rank") / F.col("per_pass")) * F.col("source_size") + start
    length = F.least(F.lit(block), F.col("source_size") - start, F.col("words") - done)
    taken = taken.select("number", F.pmod("rank", "per_pass").alias("block"), length.alias("length"))
    # how often each block is taken, and the words of a block that a pass cuts short
    blocks = taken.groupBy("number", "block", "length").agg(F.count("*").alias("times"))

    buckets = max(1, count // ROWS_PER_BUCKET)
    placed = rows.join(F.broadcast(sources.select("source", "number", "source_size", "target")), rows["source"].eqNullSafe(sources["source"]))
    placed = placed.drop(sources["source"]).withColumn("bucket", F.floor((F.col("place") / 2.0**64 + 0.5) * buckets))
    placed = _prefix(placed, "number", "bucket", ["place", "id", "size", "row"], "size", "start")
    placed = written(placed.select("id", "source", "row", "size", "number", "source_size", "target", "start"), "placed")
    end = F.col("start") + F.col("size")
    covered = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block)))
    pieces = placed.withColumn("block", F.explode(covered)).join(blocks, ["number", "block"])
    low = F.col("block") * block
    inside = F.greatest(F.lit(0), F.least(end, low + F.col("length")) - F.greatest("start", low))
    sums = pieces.groupBy("row").agg(F.sum(inside * F.col("times")).alias("taken"))
    return placed.join(sums, "row", "left").select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "row"
    )


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix: each row of ``docs`` as often as the mix takes it whole.

    A pass that ends inside a document takes it if more than half of its words are due, so a source misses its target by
    less than one document. Documents without words stay once.
    """
    taken = mix(docs, id, text, source, **options)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    # rows that share an id, if any, have their mean number of copies
    key, n, copy = (unused(docs, c) for c in ("mixed_id", "mixed_n", "mixed_copy"))
    times = taken.groupBy(F.col("doc_id").alias(key)).agg(F.round(F.avg(copies)).cast("int").alias(n))
    joined = docs.join(times, docs[id].eqNullSafe(times[key])).where(F.col(n) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), n))).drop(key, n, copy)
