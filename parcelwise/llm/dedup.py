"""Exact duplicates, by merging sorted runs of digests in a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import unused, written

FAN_IN = 16  # runs that one run of the next level merges
ROWS_PER_RUN = 100_000  # rows that a run of the lowest level holds, about
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def _digests(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``(id, digest, proof, row)`` of every row. ``proof`` holds a second hash and the length."""
    whole = F.struct(normalised(docs[text]).alias("t"))
    one = docs.select(docs[id].cast("long").alias("id"), whole.alias("whole"))
    proof = F.struct(F.xxhash64("whole.t").alias("hash"), F.octet_length("whole.t").alias("bytes"))
    digest = F.unhex(F.sha2("whole.t", 256))
    return one.select("id", digest.alias("digest"), proof.alias("proof"), F.monotonically_increasing_id().alias("row"))


def levels(rows: int) -> int:
    """Rounds of merging after the lowest level: FAN_IN ** levels runs hold ROWS_PER_RUN rows each."""
    runs, n = 1, 0
    while runs * ROWS_PER_RUN < rows:
        runs, n = runs * FAN_IN, n + 1
    return max(1, n)


def merged_runs(digests: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The lowest runs ``(run, digest, proof)`` and the last ones ``(digest, proof, keep, size)``.

    A run holds each of its digests once, with its smallest (id, row) and its number of rows. There are
    FAN_IN ** rounds runs at every level. In a round, FAN_IN runs that differ in one digit of their number exchange
    rows: each gets the digests whose next four bits are that digit of its own number, merges what the others send, and
    keeps the smallest. After the last round every digest is in one run. A digest that a third of all rows hold sends
    one row from each run, so no run grows with a group of copies. Rows merge only if digest, second hash and length
    all agree.
    """
    runs = FAN_IN**rounds
    key = ("run", "digest", "proof")
    keep = F.struct("id", "row")
    # null ids come last
    first = F.struct(F.col("id").isNull().alias("none"), keep.alias("row"))
    level = (
        digests.withColumn("run", F.pmod("row", F.lit(runs)))
        .groupBy(*key)
        .agg(F.min(first).alias("keep"), F.count("*").alias("size"))
    )
    lowest = level = written(level.repartition(runs, "run").sortWithinPartitions(*key), "runs")
    for r in range(rounds):
        weight = FAN_IN**r
        digit = F.pmod(F.conv(F.substring(F.hex("digest"), r + 1, 1), 16, 10).cast("long"), F.lit(FAN_IN))
        old = F.pmod(F.floor(F.col("run") / weight), F.lit(FAN_IN))
        sent = level.withColumn("run", (F.col("run") + (digit - old) * weight).cast("long"))
        # sorted runs meet in one partition each; the aggregation needs no further exchange
        sent = sent.repartition(runs, "run").sortWithinPartitions(*key)
        level = sent.groupBy(*key).agg(F.min("keep").alias("keep"), F.sum("size").alias("size"))
    return lowest.select(*key), level.select("digest", "proof", F.col("keep.row").alias("keep"), "size")


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row of ``docs``.

    Texts are equal if they are identical after every run of ASCII white space became one space. Of equal texts the row
    with the smallest id stays; of rows that repeat that id, one. ``text_sha256`` is the lowercase hex digest of the
    normalised text.

    A null text counts as empty. A null id ranks after all others and is kept only if its group has no other; its
    ``keep_id`` is null then. Repeated rows each get a row. An empty table gives an empty table. Other columns aren't
    used, whatever their names.
    """
    rows = written(_digests(docs, id, text), "digests")
    rounds = levels(rows.count())
    lowest, last = merged_runs(rows, rounds)
    # the way back goes over the lowest runs, so that a common digest is joined in as many places as there are runs
    known = lowest.join(last, ["digest", "proof"])
    joined = rows.withColumn("run", F.pmod("row", F.lit(FAN_IN**rounds))).join(known, ["run", "digest", "proof"])
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("keep.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("keep.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    Rows are told apart by id and text; rows equal in both are copies, of which one stays.
    """
    kept = exact_duplicates(docs, id, text).where("kept")
    key, digest = unused(docs, "kept_id"), unused(docs, "kept_digest")
    found = kept.select(F.col("doc_id").alias(key), F.unhex("text_sha256").alias(digest))
    repeated = docs.groupBy(docs[id].alias(key)).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if not repeated:  # ids alone tell rows apart
        return docs.join(found.select(key), docs[id].eqNullSafe(found[key]), "left_semi")
    own = unused(docs, "own_digest")
    left = docs.withColumn(own, F.unhex(F.sha2(normalised(docs[text]), 256)))
    left = left.join(found, left[id].eqNullSafe(found[key]) & (left[own] == found[digest]), "left_semi")
    return left.dropDuplicates([id, own]).drop(own)
