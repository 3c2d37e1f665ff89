"""Rules on single documents, and lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import unused, written
from .urls import LOWER, UPPER

SYMBOLS = "#*$%&|<>"  # fixed
ASCII_SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

MIN_DOCUMENTS = 20  # of a host, before its lines are judged
MAX_SHARE = 0.1  # of a host's documents that may share a line
MIN_LEFT = 0.5  # of a document's words that must be left


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    The windows' hashes are sorted with their places in the low bits; equal neighbours whose words agree repeat. The
    covered words are the union of [place, place + 3).
    """
    one = F.lit(1).cast("long")

    def count(w: Column) -> Column:
        windows = F.size(w) - 2
        bits = F.length(F.bin(windows.cast("long")))
        mask = F.call_function("shiftleft", one, bits) - 1

        def keys(b: Column) -> Column:
            return F.array_sort(
                F.transform(
                    F.sequence(F.lit(0), windows - 1),
                    lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(b)).bitwiseOR(i.cast("long")),
                )
            )

        def repeated(k: Column, b: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                def words_at(i: Column) -> Column:
                    return F.slice(w, i.cast("int") + 1, 3)

                close = x.bitwiseAND(F.bitwise_not(b)) == y.bitwiseAND(F.bitwise_not(b))
                return F.when(close, words_at(x.bitwiseAND(b)) == words_at(y.bitwiseAND(b))).otherwise(False)

            last = F.size(k) - 1
            kept = F.filter(
                k,
                lambda x, i: F.when(i > 0, same(x, F.get(k, i - 1))).otherwise(False)
                | F.when(i < last, same(x, F.get(k, i + 1))).otherwise(False),
            )
            return F.array_sort(F.transform(kept, lambda x: x.bitwiseAND(b)))

        def covered(p: Column) -> Column:
            return F.aggregate(
                p,
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("at")),
                lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("long"), x - a["at"])).alias("n"), x.alias("at")),
                lambda a: a["n"],
            )

        found = let(mask, lambda b: let(keys(b), lambda k: let(repeated(k, b), covered)))
        return F.when(windows >= 2, found).otherwise(F.lit(0).cast("long"))

    return let(words, count)


def _normalised_line(line: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(line, SPACES, " ")), UPPER, LOWER)


def _measured(docs: DataFrame, id: str, text: str, host: str) -> DataFrame:
    """One row per document: its base counts, a hash of its text, and hash and words of each line with a word."""
    whole = F.coalesce(docs[text], F.lit(""))
    trimmed = F.btrim(whole, F.lit(ASCII_SPACE))  # in one go, however long white space inside the text is
    some = docs.select(docs[id].alias("id"), docs[host].alias("host"), whole.alias("t"), trimmed.alias("trimmed"))
    words = F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACES))
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, ASCII_SPACE, "") != "")
    hashed = F.transform(
        "lines", lambda x: F.struct(F.xxhash64(_normalised_line(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("n"))
    )
    symbols = F.length("t") - F.length(F.translate("t", SYMBOLS, ""))
    return (
        some.withColumns({"words": words, "lines": lines})
        .select(
            "id",
            "host",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.translate("t", ASCII_SPACE, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.col("words")).alias("n_repeat_words"),
            F.xxhash64("t").alias("whole"),
            hashed.alias("lines"),
        )
        .withColumn("row", F.monotonically_increasing_id())
    )


def frequent_lines(measured: DataFrame, min_documents: int, max_share: float) -> DataFrame:
    """``(host, frequent)``: hashes of the lines that more than ``max_share`` of a host's distinct documents hold.

    A document with n lines adds to at most n of its host's lines, so a host has at most (its mean number of lines) /
    ``max_share`` frequent ones and the array is bounded whatever the host's size. Copies of one text count as one
    document. Counts are combined before the shuffle and keyed by host and line, so a hot host is spread over its lines.
    """
    distinct = measured.groupBy(F.coalesce("host", F.lit("")).alias("name"), F.col("host").isNull().alias("none"), "whole").agg(
        F.first(F.array_distinct("lines.h")).alias("lines")
    )
    distinct = written(distinct, "lines")
    sizes = distinct.groupBy("name", "none").agg(F.count("*").alias("documents")).where(F.col("documents") >= min_documents)
    counts = distinct.select("name", "none", F.explode("lines").alias("h")).groupBy("name", "none", "h").agg(F.count("*").alias("n"))
    # no host's limit is lower than this: lines that are rarer need not meet their host's size
    counts = counts.where(F.col("n") > max_share * min_documents)
    often = counts.join(sizes, ["name", "none"]).where(F.col("n") > max_share * F.col("documents"))
    return often.groupBy("name", "none").agg(F.collect_list("h").alias("frequent"))


def quality_rules(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """Counts and verdict of every row of ``docs``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_frequent_lines,
    n_left_words, kept`` and ``removed``, the hashes of the removed lines. ``base_failed``: under 50 words, or over half
    of the words in repeated 3-word windows. Lines that more than ``max_share`` of a host's distinct documents hold are
    removed; a document with less than ``min_left`` of its words left is depleted and not kept.

    Lines are compared trimmed, with A-Z lower-cased and with single spaces. Hosts with fewer than ``min_documents`` distinct
    documents have no frequent lines. A null host is a host of its own. A null or empty text has no words and fails.
    Repeated rows each get a row and count as one document. An empty table gives an empty table. Other columns aren't
    used, whatever their names.
    """
    measured = written(_measured(docs, id, text, host), "measured")
    # a table of its own, so that the join below is one of two scans and a hot host's rows can be split
    often = written(frequent_lines(measured, min_documents, max_share), "frequent")
    keyed = measured.withColumns({"name": F.coalesce("host", F.lit("")), "none": F.col("host").isNull()})
    joined = keyed.join(often, ["name", "none"], "left")
    gone = F.filter("lines", lambda x: F.coalesce(F.array_contains(F.col("frequent"), x["h"]), F.lit(False)))
    left = F.col("n_words") - F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        joined.withColumn("gone", gone)
        .withColumns({"n_left_words": left, "base_failed": failed})
        .select(
            F.col("id").alias("doc_id"),
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            F.size("gone").cast("long").alias("n_frequent_lines"),
            "n_left_words",
            (~F.col("base_failed") & (F.col("n_left_words") >= min_left * F.col("n_words"))).alias("kept"),
            F.array_distinct("gone.h").alias("removed"),
            "row",
        )
    )


def without_lines(docs: DataFrame, verdicts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed lines of each document cut out of its text; ids must be unique. Null texts stay null."""
    key, gone = unused(docs, "removed_id"), unused(docs, "removed_lines")
    removed = verdicts.select(F.col("doc_id").alias(key), F.col("removed").alias(gone))
    joined = docs.join(removed, docs[id] == removed[key], "left")
    cut = lambda x: F.coalesce(F.array_contains(gone, F.xxhash64(_normalised_line(x))), F.lit(False))
    return joined.withColumn(text, F.array_join(F.filter(F.split(text, "\n"), lambda x: ~cut(x)), "\n")).drop(key, gone)
