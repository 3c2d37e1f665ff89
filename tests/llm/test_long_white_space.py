"""Quality rules on texts that are mostly white space."""

import time

from parcelwise.llm import quality


def test_a_million_spaces_inside_a_text(spark):
    long = "a" + " " * 1_000_000 + "b"
    rows = [(1, long, "x"), (2, "\t\x0b" * 500_000 + "one two\x0c\r", "x"), (3, "\n " * 300_000, "x"), (4, "a b  c", None)]
    started = time.monotonic()
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert time.monotonic() - started < 60
    assert {i: (r["n_words"], r["word_chars"]) for i, r in got.items()} == {1: (2, 2), 2: (2, 6), 3: (0, 0), 4: (3, 4)}
    assert not any(r["kept"] for r in got.values())
