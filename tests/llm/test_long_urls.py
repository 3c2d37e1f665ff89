"""Urls of many labels: their keys are as few as the lists' numbers of labels."""

import time

from parcelwise.llm import urls

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("allow", "a.b.c.example.net", "/"))


def test_a_url_of_fifteen_thousand_labels(spark):
    many = "x." * 15_000
    rows = [
        (1, f"http://{many}example.net/en/page", "example.net/en/", "allow"),
        (2, f"http://{many}net/en/page", "net/", "block"),
        (3, f"http://{many}spam.org/", None, "block"),
        (4, f"http://{many}org/", None, "allow"),
        (5, "http://a.b.c.example.net/en/", "a.b.c.example.net/", "allow"),
        (6, "http://c.example.net/x", "net/", "block"),
        (7, "http://net/", "net/", "block"),
        (8, "http://.net/", "net/", "block"),
        (9, None, None, "allow"),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    listed = spark.createDataFrame([("spam.org",), ("one.two.three.org",), (None,)], "key string")
    started = time.monotonic()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, RULES, listed).collect()}
    assert time.monotonic() - started < 60
    assert got == {r[0]: r[2:] for r in rows}
