"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import datetime as dt
import gzip
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelwise.llm import chat, dedup, extraction, graph, jaccard, mixing, packing, quality, tokens, urls, warc

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SENTENCES = public_tokenizers.path("piece_bpe_32k.model")

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
TEXTS = [
    (1, None, "a"),
    (2, "", "a"),
    (3, "   \n\t ", None),
    (4, "one", "b"),
    (5, "Hello  World\n\n it's <|endoftext|> 123", "b"),
    (6, LONG, "b"),
    (7, LONG + "  ", "a"),
    (7, LONG + "  ", "a"),
    (8, "ÀÉ ñandú 東京 \u00a0 e\u0301 \x1c x", None),
    (None, "one", "c"),
]
DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(TEXTS, DOCS)
    # names that the operators use themselves
    extra = ("id", "row", "n", "size", "keys", "digest", "taken", "number", "place", "start", "host", "run", "kept", "_id", "h")
    return frame.withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_tokens_of_odd_texts(docs, none):
    model = Tokenizer.from_file(WORDS)
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(docs, WORDS).collect()]
    want = []
    for i, t, _ in TEXTS:
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert tokens.token_counts(none, WORDS).count() == 0


def test_pieces_of_a_text_count_as_the_whole():
    model = tokens.Tokenizer(WORDS)
    assert model.splits_at_space and not tokens.Tokenizer(BYTES).splits_at_space
    text = (" ".join(["naïve", "don't", "東京", "x" * 700, "12 3"] * 500) + "\n\n").encode()
    parts = tokens.slices(text, 1000)
    assert len(parts) > 5 and b"".join(parts) == text
    assert sum(model.count(parts)) == model.count([text])[0] == len(model.library.encode(text.decode(), add_special_tokens=False).ids)
    assert tokens.slices(b"x" * 5000, 100) == [b"x" * 5000]


@pytest.mark.parametrize("path", [BYTES, WORDS, SENTENCES])
def test_ids_equal_the_library(path):
    model = tokens.Tokenizer(path)
    spaces = ["a  b", " a", "a ", "a \n b", "a\n b", "\n", "", " ", "  ", "a   b c", "x \t y", "\u00a0 a \u00a0b"]
    for texts in ([t or "" for _, t, _ in TEXTS], spaces):
        if path == WORDS:
            want = [len(model.library.encode(t, add_special_tokens=False).ids) for t in texts]
            assert model.count([t.encode() for t in texts]) == want
        elif path == SENTENCES:
            assert model.count([t.encode() for t in texts]) == [len(model.library.encode(t)) for t in texts]
        else:
            want = [model.library.encode(t, add_special_tokens=False).ids for t in texts]
            assert [np.frombuffer(x, model.type).tolist() for x in model.ids(texts)] == want


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("allow", "b.net", ""), ("block", "b.net", ""))


def test_urls(spark):
    pages = [
        (1, None), (2, ""), (3, "no scheme/x"), (4, "http://EXAMPLE.net/en/x?y#z"), (5, "http://example.net"),
        (6, "http://a.example.net/de"), (7, "ftp://q://net/"), (8, "http://spam.com:80/"), (9, "http://x.spam.com/a"),
        (10, "http://notspam.com/a"), (11, "http://?q"), (12, "http://b.net"), (13, "http://a.b.net/en/"), (13, "http://a.b.net/en/"),
        (14, "x\n://net/\nq"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rules", "key")})
    listed = spark.createDataFrame([("spam.com",), ("spam.com",), (None,)], "key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(frame, RULES, listed).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("example.net", "/en/x", "example.net/en/", "allow"), 5: ("example.net", "", None, "allow"),
        6: ("a.example.net", "/de", "net/", "block"), 7: ("q:", "//net/", None, "allow"), 8: ("spam.com:80", "/", None, "allow"),
        9: ("x.spam.com", "/a", None, "block"), 10: ("notspam.com", "/a", None, "allow"), 11: ("", "", None, "allow"),
        12: ("b.net", "", "b.net", "block"), 13: ("a.b.net", "/en/", "b.net", "block"), 14: ("net", "/\nq", "net/", "block"),
    }
    assert urls.judge(frame, RULES, listed).count() == len(pages)
    assert urls.judge(frame.limit(0), RULES, listed).count() == 0
    assert {r["verdict"] for r in urls.judge(frame, ()).collect()} == {"allow"}


def test_a_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(60_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("pmod(xxhash64(key), 50) = 0")
    made = urls.cascade(listed.unionByName(listed), universe)
    assert 2 < len(made.levels) < 40
    rows = universe.select("key", *urls._hashes(F.col("key")), F.expr("pmod(xxhash64(key), 50) = 0").alias("member")).toPandas()
    assert (made.holds(rows["a"].to_numpy().view(np.uint64), rows["b"].to_numpy().view(np.uint64)) == rows["member"].to_numpy()).all()
    bits = sum(level.size for level in made.levels)
    assert bits < 16 * rows["member"].sum()
    assert not urls.Cascade([]).holds(np.zeros(2, np.uint64), np.zeros(2, np.uint64)).any()


def test_links_of_odd_texts(docs, none):
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect())
    n = 60_000 - 4
    assert got == [
        ("1", 0, 1), ("2", 0, 2), ("3", 0, 3), ("4", 1, 4), ("5", 1, 5), ("6", n, 6), ("7", n, 6), ("7", n, 6), ("8", 3, 8), ("None", 1, 4),
    ]
    assert jaccard.jaccard_components(none).count() == 0


@pytest.mark.parametrize("width,similarity", [(1, Fraction(4, 5)), (3, Fraction(9, 10)), (2, Fraction(1, 2))])
def test_links_equal_brute_force_in_chains_and_crowds(spark, width, similarity):
    rng = np.random.default_rng(5)
    texts, base = [], [f"b{i}" for i in range(40)]
    for _ in range(60):  # near copies of one text, many of them not similar enough to one another
        words = list(base)
        for i in rng.integers(0, 40, rng.integers(0, 6)):
            words[i] = f"z{rng.integers(0, 9)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"c{k}" for k in range(s, s + 30)) for s in range(0, 40, 2)]  # a chain
    texts += [" ".join(f"s{k}" for k in range(n)) for n in range(1, 25)]  # sizes around the bands' edges
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=width, similarity=similarity).collect()}
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))})
    parent = list(range(len(texts)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    assert got == {i: root(i) for i in range(len(texts))}


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7), (None, 3), (1, 2), (2, 1)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(200, 260)]} | {1: 1, 2: 1}
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body class="with-sidebar">
<header>Site</header><nav><a href=x>Menu</a></nav><div class="cookie-banner">We use cookies</div>
<article class="post"><header><h1>Head &amp; title %d</h1></header><p>First%d <b>bold</b>, a<br>b<p>Second&nbsp;one%d &lt;x&gt; &copy
<div class="ad">Buy</div><aside>Side</aside><form>Mail<input></form><style>p{}</style><!-- no --><p hidden>No</p>
<p>Follow us on all channels</p><p>Page %d</p><section class="comments"><p>Nice!</p></section></article>
<div id="sidebar"><article>Other</article></div><footer>Foot</footer></body></html>"""


def test_pages(spark):
    rows = [(i, "http://h.org/%d" % i, PAGE % ((i,) * 4)) for i in range(12)]
    rows += [(20, "http://g.org/", None), (21, None, ""), (22, "http://g.org/", "just text & more"), (23, "x", "<p>a<p>b" * 3), (24, "x", "<div>" * 5000 + "deep"), (20, "http://g.org/", None)]
    rows += [(25, "http://g.org/2", "<main><p>Main</p></main><p>Rest</p>"), (26, "x", "<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>"), (27, "x", "<p>cut <b")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "seed", "page", "text", "template")})
    got = {r["page_id"]: r["text"] for r in extraction.extract(frame).collect()}
    for i in range(12):  # the line that all pages share is template
        assert got[i] == f"Head & title {i} First{i} bold, a b Second one{i} <x> © Page {i}"
    assert got[20] == got[21] == "" and got[22] == "just text & more" and got[23] == "a b a b a b" and got[24] == "deep"
    assert got[25] == "Main" and got[26] == "a b 1 2 3" and got[27] == "cut"
    few = {r["page_id"]: r["text"] for r in extraction.extract(frame, min_pages=13).collect()}
    assert few[3] == "Head & title 3 First3 bold, a b Second one3 <x> © Follow us on all channels Page 3"
    assert extraction.extract(frame.limit(0)).count() == 0


def test_wrappers_are_the_same_when_joined_by_shuffle(spark, monkeypatch):
    rows = [(i, "http://h.org/%d" % i, PAGE % ((i,) * 4)) for i in range(12)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(extraction.extract(frame).collect())
    monkeypatch.setattr(extraction, "BROADCAST_BYTES", -1)
    assert sorted(extraction.extract(frame).collect()) == want


def test_hosts_with_two_layouts_and_an_outlier(spark):
    one = "<div class=x><p>%s</p></div><div class=y><p>Own %d one</p></div><div class=z><p>All rights reserved</p></div>"
    two = "<section><h2>%s</h2></section><table><tr><td>Own %d two<td>Prices without tax</table>"
    rows = [(i, "http://h.org/%d" % i, (one if i % 2 else two) % ("Old" if i == 7 else "Home and more", i)) for i in range(60)]
    rows += [(90, "http://h.org/x", "<ul><li>A layout of its own</ul>"), (91, "http://h.org/x", one % ("Home and more", 1))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(frame).collect()}
    want = {i: f"Own {i} {'one' if i % 2 else 'two'}" for i in range(60)}
    assert got == want | {7: "Old Own 7 one", 90: "A layout of its own", 91: "Own 1 one"}


def test_attributes_count_by_their_whole_names():
    text = lambda page: extraction.main_text(extraction.parsed(page), set())
    for attributes in ('style="overflow:hidden"', 'title="hidden role=navigation"', "data-hidden=false", 'data-role="navigation" data-id=footer', "x=hidden"):
        assert text(f"<body {attributes}><div {attributes}>a</div><article {attributes}>b</article></body>") == "b"
        assert text(f"<div {attributes}>a</div>") == "a"
    for attributes in ("hidden", 'data-x="y" HIDDEN=""', "x=1 hidden", 'aria-hidden="true"', 'title="a b"hidden', "id=footer", "role = 'navigation'"):
        assert text(f"<div {attributes}>a</div><p>b</p>") == "b"
    assert text("<html hidden><body hidden>a</body></html>") == "a"


def test_forms_around_a_page_lose_their_controls_only():
    text = lambda page: extraction.main_text(extraction.parsed(page), set())
    controls = "<label>Name</label><input><textarea>t</textarea><select><option>o</select><button>Go</button>"
    assert text(f"<body><form id=aspnet>{controls}<nav>n</nav><article><p>Main</article></form></body>") == "Main"
    assert text(f"<body><form class=search>{controls}<p>All of it stands here</form><p>Rest</body>") == "All of it stands here Rest"
    assert text(f"<body><p>A text that is longer</p><form>{controls}<p>Your mail</form></body>") == "A text that is longer"
    assert text(f"<article><p>A text that is longer<form>{controls}Mail</form></article><form>{controls}</form>") == "A text that is longer"
    assert text(f"<form>{controls}</form>") == text("<form hidden><article>a</article></form>") == ""


def test_simple_tree_matching_pairs_the_most_nodes():
    a, b = (extraction.signed(extraction.parsed(t)) for t in ("<ul><li>1<li><b>2</b><li>3</ul>", "<ul><li>x<li>3</ul>"))
    pairs = extraction.matched(a, b, {})[1]
    assert sum(p.tag is None for p, _ in pairs) == 2 and all(p.label == q.label for p, q in pairs)


def test_packing_of_odd_texts(docs, none):
    model = Tokenizer.from_file(BYTES)
    got = packing.pack(docs, BYTES).toPandas()
    want = sorted(len(model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in TEXTS)
    assert sorted(got.groupby("row")["length"].sum()) == want
    one = got[got["doc_id"] == 5]
    ids = np.array([*model.encode(TEXTS[4][1], add_special_tokens=False).ids, 0], "<u4")
    assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in one.itertuples()] == one["ids_crc32"].tolist()
    assert packing.pack(none, BYTES).count() == 0


def test_neighbours_fill_the_window():
    texts = [[1, 2, 3, 4], [50, 51, 52, 53], [1, 2, 3, 9], [60, 61, 62, 63], [50, 51, 52, 59]]
    documents = [np.array(t * 2, "<u2") for t in texts]
    index = packing.Index(documents, np.ones(100, np.float32), 8.0)
    assert index.neighbours(0).argsort()[::-1][:2].tolist() == [0, 2]
    assert index.neighbours(0)[[1, 3, 4]].tolist() == [0, 0, 0]
    pieces = list(packing.packed(documents, index, 16))
    together = {}
    for d, _, _, s, _ in pieces:
        together.setdefault(s, []).append(d)
    assert together == {0: [0, 2], 1: [1, 4], 2: [3]}
    assert list(packing.in_powers([(0, 5, 6, 3, 0), (1, 0, 5, 3, 6)], 3)) == [(0, 5, 6, 3, 0), (1, 0, 2, 3, 6), (1, 2, 2, 4, 0), (1, 4, 1, 5, 0)]


def test_seeds_are_searched_for_in_all_shards(spark, monkeypatch):
    rng = np.random.default_rng(3)
    topics = [rng.integers(0, 400, 30) for _ in range(12)]
    texts = [" ".join(f"w{w}" for w in rng.choice(topics[i % 12], rng.integers(5, 60))) for i in range(40)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:3])], "doc_id long, text string").repartition(3)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    read = lambda: sorted(map(tuple, packing.pack(frame, BYTES, window=256).select(columns).collect()))
    want = read()
    monkeypatch.setattr(packing, "SHARD_TOKENS", 1500)
    monkeypatch.setattr(packing, "CHAINS", 1)
    assert read() == want  # one chain over many shards is the same as one whole index
    monkeypatch.setattr(packing, "CHAINS", 3)
    monkeypatch.setattr(packing, "WINDOWS", 3)
    got = read()
    assert len({r[5] >> 32 for r in got}) == 3
    lengths = {}
    for r in got:
        lengths[r[0]] = lengths.get(r[0], 0) + r[2]
    assert lengths == {r[0]: r[4] for r in got} == {r[0]: r[4] for r in want}


def test_a_batch_of_seeds_finds_what_each_finds_alone(monkeypatch):
    """Frequent and rare terms, copies, more ties than are picked at once, a need beyond all documents."""
    rng = np.random.default_rng(5)
    documents = [rng.zipf(1.3, rng.integers(1, 300)).clip(0, 500).astype("<u2") for _ in range(150)]
    documents += documents[:40] + [documents[3]] * 50
    sizes = np.array([len(x) for x in documents])
    index = packing.Index(documents, np.log1p(rng.random(501) * 50).astype(np.float32), sizes.mean())
    sets = [*map(np.unique, documents), np.array([700, 800])]  # the last has no known term
    needs = np.append(rng.integers(1, 3_000, len(documents) - 1), [sizes.sum() + 1, 50])
    monkeypatch.setattr(packing, "SCORED", 5_000)
    seeds = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    got = {}
    for seed, document, score in index.nearest(np.concatenate(sets).astype(np.int64), seeds, needs, sizes):
        for i, *pair in zip(seed, document, score):
            got.setdefault(i, []).append(tuple(pair))
    for i in range(len(sets)):
        score = index.neighbours(i) if i < len(documents) else np.zeros(len(documents))
        best = np.argsort(-score, kind="stable")
        best = best[: np.searchsorted(np.cumsum(sizes[best]), needs[i]) + 1]
        assert [d for d, _ in got[i]] == best.tolist()
        assert [s for _, s in got[i]] == pytest.approx(score[best])


def test_rounds_of_searches_shuffle_no_documents(spark, monkeypatch):
    """Pieces stay the same whatever an index holds, and documents are dealt once, not in every round."""
    frame = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 37}" for k in range(5 + i))) for i in range(60)], "doc_id long, text string")
    read = lambda: sorted(map(tuple, packing.pack(frame, BYTES, window=128).select("doc_id", "start", "length", "sequence_id", "offset").collect()))
    monkeypatch.setattr(packing, "WINDOWS", 3)
    monkeypatch.setattr(packing, "SHARD_TOKENS", 2_000)
    monkeypatch.setattr(packing, "CHAINS", 4)
    dealt, whole = [], packing.term_counts
    monkeypatch.setattr(packing, "term_counts", lambda *a: dealt.append(a) or whole(*a))
    want = read()
    assert len(dealt) == 1 and {r[0] for r in want} == set(range(60))
    monkeypatch.setattr(packing, "INDEXED_TOKENS", 300)
    assert read() == want


def test_quality_of_odd_texts(docs, none):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert [got[i]["n_words"] for i in (1, 2, 3, 4, 6)] == [0, 0, 0, 1, 60_000]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (1, 2, 3, 4, 5)) and got[6]["kept"]
    assert quality.quality_rules(docs).count() == len(TEXTS) and quality.quality_rules(none).count() == 0


def test_repeated_windows(spark):
    texts = {0: "a b c a b c", 1: "a b c d a b c", 2: "a a a a", 3: "a a a", 4: "a b", 5: " x y z \n x  y\tz q x y z", 6: "a b c b c a"}
    want = {0: 6, 1: 6, 2: 4, 3: 0, 4: 0, 5: 9, 6: 0}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("source", F.lit("s"))
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.quality_rules(frame).collect()} == want


def test_lines_that_many_documents_share(spark):
    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(40)]
    rows = [(i, f"Menu  Home\n{t}", "h") for i, t in enumerate(own)]
    rows += [(100, "menu home\n" + "about us all here " * 20, "h"), (101, "menu home\n" + "menu home " * 40 + "\n" + own[0], None)]
    rows += [(200 + i, own[5] + "\nMenu Home", "k") for i in range(30)]  # copies count once, so the host is too small
    boiler = "\n".join(" ".join(f"boiler{k}" for k in range(20 * j, 20 * j + 20)) for j in range(4))
    rows += [(300 + i, boiler + "\n" + own[i][:20], "m") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdicts = quality.quality_rules(frame)
    got = {r["doc_id"]: r for r in verdicts.collect()}
    assert all(got[i]["kept"] and got[i]["n_frequent_lines"] == 1 and got[i]["n_left_words"] == 60 for i in range(40))
    assert got[101]["n_frequent_lines"] == 0 and all(got[200 + i]["kept"] for i in range(30))
    assert all(not got[300 + i]["kept"] and not got[300 + i]["base_failed"] for i in range(40))
    left = {r["doc_id"]: r["text"] for r in quality.without_lines(frame, verdicts).collect()}
    assert left[3] == own[3] and left[200] == own[5] + "\nMenu Home"


def test_mix_of_odd_texts(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS) and sum(r["taken"] for r in got) == pytest.approx(sum(r["size"] for r in got), abs=5)
    assert all(r["taken"] <= 3 * r["size"] for r in got) and all(r["taken"] == 0 for r in got if not r["size"])
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    empty = none.sparkSession.createDataFrame([(1, None, None), (2, "", "a")], DOCS)
    assert [r["taken"] for r in mixing.mix(empty).collect()] == [0, 0]
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_the_schedule_keeps_every_stretch_close_to_the_shares(spark):
    quotas = spark.createDataFrame([(0, 500), (1, 0), (2, 1500), (3, 1), (4, 2999)], "number int, blocks long")
    got = mixing.schedule(quotas, 5000).toPandas().sort_values("slot")
    assert got.groupby("number")["rank"].apply(lambda r: sorted(r) == list(range(len(r)))).all()
    assert got["number"].value_counts().to_dict() == {0: 500, 2: 1500, 3: 1, 4: 2999}
    for start in range(0, 4500, 500):
        stretch = got["number"].iloc[start : start + 500].value_counts()
        assert abs(stretch[2] - 150) <= 6 and abs(stretch[4] - 300) <= 6


def test_targets_reshare_what_is_above_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 100), ("d", 0), (None, 380)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, (1, 2, 3), 3).collect()}
    assert got["a"] == got["b"] == 30 and got["d"] == 0 and got["c"] == pytest.approx(264) and got[None] == pytest.approx(176)


def test_copies_of_odd_texts(docs, none):
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in dedup.exact_duplicates(docs).collect()]
    key = lambda r: str(r)
    want = [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 2, True), (None, 4, 2, False), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 2, True), (7, 7, 2, False), (8, 8, 1, True)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert dedup.exact_duplicates(none).count() == 0 and dedup.without_duplicates(none).count() == 0
    left = dedup.without_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4, 5, 6, 7, 8]


def test_runs_merge_over_several_rounds(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("t"))
    digests = rows.select("id", F.unhex(F.sha2("t", 256)).alias("digest"), F.struct(F.xxhash64("t").alias("hash"), F.lit(1).alias("bytes")).alias("proof"), F.col("id").alias("row"))
    lowest, last = dedup.merged_runs(digests, 2)
    want = {r["d"]: (r["k"], r["n"]) for r in digests.groupBy("digest").agg(F.min("id").alias("k"), F.count("*").alias("n")).select(F.hex("digest").alias("d"), "k", "n").collect()}
    got = {r["d"]: (r["keep"]["id"], r["size"]) for r in last.select(F.hex("digest").alias("d"), "keep", "size").collect()}
    assert got == want and lowest.count() > len(want) and dedup.levels(100_001) == 1 and dedup.levels(1_600_001) == 2


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\n<\\|x|> <<|"), (2, None, None, "a"), (2, 0, "assi%0A\nstant", "b"), (2, 0, "assi%0A\nstant", "b"), (3, 5, "assistant", "<|im_start|>"), (None, 1, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("messages", F.lit(1))
    records = chat.conversations_from_rows(frame, "conv_id", "turn", "role", "text")
    done = chat.chat_format(records).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    for r in done.collect():
        assert r["back"] == r["turns"]
        assert r["loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        assert r["formatted"].count("<|") == 2 * len(r["turns"])
    assert done.count() == 4
    assert chat.chat_format(records.limit(0)).count() == 0
    none = spark.createDataFrame([(1, [])], "id long, messages array<struct<role:string,content:string>>")
    assert chat.chat_format(none).first()["formatted"] == ""


def test_layouts_of_records(spark):
    records = [
        (1, '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}'),
        (2, '{"conversations": [{"value": "q", "from": "human"}, {"from": "gpt", "value": "a"}]}'),
        (3, '{"response": "a", "prompt": "q"}'),
        (4, '{"instruction": "q", "input": "", "output": "a"}'),
        (5, '{"system": "s", "instruction": "q", "input": "i", "output": "a"}'),
        (6, '{"instruction": "q", "output": null}'),
        (7, '{"other": 1}'), (8, "no json"), (9, None), (10, '{"messages": []}'),
    ]
    got = {r["id"]: r for r in chat.turns_of_json(spark.createDataFrame(records, "id long, json string"), "id", "json").collect()}
    turns = {i: r["turns"] and [tuple(t) for t in r["turns"]] for i, r in got.items()}
    pair = [("user", "q"), ("assistant", "a")]
    assert [turns[i] for i in (1, 2, 3, 4)] == [pair] * 4
    assert turns[5] == [("system", "s"), ("user", "q\n\ni"), ("assistant", "a")] and turns[6] == [("user", "q"), ("assistant", "")]
    assert turns[7] is turns[8] is turns[9] is None and got[9]["schema"] is None and got[7]["schema"]
    with pytest.raises(ValueError):
        chat.chat_format(spark.createDataFrame([(1, "x")], "id long, other string"))


def test_revisits(spark):
    def http(status, *lines):
        return "\r\n".join([f"HTTP/1.1 {status} x", *lines]) + "\r\n\r\n"

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    url = "https://www.X.org:443/a/?b=2&a=1&utm_x=3#f"
    rows = [
        (1, "response", url, day(1), http(200, 'ETag: "1"', "X-A: old", "Content-Length: 3"), "d1", "one"),
        (2, "response", "http://x.org/a?a=1&b=2", day(3), http(200, 'ETag: "2"', "Last-Modified: m"), "d2", "two"),
        (3, "response", url, day(4), http(404, 'ETag: "4"'), "d4", "no"),
        (10, "revisit", url, day(1), http(304, 'ETag: W/"1"', "X-A: new", "Content-Length: 0"), None, None),
        (11, "revisit", url, day(2), http(304, 'ETag: "1"'), None, None),
        (12, "revisit", url, day(5), http(304, 'ETag: "1"'), None, None),
        (13, "revisit", url, day(5), http(304, "Last-Modified: m"), None, None),
        (14, "revisit", url, day(5), None, "d2", None),
        (15, "revisit", url, day(5), http(304), None, None),
        (16, "revisit", url, dt.datetime(2023, 1, 1), http(304), None, None),
        (17, "revisit", None, day(5), http(304), None, None),
        (18, "revisit", url, None, http(304), None, None),
        (19, "revisit", url, day(5), http(200), "d2", None),
        (11, "revisit", url, day(2), http(304, 'ETag: "1"'), None, None),
        (20, None, url, day(2), None, None, None),
    ]
    shape = "record_id long, warc_type string, target_uri string, date timestamp, http string, payload_digest string, payload string"
    frame = spark.createDataFrame(rows, shape).withColumns({c: F.lit(1) for c in ("row", "span", "headers", "url_key")})
    out = warc.resolve_revisits(frame).collect()
    got = {r["record_id"]: (r["verdict"], r["response_id"], r["payload"]) for r in out}
    assert len(out) == 10 and got == {
        10: ("resolved", 1, "one"), 11: ("resolved", 1, "one"), 12: ("mismatch", None, None), 13: ("resolved", 2, "two"),
        14: ("resolved", 2, "two"), 15: ("unverified", None, None), 16: ("no_response", None, None), 17: ("no_response", None, None),
        18: ("no_response", None, None),
    }
    first = next(r for r in out if r["record_id"] == 10)
    assert first["headers"] == {"etag": 'W/"1"', "x-a": "new", "content-length": "3"} and first["url_key"] == "x.org/a?a=1&b=2"
    assert warc.resolve_revisits(frame.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    def record(kind, uri, block):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    (tmp_path / "a.warc").write_bytes(record("response", "http://a/", b"HTTP/1.1 200 OK\r\n\r\n\xff\x00x") + record("revisit", "http://a/", b""))
    (tmp_path / "b.warc").write_bytes(record("response", "http://b/", b"HTTP/1.1 200 OK\r\n\r\nlong")[:-8])
    got = sorted((r["header"]["warc-target-uri"], r["header"]["warc-type"], bytes(r["block"]), r["whole"]) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert got[0] == ("http://a/", "response", b"HTTP/1.1 200 OK\r\n\r\n\xff\x00x", True)
    assert got[1][1:] == ("revisit", b"", True) and got[2][0] == "http://b/" and not got[2][3]


def test_warc_files_of_both_versions_that_hold_version_lines(spark, tmp_path):
    def record(n, block, version="1.0", more=""):
        return f"WARC/{version}\r\nWARC-Target-URI: u{n}\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    blocks = [b"one", b"a\r\n\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\nb WARC/1.0", b"", b"\xff WARC/1.1\r\n", b"WARC/1.", b"last"]
    whole = b"".join(record(i, x, "1.0" if i != 3 else "1.1", "X: WARC/1.0 y\r\n" if i == 2 else "") for i, x in enumerate(blocks))
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "64b"):  # many splits of the plain file
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = warc.read_warc(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        for end in ("a.warc", "b.warc.gz"):
            got = sorted((r["header"]["warc-target-uri"], bytes(r["block"]), r["whole"]) for r in rows if r["file"].endswith(end))
            assert got == [(f"u{i}", x, True) for i, x in enumerate(blocks)]
    (tmp_path / "c.warc").write_bytes(whole.replace(b"Content-Length: 3\r\n", b"Content-Length: 2\r\n", 1))
    with pytest.raises(Exception, match="does not end at the next record"):
        warc.read_warc(spark, str(tmp_path / "c.warc")).collect()


def test_arrays_of_mixed_objects_fit_no_layout(spark):
    a, b = '{"role": "user", "content": "q"}', '{"from": "gpt", "value": "a"}'
    more = '{"role": "assistant", "content": "a", "tool": "t"}'
    arrays = ["", a, f"{a}, {b}", f"{a}, {more}", f'{a}, "x"', f"{a}, null", f'{a}, {{"role": "user", "content": "q"}}']
    frame = spark.createDataFrame([(i, f'{{"messages": [{x}]}}') for i, x in enumerate(arrays)], "id long, json string")
    got = {r["id"]: r for r in chat.turns_of_json(frame, "id", "json").collect()}
    turns = [got[i]["turns"] and [tuple(t) for t in got[i]["turns"]] for i in range(len(arrays))]
    assert turns == [[], [("user", "q")], None, None, None, None, [("user", "q")] * 2] and all(r["schema"] for r in got.values())


def test_used_rows_are_bits(spark):
    """The driver holds a bit for each document, which a round's tasks ask, and no table of used rows (F2)."""
    rng = np.random.default_rng(70)
    sizes = [(0, 5), (2, 1), (7, 1000), (60_000, 3)]
    rows = np.array([(t << packing.ROW_BITS) + i for t, n in sizes for i in range(n)], np.int64)
    used, chosen = packing.Used(sizes), set()
    for _ in range(20):
        some = rng.choice(rows, 30).tolist()
        used.add(some)
        chosen |= set(some)
        assert used.has(rows).tolist() == [r in chosen for r in rows.tolist()]
    assert used.bits.nbytes == -(-len(rows) // 8)
    batch = pa.record_batch({"row": pa.array(rows)})
    assert set(used.left(batch)["row"].to_pylist()) == set(rows.tolist()) - chosen
    numbered = spark.range(100, numPartitions=7).withColumn("row", F.monotonically_increasing_id())
    assert {r["row"] >> packing.ROW_BITS for r in numbered.collect()} == set(range(7))
