"""Queries of the training-data operators against plain Python, on the smallest tables."""

import collections
import hashlib
import html
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parcelwise.llm.queries import llm_queries

SMALL = "/root/testdata/sf0.001"
QUERIES = llm_queries()
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    return {r["doc_id"]: r for r in rows}


def result(spark, name):
    return QUERIES[name](spark, SMALL).toPandas()


def test_every_operator_has_one_query():
    numbers = [re.match(r"op(\d+)_", n) for n in QUERIES]
    assert sorted(int(m[1]) for m in numbers if m) == list(range(1, 14)) and "pipeline" in QUERIES


def test_token_counts(spark, docs):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = result(spark, "op1_token_counts").set_index("doc_id")
    assert len(got) == len(docs)
    for i, r in docs.items():
        n = len(model.encode(r["text"] or "", add_special_tokens=False).ids)
        assert tuple(got.loc[i, ["n_bytes", "n_tokens", "over_limit"]]) == (len((r["text"] or "").encode()), n, n > 2048)


def classes(sets, similarity):
    """Smallest id reachable over links of at least ``similarity``."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and common >= similarity * (len(sets[a]) + len(sets[b]) - common):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: root(i) for i in sets}


def shingles(text, width):
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def test_ngram_jaccard(spark, docs):
    sets = {i: shingles(r["text"], 3) for i, r in docs.items()}
    want = classes(sets, 0.9)
    got = result(spark, "op3_ngram_jaccard")
    assert len(got) == len(docs)
    for r in got.itertuples():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def test_html_extraction(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = result(spark, "op4_html_extraction")
    assert len(got) == len(pages)
    for r in got.itertuples():
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        plain = html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article)))
        assert r.text == re.sub(r"\s+", " ", plain).strip() and r.n_chars == len(r.text)


def check_packing(got, ids, key="doc_id"):
    """Every id is in one piece, sequences are gapless and full or a power of two."""
    for r in got.itertuples():
        part = ids[getattr(r, key)][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert set(got[key]) == set(ids)
    for i, pieces in got.sort_values("start").groupby(key):
        assert (pieces["start"].to_numpy() == np.append(0, np.cumsum(pieces["length"])[:-1])).all()
        assert pieces["length"].sum() == len(ids[i]) == pieces["doc_tokens"].iloc[0]
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert (sequence["offset"].to_numpy() == np.append(0, np.cumsum(sequence["length"])[:-1])).all()
        n = int(sequence["length"].sum())
        assert n <= 1024 and n & (n - 1) == 0


def test_packing(spark, docs):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*model.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for i, r in docs.items()}
    got = result(spark, "op5_packing")
    check_packing(got, ids)
    short = got.groupby("sequence_id")["length"].sum()
    assert (short < 1024).sum() <= 10  # of the one shard's rest


def test_quality_rules(spark, docs):
    got = result(spark, "op7_quality_rules").set_index("doc_id")
    for i, r in docs.items():
        words = WORD.findall(r["text"].encode())
        windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in r["text"].split("\n") if x.strip(" \t\x0b\x0c\r")]
        row = got.loc[i]
        assert row["n_words"] == len(words) and row["n_repeat_words"] == len(covered)
        assert row["word_chars"] == sum(len(w.decode()) for w in words)
        assert row["n_symbols"] == sum(r["text"].count(c) for c in "#*$%&|<>")
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (row["kept"] and row["base_failed"])


def test_source_mixing(spark, docs):
    got = result(spark, "op8_source_mixing")
    sizes = {i: len(WORD.findall((r["text"] or "").encode())) for i, r in docs.items()}
    by_source = collections.Counter()
    for i, r in docs.items():
        by_source[r["source"]] += sizes[i]
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight, total = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}, sum(sizes.values())
    target, left = {}, set(names)
    while left:  # reshare what is above three times a source's size
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if share[s] > 3 * by_source[s]}
        target.update({s: 3.0 * by_source[s] for s in above} if above else share)
        left = left - above if above else set()
    for source, rows in got.groupby("source"):
        assert rows["target"].iloc[0] == pytest.approx(target[source]) and rows["source_size"].iloc[0] == by_source[source]
        assert rows["taken"].sum() == round(target[source])
    for r in got.itertuples():
        assert r.size == sizes[r.doc_id] and 0 <= r.taken <= 3 * r.size
    again = result(spark, "op8_source_mixing")
    assert got.set_index("doc_id")["taken"].to_dict() == again.set_index("doc_id")["taken"].to_dict()


def test_exact_dedup(spark, docs):
    sums = {i: hashlib.sha256(re.sub(rb"[\x20\x09-\x0D]+", b" ", (r["text"] or "").encode())).hexdigest() for i, r in docs.items()}
    groups = collections.defaultdict(list)
    for i, s in sums.items():
        groups[s].append(i)
    got = result(spark, "op9_exact_dedup")
    assert len(got) == len(docs)
    for r in got.itertuples():
        group = groups[sums[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(group), len(group), r.doc_id == min(group), sums[r.doc_id])


def test_pipeline_equals_its_stages_by_hand(spark, docs):
    quality = result(spark, "op7_quality_rules")
    left = {i: docs[i] for i in quality[quality["kept"]]["doc_id"]}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(rb"[\x20\x09-\x0D]+", b" ", left[i]["text"].encode()), i)
    left = {i: left[i] for i in first.values()}
    found = classes({i: shingles(r["text"], 5) for i, r in left.items()}, 0.8)
    left = {i: r for i, r in left.items() if found[i] == i}

    import corpus_pipeline

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    reached = table
    for name, stage in corpus_pipeline.STAGES[:3]:
        reached = stage(spark, reached, SMALL)
        assert reached.columns == table.columns
    assert {r["doc_id"] for r in reached.select("doc_id").collect()} == set(left) and reached.count() == len(left)

    from parcelwise.llm.mixing import mix

    taken = {r["doc_id"]: r for r in mix(reached).collect()}
    copies = {i: int(np.floor(r["taken"] / r["size"] + 0.5)) if r["size"] else 1 for i, r in taken.items()}
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert got.groupby("doc_id")["row"].nunique().to_dict() == {i: n for i, n in copies.items() if n}
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r: np.array([*model.encode(docs[i]["text"], add_special_tokens=False).ids, 0], "<u4") for i, r in set(zip(got["doc_id"], got["row"]))}
    check_packing(got, ids, key="row")
