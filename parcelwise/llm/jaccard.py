"""Similarity join of documents on word n-grams, through parity sketches."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .storage import written
from .tokens import balanced

REMEMBERED = 300_000  # word hashes that a task keeps
BAND_RATIO = 2  # a size band ends where the next starts, this much higher
SPARE = 1.25  # blocks of a sketch for each that may differ
FOLDED = 8  # 64-bit words of the sketch kept beside a document
CHUNK_KEYS = 1 << 20  # block keys that a task sorts at once
ATTEMPTS = 2  # rounds of single pairs before all pairs of what is left
BROADCAST_IDS = 1 << 20  # ids broadcast to choose texts; more are joined by shuffle


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of hashed word n-grams, with the hashes of frequent words remembered."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingles of each text as 64-bit hashes; with fewer words, the whole sequence is one."""
        words = [t.lower().split() for t in texts]  # of bytes: A-Z only, ASCII white space only
        distinct = {w for each in words for w in each}
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
        self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in distinct if w not in self.known)
        out = []
        for each in words:
            n = len(each)
            h = np.fromiter(map(self.known.__getitem__, each), np.uint64, n)
            windows = max(n - self.width + 1, min(n, 1))
            x = np.full(windows, min(n, self.width), np.uint64)
            for k in range(min(n, self.width)):
                x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + windows])
            out.append(np.unique(x))
        return out


class Bands:
    """Size bands and, for each, the number of blocks that a sketch is cut into.

    Sets with a similarity of at least t differ in at most (|A| + |B|)(1 - t)/(1 + t) shingles. Every shingle flips one
    bit of a sketch, so the sketches differ in no more bits, and in no more blocks, than that. A pair meets in the band
    of its larger set; a set that could be the smaller partner of one in the next band is also cut as that band's are.
    """

    def __init__(self, similarity: Fraction, ratio: int = BAND_RATIO):
        self.t, self.ratio = similarity, ratio
        self.edges = [1]
        self.known: dict[int, list[tuple[int, int, int]]] = {}

    def differing(self, total: int) -> int:
        return int(total * (1 - self.t) / (1 + self.t))

    def cuts(self, size: int) -> list[tuple[int, int, int]]:
        """(band, blocks, most blocks that differ) for a set of ``size``."""
        if size in self.known:
            return self.known[size]
        while self.edges[-1] <= self.ratio * size / self.t:
            self.edges.append(self.edges[-1] * self.ratio)
        found = []
        for band, (low, high) in enumerate(zip(self.edges, self.edges[1:])):
            if low <= size < high or (low > size and size >= self.t * low):
                differing = self.differing(size + min(high - 1, int(size / self.t)))
                found.append((band, int(SPARE * self.differing(2 * (high - 1))) + 1, differing))
        self.known[size] = found
        return found


def _block_keys(x: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of blocks, equal for two sets if and, but for hash collisions, only if the blocks are.

    A block is a wide stretch of bits with few of them set; it is kept as the XOR of a code for each flipped bit. If at
    most d blocks differ, then of two sets' blocks in one order, the first d + 1 of each have one in common. The order
    puts blocks with many shingles first, so that those which say little, empty ones above all, are left out. Sets that
    must be equal to link (d = 0) need no keys.
    """
    place, code = _mixed(x + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(11), _mixed(x ^ np.uint64(0x8EBC6AF09C88C6E3))
    keys = [np.empty(0, np.uint64)]
    for band, blocks, differing in bands.cuts(len(x)):
        if differing:
            at = (place % np.uint64(blocks)).astype(np.int64)
            sketch = np.zeros(blocks, np.uint64)
            np.bitwise_xor.at(sketch, at, code)
            name = np.arange(blocks, dtype=np.uint64) + np.uint64((band + 1) << 40)
            key = _mixed(_mixed(sketch) + _mixed(name))
            keys.append(key[np.lexsort((key, -np.bincount(at, minlength=blocks)))[: differing + 1]])
    return np.concatenate(keys)


def _folded(x: np.ndarray) -> np.ndarray:
    """The whole sketch in a few words; its distance is a lower bound of the symmetric difference as well."""
    sketch = np.zeros(FOLDED, np.uint64)
    np.bitwise_xor.at(sketch, (x >> np.uint64(6)) % np.uint64(FOLDED), np.uint64(1) << (x & np.uint64(63)))
    return sketch


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64)


def _digest(x: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None


SKETCHED = "id long, n long, digest binary, folded array<bigint>, keys array<bigint>"


def sketches(docs: DataFrame, id: str, text: str, width: int, similarity: Fraction) -> DataFrame:
    """``(id, n, digest, folded, keys)`` of every row: set size, hash of the whole set, folded sketch, block keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bands = Shingles(width), Bands(similarity)
        for batch in batches:
            at = 0
            for texts in balanced((t.as_py() or b"") for t in batch["text"]):
                sets = shingles.of(texts)
                some = [x if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].slice(at, len(texts)),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([_digest(x) for x in sets], pa.binary()),
                        pa.array([x if x is None else _signed(_folded(x)) for x in some], pa.list_(pa.int64())),
                        pa.array([x if x is None else _signed(_block_keys(x, bands)) for x in some], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "digest", "folded", "keys"],
                )
                at += len(texts)

    rows = docs.select(docs[id].cast("long").alias("id"), docs[text].cast("binary").alias("text"))
    return rows.mapInArrow(run, SKETCHED)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(digest, shingles)`` of rows ``(text binary)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            for texts in balanced((t.as_py() or b"") for t in batch["text"]):
                sets = shingles.of(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_digest(x) for x in sets], pa.binary()),
                        pa.array([_signed(x) for x in sets], pa.list_(pa.int64())),
                    ],
                    names=["digest", "shingles"],
                )

    return docs.select("text").mapInArrow(run, "digest binary, shingles array<bigint>")


def _within(similarity: Fraction) -> Column:
    """True unless the sizes or the folded sketches of sides ``a`` and ``b`` rule a link out."""
    num, den = similarity.numerator, similarity.denominator
    a, b = F.col("a_n"), F.col("b_n")
    distance = sum((F.bit_count(F.col("a_folded")[k].bitwiseXOR(F.col("b_folded")[k])) for k in range(FOLDED)), F.lit(0))
    return (F.least(a, b) * den >= F.greatest(a, b) * num) & (distance * (den + num) <= (a + b) * (den - num))


def block_stars(rows: DataFrame) -> DataFrame:
    """``(key, node, hub, k)``: within some of a task's rows at a time, the first holder of each block is its hub.

    Rows of one set are one holder. ``k`` is the number of holders on the hub's own row, else 0. A block that a third
    of all rows share leaves a task as one hub; its other holders are named beside it and aren't shuffled by the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, np.ndarray]] = {}
        held = 0
        for batch in batches:
            keys = batch["keys"]
            bounds, values = keys.offsets.to_numpy(), keys.values.to_numpy()
            for i, (row, digest) in enumerate(zip(batch["row"].to_pylist(), batch["digest"].to_pylist())):
                if digest is not None and digest not in seen:
                    seen[digest] = row, values[bounds[i] : bounds[i + 1]]
                    held += bounds[i + 1] - bounds[i]
                    if held >= CHUNK_KEYS:
                        yield stars(seen)
                        seen, held = {}, 0
        if seen:
            yield stars(seen)

    def stars(seen: dict) -> pa.RecordBatch:
        owners, blocks = zip(*seen.values())
        key = np.concatenate([np.empty(0, np.int64), *blocks])
        node = np.repeat(np.array(owners, np.int64), [len(x) for x in blocks])
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        first = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1]))
        k = np.zeros(len(key), np.int64)
        k[first] = size = np.diff(np.append(first, len(key)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node, np.repeat(node[first], size), k)], names=["key", "node", "hub", "k"])

    return rows.select("row", "digest", "keys").mapInArrow(run, "key long, node long, hub long, k long")


def shared_blocks(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``(key, node, hub)`` for every class that holds a block which another holds as well; the hub is one of them."""
    stars = block_stars(rows)
    of_key = Window.partitionBy("key")  # holds a row for each chunk of rows at most
    hubs = stars.where("k > 0").withColumns({"hub": F.min("node").over(of_key), "holders": F.sum("k").over(of_key)})
    found = hubs.where("holders > 1").select("key", "node", "hub").unionByName(stars.where("k = 0").select("key", "node", "hub"))
    found = written(found, "stars")
    named = rows.select("row", "digest").join(classes.select("digest", F.col("node").alias("class")), "digest")
    for end in ("node", "hub"):
        found = found.join(named.select(F.col("row").alias(end), "class"), end).drop(end).withColumnRenamed("class", end)
    return written(found.groupBy("key", "node").agg(F.min("hub").alias("hub")), "blocks")


def _sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """``(node, shingles)`` of some classes, from the texts of rows with their ids; a row may come more than once."""
    wanted = written(classes.join(nodes, "node").select("node", "id", "digest"), "wanted")
    texts = docs.select(docs[id].cast("long").alias("id"), docs[text].cast("binary").alias("text"))
    ids = wanted.select("id").distinct()
    # the join only chooses rows; with few ids the texts need no shuffle for it
    texts = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    # a row that shares the id but not the set is recognised by its digest
    return written(shingle_sets(texts, width).join(wanted, "digest").select("node", "shingles"), "sets")


def links(rows: DataFrame, classes: DataFrame, docs: DataFrame, id: str, text: str, width: int, similarity: Fraction) -> DataFrame:
    """Linked pairs ``(u, v)`` that connect the same classes as all links do.

    Rows of ``classes`` are distinct sets. First every class is checked against one hub, that of the most blocks it
    shares: at most as many pairs as classes. What links is one component from then on. Then each block that still spans
    several components tries one holder of each against one of its largest, a few times, so that large parts of a group
    meet. At last, in blocks that even then span several, every pair of different components is checked. So no link
    between components is missed, and pairs inside a component, of which a large group has many, are not formed.
    """
    num, den = similarity.numerator, similarity.denominator
    shared = shared_blocks(rows, classes)
    about = classes.select("node", "n", "folded")

    def side(name: str) -> DataFrame:
        return about.select(*[F.col(c).alias(f"{name}_{c}") for c in about.columns]).withColumnRenamed(f"{name}_node", name)

    def checked(pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b), with ``linked``."""
        left = written(pairs, "pairs")
        nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
        sets = _sets_of(nodes, classes, docs, id, text, width)
        both = (
            left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set")), "b")
            .withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
        )
        union = F.size("a_set") + F.size("b_set") - F.col("common")
        return written(both.select("a", "b", (den * F.col("common") >= num * union).alias("linked")), "links")

    near = _within(similarity)
    votes = shared.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    star = votes.groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
    star = star.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    first = checked(star.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b"))

    def spanning(edges: DataFrame) -> DataFrame:
        """``(key, node, component, n, folded)``: the holders of blocks that lie in several components."""
        named = shared.select("key", "node").join(components(edges), "node", "left")
        named = named.withColumn("component", F.coalesce("component", "node"))
        spans = named.groupBy("key").agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.count("*").alias("k"),
            F.bit_xor(F.xxhash64("node")).alias("x"),
            F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        )
        # blocks with the same holders give the same pairs
        split = spans.where("low < high").groupBy("k", "x", "y").agg(F.min("key").alias("key"))
        return written(named.join(split.select("key"), "key").join(about, "node"), "spanning")

    def ends(of: DataFrame, name: str) -> DataFrame:
        return of.select("key", *[F.col(c).alias(f"{name}_{c}") for c in ("node", "component", "n", "folded")])

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))

    seen, edges = first, linked(first)
    for attempt in range(ATTEMPTS):
        # in each block, a holder of every component against one of the component that holds most of it
        one = F.struct(F.xxhash64("key", "node", F.lit(attempt)).alias("h"), "node", "n", "folded")
        chosen = spanning(edges).groupBy("key", "component").agg(F.count("*").alias("size"), F.min(one).alias("b"))
        most = F.max_by(F.struct("component", "b"), F.struct("size", -F.col("component"))).over(Window.partitionBy("key"))
        tried = chosen.withColumn("most", most).where(F.col("component") != F.col("most.component"))
        sides = [F.col(f"{s}.{c}").alias(f"{e}_{c}") for s, e in (("most.b", "a"), ("b", "b")) for c in ("node", "n", "folded")]
        tried = tried.select(*sides).where(near).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
        found = checked(tried.distinct().join(seen, ["a", "b"], "left_anti"))
        seen, edges = seen.unionByName(found), edges.unionByName(linked(found))
        if not found.where("linked").take(1):
            break

    holders = spanning(edges)
    a, b = ends(holders, "a"), ends(holders, "b")
    rest = a.join(b, (a["key"] == b["key"]) & (F.col("a_node") < F.col("b_node")) & (F.col("a_component") != F.col("b_component")) & near)
    rest = rest.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    last = checked(rest.join(seen, ["a", "b"], "left_anti"))
    return edges.unionByName(linked(last))


def jaccard_components(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, similarity: Fraction = Fraction(4, 5)
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row: what is reachable over links of at least ``similarity``.

    Texts are lower-cased (A-Z) and parted at ASCII white space; a set holds the distinct ``width``-word shingles, with
    fewer words the whole sequence as one. The n-gram Jaccard similarity of two sets decides a link, exactly (on 64-bit
    shingle hashes). A component is named by its smallest id; documents of equal sets are one class and share it.

    A null or empty text, or one without words, has size 0 and links with nothing, so its component is its own id.
    Repeated rows and rows that share an id each get a row. A null id is kept; such rows link only with equal sets, and
    a component of null ids alone has a null name. An empty table gives an empty table. Other columns aren't used.
    """
    rows = written(sketches(docs, id, text, width, similarity).withColumn("row", F.monotonically_increasing_id()), "sketches")
    grouped = rows.where("n > 0").groupBy("digest").agg(
        F.min("row").alias("node"),
        F.min("id").alias("id"),
        F.first("n").alias("n"),
        F.first("folded").alias("folded"),
    )
    classes = written(grouped, "classes")
    found = components(links(rows, classes, docs, id, text, width, similarity))
    named = classes.select("digest", "node", "id").join(found, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("digest", "component_id")
    # rows without words match nothing; a key of their own spreads them
    spread = F.coalesce("digest", F.col("row").cast("string").cast("binary"))
    joined = rows.select("id", "n", spread.alias("digest")).join(named, "digest", "left")
    return joined.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )
