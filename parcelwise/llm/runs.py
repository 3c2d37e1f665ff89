"""Periodic runs of words, found by comparing positions through a recompressed grammar of the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_WORDS = 200_000  # of texts that share a grammar; a longer text has its own
CANDIDATES = 1 << 20  # pairs of positions compared at once


class Grammar:
    """A run-length grammar of a sequence of numbers, built by recompression, and the longest extensions it answers.

    Levels alternate. An even one turns each block of equal symbols into one symbol named by symbol and length. An odd
    one deals the symbols out to two sides by chance and turns each pair of a left and a right symbol into one named by
    both. Equal stretches are parsed alike but near their ends, so two positions are compared by climbing while both
    begin a symbol, and by coming down again from the first symbols that differ: a constant number of steps a level.
    Names are given by sorting, so equal names mean equal stretches. Numbers from ``fixed`` on end a text: they must
    differ from all others and stay symbols of their own. Levels are built while any comparison still climbs.
    """

    def __init__(self, symbols: np.ndarray, fixed: int):
        self.symbols = [symbols.astype(np.int64)]  # of each level
        self.fixed = (fixed, fixed + len(symbols))  # names of ends; others are given from there on
        self.names = self.fixed[1]
        self.start: list[np.ndarray] = []  # of each symbol of the level above, in the level
        self.above: list[np.ndarray] = []  # the symbol of the level above that holds each symbol
        self.chance = np.random.default_rng(len(symbols))

    def _climb(self) -> None:
        """Adds a level."""
        level = len(self.start)
        s = self.symbols[level]
        n = len(s)
        begins = np.ones(n, bool)
        if level % 2 == 0:
            begins[1:] = s[1:] != s[:-1]
            start = np.flatnonzero(begins)
            size = np.diff(start, append=n)
            names = s[start].copy()
            long = np.flatnonzero(size > 1)
            made = np.stack([names[long], size[long]], axis=1)
        else:
            low, high = self.fixed
            kinds, kind = np.unique(s, return_inverse=True)
            side = self.chance.integers(0, 2, len(kinds)).astype(np.int8)
            side[(kinds >= low) & (kinds < high)] = 2
            side = side[kind]
            ways = [(side[:-1] == a) & (side[1:] == 1 - a) for a in (0, 1)]
            pair = max(ways, key=np.count_nonzero) if n > 1 else np.zeros(0, bool)
            begins[1:][pair] = False
            start = np.flatnonzero(begins)
            names = s[start].copy()
            long = np.flatnonzero(np.diff(start, append=n) > 1)
            made = np.stack([names[long], s[start[long] + 1]], axis=1)
        if len(made):
            order = np.lexsort((made[:, 1], made[:, 0]))
            fresh = np.ones(len(made), bool)
            fresh[1:] = (made[order][1:] != made[order][:-1]).any(axis=1)
            names[long[order]] = self.names + np.cumsum(fresh) - 1
            self.names += int(fresh.sum())
        self.start.append(start)
        self.above.append(np.cumsum(begins) - 1)
        self.symbols.append(names)

    def extension(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols from ``a`` on equal those from ``b`` on; with ``back``, those before ``a`` and before ``b``.

        Both are positions in texts that end by a symbol of their own, and ``a`` lies before ``b``; before the first
        text stands an end as well, so that no comparison leaves the sequence.
        """
        shift = -1 if back else 0
        origin, a, b = a, a.astype(np.int64).copy(), b.astype(np.int64).copy()
        highest = np.zeros(len(a), np.int64)
        open_ = np.arange(len(a))
        level = 0
        while len(open_):  # up
            s = self.symbols[level]
            highest[open_] = level
            open_ = open_[s[a[open_] + shift] == s[b[open_] + shift]]
            if not len(open_):
                break
            if level == len(self.start):
                self._climb()
            x, y = a[open_], b[open_]
            step = np.where(self._both_begin(level, x, y), 0, self._step(level, x, y, back))
            x, y = x + (-step if back else step), y + (-step if back else step)
            a[open_], b[open_] = x, y
            on = self._both_begin(level, x, y)  # otherwise they differ here, in the length of a block
            open_ = open_[on]
            a[open_], b[open_] = self.above[level][a[open_]], self.above[level][b[open_]]
            level += 1
        for level in range(int(highest.max(initial=0)) - 1, -1, -1):  # and down
            down = np.flatnonzero(highest > level)
            x, y = self.start[level][a[down]], self.start[level][b[down]]
            s = self.symbols[level]
            same = s[x + shift] == s[y + shift]
            step = np.where(same, self._step(level, x, y, back), 0)
            a[down], b[down] = x + (-step if back else step), y + (-step if back else step)
        return np.abs(a - origin)

    def _both_begin(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        start, above = self.start[level], self.above[level]
        return (start[above[x]] == x) & (start[above[y]] == y)

    def _step(self, level: int, x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
        """To the next, or last, boundary of the level above that one of both positions meets, where symbols are equal."""
        if level % 2:
            return np.ones(len(x), np.int64)
        start, above = self.start[level], self.above[level]
        if back:
            return np.minimum(x - start[above[x - 1]], y - start[above[y - 1]])
        ends = np.append(start[1:], len(above))
        return np.minimum(ends[above[x]] - x, ends[above[y]] - y)


def grid(sizes: np.ndarray, first: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(position, period)`` of candidates, in pieces: of each text and period, every ``exponent - 1`` periods one.

    A run of at least ``exponent`` periods holds one of these positions and the one a period behind it.
    """
    each = sizes // exponent
    offset = np.append(0, np.cumsum(each))
    done = 0
    while done < offset[-1]:
        # about as many pairs of text and period as give the wanted number of candidates
        many = np.arange(done, min(done + CANDIDATES // 4, offset[-1]))
        text = np.searchsorted(offset, many, "right") - 1
        period = many - offset[text] + 1
        count = -(-(sizes[text] - period) // ((exponent - 1) * period))
        total = np.cumsum(count)
        use = max(1, int(np.searchsorted(total, CANDIDATES, "right")))
        text, period, count, total = text[:use], period[:use], count[:use], total[:use]
        k = np.arange(total[-1]) - np.repeat(total - count, count)
        wide = np.repeat(period, count)
        yield np.repeat(first[text], count) + k * wide * (exponent - 1), wide
        done += use


def runs(words: list[np.ndarray], exponent: int = 4, least: int = 6) -> np.ndarray:
    """``(text, start, end, period)`` of all runs, in the order of text, start and period.

    A run is a stretch of at least ``exponent`` of its smallest periods and ``least`` words that can't be longer.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    if not sizes.sum():
        return np.zeros((0, 4), np.int64)
    # an end before each text and behind the last
    fixed = int(max(w.max(initial=0) for w in words)) + 1
    line = np.full(sizes.sum() + len(words) + 1, -1, np.int64)
    first = np.cumsum(sizes + 1) - sizes
    inside = np.ones(len(line), bool)
    inside[np.append(first - 1, len(line) - 1)] = False
    line[inside] = np.concatenate(words)
    line[~inside] = fixed + np.arange(len(words) + 1)
    grammar = Grammar(line, fixed)
    found = [np.zeros((0, 3), np.int64)]
    for at, period in grid(sizes, first, exponent):
        equal = line[at] == line[at + period]  # a run's candidate has equal words here
        at, period = at[equal], period[equal]
        ahead = grammar.extension(at, at + period)
        before = grammar.extension(at, at + period, back=True)
        whole = ahead + before + period
        enough = whole >= np.maximum(least, exponent * period)
        start = at[enough] - before[enough]
        found.append(np.stack([start, start + whole[enough], period[enough]], axis=1))
    # a stretch of a period has its multiples as well: the smallest counts
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    keep = np.ones(len(every), bool)
    keep[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[keep]
    text = np.searchsorted(first, every[:, 0], "right") - 1
    out = np.column_stack([text, every[:, 0] - first[text], every[:, 1] - first[text], every[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def periodic_runs(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    exponent: int = 4,
    least: int = 6,
    edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``(id, runs, collapsed)`` of each row of ``docs``.

    ``runs`` holds ``(start, length, period)`` of each stretch of words that has at least ``exponent`` of its smallest
    periods and ``least`` words and can't be longer, by start and period. ``collapsed`` is the text with one period left
    of each run: a word goes if any run holds it behind the run's first period, and one space parts the others. ``edit``
    may change the words of a text first.

    Words are what ASCII white space parts, numbered from 0. Texts are taken in batches of about ``BATCH_WORDS`` words;
    their grammars, candidates and runs grow with a batch, or with one longer text. Nothing is shuffled.

    A null or empty text has no words, no runs and an empty collapsed text. A null id stays null. Repeated rows give a
    row each. An empty table gives an empty table. Other columns aren't used, whatever their names.
    """
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            known: dict[bytes, int] = {}
            numbers = [np.array([known.setdefault(w, len(known)) for w in words], np.int64) for words in texts]
            found = runs(numbers, exponent, least)
            bounds = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
            collapsed = [without_repeats(words, found[a:b, 1:]) for words, a, b in zip(texts, bounds, bounds[1:])]
            fields = [pa.array(c) for c in (found[:, 1], found[:, 2] - found[:, 1], found[:, 3])]
            spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(run_type)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), spans, pa.array(collapsed, pa.binary())], names=["id", "runs", "collapsed"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch["id"].to_pylist(), batch["text"]):
                words = (t.as_py() or b"").split()  # at ASCII white space
                words = edit(i, words) if edit else words
                if texts and size + len(words) > BATCH_WORDS:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(words)
                size += len(words)
        if texts:
            yield flush(ids, texts)

    rows = docs.select(docs[id].cast("long").alias("id"), docs[text].cast("binary").alias("text"))
    found = rows.mapInArrow(run, "id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def without_repeats(words: list[bytes], found: np.ndarray) -> bytes:
    """The words, joined by spaces, but for those behind the first period of a run ``(start, end, period)``."""
    if not len(found):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 1], -1)
    return b" ".join(w for w, x in zip(words, np.cumsum(change).tolist()) if not x)
