"""Token counts and token ids of whole texts by public tokenizer files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20  # text handled at once
CALL_BYTES = 1 << 17  # text given to the tokenizer in one call
REMEMBERED = 300_000  # words whose result a task keeps
LONG_WORD = 512  # bytes; longer words are not remembered
# characters whose classes all regex engines agree on: Latin, Greek, Cyrillic, punctuation, Kana, Han, Hangul
COMMON = re.compile("[^\\u0000-\\u052f\\u2000-\\u20cf\\u3000-\\u30ff\\u4e00-\\u9fa5\\uac00-\\ud7a3\\uff00-\\uffef]")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: of byte-level pre-tokenizers


class Tokenizer:
    """A tokenizer file, loaded once in each Python worker."""

    loaded: dict[str, Tokenizer] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.sentences = path.endswith(".model")
        if self.sentences:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = self.library.get_piece_size()
        else:
            from tokenizers import Tokenizer as Library

            self.library = Library.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            self.size = self.library.get_vocab_size()
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.lengths: dict[bytes, int] = {}

    @classmethod
    def at(cls, path: str) -> Tokenizer:
        return cls.loaded.get(path) or cls.loaded.setdefault(path, cls(path))

    def encoded(self, texts: list[str]) -> Iterator:
        """Encodings, in calls of about equal bytes."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CALL_BYTES):
                size += len(texts[end])
                end += 1
            if self.sentences:
                yield from self.library.encode(texts[at:end], num_threads=1)
            else:
                yield from self.library.encode_batch_fast(texts[at:end], add_special_tokens=False)
            at = end

    def count(self, texts: list[bytes]) -> list[int]:
        """Number of tokens of each text.

        A tokenizer that never joins what white space parts (``splits_at_space``) sees every distinct word once; its
        lengths add up to the text's. Others get whole texts.
        """
        if not self.splits_at_space:
            return [len(x) for x in self.encoded([t.decode("utf-8", "replace") for t in texts])]
        words = [t.split() for t in texts]
        unseen = [w for w in {w for each in words for w in each} if w not in self.lengths]
        if len(self.lengths) + len(unseen) > REMEMBERED:
            self.lengths.clear()
            unseen = list({w for each in words for w in each})
        encodings = self.encoded([w.decode("utf-8", "replace") for w in unseen])
        self.lengths.update(zip(unseen, map(len, encodings), strict=True))
        known = self.lengths.__getitem__
        counts = [sum(map(known, each)) for each in words]
        for w in [w for w in unseen if len(w) > LONG_WORD]:
            del self.lengths[w]
        return counts

    @cached_property
    def splits_at_space(self) -> bool:
        """True if white space is dropped and ends a word, so that texts may be cut at every ASCII white space.

        Found by a probe: no white space on either side of a word may change its count.
        """
        probes = ("ab", " ab", "ab ", "\n\tab", "ab \n ", "ab\x0b\x0c\r")
        sizes = {len(x) for x in self.encoded(list(probes))}
        parts, whole = self.encoded(["Ab c", "1x"]), self.encoded(["Ab c 1x"])
        return not self.sentences and len(sizes) == 1 and sum(map(len, parts)) == len(next(whole))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text.

        A plain byte-level BPE has an equal in ``tiktoken``, several times as fast; texts with characters that the two
        libraries might class differently are left to the tokenizer itself.
        """
        plain = [k for k, t in enumerate(texts) if self.equal and not COMMON.search(t)]
        out = {k: self.equal.encode_to_numpy(texts[k], allowed_special="all").astype(self.type).tobytes() for k in plain}
        rest = [k for k in range(len(texts)) if k not in out]
        out.update((k, self.packed(x)) for k, x in zip(rest, self.encoded([texts[k] for k in rest]), strict=True))
        return [out[k] for k in range(len(texts))]

    @cached_property
    def equal(self):
        """The same byte-level BPE in ``tiktoken``, or None if the file asks for anything else."""
        if self.sentences:
            return None
        told = json.loads(self.library.to_str())
        model, split = told["model"], told["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not plain or told["normalizer"] or model["type"] != "BPE" or model.get("end_of_word_suffix"):
            return None
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        kept = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
        letters = {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in kept)}
        ranks = {bytes(letters[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [model["vocab"][m] for m in merges]
        if order != sorted(order):  # merges rank as they are listed there, by id here
            return None
        import tiktoken

        return tiktoken.Encoding("equal", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def packed(self, encoding) -> bytes:
        return np.asarray(encoding if self.sentences else encoding.ids, dtype=self.type).tobytes()


def slices(text: bytes, limit: int = BATCH_BYTES) -> list[bytes]:
    """A long text in parts of about ``limit`` bytes, each cut before an ASCII white space after another character.

    Where there is none, the part goes on.
    """
    out, at = [], 0
    boundary = re.compile(rb"(?<=[^\s\x80-\xff\x1c-\x1f])[ \t\n\r\x0b\x0c]")
    while len(text) - at > limit:
        found = boundary.search(text, at + limit)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def balanced(texts: Iterator[bytes], limit: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """Lists of consecutive texts of about ``limit`` bytes."""
    batch, size = [], 0
    for t in texts:
        if batch and size + len(t) > limit:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch


def token_lengths(text: Column, tokenizer: str) -> Column:
    """Number of tokens of a binary column (UTF-8), as a long."""

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Tokenizer.at(tokenizer)
        for batch in batches:
            parts = [slices(t.as_py() or b"") if model.splits_at_space else [t.as_py() or b""] for t in batch]
            counts = (n for some in balanced(p for each in parts for p in each) for n in model.count(some))
            yield pa.array([sum(next(counts) for _ in each) for each in parts], pa.int64())

    return lengths(text)


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """Every row of ``docs`` without its text, with ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    Texts are counted whole, without begin, end or added special tokens; special strings inside a text count as the
    library's default does. Only lengths leave the Arrow function. Texts come to the tokenizer in batches of about
    equal bytes; long ones are cut before white space, where no token spans the cut.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each. An empty table gives an empty table.
    Columns of ``docs`` with the names of the results are replaced by them.
    """
    raw = F.coalesce(docs[text].cast("binary"), F.lit(b""))
    return (
        docs.withColumns({"n_bytes": F.octet_length(raw).cast("long"), "n_tokens": token_lengths(raw, tokenizer)})
        .withColumn("over_limit", F.col("n_tokens") > limit)
        .drop(*({text} - {"n_bytes", "n_tokens", "over_limit"}))
    )
