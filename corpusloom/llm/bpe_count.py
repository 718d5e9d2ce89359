"""Token counts with a BPE vocabulary, by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one ragged numpy array of symbol ids. Each round looks up the rank of every adjacent
pair at once, finds every sequence's lowest rank, and merges that pair wherever the sequence has it (left to right), until no pair of
any sequence has a rank. The symbols that survive are its tokens. Counts of pre-tokens are remembered between batches in a table of
bounded size.

Normalisation and pre-tokenisation are those of the vocabulary file. Texts of ASCII and Latin characters (below U+0250, without \x1c-\x1f) take an
equivalent path through Python's own lower-casing and one regular expression; any other text goes through the file's own normalizer
and pre-tokenizer. Special strings are cut out first, as the library does by default, and count as one token.

Defined cases: a null or empty text has 0 tokens; texts of any length are taken whole; repeated and null ids are kept row by row;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens remembered in a worker before its table starts anew.
REMEMBERED = 400_000
#: Pre-tokens merged at once.
MERGED_AT_ONCE = 50_000
#: Characters of a text that are split into words at once.
PART = 1 << 20
_LONE = re.compile(r"(?<=[!-~]) (?=[!-~])")
_LATIN = re.compile(r"[^\x00-\x1b\x20-\u024f]")
# The vocabulary file's split pattern, for lower-case text below U+0250. Python's \w there is letters, digits, numbers and "_".
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: Latin-1's printable ones stand for themselves,
    the others take the code points from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merger:
    """The merge table of a byte-level BPE file with an end-of-word suffix, as arrays."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.width = len(vocab) + 1
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last_id = np.array([vocab[s + self.suffix] for s in symbols], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        # an open-addressing table: one or two random reads a pair
        self.bits = 18
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, len(merges), dtype=np.int64)
        self.made = np.zeros(1 << self.bits, dtype=np.int64)
        self.none = len(merges)
        self.probes = 0
        for rank, key in enumerate(keys):
            at, n = int(self._slot(key.reshape(1))[0]), 0
            while self.keys[at] not in (-1, key):
                at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
            if self.keys[at] == -1:
                self.keys[at], self.rank[at], self.made[at] = key, rank, made[rank]
                self.probes = max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or ``none``) and slot of each key."""
        slot = self._slot(keys)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            now = self.keys[slot[open_]]
            open_ = open_[(now != keys[open_]) & (now != -1)]
        return np.where(self.keys[slot] == keys, self.rank[slot], self.none), slot

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Number of tokens of each non-empty pre-token."""
        size = np.fromiter((len(t) for t in tokens), np.int64, len(tokens))
        data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        ids = self.byte_id[data]
        ends = np.cumsum(size)
        ids[ends - 1] = self.last_id[data[ends - 1]]
        out = size.copy()
        live = np.arange(len(tokens))
        while True:
            several = size > 1
            if not several.all():
                out[live[~several]] = size[~several]
                ids = ids[np.repeat(several, size)]
                live, size = live[several], size[several]
            if not len(live):
                return out
            starts = np.cumsum(size) - size
            last = np.zeros(len(ids), dtype=bool)
            last[starts + size - 1] = True
            rank, slot = self._find(np.append(ids[:-1] * self.width + ids[1:], 0))
            rank[last] = self.none
            lowest = np.minimum.reduceat(rank, starts)
            hit = (rank == np.repeat(lowest, size)) & (rank < self.none)
            # of overlapping places (a pair of equal symbols in a row) every second one, from the left
            run = np.flatnonzero(hit[1:] & hit[:-1])
            if len(run):
                index = np.arange(len(hit))
                head = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), index, 0))
                hit &= ((index - head) & 1) == 0
            places = np.flatnonzero(hit)
            ids[places] = self.made[slot[places]]
            keep = np.ones(len(ids), dtype=bool)
            keep[places + 1] = False
            done = lowest == self.none
            out[live[done]] = size[done]
            gone = np.add.reduceat(hit.astype(np.int64), starts)
            keep &= ~np.repeat(done, size)
            ids, live, size = ids[keep], live[~done], (size - gone)[~done]


class Counter:
    """Counts tokens of whole texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merger = Merger(path)
        added = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))))
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if _LATIN.search(text):
            normal = self.library.normalizer.normalize_str(text)
            if not _LATIN.search(normal):
                return _SPLIT.findall(normal)
            # the pre-tokenizer maps bytes to symbols; offsets give the pieces themselves
            return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return _SPLIT.findall(text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower())

    def count(self, texts: list[str]) -> list[int]:
        if any(len(t) > PART for t in texts):
            return [sum(self._count([p])[0] for p in parts(t)) if len(t) > PART else self._count([t])[0] for t in texts]
        return self._count(texts)

    def _count(self, texts: list[str]) -> list[int]:
        extra, split = [0] * len(texts), []
        for k, text in enumerate(texts):
            if "<|" in text and self.special.search(text):
                parts = self.special.split(text)
                extra[k] = len(parts) - 1
                split.append([*chain.from_iterable(map(self.pre_tokens, parts))])
            else:
                split.append(self.pre_tokens(text))
        known = self.known
        fresh = [*set().union(*split).difference(known)] if split else []
        if len(known) + len(fresh) > REMEMBERED:
            known = self.known = {}
            fresh = [*set().union(*split)]
        for at in range(0, len(fresh), MERGED_AT_ONCE):
            part = fresh[at : at + MERGED_AT_ONCE]
            known.update(zip(part, self.merger.counts([t.encode("utf-8") for t in part]).tolist(), strict=True))
        return [n + sum(map(known.__getitem__, tokens)) for n, tokens in zip(extra, split, strict=True)]


def parts(text: str, most: int = PART) -> list[str]:
    """A long text in parts of about ``most`` characters that begin at a lone space between two other characters, where no word, no
    pre-token and no special string can lie across; a text without such a place stays whole."""
    out, at = [], 0
    while len(text) - at > most:
        cut = _LONE.search(text, at + most)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def slices(texts: list[str], most: int = 4_000_000) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters; a longer text is alone."""
    at = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield slice(at, k)
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield slice(at, len(texts))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row. ``vocabulary`` is the path of a BPE file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts: list[int] = []
            for part in slices(texts):
                counts += counter.count(texts[part])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
