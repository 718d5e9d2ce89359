"""MinHash with bands, for candidates against a corpus.

A word is 32 bits of its MD5, a shingle the scrambled weighted sum of its words, and a signature the smallest values of the shingles
under odd multiples, scrambled again, modulo 2^32, so that all of it is wrapping 32-bit arithmetic that SQL can repeat. Texts of a batch lie side by side:
a worker looks every distinct word up once, and takes minima over fixed runs of shingles, wherever texts begin and end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.scratch import Scratch

# The signature's size and bands, the shingle's word count, and the agreement that counts as near.
HASHES, ROWS, WIDTH = 128, 4, 5
#: Share of equal signature entries from which two texts count as near-duplicates.
AGREEMENT = 0.7
#: Shingles whose values are held at once, and words that a worker remembers.
RUN, REMEMBERED = 1024, 500_000
_WORD = re.compile(r"\w+")


def _number(name: str) -> int:
    """A number below 2^32 for a name."""
    return int.from_bytes(hashlib.md5(name.encode("utf-8", "surrogatepass")).digest()[:4], "big")


def parameters(n: int = HASHES) -> tuple[list[int], list[int]]:
    """Multipliers (odd, below 2^30) and increments of the signature's functions."""
    return [_number(f"times {j}") >> 2 | 1 for j in range(n)], [_number(f"plus {j}") for j in range(n)]


def weights() -> tuple[list[int], int]:
    """Odd multipliers of a shingle's words, and the one that scrambles their sum, below 2^30."""
    return [_number(f"word {k}") >> 2 | 1 for k in range(WIDTH)], _number("scramble") >> 2 | 1


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(weights()[1])
    return x ^ (x >> np.uint32(13))


class Signer:
    """Signatures of texts; remembers words between batches."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        a, b = parameters()
        self.a, self.b = np.array(a, np.uint32)[:, None], np.array(b, np.uint32)[:, None]

    def _numbers(self, split: list[list[str]]) -> np.ndarray:
        fresh = set(chain.from_iterable(split)).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, fresh = {}, set(chain.from_iterable(split))
        self.known.update((w, _number(w)) for w in fresh)
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.uint32, sum(map(len, split)))

    def signatures(self, split: list[list[str]]) -> np.ndarray:
        """A row per text; every text has a word."""
        numbers, times = self._numbers(split), [np.uint32(m) for m in weights()[0]]
        size = np.fromiter(map(len, split), np.int64, len(split))
        start = np.cumsum(size) - size
        places = np.maximum(size - WIDTH + 1, 1)
        text = np.repeat(np.arange(len(split)), places)
        at = np.arange(len(text)) - np.repeat(np.cumsum(places) - places, places) + start[text]
        value = np.zeros(len(text), np.uint32)
        for k in range(WIDTH):  # a short text has the words that it has
            there = size[text] > k
            value[there] += numbers[at[there] + k] * times[k]
        value = _scrambled(value)
        best = np.full((len(split), HASHES), 0xFFFFFFFF, np.uint32)
        for first in range(0, len(value), RUN):
            part = text[first : first + RUN]
            begins = np.flatnonzero(np.diff(part, prepend=-1))
            moved = self.a * value[None, first : first + RUN] + self.b
            least = np.minimum.reduceat((moved ^ (moved >> np.uint32(16))) * np.uint32(weights()[1]), begins, axis=1)
            best[part[begins]] = np.minimum(best[part[begins]], least.T)
        return best


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, signature array<bigint>`` of every text with a word; a text of under five words has one shingle, its whole sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                split = [_WORD.findall(t.lower()) for t in batch.column(1).to_pylist()]
                some = [i for i, words in enumerate(split) if words]
                found = signer.signatures([split[i] for i in some]).astype(np.int64)
                ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * HASHES)
                yield pa.record_batch([batch.column(0).take(pa.array(some, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], ["doc_id", "signature"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, signature array<bigint>")


def classes(signed: DataFrame) -> DataFrame:
    """One row per distinct signature: ``signature, first`` (its least id) and ``copies``."""
    return signed.groupBy("signature").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))


def banded(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``key``, a hash of each band and its entries."""
    keys = [F.xxhash64(F.lit(k), *[F.get("signature", F.lit(k * ROWS + i)) for i in range(ROWS)]) for k in range(HASHES // ROWS)]
    return df.select(*keep, F.explode(F.array(*keys)).alias("key"))


def agreement(a: str, b: str):  # noqa: ANN201
    """Equal entries of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def class_pairs(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b, equal``: pairs of different signatures, by their least ids (a < b), that agree in ``AGREEMENT`` of the entries.

    Texts with one signature are one class, so groups of copies are no pairs; a class is posted only under bands that another class
    has too.
    """
    rows = scratch.table(classes(signed).select("first", "signature"), "classes")
    posts = banded(rows, ["first"])
    shared = scratch.table(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    posts = scratch.table(posts.join(shared, "key"), "posts")
    left, right = posts.select("key", F.col("first").alias("a")), posts.select("key", F.col("first").alias("b"))
    pairs = scratch.table(left.join(right, "key").where("a < b").select("a", "b").distinct(), "pairs")
    one, two = rows.select(F.col("first").alias("a"), F.col("signature").alias("sa")), rows.select(F.col("first").alias("b"), F.col("signature").alias("sb"))
    scored = pairs.join(one, "a").join(two, "b").select("a", "b", agreement("sa", "sb").cast("long").alias("equal"))
    return scored.where(F.col("equal") >= AGREEMENT * HASHES)


def near_flags(candidates: DataFrame, corpus: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, near``: whether the corpus has a signature that agrees with the candidate's in ``AGREEMENT`` of the entries."""
    own = scratch.table(classes(candidates).select("first", "signature"), "own")
    other = scratch.table(classes(corpus).select(F.col("first").alias("other"), "signature"), "other")
    pairs = scratch.table(banded(own, ["first"]).join(banded(other, ["other"]), "key").select("first", "other").distinct(), "pairs")
    scored = pairs.join(own.withColumnRenamed("signature", "sa"), "first").join(other.withColumnRenamed("signature", "sb"), "other")
    hit = scratch.table(scored.where(agreement("sa", "sb") >= AGREEMENT * HASHES).select("first").distinct(), "hit")
    flagged = own.join(hit.withColumn("near", F.lit(True)), "first", "left").select("signature", F.coalesce("near", F.lit(False)).alias("near"))
    return candidates.join(flagged, "signature").select("doc_id", "near")
