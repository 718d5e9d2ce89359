"""Best-fit packing of tokenised documents, planned on a histogram of lengths.

A document's ids and its end id are cut from the end into pieces of the sequence length, so only its first piece may be shorter. The
plan is best-fit decreasing over at most ``size`` lengths with their counts, never over documents: open sequences of equal free space
are one class, and a step puts a length into as many sequences of the tightest class as both have. Every step is a run of ranks of one
length that goes to consecutive sequences at one offset. The plan's steps are a table, and pieces take their slots by joining it on
their length and rank: both sides meet on blocks of ranks, of which a long step has several, so no length is a hot key.

Ranks come from two steps, so that a length which a third of all pieces share is not one task: pieces are numbered within (length,
bucket), and buckets are numbered from their counts. A piece's bucket comes from a number that is written with it and that repeated
rows do not share; the number of buckets grows with the pieces.

Ids are those of the ``tokenizers`` library for the vocabulary file. Where that file's ids are its merge ranks, texts of Latin
characters (below U+0250) without special strings are encoded over the same ranks by ``tiktoken``, which gives the same ids at several
times the speed; all other texts, and those whose runs of blanks are too long for its regular expression, go through the library
itself.

Defined cases: a null text is an empty one, whose only token is the end id; repeated rows and null ids are packed row by row; texts of
any length are taken whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe_count import PART, byte_symbols, parts, slices
from corpusloom.plans.scratch import Scratch

#: Pieces a bucket of ranks has over all lengths, and the most buckets.
BUCKET, MOST_BUCKETS = 512, 1 << 16
#: Ranks that meet on one key of the join to the plan.
RANKS = 1 << 14
# Texts with other characters than these always go to the library itself.
_RARE = re.compile(r"[^\x00-\x1b\x20-\u024f]")
# Fixed value: the byte-level pre-tokenizer's pattern.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = self._ranked(path)

    def _ranked(self, path: str):  # noqa: ANN202
        """The file's vocabulary as an encoder over ranks; None unless its ids are its ranks, so that both give the same ids."""
        import tiktoken

        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if [vocab["".join(m)] for m in merges] != [*range(256, 256 + len(merges))] or len(vocab) != 256 + len(merges):
            return None
        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        if any(len(t) > PART for t in texts):
            return [b"".join(self._encode([p])[0] for p in parts(t)) for t in texts]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        done = [self._quick(t) for t in texts]
        other = iter(self.library.encode_batch_fast([t for t, ids in zip(texts, done, strict=True) if ids is None], add_special_tokens=False))
        return [np.array(next(other).ids, dtype="<u4").tobytes() if ids is None else ids for ids in done]

    def _quick(self, text: str) -> bytes | None:
        """Ids by ranks; None for the library's texts."""
        if self.fast is None or _RARE.search(text) or any(s in text for s in self.special):
            return None
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:  # a run of about a million blanks exhausts the regular expression's stack
            return None


def pieces(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece, and ``spread``, a number of 31 bits that repeated rows do not share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, made = Encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes(), 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for part in slices(texts):
                for key, ids in zip(keys[part], encoder.encode(texts[part]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    at, k = 0, 0
                    while at < n:
                        length = (n - at) % size or size
                        crc = zlib.crc32(ids[4 * at : 4 * (at + length)])
                        rows.append((key, k, at, length, crc, (crc + (made + len(rows)) * 0x9E3779B1) % (1 << 32) >> 1))
                        at, k = at + length, k + 1
            made += len(rows)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "spread"]
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, spread bigint")


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, number, first sequence, offset), and every sequence gets items until no
    length fits. A class of open sequences is a list of (first, number) runs by free space."""
    steps: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    made = 0

    def put(space: int, first: int, number: int) -> None:
        if space and number:
            free.setdefault(space, []).append((first, number))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        spaces = sorted(s for s in free if s >= length)
        k = 0
        while left:
            while k < len(spaces) and not free.get(spaces[k]):
                k += 1
            if k < len(spaces):
                space = spaces[k]
                first, number = free[space].pop()
            else:
                space, first, number = size, made, left
            each = space // length  # after one item the same sequence is the tightest that fits, as long as it fits
            full = min(number, left // each)
            if full:
                for j in range(each):
                    steps.append((length, rank + j * full, full, first, size - space + j * length))
                put(space - each * length, first, full)
                rank, left = rank + each * full, left - each * full
            used = full
            if used < number and left:  # fewer than one sequence's worth is left
                for j in range(left):
                    steps.append((length, rank + j, 1, first + used, size - space + j * length))
                put(space - left * length, first + used, 1)
                rank, left, used = rank + left, 0, used + 1
            if space == size and first == made:
                made += used
            else:
                put(space, first + used, number - used)
            if left:
                spaces = sorted(s for s in free if s >= length and free[s])
                k = 0
        for s in [s for s in free if not free[s]]:
            del free[s]
    return steps


def slots(steps: list[tuple[int, int, int, int, int]], spark: SparkSession, scratch: Scratch) -> DataFrame:
    """The plan's steps as a table, a row for every block of ``RANKS`` ranks that a step touches."""
    rows = spark.createDataFrame(steps, "length long, first_rank long, number long, first_sequence long, offset long")
    last = F.col("first_rank") + F.col("number") - 1
    return scratch.table(rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("first_rank") / RANKS), F.floor(last / RANKS)))), "slots")


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Every piece with its ``sequence_id`` and its ``offset`` there."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.table(pieces(docs, vocabulary, size, end_id), "pieces")
        buckets = min(MOST_BUCKETS, max(1, rows.count() // BUCKET))
        rows = rows.withColumn("bucket", F.pmod("spread", F.lit(buckets)))
        counts = scratch.table(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")  # at most size * MOST_BUCKETS rows
        before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
        starts = counts.select("length", "bucket", before.alias("before"))
        histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
        places = slots(plan(histogram, size), spark, scratch)  # its steps depend on the lengths, not on the documents
        local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("spread", "doc_id", "piece"))
        ranked = rows.withColumn("local", local).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("local") - 1)
        ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", F.floor(F.col("rank") / RANKS).alias("block"))
        taken = ranked.join(places, ["length", "block"]).where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("number")))
        sequence = (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id")
        return scratch.keep(taken.select("doc_id", "piece", "start", "length", "ids_crc32", sequence, "offset"), "packed")
