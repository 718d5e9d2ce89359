"""Token streams: offsets, fixed-length sequences, windows, chunks and mixes, all as functions of positions."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import hex_key, unit
from corpusloom.operators.order import hash_ranked, running_sum
from corpusloom.plans.scratch import Scratch


def with_offsets(docs: DataFrame, row: str = "row_id", size: str = "n_tokens") -> DataFrame:
    """``docs`` with ``start``: the tokens of all earlier rows."""
    return running_sum(docs, size, row, "start")


def prefix(stream: DataFrame, n_tokens: int, size: str = "n_tokens") -> DataFrame:
    """Documents of a stream's first tokens; the last one is cut."""
    return stream.where(F.col("start") < n_tokens).withColumn(size, F.least(F.col(size), F.lit(n_tokens) - F.col("start")))


def pieces(stream: DataFrame, length: int, *keep: str, overlap: int = 1) -> DataFrame:
    """The part of every document in every sequence: ``seq, seq_from`` (place in the sequence), ``doc_from``, ``take``.

    Sequence i covers tokens ``[i * length, i * length + length + overlap)``; the token that two sequences share is the last label of
    one and the first input of the next. A document is exploded once per sequence it touches.
    """
    end = F.col("start") + F.col("n_tokens")
    first = F.greatest(F.floor((F.col("start") - overlap) / length), F.lit(0))
    rows = stream.where("n_tokens > 0").select(*keep, "start", "n_tokens", F.explode(F.sequence(first, F.floor((end - 1) / length))).alias("seq"))
    low, high = F.greatest(F.col("start"), F.col("seq") * length), F.least(end, (F.col("seq") + 1) * length + overlap)
    return rows.withColumns({"seq_from": low - F.col("seq") * length, "doc_from": low - F.col("start"), "take": high - low}).where("take > 0")


def _whole(stream: DataFrame, length: int, overlap: int, *keep: str) -> DataFrame:
    """``seq, _t, parts``: the tokens of every complete sequence of ``length + overlap``, and the parts that they come from."""
    parts = pieces(stream, length, "tokens", *keep, overlap=overlap).withColumn("part", F.expr("slice(tokens, int(doc_from) + 1, int(take))"))
    grouped = parts.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("seq_from", "doc_from", "part"))).alias("parts"))  # at most length + overlap
    return grouped.select("seq", "parts", F.flatten(F.transform("parts", lambda p: p["part"])).alias("_t")).where(F.size("_t") == length + overlap)


def packed(stream: DataFrame, length: int, *keep: str) -> DataFrame:
    """``seq, inputs, labels, cu_seqlens``: whole sequences of a stream with ``tokens`` arrays; ``cu_seqlens`` are the places where
    documents begin strictly inside, between 0 and ``length``."""
    whole = _whole(stream, length, 1, *keep)
    begins = F.transform(F.filter("parts", lambda p: (p["doc_from"] == 0) & (p["seq_from"] > 0) & (p["seq_from"] < length)), lambda p: p["seq_from"])
    bounds = F.concat(F.array(F.lit(0).cast("long")), begins.cast("array<bigint>"), F.array(F.lit(length).cast("long")))
    return whole.select("seq", F.slice("_t", 1, length).alias("inputs"), F.slice("_t", 2, length).alias("labels"), bounds.alias("cu_seqlens"))


def packed_views(stream: DataFrame, length: int, views: int) -> DataFrame:
    """``seq, views``: of every sequence that has them all, windows of ``length`` tokens shifted by 0, 1, ... tokens."""
    whole = _whole(stream, length, views - 1)
    return whole.select("seq", F.array(*[F.slice("_t", k + 1, length) for k in range(views)]).alias("views"))


def repeated(docs: DataFrame, n_tokens: int, passes: int, seed: int, row: str = "row_id") -> DataFrame:
    """A pool cut to ``n_tokens`` and read ``passes`` times, each pass in its own seeded order: ``pass, start`` over all passes."""
    pool = prefix(with_offsets(docs, row), n_tokens).drop("start")
    each = pool.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    ranked = hash_ranked(each, hex_key(seed, "pass", row), "_rank", by=["pass"], tie=row)
    placed = running_sum(ranked, "n_tokens", "_rank", "_in", by=["pass"])
    return placed.withColumn("start", F.col("pass") * n_tokens + F.col("_in")).drop("_rank", "_in")


def interleaved(indices: DataFrame, index: str, a: int, b: int) -> DataFrame:
    """``stream`` (1 or 2) and ``at`` for every sequence index: exactly ``a`` of any ``b`` consecutive ones are from stream 2."""
    before, after = F.expr(f"`{index}` * {a}L div {b}L"), F.expr(f"(`{index}` + 1) * {a}L div {b}L")
    second = after > before
    return indices.withColumns({"stream": F.when(second, 2).otherwise(1), "at": F.when(second, before).otherwise(F.col(index) - before).cast("long")})


def mixed_sources(picks: DataFrame, index: str, weights: list[tuple[str, float]], seed: int) -> DataFrame:
    """``source, nth, u``: a seeded weighted choice for every index, and how often the source was chosen before."""
    if any(w < 0 for _, w in weights) or sum(w for _, w in weights) <= 0:
        raise ValueError("weights are not negative and have a positive sum")
    total, choice = sum(w for _, w in weights), F.lit(weights[-1][0])
    at, cases = 0.0, []
    for name, w in weights[:-1]:
        at += w / total
        cases.append((at, name))
    for limit, name in reversed(cases):
        choice = F.when(F.col("_u") < limit, name).otherwise(choice)
    chosen = picks.withColumn("_u", unit(seed, index)).withColumn("source", choice).withColumn("_one", F.lit(1))
    return running_sum(chosen, "_one", index, "nth", by=["source"]).drop("_one", "_u")


def rolling_windows(docs: DataFrame, length: int, size: str = "n_tokens") -> DataFrame:
    """Evaluation windows of every document of two tokens or more: ``window, first_label, scored, input_from``. Every label is scored
    once; a later window's inputs are the ``length`` tokens before its last label."""
    n = F.col(size)
    rows = docs.where(n >= 2).withColumn("window", F.explode(F.sequence(F.lit(0), (F.ceil((n - 1) / length) - 1).cast("int"))))
    first = F.col("window") * length + 1
    last = F.least(first + length - 1, n - 1)
    return rows.withColumns({"first_label": first.cast("long"), "scored": (last - first + 1).cast("long"), "input_from": F.greatest(last - length, F.lit(0)).cast("long")})


def chunks(docs: DataFrame, most: int, size: str = "n_tokens") -> DataFrame:
    """Consecutive chunks of at most ``most`` tokens: ``chunk, chunk_start, chunk_tokens``; an empty document still has one."""
    n = F.col(size)
    rows = docs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / most) - 1, F.lit(0)).cast("int"))))
    return rows.withColumns({"chunk_start": (F.col("chunk") * most).cast("long"), "chunk_tokens": F.least(F.lit(most), n - F.col("chunk") * most).cast("long")})


def masked_labels(labels: Column, synthetic: Column, ignored: int = -100) -> Column:
    """Labels whose token lies in a synthetic prefix of that many tokens are ignored."""
    return F.transform(labels, lambda x, i: F.when(i + 1 < synthetic, ignored).otherwise(x))


def block_shuffled(df: DataFrame, index: str, block: int, seed: int) -> DataFrame:
    """``position``: a seeded order within consecutive blocks of the index."""
    blocked = df.withColumn("_blk", F.floor(F.col(index) / block))
    return hash_ranked(blocked, hex_key(seed, index), "_in", by=["_blk"], tie=index, digits=1).withColumn("position", (F.col("_blk") * block + F.col("_in")).cast("long")).drop("_blk", "_in")


def batch_place(seq: Column, ranks: int, per_rank: int) -> tuple[Column, Column, Column]:
    """Step, rank and slot of a sequence: each step deals ``per_rank`` consecutive sequences to every rank."""
    return F.floor(seq / (ranks * per_rank)).cast("long"), F.floor(F.pmod(seq, F.lit(ranks * per_rank)) / per_rank).cast("long"), F.pmod(seq, F.lit(per_rank)).cast("long")


def next_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size, in order: a new bin opens when the running one would overflow."""
    bins, used, at = [], 0, 0
    for s in sizes:
        if used and used + s > capacity:
            at, used = at + 1, 0
        bins.append(at)
        used += s
    return bins


def least_loaded(costs: list[float], shards: int) -> list[int]:
    """Shard of each cost, largest first to the least loaded shard, ties to the lowest."""
    waiting = [(0.0, k) for k in range(shards)]
    placed = {}
    for cost, i in sorted((-c, i) for i, c in enumerate(costs)):
        load, shard = waiting[0]
        heapq.heapreplace(waiting, (load - cost, shard))
        placed[i] = shard
    return [placed[i] for i in range(len(costs))]


class _Fill:
    """How a run of sizes is cut into batches that follow each other, for any state in which the batch before leaves it.

    ``after[i]`` is where the batch that begins at row i ends (the number of rows: not within). For next-fit the state is what the open
    batch holds, and a batch ends before the row that would overflow it; for padded batches it is the rows that the open batch still
    takes, and a batch has as many rows as fit at the size of its first, the longest.
    """

    def __init__(self, sizes: np.ndarray, capacity: int, padded: bool) -> None:
        n = len(sizes)
        self.sums = np.concatenate(([0], np.cumsum(sizes)))
        rows = np.arange(n)
        if padded:
            self.after = rows + np.maximum(capacity // np.maximum(sizes, 1), 1)
            self.candidates = min(n, max(1, capacity // max(int(sizes[0]), 1)))
        else:
            first = self.sums[:-1]
            self.after = np.maximum(np.searchsorted(self.sums, first, side="right"), np.searchsorted(self.sums, first + capacity, side="right") - 1)
            self.candidates = min(n, int(np.searchsorted(self.sums, capacity, side="right")) + 1)
        self.padded, self.capacity, self.n = padded, capacity, n

    def exits(self) -> tuple[list[int], list[int]]:
        """For each candidate first row of a batch: the number of batches that begin from there on, and the state at the end."""
        count, last = np.ones(self.n, np.int64), np.arange(self.n)
        for i in range(self.n - 1, -1, -1):
            if self.after[i] < self.n:
                count[i] += count[self.after[i]]
                last[i] = last[self.after[i]]
        state = self.after[last] - self.n if self.padded else self.sums[-1] - self.sums[last]
        return count[: self.candidates].tolist(), state[: self.candidates].tolist()

    def numbers(self, first: int, batch: int) -> np.ndarray:
        """Batch of each row, if the first new one begins at ``first`` (the number of rows: none does) and ``batch`` is open before."""
        starts = np.zeros(self.n, np.int64)
        while first < self.n:
            starts[first] = 1
            first = int(self.after[first])
        return batch + np.cumsum(starts)


def batches(ranked: DataFrame, by: str, size: str, capacity: int, scratch: Scratch, padded: bool = False, block: int = 1 << 16) -> DataFrame:
    """``ranked`` (with ``k``, each group's rows numbered from 0) with ``batch``: next-fit batches of at most ``capacity`` in that order,
    or with ``padded`` (sizes falling) batches whose rows times their longest size are at most ``capacity``. A row that is larger is a
    batch of its own.

    Blocks of rows find in parallel what becomes of every state in which the block before can leave them, which is a small table; a
    group's blocks are then gone through once, and rows are numbered in parallel again. The result is that of one sequential pass.
    """
    rows = scratch.table(ranked.withColumn("_block", F.floor(F.col("k") / block)), "ranked")

    def summarised(pdf: pd.DataFrame) -> pd.DataFrame:
        fill = _Fill(pdf.sort_values("k")[size].to_numpy(np.int64), capacity, padded)
        count, state = fill.exits()
        return pd.DataFrame({by: [pdf[by].iloc[0]], "_block": [pdf["_block"].iloc[0]], "n": [fill.n], "total": [int(fill.sums[-1])], "empty": [min(int(fill.after[0]), fill.n)], "sums": [fill.sums[1 : fill.candidates + 1].tolist()], "count": [count], "state": [state]})

    def followed(pdf: pd.DataFrame) -> pd.DataFrame:
        entries, state, batch = [], None, -1
        for row in pdf.sort_values("_block").itertuples():
            if state is None:  # the group's first row begins its first batch
                first = 0
            elif padded:
                first = min(state, row.n)
            elif not state:  # nothing but rows without size is in the open batch
                first = row.empty
            else:
                first = int(np.searchsorted(row.sums, capacity - state, side="right")) if len(row.sums) else 0
                first = row.n if first >= len(row.sums) else first
            entries.append((getattr(row, by), row[1 + list(pdf.columns).index("_block")], first, batch))
            if first < row.n:
                batch, state = batch + row.count[first], row.state[first]
            else:
                state = state - row.n if padded else state + row.total
        return pd.DataFrame(entries, columns=[by, "_block", "first", "open"])

    kind = ranked.schema[by].dataType.simpleString()
    summary = rows.select(by, "_block", "k", size).groupBy(by, "_block").applyInPandas(summarised, f"{by} {kind}, _block long, n long, total long, empty long, sums array<long>, count array<long>, state array<long>")
    entries = scratch.table(scratch.table(summary, "blocks").groupBy(by).applyInPandas(followed, f"{by} {kind}, _block long, first long, open long"), "entries")

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        fill = _Fill(pdf[size].to_numpy(np.int64), capacity, padded)
        pdf["batch"] = fill.numbers(int(pdf["first"].iloc[0]), int(pdf["open"].iloc[0]))
        return pdf.drop(columns=["first", "open", "_block"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema) + ", batch long"
    return rows.join(entries, [by, "_block"]).select(*ranked.columns, "_block", "first", "open").groupBy(by, "_block").applyInPandas(placed, schema)
