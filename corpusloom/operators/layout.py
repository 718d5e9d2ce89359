"""Where rows go: chunks, ranks, splits, subsets, shards. Everything is a function of the row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.order import hash_ranked, numbered, running_sum


def strided(df: DataFrame, row: str, stride: int, offset: int, limit: int | None = None) -> DataFrame:
    """Rows whose id is ``offset`` modulo ``stride``, among the first ``limit``. Rows are numbered before anything is dropped."""
    if not 0 <= offset < stride:
        raise ValueError("the offset lies within the stride")
    out = df.where(F.pmod(F.col(row), F.lit(stride)) == offset)
    return out if limit is None else out.where(F.col(row) < limit)


def round_robin(row: Column, chunks: int) -> tuple[Column, Column]:
    """Chunk and line of a row dealt round robin."""
    return F.pmod(row, F.lit(chunks)).cast("long"), F.floor(row / chunks).cast("long")


def from_round_robin(chunk: Column, line: Column, chunks: int) -> Column:
    """The row of a chunk's line."""
    return line * chunks + chunk


def rank_of(chunk: Column, world: int, chunks: int) -> Column:
    """The reader that owns a chunk; surplus chunks (in sorted order) have none, and too few chunks must divide the readers."""
    if chunks < world:
        if world % chunks:
            raise ValueError("the number of readers is a multiple of the number of chunks")
        return chunk
    return F.when(chunk < chunks - chunks % world, F.pmod(chunk, F.lit(world)))


def quota(chunk: Column, most: int, chunks: int) -> Column:
    """Rows of a chunk under a budget of ``most`` rows for all; the remainder goes to the first chunks."""
    if most < chunks:
        raise ValueError("the budget has a row for each chunk")
    return F.lit(most // chunks) + F.when(chunk < most % chunks, 1).otherwise(0)


def split_validation(row: Column, validation: int, chunks: int) -> tuple[Column, Column]:
    """The first rows are held out, the others are dealt to chunks."""
    return F.when(row < validation, "val").otherwise("train"), F.when(row >= validation, F.pmod(row - validation, F.lit(chunks))).cast("long")


def subsets(df: DataFrame, row: str, size: int, chunks: int) -> DataFrame:
    """Consecutive cuts of ``size`` rows, each dealt to chunks."""
    inner = F.pmod(F.col(row), F.lit(size))
    chunk, line = round_robin(inner, chunks)
    return df.withColumns({"subset": F.floor(F.col(row) / size).cast("long"), "chunk": chunk, "line": line})


def shard_of(row: Column, n: Column, shards: int) -> Column:
    """The shard s with ``s * n // shards <= row < (s + 1) * n // shards``."""
    return F.floor(((row + 1) * shards - 1) / n).cast("long")


def draw(df: DataFrame, key: Column, sizes: dict[str, int], tie: str) -> DataFrame:
    """Disjoint uniform draws of the given sizes without replacement, in draw order: ``part`` and ``position``. Rows beyond get none."""
    ranked = hash_ranked(df, key, "_rank", tie=tie)
    at, part, position = 0, F.lit(None).cast("string"), F.lit(None).cast("long")
    for name, size in sizes.items():
        inside = (F.col("_rank") >= at) & (F.col("_rank") < at + size)
        part, position = F.when(inside, name).otherwise(part), F.when(inside, F.col("_rank") - at).otherwise(position)
        at += size
    return ranked.withColumns({"part": part, "position": position}).drop("_rank")


def pointers(df: DataFrame, row: str, line_bytes: Column, chunks: int) -> DataFrame:
    """Byte offset and length of every row's line in its chunk."""
    chunk, line = round_robin(F.col(row), chunks)
    sized = df.withColumns({"chunk": chunk, "line": line, "length": line_bytes.cast("long")})
    return running_sum(sized, "length", "line", "offset", by=["chunk"])


def renumbered(df: DataFrame, row: str, name: str = "row") -> DataFrame:
    """Gapless row numbers in the old order, after rows were dropped."""
    return numbered(df, row, name)


def epochs(df: DataFrame, number: int) -> DataFrame:
    """``df`` read ``number`` times, with ``epoch``; a source that gives nothing is an error rather than an endless loop."""
    if df.isEmpty():
        raise ValueError("an epoch gave no rows")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
