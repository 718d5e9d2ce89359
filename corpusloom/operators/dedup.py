"""Exact duplicates and exact decontamination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.order import running_sum
from corpusloom.plans.scratch import Scratch


def first_rows(df: DataFrame, key: Column, row: str) -> DataFrame:
    """The least row of each key, by a partially aggregated minimum."""
    return df.groupBy(key.alias("_k")).agg(F.min(row).alias("_first"))


def keep_first(df: DataFrame, row: str, keys: dict[str, Column]) -> DataFrame:
    """``first_<name>`` for every key: whether a row is the key's first over all rows, whether or not that one is kept itself; ``keep``
    if it is first for all. Keys with nulls are equal to each other."""
    out = df
    for name, key in keys.items():
        firsts = first_rows(df, F.sha2(F.coalesce(key.cast("string"), F.lit("\x00")), 256), row).select(F.col("_first").alias("_row"))
        out = out.join(firsts, F.col(row) == F.col("_row"), "left").withColumn(f"first_{name}", F.col("_row").isNotNull()).drop("_row")
    keep = F.lit(True)
    for name in keys:
        keep = keep & F.col(f"first_{name}")
    return out.withColumn("keep", keep)


def kept_runs(df: DataFrame, row: str, size: str) -> DataFrame:
    """Runs of consecutive kept rows: ``first``, ``last``, ``rows``, ``total`` of ``size``. ``df`` has the kept rows only.

    Run starts are found by joining each row to its predecessor, and a row's run is the last start at or before it.
    """
    previous = df.select((F.col(row) + 1).alias(row), F.lit(True).alias("_follows"))
    marked = df.join(previous, row, "left").withColumn("_start", F.col("_follows").isNull().cast("long"))
    runs = running_sum(marked, "_start", row, "_earlier").withColumn("_run", F.col("_earlier") + F.col("_start"))
    return runs.groupBy("_run").agg(F.min(row).alias("first"), F.max(row).alias("last"), F.count("*").alias("rows"), F.sum(size).cast("long").alias("total")).drop("_run")


def overlap_flags(candidates: DataFrame, corpus: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``in_<key>`` for every candidate: whether the corpus has the same value (null equals nothing), and ``in_any``."""
    out, found = candidates, F.lit(False)
    for key in keys:
        there = corpus.select(F.col(key).alias(f"_{key}")).where(F.col(key).isNotNull()).distinct()
        out = out.join(there, F.col(key) == F.col(f"_{key}"), "left").withColumn(f"in_{key}", F.col(f"_{key}").isNotNull()).drop(f"_{key}")
        found = found | F.col(f"in_{key}")
    return out.withColumn("in_any", found)


def greedy_keep(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, kept``: in node order, a node is kept unless a neighbour before it was kept.

    In rounds: an undecided node without an undecided neighbour before it is kept, and its later neighbours are dropped. The result
    equals the sequential fold.
    """
    edges = scratch.table(edges.where("a < b").select("a", "b").distinct(), "edges")
    decided = scratch.table(nodes.select("node", F.lit(None).cast("boolean").alias("kept")), "undecided")
    while True:
        open_ = decided.where("kept is null").select("node")
        blocked = edges.join(open_.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        fresh = scratch.table(open_.join(blocked, "node", "left_anti"), "fresh")
        if fresh.isEmpty():
            return decided
        dropped = edges.join(fresh.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        marks = fresh.withColumn("mark", F.lit(True)).unionByName(dropped.join(fresh, "node", "left_anti").withColumn("mark", F.lit(False)))
        decided = scratch.table(decided.join(marks, "node", "left").select("node", F.coalesce("kept", "mark").alias("kept")), "decided")
        edges = scratch.table(edges.join(decided.where("kept is null").select(F.col("node").alias("b")), "b", "left_semi").select("a", "b"), "edges")


def greedy_keep_by_keys(nodes: DataFrame, keys: Sequence[str], group: str, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, kept``: in node order, a node is kept unless one before it was kept that shares a key (nulls are shared with nothing),
    is in its group, or is in a group that an edge (a, b) joins to it.

    In rounds over what is undecided: a node that is the first of all its keys and of its group, and before the firsts of all joined
    groups, is kept, and all it excludes are dropped; the result equals the sequential fold. Shared keys and groups are minima, so that
    large ones make no pairs.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).where("x <> y")
    both = scratch.table(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    tied, made = [*keys, group], None
    left = scratch.table(nodes.select("node", *tied), "undecided")
    while not left.isEmpty():
        free = left
        for k in tied:
            first = left.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min("node").alias("_first"))
            free = free.join(first, F.col(k) == F.col("_k"), "left").where(F.col("_first").isNull() | (F.col("_first") == F.col("node"))).drop("_k", "_first")
        firsts = scratch.table(left.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.min("node").alias("first")), "firsts")
        near = both.join(firsts.withColumnRenamed("g", "y"), "y").groupBy("x").agg(F.min("first").alias("_near"))
        free = free.join(near, F.col(group) == F.col("x"), "left").where(F.col("_near").isNull() | (F.col("_near") > F.col("node"))).drop("x", "_near")
        free = scratch.table(free, "free")
        out = left.join(free.select("node"), "node", "left_anti")
        for k in tied:
            out = out.join(free.select(F.col(k).alias("_k")).where("_k is not null").distinct(), F.col(k) == F.col("_k"), "left_anti")
        joined = both.join(free.select(F.col(group).alias("x")).where("x is not null").distinct(), "x").select(F.col("y").alias("_g")).distinct()
        rest = scratch.table(out.join(joined, F.col(group) == F.col("_g"), "left_anti"), "undecided")
        decided = left.join(rest.select("node"), "node", "left_anti").join(free.select(F.col("node").alias("_free")), F.col("node") == F.col("_free"), "left")
        part = scratch.table(decided.select("node", F.col("_free").isNotNull().alias("kept")), "decided")
        made, left = part if made is None else made.unionByName(part), rest
    return made if made is not None else nodes.select("node", F.lit(True).alias("kept"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by ``order``; a partially aggregated maximum of the whole row."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def previous(df: DataFrame, keys: Sequence[str], order: str, value: str) -> Column:
    """The value before, within a key."""
    return F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
