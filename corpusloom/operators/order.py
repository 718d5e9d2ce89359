"""Global order without a single-task window.

A rank or running sum over the whole table is made of two levels: rows are put into ordered blocks, blocks are summed (one small row
each), and rows are numbered within their block. Only the block table passes through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def running_sum(df: DataFrame, value: str, order: str, name: str = "start", by: Sequence[str] = (), block: Column | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all earlier rows of its ``by`` group, exclusive of the row itself.

    ``order`` is a unique integer within each group; blocks are runs of it unless ``block`` (monotone in ``order``) is given.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / BLOCK) if block is None else block)
    keys = [*by, "_block"]
    sums = blocked.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    outer = Window.partitionBy(*by).orderBy("_block") if by else Window.orderBy("_block")
    sums = sums.withColumn("_pre", F.sum("_sum").over(outer) - F.col("_sum")).drop("_sum")
    inner = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = blocked.withColumn("_inner", F.sum(value).over(inner) - F.col(value))
    for k in keys:
        sums = sums.withColumnRenamed(k, f"_b{k}")
    on = [F.col(k).eqNullSafe(F.col(f"_b{k}")) for k in keys]
    return joined.join(sums, on).withColumn(name, (F.col("_pre") + F.col("_inner")).cast("long")).drop("_inner", "_pre", "_block", *[f"_b{k}" for k in keys])


def numbered(df: DataFrame, order: str, name: str = "row", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in ``order``, within each ``by`` group."""
    return running_sum(df.withColumn("_one", F.lit(1)), "_one", order, name, by).drop("_one")


def hash_ranked(df: DataFrame, key: Column, name: str = "rank", by: Sequence[str] = (), tie: str | None = None, digits: int = 3) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the order of a hex hash (ties by the column ``tie``), within each ``by`` group.

    Blocks are the hash's first digits, 4,096 of them by default, so a group that a third of the rows share is numbered by as many
    tasks. Only groups that are small by nature ask for fewer.
    """
    hashed = df.withColumn("_key", key).withColumn("_block", F.substring("_key", 1, digits))
    keys = [*by, "_block"]
    sums = hashed.groupBy(*keys).agg(F.count("*").alias("_n"))
    outer = Window.partitionBy(*by).orderBy("_block") if by else Window.orderBy("_block")
    sums = sums.withColumn("_pre", F.sum("_n").over(outer) - F.col("_n")).drop("_n")
    inner = Window.partitionBy(*keys).orderBy("_key", *([tie] if tie else []))
    ranked = hashed.withColumn("_inner", F.row_number().over(inner) - 1)
    for k in keys:
        sums = sums.withColumnRenamed(k, f"_b{k}")
    on = [F.col(k).eqNullSafe(F.col(f"_b{k}")) for k in keys]
    return ranked.join(sums, on).withColumn(name, (F.col("_pre") + F.col("_inner")).cast("long")).drop("_inner", "_pre", "_block", "_key", *[f"_b{k}" for k in keys])


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the half-open intervals that hold them: both sides meet on buckets of ``width``, then the range is checked.

    An interval goes to every bucket it overlaps, so ``width`` should be about its usual length.
    """
    spans = intervals.where(F.col(end) > F.col(start))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    marked = points.withColumn("_bucket", F.floor(F.col(point) / width))
    return marked.join(spans, "_bucket").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bucket")


def value_blocks(df: DataFrame, value: str, blocks: int = 64) -> Column:
    """A block number that grows with ``value``, from approximate quantiles of the whole column (at most ``blocks`` numbers)."""
    cuts = df.agg(F.percentile_approx(value, [k / blocks for k in range(1, blocks)], 1000).alias("q")).first()["q"] or []
    edges = F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<double>")
    return F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(F.col(value) > e, 1).otherwise(0))


def value_ranked(df: DataFrame, value: str, tie: str, name: str = "rank", by: Sequence[str] = (), amount: str | None = None) -> DataFrame:
    """``name``: 1, 2, ... in the order of ``value`` then ``tie`` within each group; with ``amount``, also ``name_sum``, the running sum
    of it up to and including the row. Blocks of values keep a large group from being one task."""
    keys = [*by, "_block"]
    blocked = df.withColumn("_block", value_blocks(df, value)).withColumn("_amount", F.col(amount) if amount else F.lit(0))
    sums = blocked.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_amount").alias("_s"))
    outer = Window.partitionBy(*by).orderBy("_block") if by else Window.orderBy("_block")
    sums = sums.withColumns({"_nb": F.sum("_n").over(outer) - F.col("_n"), "_sb": F.sum("_s").over(outer) - F.col("_s")}).drop("_n", "_s")
    for k in keys:
        sums = sums.withColumnRenamed(k, f"_b{k}")
    inner = Window.partitionBy(*keys).orderBy(value, tie)
    ranked = blocked.withColumns({"_r": F.row_number().over(inner), "_c": F.sum("_amount").over(inner.rowsBetween(Window.unboundedPreceding, 0))})
    out = ranked.join(sums, [F.col(k).eqNullSafe(F.col(f"_b{k}")) for k in keys]).withColumn(name, F.col("_nb") + F.col("_r"))
    if amount:
        out = out.withColumn(f"{name}_sum", F.col("_sb") + F.col("_c"))
    return out.drop("_block", "_amount", "_nb", "_sb", "_r", "_c", *[f"_b{k}" for k in keys])
