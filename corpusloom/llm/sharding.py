"""Extendible hashing: shards of a bounded byte size.

Every record has 60 hash bits of its id and its text's digest, so that rows sharing an id (or lacking one) still spread. The directory starts with cells of a few bits, whose bytes one partially aggregated pass adds up; a
bucket is a prefix of the bits, and only a bucket over the limit is split on its next bit. Cells that are over the limit at the depth
reached so far are counted again on more bits, over their own records alone. Then each record takes the bucket whose prefix its
bits begin with, through a join on the cell: hash bits are uniform, so no task is hot, and no text is shuffled for it. To write the
shards, each row travels through that join itself, so that rows without an id and repeats are written once each, where they belong.

Defined cases: a null text has no bytes; a record over the limit can't fit any bucket and gets a shard of its own, so it does not
split its neighbours; records with equal bits (repeated rows) that together pass the limit form overflow shards of at most
``limit // largest`` records each; empty buckets have no row; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.scratch import Scratch

BITS = 60


def hash_bits(key: Column, text: Column) -> Column:
    """60 bits of an MD5 over the id and the text's digest, equal in every engine."""
    name = F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def directory(records: DataFrame, limit: int, scratch: Scratch, step: int = 12) -> DataFrame:
    """``cell_depth, cell, depth, bucket, bucket_bytes, overflow``: the bucket of every cell that has records.

    ``records`` has ``bits`` and ``n_bytes`` (none over the limit). Cells deepen by ``step`` bits where they are over the limit.
    """
    made, at, left = None, 0, records
    while True:
        depth = min(at + step, BITS)
        cells = scratch.table(left.groupBy(F.shiftright("bits", BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes")), "cells")
        # every prefix from the last round's depth on, with its bytes
        levels = cells.select("cell", "n_bytes", F.explode(F.sequence(F.lit(at), F.lit(depth))).alias("depth"))
        levels = levels.withColumn("bucket", F.expr(f"shiftright(cell, {depth} - depth)"))
        sums = levels.groupBy("depth", "bucket").agg(F.sum("n_bytes").alias("bucket_bytes"))
        mine = levels.join(sums, ["depth", "bucket"])
        best = F.min(F.when(F.col("bucket_bytes") <= limit, F.struct("depth", "bucket", "bucket_bytes"))).alias("leaf")
        leaves = mine.groupBy("cell").agg(best, F.max(F.when(F.col("depth") == depth, F.col("bucket_bytes"))).alias("all_bytes"))
        leaves = scratch.table(leaves, "leaves")
        done = leaves.where("leaf is not null").select(F.lit(depth).alias("cell_depth"), "cell", "leaf.depth", "leaf.bucket", "leaf.bucket_bytes", F.lit(False).alias("overflow"))
        over = leaves.where("leaf is null")
        if depth == BITS:
            done = done.unionByName(over.select(F.lit(depth).alias("cell_depth"), "cell", F.lit(depth).alias("depth"), F.col("cell").alias("bucket"), F.col("all_bytes").alias("bucket_bytes"), F.lit(True).alias("overflow")))
        made = done if made is None else made.unionByName(done)
        if depth == BITS or over.isEmpty():
            return made
        left, at = left.join(over.select(F.col("cell").alias("_over")), F.shiftright("bits", BITS - depth) == F.col("_over"), "left_semi"), depth


def keyed(docs: DataFrame, *carried: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, bits, n_bytes`` of every row, with what is carried."""
    return docs.select(F.col(id_col).alias("doc_id"), hash_bits(F.col(id_col), F.col(text_col)).alias("bits"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), *carried)


def placed(rows: DataFrame, buckets: DataFrame, limit: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_bytes`` and the ``carried`` columns of ``keyed`` rows; ``shard`` is the bucket's bits, with a
    suffix where one record or an overflow chain has its own."""
    depths = sorted(r[0] for r in buckets.select("cell_depth").distinct().collect())  # at most BITS / step values
    name = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("bucket").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    large = rows.where(F.col("n_bytes") > limit).withColumn("link", F.row_number().over(Window.partitionBy("bits").orderBy("n_bytes")))
    own = F.concat_ws("-", F.lit("large"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("bits"), F.col("link").cast("string"))
    large = large.select("doc_id", "n_bytes", own.alias("shard"), F.lit(BITS).alias("depth"), F.col("n_bytes").alias("shard_bytes"), *carried)
    small, out = rows.where(F.col("n_bytes") <= limit), None
    for depth in depths:
        cells = buckets.where(F.col("cell_depth") == depth).drop("cell_depth")
        part = small.withColumn("cell", F.shiftright("bits", BITS - depth)).join(cells, "cell")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return large
    fitting = out.where("not overflow").select("doc_id", "n_bytes", name.alias("shard"), "depth", F.col("bucket_bytes").alias("shard_bytes"), *carried)
    chain = out.where("overflow").withColumn("most", F.max("n_bytes").over(Window.partitionBy("bits")))
    chain = chain.withColumn("link", F.floor((F.row_number().over(Window.partitionBy("bits").orderBy("n_bytes")) - 1) / F.greatest(F.lit(1), F.floor(limit / F.col("most")))))
    chain = chain.withColumn("link_bytes", F.sum("n_bytes").over(Window.partitionBy("bits", "link")))
    chain = chain.select("doc_id", "n_bytes", F.concat_ws("+", name, F.col("link").cast("string")).alias("shard"), "depth", F.col("link_bytes").alias("shard_bytes"), *carried)
    return fitting.unionByName(chain).unionByName(large)


def assign(docs: DataFrame, limit: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The placement of every row, without the row."""
    records = scratch.table(keyed(docs, id_col=id_col, text_col=text_col), "records")
    buckets = scratch.table(directory(records.where(F.col("n_bytes") <= limit), limit, scratch), "directory")
    return placed(records, buckets, limit)


def shard(docs: DataFrame, limit: int) -> DataFrame:
    """The finished assignment."""
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(assign(docs, limit, scratch))


def write_shards(docs: DataFrame, limit: int, path: str, scratch: Scratch) -> None:
    """One folder of Parquet files per shard, each written by one task. A row is in the struct ``record``, beside its ``shard`` and
    ``depth``; folders are named by ``folder``, which is never empty nor a number."""
    records = scratch.table(keyed(docs), "records")
    buckets = scratch.table(directory(records.where(F.col("n_bytes") <= limit), limit, scratch), "directory")
    rows = placed(keyed(docs, F.struct(*[docs[c] for c in docs.columns]).alias("record")), buckets, limit, ("record",))
    rows = rows.select("record", "shard", "depth", F.concat(F.lit("shard-"), F.col("shard")).alias("folder"))
    rows.repartition("folder").write.option("compression", "zstd").partitionBy("folder").parquet(path)


def written(docs: DataFrame, limit: int) -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_bytes`` of every row, as read back from the shards that were written."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        path = scratch.path("shards")
        write_shards(docs, limit, path, scratch)
        if docs.isEmpty():  # no shard to read
            return scratch.keep(assign(docs, limit, scratch))
        back = spark.read.parquet(path).select("record.doc_id", F.coalesce(F.octet_length("record.text"), F.lit(0)).cast("long").alias("n_bytes"), "shard", "depth")
        sums = back.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
        return scratch.keep(back.join(sums, "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes"))
