"""Joins by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aligned(source: DataFrame, derived: DataFrame, row: str, key: str, strict: bool = False) -> DataFrame:
    """All rows of both by ``row``, with ``state``: aligned, mismatch (other key), missing (not derived) or extra. With ``strict``, any
    state but aligned stops the job."""
    d = derived.withColumnRenamed(key, "_key").withColumn("_there", F.lit(True))
    out = source.withColumn("_source", F.lit(True)).join(d, row, "full_outer")
    state = F.when(F.col("_source").isNull(), "extra").when(F.col("_there").isNull(), "missing").when(~F.col(key).eqNullSafe(F.col("_key")), "mismatch").otherwise("aligned")
    out = out.withColumn("state", state).drop("_source", "_there", "_key")
    if strict:
        out = out.withColumn("state", F.when(F.col("state") == "aligned", "aligned").otherwise(F.raise_error(F.concat(F.lit("row "), F.col(row).cast("string"), F.lit(" is "), F.col("state")))))
    return out


def unpaired(left: DataFrame, right: DataFrame) -> DataFrame:
    """``only_left, only_right``: distinct rows that the other side lacks, from one aggregation over both."""
    keys = left.columns
    both = left.withColumn("_left", F.lit(True)).unionByName(right.withColumn("_left", F.lit(False)))
    sides = both.groupBy(*keys).agg(F.bool_or("_left").alias("_l"), F.bool_and("_left").alias("_a"))
    return sides.agg(F.count_if(F.col("_l") & F.col("_a")).alias("only_left"), F.count_if(~F.col("_l")).alias("only_right"))
