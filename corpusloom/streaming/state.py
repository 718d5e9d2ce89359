"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """A stream over a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def keep_first(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of every key; with an event time, state older than the delay is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if time else stream.dropDuplicates(keys)


def binned_means(stream: DataFrame, time: str, width: str, delay: str, by: list[str], value: str) -> DataFrame:
    """Mean, count and largest value per window and group, once the watermark has passed."""
    binned = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by)
    return binned.agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.max(value).alias("largest")).select(F.col("w.start").alias("start"), *by, "mean", "n", "largest")


def sessions(stream: DataFrame, time: str, gap: str, delay: str, by: str) -> DataFrame:
    """Sessions by a gap, once the watermark has passed."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def excess_controller(stream: DataFrame, source: str, excess: str, alpha: float) -> DataFrame:
    """Exponential moving average of each source's batch means, kept in state: ``source, batches, ema``."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n = 0.0, 0
        for frame in frames:
            total, n = total + float(frame[excess].sum()), n + len(frame)
        if not n:
            return
        mean = total / n
        seen, ema = state.get if state.exists else (0, mean)
        ema = mean if seen == 0 else (1 - alpha) * ema + alpha * mean
        state.update((seen + 1, ema))
        yield pd.DataFrame({"source": [str(key[0])], "batches": [seen + 1], "ema": [ema]})

    return stream.select(source, excess).groupBy(source).applyInPandasWithState(update, "source string, batches long, ema double", "batches long, ema double", "update", GroupStateTimeout.NoTimeout)


def append_log(stream: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """An append-only sink: every batch's rows as Parquet, exactly once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it gave, for batch use and tests."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def with_refreshed_weights(stream: DataFrame, weights_path: str, source: str, out: str, checkpoint: str):  # noqa: ANN201
    """Every batch joined to the weights as they are when it starts: a small table (``source, weight``) that another job may replace
    between batches. Rows of sources without a weight get 0. A batch that runs again writes the same folder again."""

    def write(batch: DataFrame, number: int) -> None:
        weights = batch.sparkSession.read.parquet(weights_path).select(source, "weight")
        weighted = batch.join(weights, source, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        weighted.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def logged_updates(stream: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """A sink for streams that update rows: every batch's updates in a folder of its own, written again if the batch runs again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
