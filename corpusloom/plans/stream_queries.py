"""Streaming queries, run over all of a table as a stream of its files. Results go through a written table, as a memory sink would
gather them on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import normalized
from corpusloom.plans.registry import query, seconds, table
from corpusloom.plans.scratch import Scratch
from corpusloom.streaming import state


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. The file source reads folders, so a single file is picked by its name."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, scratch: Scratch) -> DataFrame:
    path = scratch.path("out")
    state.append_log(stream, path, scratch.path("state")).awaitTermination()
    return scratch.keep(stream.sparkSession.read.schema(stream.schema).parquet(path))


@query(r"SELECT CAST(count(DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS BIGINT) AS n, CAST(count(DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS BIGINT) AS texts FROM documents")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-first as a stream; which copy comes first is the stream's order, so the result is counted."""
    with Scratch(spark) as scratch:
        rows = _source(spark, sf_dir, "documents").select("doc_id", F.sha2(normalized(F.col("text")), 256).alias("norm"))
        kept = _run(state.keep_first(rows, ["norm"]), scratch)
        return kept.agg(F.count("*").alias("n"), F.count_distinct("norm").alias("texts"))


@query("""
WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events), b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL)
SELECT CAST(epoch(s) AS BIGINT) AS start, event_type, mean, n FROM b, m WHERE s + INTERVAL 1 HOUR <= mark
""")
def stream_binned_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5 over event time: hourly means by type; windows that the watermark has not passed stay open."""
    with Scratch(spark) as scratch:
        out = _run(state.binned_means(_events(spark, sf_dir), "ts", "1 hour", "1 hour", ["event_type"], "value"), scratch)
        return out.select(seconds("start").alias("start"), "event_type", F.round("mean", 6).alias("mean"), "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s, m GROUP BY user_id, k, mark HAVING max(ts) + INTERVAL 6 HOUR <= mark
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as a stream; those still open at the watermark are not given."""
    with Scratch(spark) as scratch:
        out = _run(state.sessions(_events(spark, sf_dir), "ts", "6 hours", "1 hour", "user_id"), scratch)
        return out.select("user_id", seconds("start").alias("start"), "n")


@query("SELECT event_type AS source, CAST(1 AS BIGINT) AS batches, round(avg(value), 6) AS ema FROM events GROUP BY event_type")
def stream_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving average of every source's batch means, kept in the stream's state (a table of one file is one batch)."""
    with Scratch(spark) as scratch:
        path = scratch.path("updates")
        means = state.excess_controller(_events(spark, sf_dir), "event_type", "value", 0.3)
        state.logged_updates(means, path, scratch.path("state")).awaitTermination()
        last = spark.read.parquet(path).groupBy("source").agg(F.max(F.struct("batches", "ema")).alias("x"))
        return scratch.keep(last.select("source", "x.batches", F.round("x.ema", 6).alias("ema")))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 0.5::DOUBLE WHEN 'click' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM events")
def stream_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: every batch joined to the source weights as they are when it starts."""
    with Scratch(spark) as scratch:
        weights, out = scratch.path("weights"), scratch.path("out")
        spark.createDataFrame([("view", 0.5), ("click", 2.0)], "event_type string, weight double").write.parquet(weights)
        rows = _source(spark, sf_dir, "events").select("event_id", "event_type")
        state.with_refreshed_weights(rows, weights, "event_type", out, scratch.path("state")).awaitTermination()
        return scratch.keep(spark.read.parquet(out).select("event_id", "weight"))
