"""Nearest neighbours, coverage and diversity of embeddings.

Exact search multiplies blocks: queries (or keys) are taken in blocks of a bounded number, which is what is sent to the executors, and
every Arrow batch of the corpus is one matrix product per block. Only the best of each batch leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import hex_key
from corpusloom.operators.order import hash_ranked
from corpusloom.plans.scratch import Scratch

#: Queries sent to the executors at a time.
BLOCK = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _blocks(keys: DataFrame, id_col: str, scratch: Scratch, *more: str) -> Iterator[list]:
    """Rows of ``keys`` in blocks of at most ``BLOCK``, by a hash of the id, read one block at a time."""
    held = scratch.table(keys.select(id_col, *more), "keys")
    number = -(-held.count() // BLOCK) or 1
    cut = held.withColumn("_block", F.pmod(F.xxhash64(id_col), F.lit(number)))
    for k in range(number):
        rows = cut.where(F.col("_block") == k).drop("_block").collect()
        for at in range(0, len(rows), BLOCK):
            yield rows[at : at + BLOCK]


def nearest(queries: DataFrame, corpus: DataFrame, k: int, scratch: Scratch, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query, neighbour, sim, rank``: the k most similar corpus rows by inner product, other than the query itself; ties by id."""
    found = None
    for rows in _blocks(queries, id_col, scratch, vector):
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        table = np.array([r[1] for r in rows], dtype=np.float64)
        held = corpus.sparkSession.sparkContext.broadcast((ids, table))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, table = held.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                own, sims = batch.column(0).to_numpy(), table @ _matrix(batch.column(1)).T
                sims[ids[:, None] == own[None, :]] = -np.inf
                top = min(k, sims.shape[1])
                # ties with the last place must all leave the batch
                least = np.partition(sims, sims.shape[1] - top, axis=1)[:, sims.shape[1] - top]
                q, c = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
                yield pa.record_batch([pa.array(ids[q]), pa.array(own[c]), pa.array(sims[q, c])], ["query", "neighbour", "sim"])

        part = corpus.select(F.col(id_col).cast("long"), vector).mapInArrow(run, "query bigint, neighbour bigint, sim double")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query").orderBy(F.desc("sim"), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def reverse_nearest(keys: DataFrame, corpus: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector: str = "embedding", group: str = "label") -> DataFrame:
    """``vec_id, scope, key_id, sim``: for every corpus row its most similar key of each group, and over all (scope ``all``); ties go to
    the least key id."""
    found = None
    for rows in _blocks(keys, id_col, scratch, vector, group):
        rows = sorted(rows, key=lambda r: r[0])
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        table = np.array([r[1] for r in rows], dtype=np.float64)
        scopes = {"all": np.arange(len(rows))} | {str(g): np.array([i for i, r in enumerate(rows) if r[2] == g]) for g in sorted({r[2] for r in rows})}
        held = corpus.sparkSession.sparkContext.broadcast((ids, table, scopes))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, table, scopes = held.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                own, sims = batch.column(0).to_numpy(), _matrix(batch.column(1)) @ table.T
                for scope, at in scopes.items():
                    best = sims[:, at].argmax(axis=1)
                    yield pa.record_batch([pa.array(own), pa.array([scope] * len(own)), pa.array(ids[at][best]), pa.array(sims[np.arange(len(own)), at[best]])], ["vec_id", "scope", "key_id", "sim"])

        part = corpus.select(F.col(id_col).cast("long"), vector).mapInArrow(run, "vec_id bigint, scope string, key_id bigint, sim double")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("vec_id", "scope").agg(F.max(F.struct("sim", (-F.col("key_id")).alias("neg"))).alias("best"))
    return best.select("vec_id", "scope", (-F.col("best.neg")).alias("key_id"), F.col("best.sim").alias("sim"))


def gram(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``i, j, value``: entries (i <= j) of the sum of outer products, added up per batch and then over all batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0))
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "value"])

    parts = df.select(vector).mapInArrow(run, "i bigint, j bigint, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def effective_number(moments: np.ndarray, renormalize: bool = True) -> float:
    """Exponential of the entropy of a mean outer product's eigenvalues, which are first scaled to a sum of one (all of them, also
    those too small to count)."""
    spectrum = np.linalg.eigvalsh(moments)
    if renormalize and spectrum.sum() > 0:
        spectrum = spectrum / spectrum.sum()
    shares = spectrum[spectrum > 1e-12]
    return float(np.exp(-np.dot(shares, np.log(shares))))


def vendi(df: DataFrame, vector: str = "embedding", renormalize: bool = True) -> tuple[float, int]:
    """``effective_number`` of all vectors, and how many they are. Only the square of the dimension reaches the driver."""
    n = df.count()
    sums = gram(df, vector).toPandas()
    moments = np.zeros((1 + int(sums["j"].max()),) * 2) if len(sums) else np.zeros((1, 1))
    moments[sums["i"], sums["j"]] = moments[sums["j"], sums["i"]] = sums["value"] / max(n, 1)
    return effective_number(moments, renormalize), n


def vendi_of_subsets(df: DataFrame, group: str, size: int, repeats: int, seed: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``group, mean, deviation, repeats``: ``effective_number`` over random subsets of ``size`` vectors, drawn ``repeats`` times by hash
    order; groups with fewer vectors have no row. Only ids are ranked; a subset's vectors are one task, and as many as its size."""
    ids = df.select(group, id_col, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("draw"))
    drawn = hash_ranked(ids, hex_key(seed, "draw", id_col), "_rank", by=[group, "draw"], tie=id_col).where(F.col("_rank") < size)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf[vector].tolist(), dtype=np.float64)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "value": [effective_number(m.T @ m / len(m))], "n": [len(m)]})

    kind = df.schema[group].dataType.simpleString()
    each = df.select(id_col, vector).join(drawn.drop("_rank"), id_col).groupBy(group, "draw").applyInPandas(score, f"{group} {kind}, value double, n long")
    return each.where(F.col("n") == size).groupBy(group).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"), F.count("*").alias("repeats"))


def coverage(keys: DataFrame, hits: DataFrame, at_least: float) -> DataFrame:
    """One row per scope of ``hits`` (scope, key_id, sim): how the keys (key_id, scope) are hit; keys without hits count."""
    per_hit = hits.groupBy("scope").agg(F.avg("sim").alias("mean_sim"), F.percentile("sim", 0.9).alias("p90_sim"), F.count("*").alias("n_hits"))
    counted = hits.groupBy("scope", "key_id").agg(F.count("*").alias("hits"), F.sum((F.col("sim") >= at_least).cast("long")).alias("close"))
    joined = keys.join(counted, ["scope", "key_id"], "left").select("scope", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("close", F.lit(0)).alias("close"))
    # shares of the most-hit keys come from the histogram of hit counts
    histogram = joined.groupBy("scope", "hits").agg(F.count("*").alias("keys"))
    size = F.sum("keys").over(Window.partitionBy("scope"))
    before = F.sum("keys").over(Window.partitionBy("scope").orderBy(F.desc("hits"))) - F.col("keys")
    room = F.greatest(F.lit(1), F.ceil(F.col("size") / 100))
    top = histogram.withColumns({"size": size, "before": before}).withColumn("taken", F.greatest(F.lit(0), F.least(F.col("keys"), room - F.col("before"))))
    top = top.groupBy("scope").agg((F.sum(F.col("taken") * F.col("hits")) / F.sum(F.col("keys") * F.col("hits"))).alias("top_share"))
    stats = joined.groupBy("scope").agg(F.count("*").alias("n_keys"), F.avg((F.col("hits") > 0).cast("double")).alias("hit_share"), F.avg((F.col("close") > 0).cast("double")).alias("close_share"), F.percentile("hits", 0.5).alias("median_hits"))
    return stats.join(top, "scope").join(per_hit, "scope")
