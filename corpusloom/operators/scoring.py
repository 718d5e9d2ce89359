"""Pluggable scorers and embedders, and a lexical scorer that needs no outside model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import words


def applied(docs: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list[str]], list]], kind: str = "double") -> DataFrame:
    """``id, value``: what a model gives for every text. ``make`` builds the model once per task; the model maps a list of texts to a list
    of values of the Spark type ``kind`` (``array<float>`` for an embedder). Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            values = model([t or "" for t in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array(values)], ["id", "value"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, value {kind}")


def word_weights(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, weight``: smoothed log-odds of every word of the labelled texts (1 against 0), counted once a text."""
    marked = docs.select(id_col, F.explode(F.array_distinct(words(F.col(text_col)))).alias("word")).join(labels.where(F.col(label).isin(0, 1)).select(id_col, label), id_col)
    counted = marked.groupBy("word").agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    totals = counted.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.count("*").alias("v")).first()  # one row
    p, n, v = (totals[c] or 0 for c in ("p", "n", "v"))
    return counted.select("word", (F.log((F.col("pos") + 1) / F.lit(float(p + v))) - F.log((F.col("neg") + 1) / F.lit(float(n + v)))).alias("weight"))


def lexical_scores(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score``: mean weight of a text's known words, 0 without any. Words are counted per text before they are joined."""
    each = docs.select(F.col(id_col).alias("id"), F.explode_outer(words(F.col(text_col))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    joined = each.join(weights, "word", "left").groupBy("id")
    known = F.sum(F.when(F.col("weight").isNotNull(), F.col("n")))
    return joined.agg(F.coalesce(F.sum(F.col("weight") * F.col("n")) / known, F.lit(0.0)).alias("score"))
