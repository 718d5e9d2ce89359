"""The corpus pipeline: documents to packed sequences, five stages, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result and reads it as the next one's
documents. All stages but the last return the columns of ``documents``, whatever those are: a row travels as one struct, so that extra
columns with names that an operator uses are safe.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, neardup, packing, quality, toxicity
from corpusloom.llm.queries import tokenizer_path
from corpusloom.plans.scratch import Scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half. Labels come from the ``labels`` table."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in docs.columns if c == "lang"])
    model = toxicity.train(keyed.drop("_row"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scores(keyed, model, ["_row"]).where("_score < 0.5").select("_row.*")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, with the verdicts of host and rules."""
    with Scratch(spark) as scratch:
        rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), "source", "text")
        failed = quality.failures(quality.measures(rows)).drop("text")
        judged = quality.verdicts(scratch.table(failed, "measured"), scratch)
        return scratch.keep(judged.where("kept").select("_row.*"), "quality")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, the one with the least id (then text hash); all documents without words stay."""
    with Scratch(spark) as scratch:
        rows = scratch.table(neardup.near_duplicates(docs.select("doc_id", "text"), scratch), "grouped")
        first = scratch.table(rows.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n")).where("n > 1").select("group", "first"), "first")
        others = rows.join(first, "group").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))))
        others = scratch.table(others.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "others")
        kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text"))
        kept = kept.join(others, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_anti")
        # exact repeats of a kept row (same id, same text) are few; only they are compared further, by their other columns
        twice = rows.where("group is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
        twice = scratch.table(twice.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "repeated")
        on = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
        if twice.isEmpty():
            return scratch.keep(kept.select("_row.*"), "unique")
        once = kept.join(twice, on, "left_anti").select("_row")
        one = kept.join(twice, on, "left_semi").groupBy("_doc", "_text").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row")
        return scratch.keep(once.unionByName(one).select("_row.*"), "unique")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the ``benchmark`` table."""
    with Scratch(spark) as scratch:
        found = decontaminate.overlaps(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch)
        bad = scratch.table(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "bad")
        rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
        return scratch.keep(rows.join(bad, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_anti").select("_row.*"), "clean")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences and offsets."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The models of the first stage and the tokens of the last can't be expressed in SQL; a test holds run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
