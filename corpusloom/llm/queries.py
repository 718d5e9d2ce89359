"""One query per operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe_count, chat, decontaminate, langid, neardup, packing, quality, sharding, toxicity, warc
from corpusloom.plans.scratch import Scratch

SHARD_BYTES = 4 << 20


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; its path is all that the operators take."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.deduplicated_archives(spark, _table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        out = neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), scratch)
        return scratch.keep(out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.written(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    with Scratch(spark) as scratch:
        found = decontaminate.overlaps(docs, _table(spark, sf_dir, "benchmark"), scratch)
        out = decontaminate.verdicts(docs, found, scratch)
        return scratch.keep(out.select("doc_id", "contaminated", "n_items", "first_item", "best_score"))


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    with Scratch(spark) as scratch:
        measured = scratch.table(quality.failures(quality.measures(docs)).drop("text"), "measured")
        judged = quality.verdicts(measured, scratch)
        return scratch.keep(judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in docs.columns if c == "lang"])
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.scores(docs, model, ["doc_id"])
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_revisits,
        op2_minhash_neardup,
        op3_chat_format,
        op4_extendible_shards,
        op5_bpe_token_counts,
        op6_decontamination,
        op7_host_quality,
        op8_language_id,
        op9_toxicity,
        op10_best_fit_packing,
    )
}
