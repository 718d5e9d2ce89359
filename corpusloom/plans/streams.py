"""Queries over token streams: offsets, packing, mixing, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text, tokenizers
from corpusloom.functions.hashing import hex_key
from corpusloom.operators import dedup, tokens
from corpusloom.operators.order import hash_ranked, running_sum
from corpusloom.plans.corpus import documents
from corpusloom.plans.registry import h32_sql, query, table
from corpusloom.plans.scratch import Scratch

LENGTH = 4096


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as byte-token counts (begin and end ids included) with their offsets."""
    sized = documents(spark, sf_dir).select("row_id", "source", "text", (F.octet_length("text") + 2).cast("long").alias("n_tokens"))
    return tokens.with_offsets(sized)


STREAM = "s AS (SELECT doc_id AS row_id, source, n, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT doc_id, source, CAST(strlen(text) + 2 AS BIGINT) AS n FROM documents))"


@query(f"WITH {STREAM} SELECT row_id, n AS n_tokens, start FROM s")
def byte_tokenize_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and offsets of every document."""
    return stream(spark, sf_dir).select("row_id", "n_tokens", "start")


@query("SELECT doc_id, CAST(strlen(text) + 2 AS BIGINT) AS n, CAST(256 + 257 + list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)) AS BIGINT) AS total FROM documents WHERE strlen(text) BETWEEN 1 AND 1000000000")
def byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte tokenizer: one id per UTF-8 byte, with begin and end ids."""
    rows = documents(spark, sf_dir).where(F.octet_length("text") > 0).select("doc_id", text.byte_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"WITH {STREAM} SELECT row_id, start, least(n, 500000 - start) AS n_tokens FROM s WHERE start < 500000")
def stream_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a stream's first 500,000 tokens; the last is cut (the reader's own budget)."""
    return tokens.prefix(stream(spark, sf_dir).select("row_id", "start", "n_tokens"), 500_000).select("row_id", "start", "n_tokens")


_PIECES = f"""{STREAM},
p AS (SELECT row_id, source, start, n, unnest(range(greatest((start - 1) // {LENGTH}, 0), (start + n - 1) // {LENGTH} + 1)) AS seq FROM s WHERE start > 0 OR true),
t AS (SELECT seq, row_id, source, greatest(start, seq * {LENGTH}) - seq * {LENGTH} AS seq_from, greatest(start, seq * {LENGTH}) - start AS doc_from,
      least(start + n, (seq + 1) * {LENGTH} + 1) - greatest(start, seq * {LENGTH}) AS take FROM p)"""


@query(f"""
WITH {_PIECES}
SELECT seq, CAST(sum(take) AS BIGINT) AS tokens, count(*) AS docs, min(row_id) AS first_doc, max(row_id) AS last_doc, count(*) FILTER (doc_from = 0 AND seq_from > 0 AND seq_from < {LENGTH}) AS boundaries
FROM t WHERE take > 0 GROUP BY seq HAVING sum(take) = {LENGTH} + 1
""")
def pack_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of a stream read once, with their documents and the boundaries strictly inside."""
    parts = tokens.pieces(stream(spark, sf_dir), LENGTH, "row_id")
    inside = (F.col("doc_from") == 0) & (F.col("seq_from") > 0) & (F.col("seq_from") < LENGTH)
    each = parts.groupBy("seq").agg(F.sum("take").alias("tokens"), F.count("*").alias("docs"), F.min("row_id").alias("first_doc"), F.max("row_id").alias("last_doc"), F.count_if(inside).alias("boundaries"))
    return each.where(F.col("tokens") == LENGTH + 1)


@query(rf"""
WITH {_PIECES}, x AS (SELECT t.*, hex(encode(d.text)) AS h, strlen(d.text) AS len FROM t JOIN documents d ON d.doc_id = t.row_id WHERE take > 0),
w AS (SELECT seq, string_agg((CASE WHEN doc_from = 0 THEN '[' ELSE '' END) || substr(h, CAST(2 * greatest(doc_from - 1, 0) + 1 AS BIGINT), CAST(2 * (least(doc_from + take - 1, len) - greatest(doc_from - 1, 0)) AS BIGINT))
   || (CASE WHEN doc_from + take = len + 2 THEN ']' ELSE '' END), '' ORDER BY seq_from) AS body, sum(take) AS n FROM x GROUP BY seq)
SELECT seq, md5(body) AS sequence_md5 FROM w WHERE n = {LENGTH} + 1
""")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens themselves, inputs and labels shifted by one; digests of each sequence's bytes, with begin and end marked."""
    docs = stream(spark, sf_dir).withColumn("tokens", text.byte_tokens(F.col("text"))).drop("text", "source")
    packed = tokens.packed(docs, LENGTH)
    whole = F.concat(F.slice("inputs", 1, 1), F.col("labels"))
    marked = F.transform(whole, lambda t: F.when(t == 256, "[").when(t == 257, "]").otherwise(F.lpad(F.hex(t), 2, "0")))
    return packed.select("seq", F.md5(F.array_join(marked, "")).alias("sequence_md5"))


@query(f"""
WITH {_PIECES}, q AS (SELECT seq, source, take, seq_from, row_id, sum(take) OVER (PARTITION BY seq) AS n FROM t WHERE take > 0)
SELECT seq, max_by(source, take * 1000000 - seq_from) AS block_source, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM q WHERE n = {LENGTH} + 1 GROUP BY seq
""")
def labelled_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of each sequence, and the one with most of it."""
    parts = tokens.pieces(stream(spark, sf_dir), LENGTH, "row_id", "source")
    each = parts.groupBy("seq").agg(F.sum("take").alias("n"), F.max_by("source", F.col("take") * 1_000_000 - F.col("seq_from")).alias("block_source"), F.count_distinct("source").alias("sources"))
    return each.where(F.col("n") == LENGTH + 1).select("seq", "block_source", "sources")


@query(f"""
WITH {STREAM}, pool AS (SELECT row_id, least(n, 400000 - start) AS n FROM s WHERE start < 400000),
e AS (SELECT row_id, n, unnest([0, 1, 2]) AS pass FROM pool)
SELECT pass, row_id, n AS n_tokens, CAST(pass * 400000 + coalesce(sum(n) OVER (PARTITION BY pass ORDER BY md5('17|' || pass || '|' || row_id), row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM e
""")
def pack_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of 400,000 tokens read three times, each pass in its own order."""
    sized = documents(spark, sf_dir).select("row_id", (F.octet_length("text") + 2).cast("long").alias("n_tokens"))
    return tokens.repeated(sized, 400_000, 3, 17).select("pass", "row_id", "n_tokens", "start")


@query("""
WITH r AS (SELECT i, i * 2 // 7 AS a, (i + 1) * 2 // 7 AS b FROM range(0, 100000) t(i))
SELECT i AS seq, CASE WHEN b > a THEN 2 ELSE 1 END AS stream, CASE WHEN b > a THEN a ELSE i - a END AS at FROM r
""")
def mix_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: two of every seven sequences come from the second stream, exactly."""
    return tokens.interleaved(spark.range(100_000).withColumnRenamed("id", "seq"), "seq", 2, 7)


_U = h32_sql("'19|' || doc_id") + " / 4294967296.0::DOUBLE"


@query(f"""
WITH c AS (SELECT doc_id, CASE WHEN {_U} < 0.5 THEN 'web' WHEN {_U} < 0.8 THEN 'code' ELSE 'books' END AS source FROM documents)
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth FROM c
""")
def source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted choice of source for every pick, and which of its documents that takes."""
    picks = documents(spark, sf_dir).select("doc_id")
    return tokens.mixed_sources(picks, "doc_id", [("web", 5.0), ("code", 3.0), ("books", 2.0)], 19).select("doc_id", "source", "nth")


@query("""
WITH d AS (SELECT doc_id, CAST(strlen(text) + 2 AS BIGINT) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, (n - 2) // 512 + 1)) AS k FROM d WHERE n >= 2)
SELECT doc_id, k AS "window", k * 512 + 1 AS first_label, least(k * 512 + 512, n - 1) - k * 512 AS scored, greatest(least(k * 512 + 512, n - 1) - 512, 0) AS input_from FROM w
""")
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation windows that score every label once."""
    sized = documents(spark, sf_dir).select("doc_id", (F.octet_length("text") + 2).cast("long").alias("n_tokens"))
    return tokens.rolling_windows(sized, 512).select("doc_id", F.col("window").cast("long").alias("window"), "first_label", "scored", "input_from")


@query("""
WITH d AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, greatest((n + 510) // 511, 1))) AS k FROM d)
SELECT doc_id, k AS chunk, k * 511 AS chunk_start, least(511, n - k * 511) AS chunk_tokens FROM w
""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks for embedding; empty documents have one."""
    sized = documents(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("n_tokens"))
    return tokens.chunks(sized, 511).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "chunk_start", "chunk_tokens")


_TOKENS = "[256] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) || [257]"


@query(f"""
WITH t AS (SELECT doc_id, ({_TOKENS})[2:] AS labels FROM documents)
SELECT doc_id, CAST(least(greatest(doc_id % 6 * 10 - 1, 0), len(labels)) AS BIGINT) AS masked, CAST(list_sum(list_transform(labels, lambda x, i: CASE WHEN i < doc_id % 6 * 10 THEN -100 ELSE x END)) AS BIGINT) AS total FROM t
""")
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every text's tokens, those within a synthetic prefix of 0 to 50 tokens ignored."""
    tokenized = documents(spark, sf_dir).select("doc_id", text.byte_tokens(F.col("text")).alias("t"))
    labels = tokenized.select("doc_id", tokens.masked_labels(F.slice("t", 2, F.size("t") - 1), (F.col("doc_id") % 6 * 10).cast("int")).alias("labels"))
    return labels.select("doc_id", F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("masked"), F.aggregate("labels", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"""
WITH {STREAM}, x AS (SELECT start, s.n, {_TOKENS} AS t FROM s JOIN documents d ON d.doc_id = s.row_id), p AS (SELECT start + unnest(range(0, n)) AS p, unnest(t) AS token FROM x), e AS (SELECT max(p) + 1 AS size FROM p),
f AS (SELECT (p - view) // {LENGTH} AS seq, view, sum(token) AS total, count(*) AS n FROM p, (SELECT unnest([0, 1, 2]) AS view) WHERE p >= view GROUP BY ALL)
SELECT seq, CAST(view AS BIGINT) AS view, CAST(total AS BIGINT) AS total FROM f, e WHERE n = {LENGTH} AND seq * {LENGTH} + {LENGTH} + 2 <= size
""")
def packed_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three views of every sequence, each shifted by one more token."""
    docs = stream(spark, sf_dir).withColumn("tokens", text.byte_tokens(F.col("text"))).drop("text", "source")
    each = tokens.packed_views(docs, LENGTH, 3).select("seq", F.posexplode("views").alias("view", "t"))
    return each.select("seq", F.col("view").cast("long").alias("view"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT doc_id, doc_id // 64 * 64 + row_number() OVER (PARTITION BY doc_id // 64 ORDER BY md5('23|' || doc_id), doc_id) - 1 AS position FROM documents")
def block_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: a seeded order within blocks."""
    return tokens.block_shuffled(documents(spark, sf_dir).select("doc_id"), "doc_id", 64, 23).select("doc_id", "position")


@query("SELECT doc_id AS seq, doc_id // 32 AS step, doc_id % 32 // 8 AS rank, doc_id % 8 AS slot FROM documents")
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step, rank and slot of every sequence."""
    step, rank, slot = tokens.batch_place(F.col("doc_id"), 4, 8)
    return documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), step.alias("step"), rank.alias("rank"), slot.alias("slot"))


@query("""
WITH t AS (SELECT source, sum(strlen(text) + 2) AS n, count(*) AS docs FROM documents GROUP BY source), m AS (SELECT min(n) AS target FROM t)
SELECT source, round(target / n, 6) AS weight, round(target / n * docs / 100.0::DOUBLE, 6) AS epochs, CAST(n // (256 * 16) * 256 AS BIGINT) AS pool_sequences FROM t, m
""")
def token_matched_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source weights that match token counts, and pools in whole multiples of 256 sequences of 16 tokens."""
    per = documents(spark, sf_dir).groupBy("source").agg(F.sum(F.octet_length("text") + 2).alias("n"), F.count("*").alias("docs"))
    target = per.agg(F.min("n")).first()[0]
    weight = F.lit(target) / F.col("n")
    return per.select("source", F.round(weight, 6).alias("weight"), F.round(weight * F.col("docs") / 100, 6).alias("epochs"), (F.floor(F.col("n") / (256 * 16)) * 256).cast("long").alias("pool_sequences"))


@query("""
SELECT w.w AS width, l.l AS lr, b.b AS bs, s.s AS seed, 'w' || w.w || '_lr' || l.l || '_bs' || b.b || '_s' || s.s AS name, CAST(20000000 // (b.b * 256) AS BIGINT) AS steps, b.b = 64 AND s.s = 0 AS main
FROM (SELECT unnest([256, 512, 1024]) AS w) w, (SELECT unnest(['0.001', '0.002', '0.004']) AS l) l, (SELECT unnest([32, 64, 128]) AS b) b, (SELECT unnest([0, 1]) AS s) s
""")
def run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Cartesian grid of run parameters, from one sequence of cell numbers."""
    widths, rates, batches, seeds = [256, 512, 1024], ["0.001", "0.002", "0.004"], [32, 64, 128], [0, 1]
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    k = F.col("id")
    cells = spark.range(len(widths) * len(rates) * len(batches) * len(seeds)).select(pick(seeds, k % 2).alias("seed"), pick(batches, F.floor(k / 2) % 3).alias("bs"), pick(rates, F.floor(k / 6) % 3).alias("lr"), pick(widths, F.floor(k / 18)).alias("width"))
    name = F.concat(F.lit("w"), "width", F.lit("_lr"), "lr", F.lit("_bs"), "bs", F.lit("_s"), "seed")
    return cells.select("width", "lr", "bs", "seed", name.alias("name"), F.floor(F.lit(20_000_000) / (F.col("bs") * 256)).cast("long").alias("steps"), ((F.col("bs") == 64) & (F.col("seed") == 0)).alias("main"))


def _longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", F.octet_length("text").cast("long").alias("n"))
    order = F.concat(F.lpad((F.lit(10**12) - F.col("n")).cast("string"), 13, "0"), F.lpad(F.col("doc_id").cast("string"), 19, "0"))
    return hash_ranked(sized, order, "k", by=["source"], digits=11)


@query()
def next_fit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, documents in length order put into batches of a token budget, as one pass over them would."""
    with Scratch(spark) as scratch:
        made = tokens.batches(_longest_first(spark, sf_dir), "source", "n", 32_768, scratch)
        return scratch.keep(made.select("doc_id", "source", "k", "n", "batch"))


@query()
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, documents from the longest on in batches whose rows, padded to the first, are within a token budget."""
    with Scratch(spark) as scratch:
        made = tokens.batches(_longest_first(spark, sf_dir), "source", "n", 32_768, scratch, padded=True)
        return scratch.keep(made.select("doc_id", "source", "k", "n", "batch"))


@query()
def least_loaded_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks (sources, by their tokens) to eight shards, largest first."""
    cost = documents(spark, sf_dir).groupBy("source").agg(F.sum(F.octet_length("text")).alias("cost"))

    def assign(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values(["cost", "source"], ascending=[False, True]).reset_index(drop=True)
        pdf["shard"] = tokens.least_loaded(pdf["cost"].astype(float).tolist(), 8)
        return pdf[["source", "cost", "shard"]]

    return cost.groupBy(F.lit(0).alias("g")).applyInPandas(assign, "source string, cost long, shard long")


_FLAGSHIP = f"""
WITH k AS (SELECT doc_id, source, text, doc_id = min(doc_id) OVER (PARTITION BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS keep FROM documents WHERE regexp_matches(text, '\\S')),
s AS (SELECT doc_id AS row_id, source, n, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT doc_id, source, CAST(strlen(text) + 2 AS BIGINT) AS n FROM k WHERE keep)),
p AS (SELECT source, start, n, unnest(range(greatest((start - 1) // {LENGTH}, 0), (start + n - 1) // {LENGTH} + 1)) AS seq FROM s),
t AS (SELECT seq, source, least(start + n, (seq + 1) * {LENGTH} + 1) - greatest(start, seq * {LENGTH}) AS take FROM p),
f AS (SELECT seq FROM t WHERE take > 0 GROUP BY seq HAVING sum(take) = {LENGTH} + 1)
SELECT source, CAST(sum(take) AS BIGINT) AS tokens, CAST(count(DISTINCT seq) AS BIGINT) AS sequences, count(*) AS pieces FROM t JOIN f USING (seq) WHERE take > 0 GROUP BY source
"""


@query(_FLAGSHIP)
def flagship_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus to sequences: blank texts out, keep-first on normalised text, byte tokens, offsets, packing, tokens by source."""
    docs = documents(spark, sf_dir).where(~text.is_blank(F.col("text")))
    kept = dedup.keep_first(docs, "doc_id", {"norm": text.normalized(F.col("text"))}).where("keep")
    sized = tokens.with_offsets(kept.select("row_id", "source", (F.octet_length("text") + 2).cast("long").alias("n_tokens")))
    parts = tokens.pieces(sized, LENGTH, "source")
    full = parts.groupBy("seq").agg(F.sum("take").alias("n")).where(F.col("n") == LENGTH + 1).select("seq")
    return parts.join(full, "seq").groupBy("source").agg(F.sum("take").alias("tokens"), F.count_distinct("seq").alias("sequences"), F.count("*").alias("pieces"))


@query("""
WITH t AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations)
SELECT conv_id, turn, role, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM t
""")
def turn_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 within groups: where each turn begins in its conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    return running_sum(turns, "n", "turn", "start", by=["conv_id"]).select("conv_id", "turn", "role", "start")


@query("SELECT doc_id, md5('29|' || doc_id) AS key FROM documents")
def shuffle_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of a seeded order; a range partitioning on them is the external shuffle."""
    return documents(spark, sf_dir).select("doc_id", hex_key(29, "doc_id").alias("key"))


@query()
def tokenizer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions, tokenizers: token counts of every text by a SentencePiece model and by a tokenizer file."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    pieces = tokenizers.tokenized(docs, "pieces", public_tokenizers.path("piece_bpe_32k.model"), begin=True, end=True)
    library = tokenizers.tokenized(docs, "library", public_tokenizers.path("byte_bpe_50k.json"))
    both = pieces.select(F.col("id").alias("doc_id"), F.size("tokens").alias("pieces")).join(library.select(F.col("id").alias("doc_id"), F.size("tokens").alias("tokens")), "doc_id")
    return both.select("doc_id", F.col("pieces").cast("long").alias("pieces"), F.col("tokens").cast("long").alias("tokens"))
