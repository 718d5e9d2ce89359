"""Queries over the documents: scans, layout, sampling, filters, duplicates and decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import arrays, text
from corpusloom.functions.hashing import h32, hex_key, unit
from corpusloom.operators import dedup, layout, minhash, scoring
from corpusloom.operators.order import hash_ranked, interval_join, numbered
from corpusloom.plans.registry import h32_sql, query, table
from corpusloom.plans.scratch import Scratch
from corpusloom.sources import columnar, jsonl, sinks

NORM = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("row_id", F.col("doc_id"))


@query("SELECT doc_id AS row_id, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE doc_id % 16 = 3")
def scan_strided_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: one reader's lines of a strided file."""
    return layout.strided(documents(spark, sf_dir), "row_id", 16, 3).select("row_id", F.length("text").cast("long").alias("chars"))


@query("""
WITH e AS (SELECT doc_id, source, unnest([0, 1, 2]) AS epoch FROM documents)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch,
       row_number() OVER (PARTITION BY epoch, source ORDER BY CASE WHEN epoch = 0 THEN lpad(CAST(doc_id AS VARCHAR), 20, '0') ELSE md5('7|' || epoch || '|' || doc_id) END, doc_id) - 1 AS position
FROM e
""")
def epoch_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3: three epochs; the first in file order, later ones in a seeded order per file."""
    epochs = documents(spark, sf_dir).select("doc_id", "source", F.explode(F.array(*[F.lit(e).cast("long") for e in range(3)])).alias("epoch"))
    first = numbered(epochs.where("epoch = 0"), "doc_id", "position", by=["source"])
    later = hash_ranked(epochs.where("epoch > 0"), hex_key(7, "epoch", "doc_id"), "position", by=["epoch", "source"], tie="doc_id")
    cols = ["doc_id", "source", "epoch", "position"]
    return first.select(*cols).unionByName(later.select(*cols))


@query("""
WITH d AS (SELECT doc_id, doc_id % 18 AS chunk, doc_id // 18 AS line FROM documents)
SELECT chunk % 8 AS reader, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM d
WHERE chunk < 16 AND line < 801 // 18 + CASE WHEN chunk < 801 % 18 THEN 1 ELSE 0 END GROUP BY 1
""")
def rank_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5, K5: chunks go to readers, surplus chunks to none, under a budget split over the chunks."""
    chunk, line = layout.round_robin(F.col("row_id"), 18)
    rows = documents(spark, sf_dir).select("doc_id", chunk.alias("chunk"), line.alias("line")).withColumn("reader", layout.rank_of(F.col("chunk"), 8, 18))
    rows = rows.where(F.col("reader").isNotNull() & (F.col("line") < layout.quota(F.col("chunk"), 801, 18)))
    return rows.groupBy(F.col("reader").cast("long").alias("reader")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


@query("SELECT doc_id, CASE WHEN doc_id < 100 THEN 'val' ELSE 'train' END AS split, CASE WHEN doc_id >= 100 THEN (doc_id - 100) % 16 END AS chunk FROM documents")
def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: the first rows are held out, the rest dealt to chunks."""
    split, chunk = layout.split_validation(F.col("row_id"), 100, 16)
    return documents(spark, sf_dir).select("doc_id", split.alias("split"), chunk.alias("chunk"))


@query(f"""
WITH clean AS (SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE {NORM.replace('text', 'b.text')} = {NORM.replace('text', 'd.text')})),
n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM clean)
SELECT doc_id, r // 250 AS subset, (r % 250) % 16 AS chunk, (r % 250) // 16 AS line FROM n
""")
def subset_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap with the held-out set is dropped, rows are renumbered, and consecutive cuts are dealt to chunks."""
    docs = documents(spark, sf_dir).withColumn("norm", text.normalized(F.col("text")))
    held = table(spark, sf_dir, "benchmark").select(text.normalized(F.col("text")).alias("norm")).distinct()
    clean = layout.renumbered(docs.join(held, "norm", "left_anti").select("doc_id"), "doc_id", "r")
    return layout.subsets(clean, "r", 250, 16).select("doc_id", "subset", "chunk", "line")


@query("""
WITH d AS (SELECT doc_id, doc_id % 16 AS chunk, doc_id // 16 AS line, CAST(strlen(text) + 1 AS BIGINT) AS length FROM documents)
SELECT doc_id, chunk, line, length, CAST(coalesce(sum(length) OVER (PARTITION BY chunk ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM d
""")
def pointer_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offset and length of every row's line in its chunk."""
    docs = documents(spark, sf_dir)
    return layout.pointers(docs, "row_id", F.octet_length("text") + 1, 16).select("doc_id", "chunk", "line", "length", "offset")


@query("""
SELECT doc_id % 16 AS chunk, count(*) AS n, max(doc_id // 16) + 1 AS expected, count(*) = max(doc_id // 16) + 1 AS complete FROM documents GROUP BY 1
""")
def merge_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether dealt chunks merge back into gapless rows."""
    chunk, line = layout.round_robin(F.col("row_id"), 16)
    rows = documents(spark, sf_dir).select(chunk.alias("chunk"), line.alias("line"))
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), (F.max("line") + 1).alias("expected")).withColumn("complete", F.col("n") == F.col("expected"))


@query("""
WITH n AS (SELECT count(*) AS n FROM documents), d AS (SELECT doc_id, ((doc_id + 1) * 7 - 1) // n AS shard FROM documents, n)
SELECT shard, count(*) AS rows, min(doc_id) AS first, max(doc_id) AS last FROM d GROUP BY shard
""")
def shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous shards of equal size, with their counts."""
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", layout.shard_of(F.col("row_id"), F.lit(docs.count()), 7).alias("shard"))
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query(f"SELECT doc_id, {h32_sql("'s|' || doc_id")} % 10 = 0 AS chosen FROM documents")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a salted hash picks."""
    return documents(spark, sf_dir).select("doc_id", (F.pmod(h32(F.lit("s"), "doc_id"), F.lit(10)) == 0).alias("chosen"))


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('11|' || doc_id), doc_id) - 1 AS k FROM documents)
SELECT doc_id, CASE WHEN k < 200 THEN 'a' WHEN k < 400 THEN 'b' WHEN k < 450 THEN 'held' END AS part,
       CASE WHEN k < 200 THEN k WHEN k < 400 THEN k - 200 WHEN k < 450 THEN k - 400 END AS position FROM r
""")
def uniform_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint draws without replacement, each in draw order; the next draw comes from rows unused so far."""
    docs = documents(spark, sf_dir).select("doc_id")
    return layout.draw(docs, hex_key(11, "doc_id"), {"a": 200, "b": 200, "held": 50}, "doc_id").select("doc_id", "part", "position")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('3|' || doc_id), doc_id) - 1 AS position FROM documents")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global seeded order."""
    return hash_ranked(documents(spark, sf_dir).select("doc_id"), hex_key(3, "doc_id"), "position", tie="doc_id")


@query(f"""
WITH r AS (SELECT doc_id, {h32_sql("'c|' || doc_id")} % 16 AS chunk FROM documents)
SELECT doc_id, chunk, row_number() OVER (PARTITION BY chunk ORDER BY md5('5|' || doc_id), doc_id) - 1 AS position FROM r
""")
def routed_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are routed to chunks by hash and put in a seeded order there."""
    routed = documents(spark, sf_dir).select("doc_id", F.pmod(h32(F.lit("c"), "doc_id"), F.lit(16)).alias("chunk"))
    return hash_ranked(routed, hex_key(5, "doc_id"), "position", by=["chunk"], tie="doc_id")


@query(r"""
SELECT doc_id, md5(CASE WHEN ends_with(t, chr(10)) THEN t ELSE t || chr(10) END) AS text_md5 FROM (
  SELECT doc_id, coalesce(CASE WHEN lang = 'de' THEN NULL ELSE text END, CASE WHEN source = 'src1' THEN NULL ELSE source || text END, '') AS t FROM documents)
WHERE regexp_matches(t, '\S')
""")
def text_extract_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the text fields that is there, blank ones dropped, ending in a line feed."""
    docs = documents(spark, sf_dir)
    found = text.first_present(F.when(F.col("lang") != "de", F.col("text")), F.when(F.col("source") != "src1", F.concat("source", "text")))
    rows = docs.select("doc_id", found.alias("t")).where(~text.is_blank(F.col("t")))
    return rows.select("doc_id", F.md5(text.with_newline(F.col("t"))).alias("text_md5"))


@query("""
WITH c AS (SELECT doc_id, text, list_filter([lang || ' notes', CASE WHEN source = 'src2' THEN ' INFEASIBLE ' ELSE source END, CASE WHEN lang <> 'en' THEN 'UNFEASIBLE' END],
  lambda x: x IS NOT NULL AND trim(x) NOT IN ('INFEASIBLE', 'UNFEASIBLE')) AS ctx FROM documents)
SELECT doc_id, md5(array_to_string(ctx, '--') || '--' || text) AS full_md5, CAST(length(array_to_string(ctx, '--')) + 2 AS BIGINT) AS boundary, CAST(len(ctx) AS BIGINT) AS contexts FROM c
""")
def synthetic_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable contexts joined before the original, and where the original begins."""
    ctx = F.array(F.concat("lang", F.lit(" notes")), F.when(F.col("source") == "src2", " INFEASIBLE ").otherwise(F.col("source")), F.when(F.col("lang") != "en", "UNFEASIBLE"))
    docs = documents(spark, sf_dir).withColumn("ctx", ctx)
    return docs.select(
        "doc_id",
        F.md5(text.with_contexts(F.col("text"), F.col("ctx"), "prepend", "--")).alias("full_md5"),
        text.context_boundary(F.col("text"), F.col("ctx"), "--").cast("long").alias("boundary"),
        F.size(text.usable(F.col("ctx"))).cast("long").alias("contexts"),
    )


@query("""
WITH s AS (SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN n_chars % 37 END AS large, CASE WHEN l.toxic = 0 THEN n_chars % 53 END AS small FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, large IS NULL OR small IS NULL AS passed_through FROM s WHERE large IS NULL OR small IS NULL OR (large <= 30 AND small - large >= 1)
""")
def delta_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: unscored rows pass; scored ones need a low large-model value and a difference."""
    scored = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = scored.select("doc_id", F.when(F.col("quality").isNotNull(), F.col("n_chars") % 37).alias("large"), F.when(F.col("toxic") == 0, F.col("n_chars") % 53).alias("small"))
    unknown = F.col("large").isNull() | F.col("small").isNull()
    return rows.where(unknown | ((F.col("large") <= 30) & (F.col("small") - F.col("large") >= 1))).select("doc_id", unknown.alias("passed_through"))


@query(r"""
WITH w AS (SELECT doc_id, string_split(regexp_replace(trim(text, E' \t\n\r\x0b\x0c'), '\s+', ' ', 'g'), ' ') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w[1:64], ' ')) AS head, md5(array_to_string(w[greatest(len(w) - 15, 1):], ' ')) AS tail,
       CASE WHEN doc_id % 2 = 0 THEN CAST(len(w) - 1 AS BIGINT) END AS signal FROM w
""")
def token_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last tokens, and a per-label signal that counts only if its length fits."""
    blanks = r"^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$"
    w = F.split(F.regexp_replace(F.regexp_replace("text", blanks, ""), r"\s+", " "), " ")
    rows = documents(spark, sf_dir).select("doc_id", w.alias("w"))
    signal = arrays.aligned(F.when(F.col("doc_id") % 2 == 0, F.slice("w", 1, F.size("w") - 1)).otherwise(F.col("w")), F.col("w"))
    join = lambda v: F.md5(F.array_join(v, " "))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), join(arrays.first_n(F.col("w"), 64)).alias("head"), join(arrays.last_n(F.col("w"), 16)).alias("tail"), F.when(signal.isNotNull(), F.size(signal)).cast("long").alias("signal"))


@query(r"SELECT source, count(*) AS n, count(*) FILTER (w < 200) AS short, count(*) FILTER (w > 1200) AS long, count(*) FILTER (w BETWEEN 200 AND 1200) AS kept FROM (SELECT source, len(regexp_extract_all(text, '\S+')) AS w FROM documents) GROUP BY source")
def word_band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts within a band of words, with counters of what falls out."""
    w = F.regexp_count("text", F.lit(r"\S+"))
    rows = documents(spark, sf_dir).select("source", w.alias("w"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("w") < 200).alias("short"), F.count_if(F.col("w") > 1200).alias("long"), F.count_if(F.col("w").between(200, 1200)).alias("kept"))


@query("""
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def unlabelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an earlier step has not done."""
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("""
SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('13|' || doc_id), doc_id) - 1 AS position FROM documents WHERE length(text) > 200 AND doc_id < 20001) WHERE position < 50
""")
def long_document_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11, K3: fifty of the long documents among a file's first 20,001 lines, in a seeded order (the sampler's own limits)."""
    long = documents(spark, sf_dir).where((F.length("text") > 200) & (F.col("row_id") < 20_001)).select("doc_id")
    return hash_ranked(long, hex_key(13, "doc_id"), "position", tie="doc_id").where("position < 50")


@query("""
WITH n AS (SELECT p_partkey, 'run_w' || p_size || '_lr0p' || lpad(CAST(p_partkey % 100 AS VARCHAR), 3, '0') || CASE WHEN p_size % 2 = 0 THEN '_bs' || p_size ELSE '' END AS name FROM part)
SELECT p_partkey, CAST(regexp_extract(name, '_w([0-9]+)', 1) AS BIGINT) AS width, CAST(replace(regexp_extract(name, '_lr([0-9p]+)', 1), 'p', '.') AS DOUBLE) AS lr,
       CAST(nullif(regexp_extract(name, '_bs([0-9]+)$', 1), '') AS BIGINT) AS bs FROM n
""")
def run_name_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters read from run names."""
    lr = F.concat(F.lit("_lr0p"), F.lpad((F.col("p_partkey") % 100).cast("string"), 3, "0"))
    name = F.concat(F.lit("run_w"), "p_size", lr, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_bs"), "p_size")).otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).where(F.col("name").rlike("^run_"))
    take = lambda p: F.regexp_extract("name", p, 1)
    return rows.select("p_partkey", take("_w([0-9]+)").cast("long").alias("width"), F.replace(take("_lr([0-9p]+)"), F.lit("p"), F.lit(".")).cast("double").alias("lr"), F.nullif(take("_bs([0-9]+)$"), F.lit("")).cast("long").alias("bs"))


@query("""
SELECT event_id, starts_with(rtrim(props), '{') AND ends_with(rtrim(props), '}') AS is_object, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
""")
def json_line_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line is an object, and a field of it."""
    line = F.rtrim("props")
    return table(spark, sf_dir, "events").select("event_id", (line.startswith("{") & line.endswith("}")).alias("is_object"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(r"""
WITH f AS (SELECT source, lang, length(text) AS chars, doc_id % 7 = 0 AS by_length, NOT regexp_matches(text, '\S') AS blank, doc_id % 11 = 0 AS truncated FROM documents)
SELECT source, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (by_length) AS finish_length, count(*) FILTER (blank) AS blank,
       count(*) FILTER (truncated) AS truncated, round(avg(CASE WHEN by_length THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS length_share, CAST(count(DISTINCT lang) AS BIGINT) AS langs FROM f GROUP BY source
""")
def split_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality flags of a derived split and their counts."""
    rows = documents(spark, sf_dir).select("source", "lang", F.length("text").alias("chars"), (F.col("doc_id") % 7 == 0).alias("by_length"), text.is_blank(F.col("text")).alias("blank"), (F.col("doc_id") % 11 == 0).alias("truncated"))
    return rows.groupBy("source").agg(
        F.count("*").alias("n"),
        F.sum("chars").alias("chars"),
        F.count_if("by_length").alias("finish_length"),
        F.count_if("blank").alias("blank"),
        F.count_if("truncated").alias("truncated"),
        F.round(F.avg(F.col("by_length").cast("double")), 6).alias("length_share"),
        F.count_distinct("lang").alias("langs"),
    )


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def view_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per category and view."""
    return documents(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("""
SELECT page_id, CAST((length(html) - length(replace(html, '<p>', ''))) // 3 AS BIGINT) AS opened, CAST((length(html) - length(replace(html, '</p>', ''))) // 4 AS BIGINT) AS closed,
  (length(html) - length(replace(html, '<p>', ''))) // 3 = (length(html) - length(replace(html, '</p>', ''))) // 4 AS balanced FROM pages
""")
def markup_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether opening and closing marks balance."""
    rows = table(spark, sf_dir, "pages").select("page_id", text.occurrences(F.col("html"), "<p>").alias("opened"), text.occurrences(F.col("html"), "</p>").alias("closed"))
    return rows.withColumn("balanced", F.col("opened") == F.col("closed"))


@query(r"""SELECT doc_id, md5(replace(text, chr(10), ' ')) AS plain, md5(regexp_replace(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', ' ', 'g')) AS lines FROM documents""")
def single_line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways to put a text on one line for a classifier."""
    return documents(spark, sf_dir).select("doc_id", F.md5(F.replace("text", F.lit("\n"), F.lit(" "))).alias("plain"), F.md5(text.single_line(F.col("text"))).alias("lines"))


@query()
def stripped_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: all six rules, over texts with headers, bold words, bullets, numbers, fences and italics put in (one rule looks around its
    match, which SQL's regular expressions can't; a test holds it against Python's)."""
    marked = F.concat(F.lit("# "), F.replace("text", F.lit(". "), F.lit(".\n- **x** *y* ")), F.lit("\n1.2) z\n```py\n__w__\n"))
    return documents(spark, sf_dir).select("doc_id", F.md5(text.stripped_markup(marked)).alias("plain"))


@query("""
SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS n, CAST(256 + coalesce(list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)), 0) AS BIGINT) AS total FROM documents
""")
def trailing_end_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end token of every text's tokens is dropped before decoding."""
    rows = documents(spark, sf_dir).select("doc_id", arrays.without_trailing(text.byte_tokens(F.col("text")), 257).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("""
WITH f AS (SELECT doc_id, n_chars, doc_id = min(doc_id) OVER (PARTITION BY text) AS first_text, doc_id = min(doc_id) OVER (PARTITION BY lang, n_chars) AS first_id FROM documents)
SELECT doc_id, first_text, first_id, first_text AND first_id AS keep FROM f
""")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row is kept if it is the first of its text and the first of its id, both over all rows."""
    docs = documents(spark, sf_dir)
    found = dedup.keep_first(docs, "doc_id", {"text": F.col("text"), "id": F.concat_ws("|", "lang", F.col("n_chars").cast("string"))})
    return found.select("doc_id", "first_text", "first_id", "keep")


@query(f"SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY {NORM}) AS keep FROM documents WHERE length(trim(text)) > 50")
def dedup_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-first by normalised text after a length filter."""
    long = documents(spark, sf_dir).where(F.length(F.trim("text")) > 50)
    return dedup.keep_first(long, "doc_id", {"norm": text.normalized(F.col("text"))}).select("doc_id", "keep")


@query("""
WITH f AS (SELECT doc_id, source, doc_id = min(doc_id) OVER (PARTITION BY text) AS t, doc_id = min(doc_id) OVER (PARTITION BY lang, n_chars) AS i FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (NOT t) AS text_duplicates, count(*) FILTER (t AND NOT i) AS id_only_duplicates, count(*) FILTER (t AND i) AS kept FROM f GROUP BY source
""")
def dedup_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows were dropped, by subset."""
    docs = documents(spark, sf_dir)
    f = dedup.keep_first(docs, "doc_id", {"t": F.col("text"), "i": F.concat_ws("|", "lang", F.col("n_chars").cast("string"))})
    t, i = F.col("first_t"), F.col("first_i")
    return f.groupBy("source").agg(F.count("*").alias("n"), F.count_if(~t).alias("text_duplicates"), F.count_if(t & ~i).alias("id_only_duplicates"), F.count_if(t & i).alias("kept"))


@query("""
WITH k AS (SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, min(doc_id) OVER (PARTITION BY text) AS m FROM documents) WHERE m = doc_id),
g AS (SELECT doc_id, n_chars, doc_id - row_number() OVER (ORDER BY doc_id) AS island FROM k)
SELECT min(doc_id) AS first, max(doc_id) AS last, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS total FROM g GROUP BY island
""")
def kept_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive kept rows, to copy as a whole."""
    kept = dedup.keep_first(documents(spark, sf_dir), "doc_id", {"text": F.col("text")}).where("keep")
    return dedup.kept_runs(kept.select("doc_id", "n_chars"), "doc_id", "n_chars")


_SPLIT = h32_sql("'v|' || doc_id") + " % 8 = 0"
_TRI = f"SELECT doc_id, CAST(n_chars AS VARCHAR) || lang AS id, text, {NORM} AS norm, {_SPLIT} AS held FROM documents"


def _held_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.col("n_chars").cast("string"), "lang").alias("id"), "text", text.normalized(F.col("text")).alias("norm"), (F.pmod(h32(F.lit("v"), "doc_id"), F.lit(8)) == 0).alias("held"))
    return rows.where("held"), rows.where("not held")


@query(f"""
WITH a AS ({_TRI}), c AS (SELECT * FROM a WHERE NOT held)
SELECT doc_id, id IN (SELECT id FROM c) AS in_id, text IN (SELECT text FROM c) AS in_text, norm IN (SELECT norm FROM c) AS in_norm,
       id IN (SELECT id FROM c) OR text IN (SELECT text FROM c) OR norm IN (SELECT norm FROM c) AS in_any FROM a WHERE held
""")
def decontam_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows that share id, text or normalised text with the corpus (a hashed split of the documents)."""
    held, corpus = _held_out(spark, sf_dir)
    return dedup.overlap_flags(held, corpus, ["id", "text", "norm"]).select("doc_id", "in_id", "in_text", "in_norm", "in_any")


@query(f"""
WITH a AS ({_TRI}), c AS (SELECT * FROM a WHERE NOT held),
f AS (SELECT id IN (SELECT id FROM c) AS i, text IN (SELECT text FROM c) AS t, norm IN (SELECT norm FROM c) AS n FROM a WHERE held)
SELECT count(*) AS candidates, count(*) FILTER (i) AS by_id, count(*) FILTER (t) AS by_text, count(*) FILTER (n) AS by_norm, count(*) FILTER (i OR t OR n) AS by_any FROM f
""")
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many held-out rows overlap, by key."""
    held, corpus = _held_out(spark, sf_dir)
    f = dedup.overlap_flags(held, corpus, ["id", "text", "norm"])
    return f.agg(F.count("*").alias("candidates"), F.count_if("in_id").alias("by_id"), F.count_if("in_text").alias("by_text"), F.count_if("in_norm").alias("by_norm"), F.count_if("in_any").alias("by_any"))


_A, _B = minhash.parameters()
_TIMES, _SCRAMBLE = minhash.weights()
_NEAR = f"{minhash.AGREEMENT} * {minhash.HASHES}"
_SIGNATURES = rf"""
w AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM documents),
s AS (SELECT doc_id, h, least(len(h), 5) AS k FROM w WHERE len(h) > 0),
z AS (SELECT doc_id, list_transform(range(1, len(h) - k + 2), lambda i: CAST(list_sum(list_transform(list_zip(h[i:i + k - 1], ({_TIMES}::BIGINT[])[1:k]), lambda p: (p[1] * p[2]) % 4294967296)) % 4294967296 AS BIGINT)) AS x FROM s),
y AS (SELECT doc_id, list_transform(x, lambda v: (xor(v, v >> 15) * {_SCRAMBLE}) % 4294967296) AS x FROM z),
sh AS (SELECT doc_id, list_distinct(list_transform(x, lambda v: xor(v, v >> 13))) AS x FROM y),
sig AS (SELECT doc_id, list_transform(list_zip({_A}::BIGINT[], {_B}::BIGINT[]), lambda p: list_min(list_transform(list_transform(x, lambda v: (p[1] * v + p[2]) % 4294967296), lambda u: (xor(u, u >> 16) * {_SCRAMBLE}) % 4294967296))) AS signature FROM sh)
"""


@query(f"WITH {_SIGNATURES} SELECT doc_id, md5(array_to_string(signature, ',')) AS signature_md5 FROM sig")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: 128 minima over word 5-grams of every text."""
    return minhash.signatures(documents(spark, sf_dir)).select("doc_id", F.md5(F.array_join("signature", ",")).alias("signature_md5"))


@query(f"""
WITH {_SIGNATURES}, c AS (SELECT min(doc_id) AS first, signature FROM sig GROUP BY signature),
b AS (SELECT first, signature, unnest(range(0, 32)) AS band FROM c), k AS (SELECT first, band, signature, signature[band * 4 + 1:band * 4 + 4] AS rows FROM b),
p AS (SELECT DISTINCT x.first AS a, y.first AS b FROM k x JOIN k y ON x.band = y.band AND x.rows = y.rows AND x.first < y.first)
SELECT a, b, CAST(list_sum(list_transform(list_zip(x.signature, y.signature), lambda q: CASE WHEN q[1] = q[2] THEN 1 ELSE 0 END)) AS BIGINT) AS equal
FROM p JOIN c x ON x.first = a JOIN c y ON y.first = b WHERE list_sum(list_transform(list_zip(x.signature, y.signature), lambda q: CASE WHEN q[1] = q[2] THEN 1 ELSE 0 END)) >= {_NEAR}
""")
def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: pairs of classes (texts of one signature) that share a band and agree in 0.7 of the entries."""
    with Scratch(spark) as scratch:
        signed = scratch.table(minhash.signatures(documents(spark, sf_dir)), "signed")
        return scratch.keep(minhash.class_pairs(signed, scratch))


@query(f"""
WITH {_SIGNATURES}, v AS (SELECT sig.*, {_SPLIT} AS held FROM sig), k AS (SELECT doc_id, held, signature, unnest(range(0, 32)) AS band FROM v),
r AS (SELECT *, signature[band * 4 + 1:band * 4 + 4] AS rows FROM k),
n AS (SELECT DISTINCT x.doc_id FROM r x JOIN r y ON x.band = y.band AND x.rows = y.rows AND x.held AND NOT y.held
      WHERE list_sum(list_transform(list_zip(x.signature, y.signature), lambda q: CASE WHEN q[1] = q[2] THEN 1 ELSE 0 END)) >= {_NEAR})
SELECT doc_id, doc_id IN (SELECT doc_id FROM n) AS near FROM v WHERE held
""")
def decontam_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: held-out texts with a near-duplicate in the corpus."""
    with Scratch(spark) as scratch:
        held = F.pmod(h32(F.lit("v"), "doc_id"), F.lit(8)) == 0
        signed = scratch.table(minhash.signatures(documents(spark, sf_dir)).withColumn("held", held), "signed")
        return scratch.keep(minhash.near_flags(signed.where("held").drop("held"), signed.where("not held").drop("held"), scratch))


@query()
def greedy_self_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order, each kept unless one that shares its id, text or normalised text, or a near-duplicate, was kept before."""
    with Scratch(spark) as scratch:
        docs = documents(spark, sf_dir)
        signed = scratch.table(minhash.signatures(docs), "signed")
        pairs = scratch.table(minhash.class_pairs(signed, scratch), "pairs")
        firsts = scratch.table(minhash.classes(signed), "classes").select("signature", F.col("first").alias("class"))
        alike = scratch.table(signed.join(firsts, "signature").select("doc_id", "class"), "alike")
        keys = docs.select("doc_id", F.concat(F.col("n_chars").cast("string"), "lang").alias("id"), F.md5("text").alias("text"), F.md5(text.normalized(F.col("text"))).alias("norm"))
        nodes = scratch.table(keys.join(alike, "doc_id", "left").withColumnRenamed("doc_id", "node"), "nodes")
        kept = dedup.greedy_keep_by_keys(nodes, ["id", "text", "norm"], "class", pairs, scratch)
        return scratch.keep(kept.select(F.col("node").alias("doc_id"), "kept"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n FROM bg GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, round(count(*) / any_value(n.n), 6) AS contained FROM dg JOIN bg USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id
""")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3's extension: how much of each benchmark item's 13-grams a document holds."""

    def grams(df: DataFrame, key: str) -> DataFrame:
        hashed = F.transform(text.words(F.col("text")), lambda x: F.xxhash64(x))
        w = df.select(key, hashed.alias("w")).where(F.size("w") >= 13)
        each = F.transform(F.sequence(F.lit(1), F.size("w") - 12), lambda i: F.xxhash64(F.slice("w", i, 13)))
        return w.select(key, F.explode(F.array_distinct(each)).alias("g"))

    items = grams(table(spark, sf_dir, "benchmark"), "item_id")
    totals = items.groupBy("item_id").agg(F.count("*").alias("n"))
    found = grams(documents(spark, sf_dir), "doc_id").join(items, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    return found.join(totals, "item_id").select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("contained"))


@query("""
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN lang || '?' ELSE lang END AS id, length(text) AS chars FROM documents WHERE doc_id % 10 <> 7)
SELECT d.doc_id, CASE WHEN r.doc_id IS NULL THEN 'missing' WHEN r.id IS DISTINCT FROM d.lang THEN 'mismatch' ELSE 'aligned' END AS state, CAST(r.chars AS BIGINT) AS chars
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
""")
def row_aligned_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived split against its source by row, with its alignment; ``operators.align`` aborts on any other state."""
    from corpusloom.operators.align import aligned

    docs = documents(spark, sf_dir)
    derived = docs.where("doc_id % 10 <> 7").select("row_id", F.when(F.col("doc_id") % 9 == 4, F.concat("lang", F.lit("?"))).otherwise(F.col("lang")).alias("id"), F.length("text").cast("long").alias("chars"))
    out = aligned(docs.select("row_id", F.col("lang").alias("id")), derived, "row_id", "id")
    return out.select(F.col("row_id").alias("doc_id"), "state", "chars")


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_right")
def pairing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two sets were drawn at the same rows."""
    from corpusloom.operators.align import unpaired

    return unpaired(documents(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))


@query("""
WITH v AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE role = 'assistant')
SELECT conv_id, k AS view, ('0x' || substr(md5('r|' || conv_id || '|' || k), 1, 8))::BIGINT % 16 AS chunk, CAST(length(text) AS BIGINT) AS chars FROM v WHERE k < CASE WHEN conv_id < 50 THEN 4 ELSE 2 END
""")
def view_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first views of every record, more for the first records, routed by hash."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    grouped = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("views"))
    each = grouped.select("conv_id", F.posexplode("views").alias("view", "text")).where(F.col("view") < F.when(F.col("conv_id") < 50, 4).otherwise(2))
    return each.select("conv_id", F.col("view").cast("long").alias("view"), F.pmod(h32(F.lit("r"), "conv_id", "view"), F.lit(16)).alias("chunk"), F.length("text").cast("long").alias("chars"))


@query(f"""
WITH c AS (SELECT doc_id, unnest(['a', 'b', 'c', 'd', 'e']) AS cat, unnest([0.4, 0.3, 0.15, 0.1, 0.05]::DOUBLE[]) AS p FROM documents),
p AS (SELECT doc_id, cat, p / sum(p) OVER (PARTITION BY doc_id) AS p FROM c WHERE cat <> 'c'),
k AS (SELECT doc_id, cat, -ln(({h32_sql("'w|' || doc_id || '|' || cat")} + 1) / 4294967297.0::DOUBLE) / p AS key FROM p)
SELECT doc_id, cat, row_number() OVER (PARTITION BY doc_id ORDER BY key, cat) AS pick FROM k QUALIFY pick <= 3
""")
def weighted_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three categories per document without replacement, by weights renormalised after an exclusion."""
    weights = {"a": 0.4, "b": 0.3, "c": 0.15, "d": 0.1, "e": 0.05}
    left = {k: w for k, w in weights.items() if k != "c"}
    entry = lambda c, w: F.struct((-F.log((h32(F.lit("w"), "doc_id", F.lit(c)) + 1) / F.lit(4294967297.0)) / F.lit(w / sum(left.values()))).alias("key"), F.lit(c).alias("cat"))
    picks = F.slice(F.sort_array(F.array(*[entry(c, w) for c, w in left.items()])), 1, 3)
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(picks).alias("k", "x"))
    return rows.select("doc_id", "x.cat", (F.col("k") + 1).cast("long").alias("pick"))


@query("""
SELECT doc_id, CAST(o.start AS BIGINT) AS start, CAST(o.stop AS BIGINT) AS stop FROM documents d
JOIN (SELECT s * 97 AS start, (s + 1) * 97 AS stop FROM range(0, 100000) t(s)) o ON d.doc_id >= o.start AND d.doc_id < o.stop
""")
def row_to_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file (row range) of every row, by an interval join on buckets. The files are those that the ids ask for, however large
    or sparse these are (the twin lists the files of ids under 9,700,000)."""
    docs = documents(spark, sf_dir).select("doc_id")
    files = docs.select((F.col("doc_id") - F.pmod("doc_id", F.lit(97))).alias("start")).distinct().withColumn("stop", F.col("start") + 97)
    return interval_join(docs, files, "doc_id", "start", "stop", 128).select("doc_id", "start", "stop")


@query("SELECT source, lang, count(*) AS n, CAST(count(DISTINCT text) AS BIGINT) AS texts, CAST(count(*) - count(DISTINCT text) AS BIGINT) AS duplicates FROM documents GROUP BY GROUPING SETS ((source), (lang), ())")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts and duplicates by source, by language and over all."""
    docs = documents(spark, sf_dir).select("source", "lang", F.sha2("text", 256).alias("t"))
    each = docs.groupingSets([[F.col("source")], [F.col("lang")], []], F.col("source"), F.col("lang")).agg(F.count("*").alias("n"), F.count_distinct("t").alias("texts"))
    return each.select("source", "lang", "n", "texts", (F.col("n") - F.col("texts")).alias("duplicates"))


@query("""
SELECT count(*) AS sampled, CAST((SELECT count(*) FROM documents) AS BIGINT) AS rows, round(avg(strlen(text) + 2) * (SELECT count(*) FROM documents), 3) AS estimate FROM documents WHERE doc_id % 200 = 0
""")
def systematic_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a set estimated from every 200th row (the estimator's definition)."""
    docs = documents(spark, sf_dir)
    picked = F.when(F.col("row_id") % 200 == 0, F.octet_length("text") + 2)
    return docs.agg(F.count(picked).alias("sampled"), F.count("*").alias("rows"), F.round(F.avg(picked) * F.count("*"), 3).alias("estimate"))


@query("""
SELECT doc_id + 0 AS row_id, 0 AS part, source FROM documents UNION ALL SELECT item_id + (SELECT max(doc_id) + 1 FROM documents), 1, 'benchmark' FROM benchmark
""")
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources one after the other, with row ids offset."""
    docs, items = documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    after = docs.agg(F.max("doc_id")).first()[0] + 1
    return docs.select("row_id", F.lit(0).alias("part"), "source").unionByName(items.select((F.col("item_id") + after).alias("row_id"), F.lit(1).alias("part"), F.lit("benchmark").alias("source")))


@query(f"""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY md5('21|' || doc_id), doc_id) AS k FROM documents WHERE lang = 'en'), b AS (SELECT doc_id, row_number() OVER (ORDER BY md5('22|' || doc_id), doc_id) AS k FROM documents WHERE lang <> 'en'),
n AS (SELECT count(*) AS n FROM a)
SELECT doc_id, 'a' AS part FROM a, n WHERE k <= n * 4 // 5 UNION ALL SELECT doc_id, 'b' FROM b, n WHERE k <= n - n * 4 // 5
""")
def weighted_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of one set and, of the other, a fifth of the first's size."""
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    a = hash_ranked(docs.where("lang = 'en'"), hex_key(21, "doc_id"), "k", tie="doc_id")
    b = hash_ranked(docs.where("lang <> 'en'"), hex_key(22, "doc_id"), "k", tie="doc_id")
    n = docs.where("lang = 'en'").count()
    return a.where(F.col("k") < n * 4 // 5).select("doc_id", F.lit("a").alias("part")).unionByName(b.where(F.col("k") < n - n * 4 // 5).select("doc_id", F.lit("b").alias("part")))


@query(f"SELECT doc_id, round({h32_sql("'u|' || doc_id")} / 4294967296.0::DOUBLE, 9) AS u FROM documents")
def hash_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded uniform number that draws rest on."""
    return documents(spark, sf_dir).select("doc_id", F.round(unit(F.lit("u"), "doc_id"), 9).alias("u"))


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents), l AS (SELECT word, sum(quality) AS pos, sum(1 - quality) AS neg FROM (SELECT DISTINCT doc_id, word FROM w) JOIN labels USING (doc_id) GROUP BY word),
t AS (SELECT sum(pos) AS p, sum(neg) AS n, count(*) AS v FROM l), x AS (SELECT word, ln((pos + 1) / (p + v)::DOUBLE) - ln((neg + 1) / (n + v)::DOUBLE) AS weight FROM l, t),
s AS (SELECT w.doc_id, sum(weight) / count(weight) AS score FROM w LEFT JOIN x USING (word) GROUP BY w.doc_id)
SELECT doc_id, round(coalesce(score, 0), 6) + 0.0 AS score FROM documents LEFT JOIN s USING (doc_id)
""")
def lexical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: a quality score from words' log-odds in labelled texts; any model can take its place (``operators.scoring``)."""
    docs = documents(spark, sf_dir)
    weights = scoring.word_weights(docs, table(spark, sf_dir, "labels"), "quality")
    return scoring.lexical_scores(docs, weights).select(F.col("id").alias("doc_id"), (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query("SELECT doc_id, lang AS metadata_lang, source AS metadata_source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def parquet_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested record's fields as columns, for the rows of a list."""
    nested = documents(spark, sf_dir).select("doc_id", F.struct("lang", "source").alias("metadata"))
    return columnar.taken(columnar.flattened(nested), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, md5(text) AS text_md5, doc_id % 4 AS chunk FROM documents")
def jsonl_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet table as compressed JSON lines in chunks, read back by the strict reader."""
    with Scratch(spark) as scratch:
        path = scratch.path("lines")
        sinks.write_round_robin(documents(spark, sf_dir).select("doc_id", "text", "row_id"), path, "row_id", 4, columns=["doc_id", "text"], compression="gzip")
        schema = T.StructType().add("doc_id", "long").add("text", "string")
        lines = jsonl.parsed(jsonl.numbered_lines(spark, f"{path}/split=train/chunk=*"), schema, strict=True)
        chunk = F.regexp_extract("file", "chunk=([0-9]+)", 1).cast("long").alias("chunk")
        return scratch.keep(lines.select("record.doc_id", F.md5(jsonl.text_of("record", schema)).alias("text_md5"), chunk))


@query("SELECT doc_id, n_chars FROM documents")
def published_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result appears whole under its name, and a second one does not replace it."""
    rows = documents(spark, sf_dir).select("doc_id", "n_chars")
    with Scratch(spark) as scratch:
        path = scratch.path("published")
        made = sinks.publish(rows, path), sinks.publish(rows.withColumn("n_chars", F.lit(0)), path)
        if made != (True, False):
            raise RuntimeError("published twice")
        return scratch.keep(spark.read.parquet(path))
