"""Benchmark decontamination by spaced-seed hashing, with DataFrame expressions only.

Words are runs of letters and digits, lower-cased. A seed is a fixed mask over ``SPAN`` words whose unmarked places are ignored; for
every place and mask the marked words are hashed, in the test items and in the documents, and the hashes are joined. A hit fixes how
document and item lie against each other; there the two are compared word by word over all places they share, and the best stretch is
found where equal words score +2 and different ones -3. An overlap counts if its score reaches ``2 * OVERLAP`` (13 equal words net of
1.5 for each substitution), or the item's own length for shorter items (which a whole copy with one word in five substituted reaches).
Items of under ``SPAN`` words are too short for a mask; they count where a document has them whole, word by word, found by a join on
the hashes of whole items.

The benchmark's hashes are broadcast only if their counted number is at most ``BROADCAST_ROWS``; beyond, the join is a shuffle. Texts
are read again only for documents with hits, and these are found by a join on the written hits, which Spark broadcasts if they are few.

Defined cases: null texts have no overlap, and texts under ``SPAN`` words only with items that they hold whole; items without a word
match nothing; null and repeated document ids are told apart by their text; repeated rows get the same verdict; repeated and null item
ids are one item per distinct row; extra columns are ignored by ``overlaps`` and stay in ``verdicts``, whose results
replace columns of their own names (names that begin with an underscore are reserved); empty tables give no overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.scratch import Scratch

SPAN = 10
#: Together they find 99.7 % of whole copies of 15 words with 3 substituted at random, and more of longer ones.
MASKS = ((0, 1, 2, 4, 7, 9), (0, 1, 3, 6, 8, 9), (0, 2, 3, 5, 8, 9), (0, 4, 6, 7, 8))
OVERLAP = 13
#: Places of a block.
BLOCK = 64
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Hashes of a text's words in order."""
    split = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(split, lambda w: F.xxhash64(w))


def _places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``place`` and ``seed`` of every place and mask of the rows' ``words``.

    Words are cut into blocks that overlap by a span, and blocks are exploded into places: array reads and hashes are then generated
    code, and where Spark falls back to copying rows, it copies a block and not a text.
    """
    cut = F.transform(F.sequence(F.lit(0), F.size("words") - SPAN, F.lit(BLOCK)), lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, BLOCK + SPAN - 1).alias("w")))
    blocks = rows.where(F.size("words") >= SPAN).select(*keys, F.explode(cut).alias("_b")).select(*keys, F.col("_b.start").alias("_start"), F.col("_b.w").alias("_w"))
    places = blocks.select(*keys, "_start", "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - SPAN)).alias("_i"))
    seeds = F.array(*[F.xxhash64(F.lit(k), *[F.get("_w", F.col("_i") + d) for d in mask]) for k, mask in enumerate(MASKS)])
    return places.select(*keys, (F.col("_start") + F.col("_i")).alias("place"), F.explode(seeds).alias("seed"))


def items(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """``item, item_id, item_words`` of every distinct item."""
    rows = benchmark.select("item_id", words(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    return scratch.table(rows.withColumn("item", F.xxhash64("item_id", "item_words")).dropDuplicates(["item"]), "items")


def whole_copies(rows: DataFrame, tests: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame | None:
    """``keys, item, shift``: the first place of every short item in every row that has it whole; None without short items."""
    short = tests.where(F.size("item_words") < SPAN).select("item", F.size("item_words").alias("n"), F.expr("aggregate(item_words, 0L, (s, x) -> xxhash64(s, x))").alias("whole"))
    short = scratch.table(short, "short")
    sizes = sorted(r["n"] for r in short.select("n").distinct().collect())  # at most SPAN - 1 values
    if not sizes:
        return None

    def whole(n: int) -> Column:
        out = F.lit(0).cast("long")
        for k in range(n):
            out = F.xxhash64(out, F.get("_w", F.col("_i") + k))
        return F.when(F.col("_i") + n <= F.size("_w"), F.struct(F.lit(n).alias("n"), out.alias("whole")))

    cut = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(BLOCK)), lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, BLOCK + SPAN - 2).alias("w")))
    blocks = rows.where(F.size("words") > 0).select(*keys, F.explode(cut).alias("_b")).select(*keys, F.col("_b.start").alias("_start"), F.col("_b.w").alias("_w"))
    places = blocks.select(*keys, "_start", "_w", F.explode(F.sequence(F.lit(0), F.least(F.size("_w"), F.lit(BLOCK)) - 1)).alias("_i"))
    each = places.select(*keys, (F.col("_start") + F.col("_i")).alias("place"), F.explode(F.array(*[whole(n) for n in sizes])).alias("_h")).where("_h is not null")
    small = F.broadcast if short.count() <= BROADCAST_ROWS else lambda df: df
    found = each.select(*keys, "place", "_h.n", "_h.whole").join(small(short), ["n", "whole"])
    return found.groupBy(*keys, "item").agg(F.min("place").alias("shift"))


def best_stretch(a: Column, b: Column) -> Column:
    """Largest score of a stretch of two equally long arrays."""
    gain = F.zip_with(a, b, lambda x, y: F.when(x == y, 2).otherwise(-3))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        now = F.greatest(s["now"] + x, F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(gain, start, step, lambda s: s["best"])


def overlaps(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, item_id, score`` of every document and item with an overlap that counts."""
    tests = items(benchmark, scratch)
    marked = scratch.table(_places(tests.withColumnRenamed("item_words", "words"), ["item"]).withColumnRenamed("place", "item_place"), "seeds")
    bounded = marked.count() <= BROADCAST_ROWS
    small = F.broadcast if bounded else lambda df: df
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("words"))
    hits = _places(rows, ["doc_id", "text_hash"]).join(small(marked), "seed").select("doc_id", "text_hash", "item", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    copies = whole_copies(rows, tests, ["doc_id", "text_hash"], scratch)
    hits = scratch.table(hits if copies is None else hits.unionByName(copies), "hits")
    found = scratch.table(hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "found")
    again = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))
    again = again.join(found, again["doc_id"].eqNullSafe(found["_id"]) & (again["text_hash"] == found["_hash"]), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    again = scratch.table(again.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), words(F.col("_text")).alias("words")), "again")
    both = hits.join(small(tests), "item")
    both = both.join(again, both["doc_id"].eqNullSafe(again["_id"]) & (both["text_hash"] == again["_hash"]))
    a, b = F.greatest(F.col("shift"), F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    length = F.least(F.size("words") - a, F.size("item_words") - b)
    scored = both.withColumn("score", best_stretch(F.slice("words", a + 1, length), F.slice("item_words", b + 1, length)))
    needed = F.when(F.size("item_words") < SPAN, 2 * F.size("item_words")).otherwise(F.least(F.lit(2 * OVERLAP), F.size("item_words")))
    scored = scored.where(F.col("score") >= needed)
    return scratch.table(scored.groupBy("doc_id", "text_hash", "item_id").agg(F.max("score").alias("score")), "overlaps")


def verdicts(docs: DataFrame, found: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``contaminated``, ``n_items``, ``first_item`` (the least id) and ``best_score``."""
    by = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max("score").alias("best_score"))
    by = scratch.table(by, "by_document")
    out = docs.join(by, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_hash")), "left")
    out = out.withColumns({"contaminated": F.col("n_items").isNotNull(), "n_items": F.coalesce("n_items", F.lit(0)).cast("long"), "best_score": F.coalesce("best_score", F.lit(0))})
    return out.drop("_id", "_hash")
