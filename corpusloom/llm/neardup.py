"""Near-duplicate documents by an inverted join on MinHash coordinates.

1. A text's set is its distinct word 5-grams; texts with equal sets become one node. A node's signature has ``SIZE`` coordinates, and
   the node is posted under each (coordinate, value) pair.
2. Pairs that occur once can't collide and are dropped. A link at the threshold shares ``MATCHES`` coordinates or more (but for about
   3 in 10 million at the threshold itself, fewer above), so both its nodes have one of their ``SIZE - MATCHES + 1`` rarest pairs in
   common: only these prefixes are posted, and a node whose pairs are mostly its own posts nothing.
3. Among the nodes that still post, shingles are counted. A node with e shingles of its own in a set of n shares at most n - e with
   any other, which rules out most nodes that merely share a passage, and bounds the sizes of possible partners. The shingles that
   are not its own are also counted in ``CELLS`` cells by hash: two sets share at most the sum of the cells' smaller counts.
4. Collisions are counted per list against the list's most ordinary node only, each node is confirmed on full sets against its best
   two, and the links give first components. What is left are lists that hold several components: their nodes outside the main
   component are paired with possible partners in other components, by size range. So pairs that are already connected are skipped,
   groups of copies are not expanded into all pairs, and no link between components is lost.
5. Pairs that collide on ``MATCHES`` coordinates or more are retained and confirmed on full sets, and components are found by
   contraction.

Defined cases: null, empty and wordless texts have empty sets and are alone; a text of under five words has its word sequence as its
only shingle; component ids ignore null document ids, and are null where a group has no other; repeated rows are in one component;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe_count import slices
from corpusloom.llm.components import components
from corpusloom.llm.shingles import coordinates, shingle_sets, signature
from corpusloom.plans.scratch import Scratch

SIZE, MATCHES, WIDTH = 64, 36, 5
#: The threshold as a fraction: links have NUMERATOR / DENOMINATOR of the union in common at least.
NUMERATOR, DENOMINATOR = 85, 100
#: Cells in which a node's shingles are counted.
CELLS = 64
#: Logarithmic width of a size bucket.
STEP = 0.04


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, key, sig`` of every row; ``key`` (null without words) names the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = coordinates(SIZE)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes, keys, sigs = [], [], []
            for part in slices(texts, 2_000_000):
                for s in shingle_sets([t.encode("utf-8") for t in texts[part]], WIDTH):
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(signature(s, params).view(np.int32) if len(s) else None)
            flat = pa.array(np.concatenate([s for s in sigs if s is not None] or [np.zeros(0, np.int32)]), pa.int32())
            ends = np.concatenate(([0], np.cumsum([0 if s is None else SIZE for s in sigs]))).astype(np.int32)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)]
            yield pa.record_batch(columns, ["doc_id", "text_hash", "n_shingles", "key", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, key binary, sig array<int>")


def prefixes(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, posts``: of every node, its pairs that others have too among its rarest ``SIZE - MATCHES + 1``, if there are any."""
    place = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    pairs = nodes.select("key", F.posexplode("sig").alias("pos", "value")).select("key", place.alias("pair"))
    shared = scratch.table(pairs.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    mine = pairs.join(shared, "pair").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("found"))  # at most SIZE
    room = F.lit(SIZE - MATCHES + 1) - (F.lit(SIZE) - F.size("found"))
    return mine.where(room > 0).select("key", F.transform(F.slice("found", 1, F.greatest(room, F.lit(1))), lambda x: x["pair"]).alias("posts"))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    nodes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for part in slices(texts, 2_000_000):
        yield from zip(nodes[part], shingle_sets([t.encode("utf-8") for t in texts[part]], WIDTH), strict=True)


def shared_shingles(texts: DataFrame) -> DataFrame:
    """``node, own, cells``: the number of shingles that no other of these texts has, and the others counted by cell (a shingle's last
    bits). A node is the 64-bit hash of its key."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, n = [], [], 0
        for batch in batches:
            for node, s in _sets(batch):
                for at in range(0, len(s), 100_000):
                    sets.append(s[at : at + 100_000].view(np.int64))
                    nodes.append(np.full(len(sets[-1]), node))
                    n += len(sets[-1])
                    if n >= 100_000:
                        yield pa.record_batch([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sets))], ["node", "shingle"])
                        nodes, sets, n = [], [], 0
        if n:
            yield pa.record_batch([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sets))], ["node", "shingle"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(node, np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).tolist()) for node, s in _sets(batch)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["node", "all_cells"])

    rows = texts.select("node", "text").mapInArrow(exploded, "node bigint, shingle bigint")
    single = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    cell = F.col("shingle").bitwiseAND(F.lit(CELLS - 1)).cast("int")
    own = single.groupBy("node", cell.alias("cell")).agg(F.count("*").alias("n")).groupBy("node").agg(F.sum("n").alias("own"), F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("_own"))
    total = texts.select("node", "text").mapInArrow(counted, "node bigint, all_cells array<bigint>")
    both = total.join(own, "node", "left")
    cells = F.transform("all_cells", lambda x, i: (x - F.coalesce(F.col("_own")[i], F.lit(0))).cast("int"))
    return both.select("node", F.coalesce("own", F.lit(0)).alias("own"), cells.alias("cells"))


def matching(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b, matches`` of the pairs that collide on ``MATCHES`` coordinates or more, counted over whole signatures."""
    one, two = nodes.select(F.col("key").alias("a"), F.col("sig").alias("sig_a")), nodes.select(F.col("key").alias("b"), F.col("sig").alias("sig_b"))
    equal = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", equal.alias("matches")).where(F.col("matches") >= MATCHES)


def confirmed(pairs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are links: those that match, held against the threshold on full sets. Texts move for those only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            links = []
            for at in range(0, len(a), 256):
                some = range(at, min(at + 256, len(a)))
                texts = {}
                for i in some:
                    texts.setdefault(a[i], (2, i))
                    texts.setdefault(b[i], (3, i))
                whole = [batch.column(c)[i].as_py().encode("utf-8") for c, i in texts.values()]
                sets = dict(zip(texts, [s for part in slices(whole, 2_000_000) for s in shingle_sets(whole[part], WIDTH)], strict=True))
                for i in some:
                    x, y = sets[a[i]], sets[b[i]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common):
                        links.append(i)
            kept = pa.array(links, pa.int64())
            yield pa.record_batch([batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"])

    found = scratch.table(matching(pairs, nodes).select("a", "b"), "matching")
    one, two = nodes.select(F.col("key").alias("a"), F.col("text").alias("text_a")), nodes.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    both = found.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a binary, b binary")


def _possible(n1: Column, e1: Column, n2: Column, e2: Column) -> Column:
    """Whether sets of n1 and n2 with e1 and e2 own elements can be linked."""
    most = F.least(n1 - e1, n2 - e2)
    return (NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (n1 + n2)


def _possible_by_cells(n1: Column, c1: Column, n2: Column, c2: Column) -> Column:
    """The same from the sets' counts by cell."""
    most = F.aggregate(F.zip_with(c1, c2, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return (NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (n1 + n2)


def links(nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between keys of ``nodes`` (key, n_shingles, sig, rep) that connect all that the threshold connects."""
    posts = scratch.table(prefixes(nodes, scratch), "prefixes")
    posting = nodes.join(posts, "key").select("key", "n_shingles", "sig", "posts", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), F.xxhash64("key").alias("node"))
    posting = scratch.table(posting, "posting")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    wanted = posting.select("key", "node", "rep_id", "rep_hash")
    texts = scratch.table(rows.join(wanted, rows["_id"].eqNullSafe(wanted["rep_id"]) & (rows["_hash"] == wanted["rep_hash"])).select("key", "node", "text").dropDuplicates(["key"]), "texts")
    own = scratch.table(shared_shingles(texts), "own")
    able = posting.join(own, "node")
    able = able.where(DENOMINATOR * (F.col("n_shingles") - F.col("own")) >= NUMERATOR * F.col("n_shingles"))
    able = scratch.table(able.select("key", F.col("n_shingles").alias("n"), "own", "cells", "sig", "posts").join(texts.select("key", "text"), "key"), "able")
    post = scratch.table(able.select("key", "n", "own", "cells", F.explode("posts").alias("pair")), "post")

    heads = post.groupBy("pair").agg(F.min(F.struct("own", "n", "key")).alias("head"), F.count("*").alias("size")).where("size > 1")
    heads = scratch.table(heads.select("pair", "head"), "heads")
    tries = post.join(heads, "pair").where((F.col("key") != F.col("head.key")) & _possible(F.col("n"), F.col("own"), F.col("head.n"), F.col("head.own")))
    tries = tries.groupBy(F.col("key").alias("a"), F.col("head.key").alias("b")).agg(F.count("*").alias("hits"))
    best = tries.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("hits", "b")), False).alias("best"))  # at most one a prefix pair
    first = scratch.table(best.select("a", F.explode(F.slice("best", 1, 2)).alias("x")).select("a", "x.b"), "first")
    found = scratch.table(confirmed(first, able, scratch), "links")

    labels = components(found, scratch)
    named = post.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = scratch.table(named, "named")
    head_labels = heads.select("pair", F.col("head.key").alias("key")).join(labels.withColumnRenamed("node", "key"), "key", "left").select("pair", F.coalesce("label", "key").alias("main"))
    head_labels = scratch.table(head_labels, "mains")
    bucket = lambda c: F.floor(F.log(c.cast("double")) / STEP)
    largest = F.least(F.col("n") * DENOMINATOR / NUMERATOR, (F.col("n") - F.col("own")) * ((NUMERATOR + DENOMINATOR) / NUMERATOR) - F.col("n"))
    apart = named.join(head_labels, "pair").where("label <> main")
    span = F.sequence(bucket(F.greatest(F.col("n") * NUMERATOR / DENOMINATOR * 0.9999, F.lit(1.0))), bucket(largest * 1.0001))
    apart = apart.where(largest >= F.col("n") * NUMERATOR / DENOMINATOR).select("pair", F.col("key").alias("x"), F.col("n").alias("nx"), F.col("own").alias("ex"), F.col("cells").alias("cx"), F.col("label").alias("lx"), F.explode(span).alias("bucket"))
    apart = scratch.table(apart, "apart")
    others = named.withColumn("bucket", bucket(F.col("n")))
    more = apart.join(others, ["pair", "bucket"]).where((F.col("lx") != F.col("label")) & _possible(F.col("n"), F.col("own"), F.col("nx"), F.col("ex")) & _possible_by_cells(F.col("n"), F.col("cells"), F.col("nx"), F.col("cx")))
    more = more.select(F.least("x", "key").alias("a"), F.greatest("x", "key").alias("b")).distinct()
    more = scratch.table(more, "more")
    return found.unionByName(scratch.table(confirmed(more, able, scratch), "links")).select("a", "b")


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, text_hash, n_shingles, group, component_id`` of every row; ``group`` names the component (null: alone)."""
    rows = scratch.table(fingerprints(docs), "rows")
    nodes = rows.where("key is not null").groupBy("key").agg(F.max("n_shingles").alias("n_shingles"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("sig").alias("sig"))
    nodes = scratch.table(nodes, "nodes")
    labels = components(links(nodes, docs, scratch), scratch).withColumnRenamed("node", "key")
    labels = scratch.table(labels.join(nodes.select("key", "least_id"), "key"), "labelled")
    ids = scratch.table(labels.groupBy("label").agg(F.min("least_id").alias("component_id")), "ids")
    named = labels.join(ids, "label").select("key", "label", "component_id")
    named = nodes.select("key", "least_id").join(named, "key", "left").select("key", F.coalesce("label", "key").alias("group"), F.coalesce("component_id", "least_id").alias("component_id"))
    named = scratch.table(named, "named")
    out = rows.drop("sig").join(named, "key", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "group", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


