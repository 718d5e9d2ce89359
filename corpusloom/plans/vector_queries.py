"""Queries over embeddings and class probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrays
from corpusloom.operators import statistics, vectors
from corpusloom.plans.registry import query, table
from corpusloom.plans.scratch import Scratch

_SIM = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query(f"""
WITH s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, {_SIM} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query, neighbour, round(sim, 6) AS sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS rank FROM s QUALIFY rank <= 10
""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every query (ids divisible by 100), against all."""
    vecs = table(spark, sf_dir, "embeddings")
    with Scratch(spark) as scratch:
        found = vectors.nearest(vecs.where("vec_id % 100 = 0"), vecs, 10, scratch)
        return scratch.keep(found.select("query", "neighbour", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank")))


_REVERSE = f"""
s AS (SELECT b.vec_id, a.vec_id AS key_id, a.label, {_SIM} AS sim FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 100 = 0),
u AS (SELECT vec_id, key_id, CAST(label AS VARCHAR) AS scope, sim FROM s UNION ALL SELECT vec_id, key_id, 'all', sim FROM s),
r AS (SELECT vec_id, scope, key_id, sim FROM u QUALIFY row_number() OVER (PARTITION BY vec_id, scope ORDER BY sim DESC, key_id) = 1)"""


@query(f"WITH {_REVERSE} SELECT vec_id, scope, key_id, round(sim, 6) AS sim FROM r")
def reverse_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's most similar key, by key group and over all."""
    vecs = table(spark, sf_dir, "embeddings")
    with Scratch(spark) as scratch:
        found = vectors.reverse_nearest(vecs.where("vec_id % 100 = 0"), vecs, scratch)
        return scratch.keep(found.withColumn("sim", F.round("sim", 6)))


@query(f"""
WITH {_REVERSE}, k AS (SELECT vec_id AS key_id, 'all' AS scope FROM embeddings WHERE vec_id % 100 = 0 UNION ALL SELECT vec_id, CAST(label AS VARCHAR) FROM embeddings WHERE vec_id % 100 = 0),
h AS (SELECT k.scope, k.key_id, count(r.vec_id) AS hits, count(r.vec_id) FILTER (r.sim >= 0.3) AS close FROM k LEFT JOIN r ON r.scope = k.scope AND r.key_id = k.key_id GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY hits DESC) AS n, count(*) OVER (PARTITION BY scope) AS c FROM h),
p AS (SELECT scope, avg(sim) AS mean_sim, quantile_cont(sim, 0.9) AS p90_sim, count(*) AS n_hits FROM r GROUP BY scope)
SELECT scope, any_value(c) AS n_keys, round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS hit_share, round(avg(CASE WHEN close > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS close_share,
  round(quantile_cont(hits, 0.5), 6) AS median_hits, round(sum(hits) FILTER (n <= greatest(1, ceil(c / 100))) / sum(hits), 6) AS top_share,
  round(any_value(mean_sim), 6) AS mean_sim, round(any_value(p90_sim), 6) AS p90_sim, any_value(n_hits) AS n_hits FROM o JOIN p USING (scope) GROUP BY scope
""")
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the keys are hit; keys without hits count."""
    vecs = table(spark, sf_dir, "embeddings")
    own = vecs.where("vec_id % 100 = 0")
    keys = own.select(F.col("vec_id").alias("key_id"), F.lit("all").alias("scope")).unionByName(own.select(F.col("vec_id").alias("key_id"), F.col("label").cast("string").alias("scope")))
    with Scratch(spark) as scratch:
        hits = scratch.table(vectors.reverse_nearest(own, vecs, scratch), "hits")
        out = vectors.coverage(keys, hits, 0.3)
        rounded = [F.round(c, 6).alias(c) for c in ("hit_share", "close_share", "median_hits", "top_share", "mean_sim", "p90_sim")]
        return scratch.keep(out.select("scope", "n_keys", *rounded, "n_hits"))


@query("""
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), e AS (SELECT v, unnest(range(1, 65)) AS i FROM u), f AS (SELECT i, v, unnest(range(1, 65)) AS j FROM e)
SELECT i - 1 AS i, j - 1 AS j, round(sum(v[i] * v[j]), 6) + 0.0 AS value FROM f WHERE i <= j GROUP BY i, j
""")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: the sum of outer products, which diversity rests on."""
    return vectors.gram(table(spark, sf_dir, "embeddings")).select("i", "j", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query()
def vendi_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective number of distinct vectors, overall and by label."""
    vecs = table(spark, sf_dir, "embeddings")
    rows = [("all", *vectors.vendi(vecs))]
    for label in [r[0] for r in vecs.select("label").distinct().orderBy("label").collect()]:  # labels are few by nature
        rows.append((str(label), *vectors.vendi(vecs.where(F.col("label") == label))))
    return spark.createDataFrame(rows, "scope string, vendi double, n long")


@query()
def vendi_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: mean and deviation of the effective number over five random subsets of 64 vectors of every label, and of all together."""
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("scope"), "embedding")
    both = vecs.withColumn("scope", F.explode(F.array("scope", F.lit("all"))))
    # ids are unique within a scope only, so they carry it
    both = both.withColumn("vec_id", F.concat_ws("/", "scope", "vec_id"))
    return vectors.vendi_of_subsets(both, "scope", 64, 5, 41)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) + 0.0 AS first FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: lengths, and vectors at length one."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.norm(v), 5).alias("norm"), (F.round(F.get(v, F.lit(0)) / arrays.norm(v), 5) + F.lit(0.0)).alias("first"))


@query(f"""
WITH p AS (SELECT a.label, a.vec_id, max({_SIM}) FILTER (b.label = a.label) AS own, max({_SIM}) FILTER (b.label <> a.label) AS other FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(CASE WHEN own > other THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS own_first, round(avg(own), 6) AS mean_own, round(avg(other), 6) AS mean_other FROM p WHERE own IS NOT NULL AND other IS NOT NULL GROUP BY label
""")
def own_source_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: how often a query (ids divisible by 100) is closest to its own group, with the similarities to own and nearest other."""
    vecs = table(spark, sf_dir, "embeddings")
    with Scratch(spark) as scratch:
        own = vecs.where("vec_id % 100 = 0")
        labels = [r[0] for r in vecs.select("label").distinct().collect()]  # few by nature
        found = None
        for label in labels:
            part = vectors.nearest(own, vecs.where(F.col("label") == label), 1, scratch).select("query", F.lit(label).alias("group"), "sim")
            found = part if found is None else found.unionByName(part)
        both = scratch.table(found, "best").join(own.select(F.col("vec_id").alias("query"), "label"), "query")
        each = both.groupBy("query", "label").agg(F.max(F.when(F.col("group") == F.col("label"), F.col("sim"))).alias("own"), F.max(F.when(F.col("group") != F.col("label"), F.col("sim"))).alias("other")).where("own is not null and other is not null")
        out = each.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("own") > F.col("other")).cast("double")), 6).alias("own_first"), F.round(F.avg("own"), 6).alias("mean_own"), F.round(F.avg("other"), 6).alias("mean_other"))
        return scratch.keep(out)


@query("""
WITH e AS (SELECT label, list_transform(embedding[1:8], lambda x: abs(x::DOUBLE)) AS a FROM embeddings), q AS (SELECT label, list_transform(a, lambda x: x / list_sum(a)) AS p FROM e),
c AS (SELECT label, i - 1 AS class, avg(p[i]) AS p FROM (SELECT label, p, unnest(range(1, 9)) AS i FROM q) GROUP BY ALL), r AS (SELECT class, p AS q FROM c WHERE label = 0)
SELECT label, round(0.5 * sum(abs(p - q)), 6) AS tv, round(-sum(p * ln(p)), 6) AS entropy FROM c JOIN r USING (class) GROUP BY label
""")
def class_distribution_tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean class distribution of each group, its entropy and its distance from a reference group."""
    a = F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double")))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    rows = table(spark, sf_dir, "embeddings").select("label", a.alias("a")).withColumn("p", F.transform("a", lambda x: x / total))
    out = statistics.variation(statistics.class_means(rows, "p", ["label"]), "label", 0)
    return out.select("label", F.round("tv", 6).alias("tv"), F.round("entropy", 6).alias("entropy"))


@query("""
WITH c AS (SELECT label, list_position(list_transform(embedding[1:8], lambda x: x), list_max(embedding[1:8])) - 1 AS top_a, list_position(embedding[9:16], list_max(embedding[9:16])) - 1 AS top_b FROM embeddings)
SELECT label, round(avg(CASE WHEN top_a = top_b THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS agreement, CAST(max(top_a) AS BIGINT) AS largest FROM c GROUP BY label
""")
def class_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: arg-max classes of two classifiers, and how often they agree."""
    top = lambda at: F.array_position(F.slice("embedding", at, 8), F.array_max(F.slice("embedding", at, 8))) - 1
    rows = table(spark, sf_dir, "embeddings").select("label", top(1).alias("a"), top(9).alias("b"))
    return rows.groupBy("label").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("agreement"), F.max("a").cast("long").alias("largest"))


@query("""
WITH s AS (SELECT label, doc_id // 1024 AS subset, n_chars FROM documents JOIN embeddings ON vec_id = doc_id), m AS (SELECT label, subset, avg(n_chars) AS m FROM s GROUP BY ALL),
a AS (SELECT label, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS median, round(stddev_pop(n_chars) / sqrt(count(*)), 6) AS sem FROM s GROUP BY label)
SELECT a.*, round(stddev_pop(m), 6) AS subset_std FROM a JOIN m USING (label) GROUP BY ALL
""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and standard error of a score, and its deviation over disjoint subsets of 1,024."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings"), F.col("vec_id") == F.col("doc_id")).select("label", F.floor(F.col("doc_id") / 1024).alias("subset"), "n_chars")
    whole = joined.groupBy("label").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.percentile("n_chars", 0.5), 6).alias("median"), F.round(F.stddev_pop("n_chars") / F.sqrt(F.count("*")), 6).alias("sem"))
    parts = joined.groupBy("label", "subset").agg(F.avg("n_chars").alias("m")).groupBy("label").agg(F.round(F.stddev_pop("m"), 6).alias("subset_std"))
    return whole.join(parts, "label")


@query("""
WITH v AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY ALL)
SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 6) + 0.0 AS cosine, round(sqrt(sum(a.m * a.m)), 6) AS norm_a FROM v a JOIN v b ON a.i = b.i AND a.label < b.label GROUP BY ALL
""")
def group_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines between the groups' mean vectors, with their lengths."""
    means = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    a, b = means.select(F.col("label").alias("a"), "i", F.col("m").alias("ma")), means.select(F.col("label").alias("b"), "i", F.col("m").alias("mb"))
    sums = a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.sum(F.col("ma") * F.col("mb")).alias("ab"), F.sum(F.col("ma") * F.col("ma")).alias("aa"), F.sum(F.col("mb") * F.col("mb")).alias("bb"))
    return sums.select("a", "b", (F.round(F.col("ab") / (F.sqrt("aa") * F.sqrt("bb")), 6) + F.lit(0.0)).alias("cosine"), F.round(F.sqrt("aa"), 6).alias("norm_a"))
