"""Queries of the statistical analyses, over the star schema's measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import statistics
from corpusloom.operators.order import numbered
from corpusloom.plans.registry import h32_sql, query, table


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


@query("""
WITH t AS (SELECT quantile_cont(value, 0.3) AS tau FROM events), f AS (SELECT event_type, value <= tau AS fired FROM events, t)
SELECT event_type, count(*) AS n, count(*) FILTER (fired) AS fired, round(count(*) FILTER (fired) / count(*), 6) AS rate, round(count(*) FILTER (fired) / sum(count(*) FILTER (fired)) OVER (), 6) AS share FROM f GROUP BY event_type
""")
def quantile_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate at a quantile of all values, its rate by source and what the gated part is made of."""
    gated = statistics.gate(table(spark, sf_dir, "events"), "value", 0.3)
    out = gated.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("fired").alias("fired"))
    share = F.col("fired") / F.sum("fired").over(Window.partitionBy())  # one row a source
    return _rounded(out.withColumns({"rate": F.col("fired") / F.col("n"), "share": share}), "rate", "share")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def entropy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and exact quantiles by source."""
    q = F.percentile("value", [0.5, 0.1, 0.9])
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), q.alias("q"))
    return _rounded(out.select("event_type", "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p10"), F.col("q")[2].alias("p90")), "mean", "median", "p10", "p90")


@query("""
WITH v AS (SELECT c_mktsegment AS seg, abs(c_acctbal) AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT seg, count(*) AS n, round(sum(v) FILTER (r > n - greatest(1, floor(n * 0.1))) / sum(v), 6) AS top10, round(sum(v) FILTER (r > n - greatest(1, floor(n * 0.2))) / sum(v), 6) AS top20,
  round(2 * sum(r * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) AS gini, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.99), 6) AS p99 FROM v GROUP BY seg
""")
def concentration_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the top tenth and fifth, Gini, mean and quantiles of absolute values."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), "c_acctbal")
    return _rounded(statistics.concentration(rows, "c_acctbal", "c_custkey", ["seg"]), "top10", "top20", "gini", "mean", "median", "p99")


@query("""
WITH m AS (SELECT c_mktsegment AS seg, avg(c_acctbal) AS m FROM customer GROUP BY 1), s AS (SELECT seg, count(*) AS n, avg(c_acctbal) AS mean, sum(pow(c_acctbal - m, 2)) AS s2, sum(pow(c_acctbal - m, 3)) AS s3, sum(pow(c_acctbal - m, 4)) AS s4, avg(abs(c_acctbal)) AS abs_mean, min(c_acctbal) AS least, max(c_acctbal) AS largest FROM customer JOIN m ON seg = c_mktsegment GROUP BY seg)
SELECT seg, n, round(mean, 5) AS mean, round(sqrt(s2 / (n - 1)), 5) AS std, round(s3 / n / pow(sqrt(s2 / (n - 1)), 3), 5) AS skew, round(s4 / n / pow(sqrt(s2 / (n - 1)), 4), 5) AS kurtosis, round(abs_mean, 5) AS abs_mean, round(least, 5) AS least, round(largest, 5) AS largest FROM s
""")
def moment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments over the sample deviation."""
    out = statistics.moments(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "seg"), "c_acctbal", ["seg"])
    return _rounded(out, "mean", "std", "skew", "kurtosis", "abs_mean", "least", "largest", digits=5)


@query("""
WITH b AS (SELECT event_type, CAST(floor(value / 5.0::DOUBLE) AS BIGINT) AS bin FROM events WHERE value >= 0 AND value < 100)
SELECT event_type, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY event_type) * 5.0::DOUBLE), 6) AS density FROM b GROUP BY event_type, bin
""")
def histogram_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities over fixed bins by source."""
    return _rounded(statistics.histogram(table(spark, sf_dir, "events"), "value", 0.0, 100.0, 20, ["event_type"]), "density")


@query("""
WITH r AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey % 50, o_orderkey) AS x, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS y FROM orders)
SELECT o_orderstatus, round(corr(x::DOUBLE, y::DOUBLE), 6) AS spearman, count(*) AS n FROM r GROUP BY o_orderstatus
""")
def spearman_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation in which ties keep their position."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_custkey") % 50).cast("double").alias("x"), "o_totalprice", "o_orderkey")
    return _rounded(statistics.spearman(rows, "x", "o_totalprice", "o_orderkey", ["o_orderstatus"]), "spearman")


@query("""
WITH r AS (SELECT o_orderstatus, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey % 50) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey % 50) - 1) / 2.0::DOUBLE AS x,
  rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0::DOUBLE AS y FROM orders)
SELECT o_orderstatus, round(corr(x, y), 6) AS spearman, count(*) AS n FROM r GROUP BY o_orderstatus
""")
def spearman_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation in which ties share their average rank."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_custkey") % 50).cast("double").alias("x"), "o_totalprice", "o_orderkey")
    return _rounded(statistics.spearman(rows, "x", "o_totalprice", "o_orderkey", ["o_orderstatus"], average_ties=True), "spearman")


_PAR = "p AS (SELECT o_orderkey AS id, o_totalprice AS c, ((o_custkey * 7919 + o_orderkey * 104729) % 100003)::DOUBLE / o_totalprice AS y FROM orders WHERE o_totalprice > 0)"


@query(f"""
WITH {_PAR}, m AS (SELECT id, c, y, min(y) OVER (ORDER BY ln(c) RANGE BETWEEN UNBOUNDED PRECEDING AND 0.0198026272961797 FOLLOWING) AS least FROM p)
SELECT id, round(c, 6) AS c, round(y, 6) AS y FROM m WHERE least >= y
""")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that nothing of about their cost beats."""
    loss = ((F.col("o_custkey") * 7919 + F.col("o_orderkey") * 104_729) % 100_003).cast("double") / F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("c"), loss.alias("y"))
    return _rounded(statistics.pareto(rows, "c", "y", "id"), "c", "y")


_CURVE = "g AS (SELECT p_brand, p_size::DOUBLE AS x, avg(p_retailprice) AS y FROM part GROUP BY ALL)"


@query(f"""
WITH {_CURVE}, n AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER (PARTITION BY p_brand ORDER BY y, x) AS k FROM g WINDOW w AS (PARTITION BY p_brand ORDER BY x)),
q AS (SELECT *, (x - x0) * (y - y2) AS a, (x - x2) * (y - y0) AS b FROM n WHERE k = 1)
SELECT p_brand, x AS best, x0 IS NULL OR x2 IS NULL AS edge, round(x - 0.5 * ((x - x0) * a - (x - x2) * b) / (a - b), 5) AS vertex FROM q
""")
def parabola_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertex through the best point and its neighbours; points at the edge have none."""
    g = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    w = Window.partitionBy("p_brand").orderBy("x")  # one row a grid value
    near = g.withColumns({"x0": F.lag("x").over(w), "y0": F.lag("y").over(w), "x2": F.lead("x").over(w), "y2": F.lead("y").over(w)})
    best = near.groupBy("p_brand").agg(F.min(F.struct("y", "x", "x0", "y0", "x2", "y2")).alias("b")).select("p_brand", "b.*")
    found = statistics.vertex(F.col("x0"), F.col("y0"), F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    return best.select("p_brand", F.col("x").alias("best"), (F.col("x0").isNull() | F.col("x2").isNull()).alias("edge"), F.round(found, 5).alias("vertex"))


@query(f"""
WITH {_CURVE}, n AS (SELECT p_brand, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM g WINDOW w AS (PARTITION BY p_brand ORDER BY x)), q AS (SELECT unnest([5.5, 12.25, 49.5, 77.0]::DOUBLE[]) AS at)
SELECT b.p_brand, q.at, round(n.y + (n.y2 - n.y) * (q.at - n.x) / (n.x2 - n.x), 5) AS y FROM (SELECT DISTINCT p_brand FROM g) b CROSS JOIN q LEFT JOIN n ON n.p_brand = b.p_brand AND q.at >= n.x AND q.at < n.x2
""")
def interpolated_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves at fixed offsets, null outside their range."""
    g = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    w = Window.partitionBy("p_brand").orderBy("x")  # one row a grid value
    spans = g.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)})
    asked = g.select("p_brand").distinct().withColumn("at", F.explode(F.array(*map(F.lit, (5.5, 12.25, 49.5, 77.0)))))
    on = (asked["p_brand"] == spans["p_brand"]) & (F.col("at") >= F.col("x")) & (F.col("at") < F.col("x2"))
    y = F.col("y") + (F.col("y2") - F.col("y")) * (F.col("at") - F.col("x")) / (F.col("x2") - F.col("x"))
    return asked.join(spans, on, "left").select(asked["p_brand"], "at", F.round(y, 5).alias("y"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n, round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2)), 2) AS sigma FROM lineitem GROUP BY l_returnflag")
def line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares with correlation and residual deviation."""
    out = statistics.line_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r", 6).alias("r"), "n", F.round("sigma", 2).alias("sigma"))


@query("""
WITH s AS (SELECT l_partkey, l_returnflag, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL), d AS (SELECT a.l_partkey, b.v - a.v AS delta FROM s a JOIN s b ON a.l_partkey = b.l_partkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R')
SELECT count(*) AS n, round(quantile_cont(delta, 0.5), 4) AS median_delta, round(avg(CASE WHEN delta < 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share_better FROM d
""")
def paired_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences: median and share that improves."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("v"))
    a, b = s.where("l_returnflag = 'A'").select("l_partkey", F.col("v").alias("a")), s.where("l_returnflag = 'R'").select("l_partkey", F.col("v").alias("b"))
    d = a.join(b, "l_partkey").select((F.col("b") - F.col("a")).alias("delta"))
    return d.agg(F.count("*").alias("n"), F.round(F.percentile("delta", 0.5), 4).alias("median_delta"), F.round(F.avg((F.col("delta") < 0).cast("double")), 6).alias("share_better"))


@query("""
WITH r AS (SELECT l_shipdate::DATE AS d, l_returnflag, l_quantity AS x, l_extendedprice AS y, l_tax * 100 + l_quantity / 10 AS c FROM lineitem)
SELECT l_returnflag, round(corr(x, y), 6) AS xy, round(corr(x, c), 6) AS xc, round(corr(y, c), 6) AS yc, count(*) AS n, round((corr(x, y) - corr(x, c) * corr(y, c)) / sqrt((1 - corr(x, c) * corr(x, c)) * (1 - corr(y, c) * corr(y, c))), 6) AS partial_r FROM r GROUP BY l_returnflag
""")
def partial_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation with a third variable's part removed."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_tax") * 100 + F.col("l_quantity") / 10).alias("c"))
    return _rounded(statistics.partial_correlation(rows, "x", "y", "c", ["l_returnflag"]), "xy", "xc", "yc", "partial_r")


@query("""
WITH p AS (SELECT l_returnflag AS g, corr(l_quantity, l_tax) AS qt, corr(l_quantity, l_discount) AS qd, corr(l_extendedprice, l_tax) AS et, corr(l_extendedprice, l_discount) AS ed FROM lineitem GROUP BY 1)
SELECT g, source, metric, round(r, 6) + 0.0 AS r FROM (SELECT g, 'quantity' AS source, 'tax' AS metric, qt AS r FROM p UNION ALL SELECT g, 'quantity', 'discount', qd FROM p UNION ALL SELECT g, 'price', 'tax', et FROM p UNION ALL SELECT g, 'price', 'discount', ed FROM p)
""")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source by metric matrix of correlations in one pass."""
    pairs = [("quantity", "l_quantity", "tax", "l_tax"), ("quantity", "l_quantity", "discount", "l_discount"), ("price", "l_extendedprice", "tax", "l_tax"), ("price", "l_extendedprice", "discount", "l_discount")]
    entries = [F.struct(F.lit(s).alias("source"), F.lit(m).alias("metric"), F.corr(x, y).alias("r")) for s, x, m, y in pairs]
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.array(*entries).alias("e"))
    return _rounded(wide.select("g", F.explode("e").alias("e")).select("g", "e.*"), "r")


_DRAW = h32_sql("'31|' || rep || '|' || c_mktsegment || '|' || r")


@query(f"""
WITH i AS (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS r, c_acctbal FROM customer), n AS (SELECT c_mktsegment, count(*) AS n FROM i GROUP BY 1),
d AS (SELECT c_mktsegment, rep, r FROM i, range(0, 2000) t(rep)), k AS (SELECT d.c_mktsegment, rep, {_DRAW} % n.n AS r FROM d JOIN n USING (c_mktsegment)),
m AS (SELECT rep, k.c_mktsegment, avg(c_acctbal) AS m FROM k JOIN i ON i.c_mktsegment = k.c_mktsegment AND i.r = k.r GROUP BY ALL), a AS (SELECT rep, avg(m) AS macro FROM m GROUP BY rep)
SELECT count(*) AS reps, round(avg(macro), 5) AS mean, round(stddev_pop(macro), 5) AS se FROM a
""")
def bootstrap_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard error of a macro mean by resampling within groups."""
    rows = numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_custkey", "r", by=["c_mktsegment"])
    return _rounded(statistics.bootstrap(rows, "r", "c_acctbal", 2000, 31, ["c_mktsegment"]), "mean", "se", digits=5)


@query("""
WITH l AS (SELECT c_nationkey, ln(count(*)) AS x, ln(sum(o_totalprice)) AS y FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT round(exp(regr_intercept(y, x)), 3) AS factor, round(regr_slope(y, x), 6) AS exponent, round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*)), 6) AS rms FROM l
""")
def power_law_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y = A x^k by least squares of the logarithms."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    logs = joined.groupBy("c_nationkey").agg(F.log(F.count("*").cast("double")).alias("x"), F.log(F.sum("o_totalprice")).alias("y"))
    out = statistics.line_fit(logs, "x", "y")
    rms = F.col("sigma") * F.sqrt((F.col("n") - 2) / F.col("n"))
    return out.select(F.round(F.exp("intercept"), 3).alias("factor"), F.round("slope", 6).alias("exponent"), F.round(rms, 6).alias("rms"))


@query("""
WITH l AS (SELECT l_suppkey, ln(sum(l_quantity)) AS n, ln(count(DISTINCT l_partkey) + avg(l_discount) * 20) AS d, ln(sum(l_extendedprice)) AS y FROM lineitem GROUP BY 1),
s AS (SELECT covar_pop(n, n) AS a, covar_pop(n, d) AS b, covar_pop(d, d) AS c, covar_pop(n, y) AS e, covar_pop(d, y) AS f, avg(n) AS mn, avg(d) AS md, avg(y) AS my FROM l)
SELECT round(my - (e * c - f * b) / (a * c - b * b) * mn - (f * a - e * b) / (a * c - b * b) * md, 4) AS c0, round((e * c - f * b) / (a * c - b * b), 4) AS c1, round((f * a - e * b) / (a * c - b * b), 4) AS c2 FROM s
""")
def two_regressor_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A law in two variables by least squares of the logarithms."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.log(F.sum("l_quantity")).alias("n"), F.log(F.count_distinct("l_partkey") + F.avg("l_discount") * 20).alias("d"), F.log(F.sum("l_extendedprice")).alias("y"))
    return statistics.plane_fit(per, "n", "d", "y").select(*[F.round(c, 4).alias(c) for c in ("c0", "c1", "c2")])


@query()
def saturating_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L = E + A C^-b over the mean loss by quantity; the table is one row a quantity."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("y")).orderBy("l_quantity").collect()
    e, a, b, rms = statistics.saturating_fit([r["l_quantity"] for r in rows], [r["y"] for r in rows])
    return spark.createDataFrame([(e, a, b, rms)], "e double, a double, b double, rms double")


@query("""
SELECT p_size, CAST(6 * p_partkey * 1000 AS BIGINT) AS compute, round(p_partkey * 1000 / (20.0::DOUBLE * p_size), 6) AS multiple, round_even(round(p_retailprice, 2) / 10, 0) AS half_even FROM part
""")
def derived_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compute, multiples and values rounded with ties to even."""
    p = table(spark, sf_dir, "part")
    return p.select("p_size", (F.col("p_partkey") * 6000).alias("compute"), F.round(F.col("p_partkey") * 1000 / (F.lit(20.0) * F.col("p_size")), 6).alias("multiple"), F.bround(F.round("p_retailprice", 2) / 10, 0).alias("half_even"))


@query("""
WITH s AS (SELECT o_orderpriority AS arm, o_custkey % 4 AS seed, avg(o_totalprice) AS y FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL), m AS (SELECT arm, avg(y) AS mean, stddev_pop(y) AS spread FROM s GROUP BY arm), b AS (SELECT mean AS base FROM m WHERE starts_with(arm, '1'))
SELECT arm, round(mean, 4) AS mean, round(spread, 4) AS spread, round(mean - base, 4) + 0.0 AS against_unique FROM m, b
""")
def sweep_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed means of a sweep, excluded sources left out, against a reference arm."""
    s = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_orderpriority").alias("arm"), (F.col("o_custkey") % 4).alias("seed")).agg(F.avg("o_totalprice").alias("y"))
    m = s.groupBy("arm").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("spread"))
    base = m.where(F.col("arm").startswith("1")).first()["mean"]  # one row an arm
    return m.select("arm", F.round("mean", 4).alias("mean"), F.round("spread", 4).alias("spread"), (F.round(F.col("mean") - base, 4) + F.lit(0.0)).alias("against_unique"))
