"""The ordinary relational surface, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.registry import query, seconds, table


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, then sums and means by two keys."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY n_name
""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join down to small dimensions, which adaptive execution broadcasts by their size."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT s_nationkey, s_suppkey, round(s_acctbal, 2) AS s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier QUALIFY place <= 3")
def top_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three per group."""
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).cast("long")
    return table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"), place.alias("place")).where("place <= 3")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def segment_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All subtotals of two dimensions."""
    return table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ROLLUP (year(o_orderdate), month(o_orderdate))")
def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotals down a hierarchy."""
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"))
    return rows.rollup("y", "m").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def nation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and difference of sets."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return a.intersect(table(spark, sf_dir, "customer").select("c_nationkey")).exceptAll(table(spark, sf_dir, "nation").where("n_regionkey = 0").select("n_nationkey"))


@query("""
SELECT e.event_id, max(o.event_id) AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'view') e LEFT JOIN events o ON o.user_id = e.user_id AND o.event_type = 'purchase' AND o.event_id <= e.event_id GROUP BY e.event_id
""")
def last_purchase_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join by a running maximum within each user, without pairing rows."""
    rows = table(spark, sf_dir, "events").where("event_type in ('view', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("last_purchase", F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w))
    return out.where("event_type = 'view'").select("event_id", "last_purchase")


@query("""
SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour windows over event time."""
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(seconds("w.start").alias("start"), "event_type", "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after twelve quiet hours."""
    w = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", seconds("w.start").alias("start"), "n")
