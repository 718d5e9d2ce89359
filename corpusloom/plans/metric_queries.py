"""Queries over run logs. ``events`` is the log: the user is the run, the event id the step, ``props.k`` a grid value, ``value`` the
loss; the star schema's tables are manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import schedules
from corpusloom.operators import dedup, experiments
from corpusloom.plans.registry import query, table

_E = "e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
#: Last write of every (run, metric, k).
_LAST = f"{_E}, l AS (SELECT user_id, event_type, k, max_by(value, event_id) AS value FROM e GROUP BY ALL)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with their grid value."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of every run, metric and grid value."""
    rows = log(spark, sf_dir).select("user_id", "event_type", "k", "value", "event_id")
    return dedup.latest(rows, ["user_id", "event_type", "k"], [F.col("event_id")]).select("user_id", "event_type", "k", "value")


@query(f"""
WITH {_E} SELECT event_type, (event_id - 1 + 50) // 50 - 1 AS bin, round(avg(value), 6) AS mean_loss, max(event_id) AS last_step, max_by(k, event_id) AS last_k, count(value) AS n FROM e GROUP BY ALL
""")
def binned_training_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean finite loss per bin of 50 steps, with the last value of another column."""
    out = experiments.binned_means(log(spark, sf_dir), ["event_type"], "event_id", "value", "k", "event_id")
    return out.select("event_type", "bin", F.round("mean_loss", 6).alias("mean_loss"), "last_step", F.col("last_value").alias("last_k"), "n")


@query(f"WITH {_LAST} SELECT user_id, event_type, k, value FROM l")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest record of each key; later lines win ties of time."""
    return last(spark, sf_dir)


@query("SELECT user_id, max(event_id) AS last_step FROM events GROUP BY user_id")
def tail_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last step that a run has logged."""
    return log(spark, sf_dir).groupBy("user_id").agg(F.max("event_id").alias("last_step"))


@query(f"""
WITH {_LAST}, f AS (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'browse' ELSE 'act' END AS family, event_type, avg(value) AS v FROM l GROUP BY ALL)
SELECT user_id, family, n, mean, n = expected AS complete, CASE WHEN n = expected THEN mean END AS mean_if_complete FROM (
  SELECT user_id, family, count(v) AS n, round(avg(v), 10) AS mean, CASE family WHEN 'browse' THEN 2 ELSE 3 END AS expected FROM f GROUP BY user_id, family)
""")
def family_macro_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro averages over families of metrics; incomplete ones give no mean."""
    family = F.when(F.col("event_type").isin("click", "view"), "browse").otherwise("act")
    each = last(spark, sf_dir).groupBy("user_id", family.alias("family"), "event_type").agg(F.avg("value").alias("v"))
    out = each.groupBy("user_id", "family").agg(F.count("v").alias("n"), F.round(F.avg("v"), 10).alias("mean"))
    complete = F.col("n") == F.when(F.col("family") == "browse", 2).otherwise(3)
    return out.withColumns({"complete": complete, "mean_if_complete": F.when(complete, F.col("mean"))})


@query("""
WITH s AS (SELECT source, lang, sum(n_chars * 0.7::DOUBLE + doc_id % 13) AS nll, sum(strlen(text)) AS bytes FROM documents GROUP BY ALL), b AS (SELECT lang, source, nll / ln(2::DOUBLE) / bytes AS bpb, nll, bytes FROM s)
SELECT lang, round(sum(nll) / ln(2::DOUBLE) / sum(bytes), 6) AS micro_bpb, round(avg(bpb), 6) AS macro_bpb, round(exp(avg(bpb)), 6) AS perplexity FROM b GROUP BY lang
""")
def micro_macro_bpb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits per byte over all bytes, unweighted over sources, and the perplexity of the mean."""
    s = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum(F.col("n_chars") * F.lit(0.7) + F.col("doc_id") % 13).alias("nll"), F.sum(F.octet_length("text")).alias("bytes"))
    s = s.withColumn("bpb", F.col("nll") / F.log(F.lit(2.0)) / F.col("bytes"))
    return s.groupBy("lang").agg(F.round(F.sum("nll") / F.log(F.lit(2.0)) / F.sum("bytes"), 6).alias("micro_bpb"), F.round(F.avg("bpb"), 6).alias("macro_bpb"), F.round(F.exp(F.avg("bpb")), 6).alias("perplexity"))


@query("""
WITH d AS (SELECT doc_id % 8 AS rank, source, (n_chars % 97)::DOUBLE AS nll, n_chars FROM documents WHERE n_chars > 0), r AS (SELECT source, rank, avg(nll) AS a, avg(nll / n_chars) AS b FROM d GROUP BY ALL)
SELECT source, round(avg(a), 6) AS nll, round(avg(b), 6) AS nll_per_char FROM r GROUP BY source
""")
def validation_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-document ratios averaged per reader, then over readers without weights."""
    d = table(spark, sf_dir, "documents").where("n_chars > 0").select((F.col("doc_id") % 8).alias("rank"), "source", (F.col("n_chars") % 97).cast("double").alias("nll"), "n_chars")
    per = d.groupBy("source", "rank").agg(F.avg("nll").alias("a"), F.avg(F.col("nll") / F.col("n_chars")).alias("b"))
    return per.groupBy("source").agg(F.round(F.avg("a"), 6).alias("nll"), F.round(F.avg("b"), 6).alias("nll_per_char"))


@query(f"""
WITH {_LAST}, m AS (SELECT c_custkey AS user_id, s.k FROM customer, (SELECT unnest([10, 50, 90]::BIGINT[]) AS k) s) SELECT m.user_id, m.k, round(l.value, 6) AS purchase FROM m LEFT JOIN l ON l.user_id = m.user_id AND l.k = m.k AND l.event_type = 'purchase'
""")
def manifest_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows with their metric at exactly the step asked for; absent ones are null."""
    manifest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.array(*[F.lit(k).cast("long") for k in (10, 50, 90)])).alias("k"))
    metrics = last(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "k", F.round("value", 6).alias("purchase"))
    return experiments.at_step(manifest, metrics, ["user_id", "k"])


@query(f"""
WITH {_LAST}, p AS (SELECT user_id, k, value FROM l WHERE event_type = 'purchase'), q AS (SELECT user_id, k, value FROM l WHERE event_type = 'view')
SELECT coalesce(p.user_id, q.user_id) AS user_id, coalesce(p.k, q.k) AS k, round(coalesce(p.value, q.value), 6) AS value, p.value IS NULL AS filled FROM p FULL JOIN q ON p.user_id = q.user_id AND p.k = q.k
""")
def gap_fill_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary family's value where there is one, else the fallback's."""
    rows = last(spark, sf_dir)
    pick = lambda kind: rows.where(F.col("event_type") == kind).select("user_id", "k", "value")
    return experiments.gaps_filled(pick("purchase"), pick("view"), ["user_id", "k"], "value").withColumn("value", F.round("value", 6))


@query(f"""
WITH {_LAST}, a AS (SELECT user_id, k, value FROM l WHERE event_type = 'view'), b AS (SELECT user_id, k, value FROM l WHERE event_type = 'click' AND k >= 50)
SELECT user_id, k, round(value, 6) AS value FROM b UNION ALL SELECT user_id, k, round(value, 6) FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.k = a.k)
""")
def branch_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch's log over the main one."""
    rows = last(spark, sf_dir)
    main = rows.where("event_type = 'view'").select("user_id", "k", "value")
    branch = rows.where("event_type = 'click' and k >= 50").select("user_id", "k", "value")
    return experiments.overridden(main, branch, ["user_id", "k"]).withColumn("value", F.round("value", 6))


@query(f"""
WITH {_LAST}, n AS (SELECT user_id, 'run_' || event_type || '_' || k AS name, value FROM l WHERE event_type IN ('view', 'click'))
SELECT a.user_id, a.name, round(b.value - a.value, 6) + 0.0 AS delta FROM n a JOIN n b ON a.user_id = b.user_id AND b.name = replace(a.name, '_view_', '_click_') WHERE a.name LIKE '%_view_%'
""")
def twin_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs joined to their twins by a rewritten name."""
    rows = last(spark, sf_dir).where("event_type in ('view', 'click')").select("user_id", F.concat(F.lit("run_"), "event_type", F.lit("_"), "k").alias("name"), "value")
    a = rows.where(F.col("name").contains("_view_")).withColumn("twin", F.replace("name", F.lit("_view_"), F.lit("_click_")))
    b = rows.select("user_id", F.col("name").alias("twin"), F.col("value").alias("other"))
    return a.join(b, ["user_id", "twin"]).select("user_id", "name", (F.round(F.col("other") - F.col("value"), 6) + F.lit(0.0)).alias("delta"))


@query(f"""
WITH {_LAST}, r AS (SELECT event_type, k, value FROM l WHERE user_id = 1) SELECT l.user_id, l.event_type, l.k, round(l.value - r.value, 6) + 0.0 AS delta FROM l JOIN r USING (event_type, k) WHERE l.user_id <> 1
""")
def delta_vs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences to a reference run at the same step."""
    rows = last(spark, sf_dir).withColumn("step", F.struct("event_type", "k"))
    out = experiments.against_reference(rows, "user_id", "step", "value", 1)
    return out.select("user_id", "event_type", "k", (F.round("delta", 6) + F.lit(0.0)).alias("delta"))


@query(f"""
WITH {_E}, n AS (SELECT event_type, count(DISTINCT user_id % 10) AS runs FROM e GROUP BY 1), h AS (SELECT event_type, k, count(DISTINCT user_id % 10) AS have FROM e GROUP BY ALL)
SELECT event_type, max(k) AS common_step, CAST(any_value(runs) AS BIGINT) AS n_runs FROM h JOIN n USING (event_type) WHERE have = runs GROUP BY event_type
""")
def common_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest step that every run has (relational division)."""
    return experiments.common_step(log(spark, sf_dir).withColumn("run", F.col("user_id") % 10), "event_type", "run", "k")


@query("SELECT o_custkey % 100 AS item, count(*) AS n, round(avg(a.o_totalprice), 6) AS mean_a FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = a.o_orderkey AND b.o_orderstatus = a.o_orderstatus) GROUP BY 1")
def paired_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one set that the other has too."""
    orders = table(spark, sf_dir, "orders")
    both = orders.join(orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey", "o_orderstatus"], "left_semi")
    return both.groupBy((F.col("o_custkey") % 100).alias("item")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean_a"))


_GRID = "g AS (SELECT p_size, p_brand, p_type, min(p_retailprice + p_partkey * 1e-4::DOUBLE) AS loss FROM part GROUP BY ALL)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice") + F.col("p_partkey") * F.lit(1e-4)
    return table(spark, sf_dir, "part").groupBy("p_size", "p_brand", "p_type").agg(F.min(price).alias("loss"))


@query(f"WITH {_GRID} SELECT p_size, arg_min(p_brand, loss) AS p_brand, arg_min(p_type, loss) AS p_type, round(min(loss), 6) AS loss, count(*) AS n FROM g GROUP BY p_size")
def argmin_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cell of every group."""
    return experiments.best_of(_grid(spark, sf_dir), ["p_size"], "loss", "p_brand", "p_type").withColumn("loss", F.round("loss", 6))


@query(f"WITH {_GRID}, s AS (SELECT p_brand, p_size, min(loss) AS loss FROM g GROUP BY ALL) SELECT p_brand, round(min(loss) FILTER (p_size = 1), 6) AS s1, round(min(loss) FILTER (p_size = 2), 6) AS s2, round(min(loss) FILTER (p_size = 3), 6) AS s3 FROM s WHERE p_size IN (1, 2, 3) GROUP BY p_brand")
def pivot_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of cells, with nulls where nothing ran."""
    wide = _grid(spark, sf_dir).groupBy("p_brand").pivot("p_size", [1, 2, 3]).agg(F.round(F.min("loss"), 6)).where("`1` is not null or `2` is not null or `3` is not null")
    return wide.select("p_brand", F.col("1").alias("s1"), F.col("2").alias("s2"), F.col("3").alias("s3"))


@query(f"WITH {_GRID}, b AS (SELECT p_brand, p_size, min(loss) AS loss FROM g GROUP BY ALL) SELECT p_brand, p_size, round(loss, 6) AS loss, rank() OVER (PARTITION BY p_size ORDER BY loss) AS place FROM b")
def ranked_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations by their best value in each pass."""
    from pyspark.sql import Window

    best = _grid(spark, sf_dir).groupBy("p_brand", "p_size").agg(F.min("loss").alias("loss"))
    place = F.rank().over(Window.partitionBy("p_size").orderBy("loss")).cast("long")  # one row a configuration
    return best.select("p_brand", "p_size", F.round("loss", 6).alias("loss"), place.alias("place"))


@query(f"""
WITH {_GRID}, m AS (SELECT p_size, min(loss) AS best FROM g GROUP BY p_size) SELECT p_size, p_brand, p_type, round(loss - best, 6) AS penalty FROM g JOIN m USING (p_size) WHERE loss - best <= 5
""")
def tie_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells within a band of their group's best."""
    grid = _grid(spark, sf_dir)
    best = grid.groupBy("p_size").agg(F.min("loss").alias("best"))
    return grid.join(best, "p_size").where("loss - best <= 5").select("p_size", "p_brand", "p_type", F.round(F.col("loss") - F.col("best"), 6).alias("penalty"))


@query("""
WITH d AS (SELECT o_orderpriority AS metric, o_custkey % 20 AS run, avg(o_totalprice) AS v FROM orders GROUP BY ALL), m AS (SELECT metric, avg(v) AS base FROM d GROUP BY metric)
SELECT metric, run, CASE WHEN abs(v - base) <= 500 THEN 'same' WHEN (CASE WHEN regexp_matches(metric, 'LOW|URGENT') THEN base - v ELSE v - base END) > 0 THEN 'better' ELSE 'worse' END AS verdict FROM d JOIN m USING (metric)
""")
def direction_aware_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of differences by the metric's direction, with a dead band."""
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("metric"), (F.col("o_custkey") % 20).alias("run")).agg(F.avg("o_totalprice").alias("v"))
    base = d.groupBy("metric").agg(F.avg("v").alias("base"))
    verdict = experiments.banded_delta(F.col("v") - F.col("base"), F.col("metric").rlike("LOW|URGENT"), 500.0)
    return d.join(base, "metric").select("metric", "run", verdict.alias("verdict"))


@query("""
WITH x AS (SELECT doc_id, e.e AS expert, ((n_chars * (e.e + 3)) % 101)::DOUBLE AS nll FROM documents, (SELECT unnest([0, 1, 2, 3]) AS e) e), b AS (SELECT doc_id, expert FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY nll, expert) = 1)
SELECT e.e AS expert, count(b.doc_id) AS wins FROM (SELECT unnest([0, 1, 2, 3, 9]) AS e) e LEFT JOIN b ON b.expert = e.e GROUP BY 1
""")
def expert_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents go to the expert of least loss; experts that win nothing are listed too."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(4)))).alias("expert"), "n_chars").withColumn("nll", (F.col("n_chars") * (F.col("expert") + 3) % 101).cast("double"))
    best = experiments.routed(each, "doc_id", "expert", "nll").groupBy("expert").agg(F.count("*").alias("wins"))
    experts = spark.createDataFrame([(e,) for e in (0, 1, 2, 3, 9)], "expert int")
    return experts.join(best, "expert", "left").select("expert", F.coalesce("wins", F.lit(0)).cast("long").alias("wins"))


@query("""
WITH m AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id) SELECT user_id, round(avg(value), 6) AS trailing, count(*) AS n FROM events JOIN m USING (user_id) WHERE event_id > last - greatest(1, round(0.01::DOUBLE * last)) GROUP BY user_id
""")
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the last hundredth of a run's steps."""
    rows = log(spark, sf_dir)
    end = rows.groupBy("user_id").agg(F.max("event_id").alias("last"))
    recent = rows.join(end, "user_id").where(F.col("event_id") > F.col("last") - F.greatest(F.lit(1.0), F.round(F.col("last") * F.lit(0.01))))
    return recent.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("trailing"), F.count("*").alias("n"))


@query("""
SELECT CASE WHEN o.o_custkey IS NULL THEN 'waiting' WHEN open = 0 THEN 'evaluated' WHEN open < n THEN 'training' ELSE 'trained' END AS state, count(*) AS n FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS open FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey GROUP BY 1
""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every run, counted."""
    done = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != "F").alias("open"))
    state = F.when(F.col("o_custkey").isNull(), "waiting").when(F.col("open") == 0, "evaluated").when(F.col("open") < F.col("n"), "training").otherwise("trained")
    joined = table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS have, (SELECT CAST(count(DISTINCT user_id) AS BIGINT) FROM e) AS expected, count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM e) AS complete FROM e GROUP BY event_type")
def shard_merge_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged shards of metrics, with what is missing."""
    rows = log(spark, sf_dir)
    whole = rows.agg(F.count_distinct("user_id")).first()[0]
    out = rows.groupBy("event_type").agg(F.count_distinct("user_id").alias("have"))
    return out.withColumns({"expected": F.lit(whole).cast("long"), "complete": F.col("have") == whole})


@query("""
WITH o AS (SELECT * FROM (VALUES (0::BIGINT, 'a', 1.0::DOUBLE), (100, 'a', 2.0), (100, 'b', 0.5), (250, 'b', 3.0), (700, 'c', 1.5)) t(step, source, weight)),
a AS (SELECT doc_id AS asked, (SELECT max(step) FROM o WHERE step <= doc_id) AS step FROM documents)
SELECT asked, a.step, string_agg(source || '=' || round(weight, 2), ',' ORDER BY source) AS weights FROM a JOIN o ON o.step = a.step GROUP BY ALL
""")
def source_schedule_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overrides in force at every step: the latest at or before it, not the sum of those skipped."""
    overrides = spark.createDataFrame([(0, "a", 1.0), (100, "a", 2.0), (100, "b", 0.5), (250, "b", 3.0), (700, "c", 1.5)], "step long, source string, weight double")
    out = experiments.schedule_at(overrides, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("step")))
    told = F.array_join(F.transform(F.map_entries("weights"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 2).cast("string"))), ",")
    return out.select("asked", "step", told.alias("weights"))


@query(f"""
WITH {_E}, b AS (SELECT user_id, event_id, value > 90 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM e), g AS (SELECT user_id, event_id, r - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM b WHERE bad)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g GROUP BY user_id, island
""")
def skip_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive bad steps, which abort at a limit."""
    return experiments.streaks(log(spark, sf_dir), ["user_id"], "event_id", F.col("value") > 90)


@query("""
WITH c AS (SELECT DISTINCT user_id, event_id // 100 * 10 AS step FROM events), x AS (SELECT *, step % 500 = 0 OR step % 770 = 0 AS regular FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, regular ORDER BY step DESC) AS k FROM x)
SELECT user_id, step, regular OR k <= 3 AS retained FROM r
""")
def checkpoint_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which checkpoints stay."""
    steps = log(spark, sf_dir).select("user_id", (F.floor(F.col("event_id") / 100) * 10).alias("step")).distinct().withColumn("extra", F.col("step") % 770 == 0)
    return experiments.retained(steps, ["user_id"], "step", 500, 3).select("user_id", "step", "retained")


@query(f"""
WITH RECURSIVE {_E}, w AS (SELECT event_type AS source, event_id // 1000 AS w, avg(value) - 20 AS excess FROM e GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w) AS k FROM w),
f AS (SELECT source, w, k, excess AS ema FROM o WHERE k = 1 UNION ALL SELECT o.source, o.w, o.k, 0.7::DOUBLE * f.ema + 0.3::DOUBLE * o.excess FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1)
SELECT source, w AS "window", round(ema, 6) AS ema, round(least(greatest(ema, 1), 40) / sum(least(greatest(ema, 1), 40)) OVER (PARTITION BY w), 6) AS weight FROM f
""")
def excess_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source weights from a moving average of the excess, clipped and renormalised window by window."""
    w = log(spark, sf_dir).groupBy(F.col("event_type").alias("source"), F.floor(F.col("event_id") / 1000).alias("window")).agg((F.avg("value") - 20).alias("excess"))
    out = experiments.controlled_weights(w, "source", "window", "excess", 0.3, 1.0, 40.0)
    return out.select("source", "window", F.round("ema", 6).alias("ema"), F.round("weight", 6).alias("weight"))


@query("""
SELECT step, round(CASE WHEN step < 100 THEN step / 100.0::DOUBLE WHEN step <= 1000 THEN ((step - 100) / 900.0::DOUBLE) * 0.1 + (1 - (step - 100) / 900.0::DOUBLE) ELSE 0.1 END, 6) AS linear,
  round(CASE WHEN step < 100 THEN step / 100.0::DOUBLE ELSE greatest(pow(100.0::DOUBLE, 0.5) / pow(step::DOUBLE, 0.5), 0.05) END, 6) AS inverse_sqrt,
  round(CASE WHEN step < 100 THEN step / 100.0::DOUBLE WHEN step <= 1000 THEN 0.1 + 0.9::DOUBLE * 0.5 * ((CASE WHEN (step // 500) % 2 = 0 THEN 1 ELSE -1 END) * cos(pi() * pow((step - 100) / 900.0::DOUBLE, 1.5::DOUBLE) / 0.5) + 1) ELSE 0.1 END, 6) AS cosine,
  round(CASE WHEN step < 100 THEN step / 100.0::DOUBLE WHEN step <= edge - floor(edge * 0.2::DOUBLE) THEN 1.0
    ELSE 1 / ((step - (edge - floor(edge * 0.2::DOUBLE))) / floor(edge * 0.2::DOUBLE) * 10 + (1 - (step - (edge - floor(edge * 0.2::DOUBLE))) / floor(edge * 0.2::DOUBLE))) END, 6) AS stable_decay,
  round(CASE WHEN step < 100 THEN step / 100.0::DOUBLE WHEN step < 800 THEN 1.0 ELSE greatest(1 - sqrt(least((step - 800) / 200.0::DOUBLE, 1.0)), 0) END, 6) + 0.0 AS stable_root_decay
FROM (SELECT step, CASE WHEN step = 1000 THEN 1000 ELSE (step // 500 + 1) * 500 END AS edge FROM range(1, 1201) t(step))
""")
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules as functions of the step."""
    steps = spark.range(1, 1201).withColumnRenamed("id", "step")
    s = F.col("step")
    made = {
        "linear": schedules.linear(s, 100, 1000, 0.1),
        "inverse_sqrt": schedules.inverse_sqrt(s, 100, 0.5, 0.05),
        "cosine": schedules.cosine(s, 100, 1000, 0.1, 0.5, 1.5),
        "stable_decay": schedules.stable_decay(s, 100, 1000, 0.2, 0.1, 0.5),
        "stable_root_decay": schedules.stable_root_decay(s, 100, 1000, 0.2),
    }
    return steps.select("step", *[(F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in made.items()])


@query(f"""
WITH RECURSIVE {_E}, w AS (SELECT event_type AS source, event_id // 1000 AS w, sum((value - 20) * (1 + event_id % 5)) / sum(1 + event_id % 5) AS excess FROM e WHERE NOT (event_type = 'view' AND event_id // 1000 = 1) GROUP BY ALL),
n AS (SELECT count(DISTINCT source) AS n, max(w) AS last FROM w), g AS (SELECT source, unnest(range(0, last + 1)) AS w FROM (SELECT DISTINCT source FROM w), n), x AS (SELECT g.source, g.w, excess FROM g LEFT JOIN w ON w.source = g.source AND w.w = g.w),
f AS (SELECT source, w, excess AS ema FROM x WHERE w = 0 UNION ALL SELECT x.source, x.w, CASE WHEN x.excess IS NULL THEN f.ema WHEN f.ema IS NULL THEN x.excess ELSE 0.7::DOUBLE * f.ema + 0.3::DOUBLE * x.excess END FROM f JOIN x ON x.source = f.source AND x.w = f.w + 1),
c AS (SELECT source, w, coalesce(ema, 0) AS ema, coalesce(ema, 0) - sum(coalesce(ema, 0) / n) OVER (PARTITION BY w) AS c, n FROM f, n), z AS (SELECT *, c / sqrt(greatest(sum(c * c / n) OVER (PARTITION BY w), 0.000001::DOUBLE * 0.000001::DOUBLE)) AS s FROM c),
r AS (SELECT source, w, ema, least(greatest(exp(0.5::DOUBLE * s) / n, 0.5::DOUBLE / n), 2.0::DOUBLE / n) AS r FROM z)
SELECT source, w AS "window", round(ema, 6) AS ema, round(r / sum(r) OVER (PARTITION BY w), 6) AS weight FROM r
""")
def excess_reweighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-weighted excess by source and window, its moving average (held where a source has no data), centred and scaled to
    unit spread, and base weights multiplied by its exponential within bounds."""
    rows = log(spark, sf_dir).where("not (event_type = 'view' and event_id div 1000 = 1)")
    tokens = 1 + F.col("event_id") % 5
    w = rows.groupBy(F.col("event_type").alias("source"), F.floor(F.col("event_id") / 1000).alias("window")).agg((F.sum((F.col("value") - 20) * tokens) / F.sum(tokens)).alias("excess"))
    out = experiments.reweighted(w, "source", "window", "excess", 0.7, 0.5, 0.5, 2.0, zscore=True)
    return out.select("source", "window", F.round("ema", 6).alias("ema"), F.round("weight", 6).alias("weight"))


@query(f"""
WITH {_GRID}, b AS (SELECT p_brand, p_size, min(loss) AS loss FROM g GROUP BY ALL), j AS (SELECT a.p_brand AS a, b.p_brand AS b, a.p_size, a.loss AS la, b.loss AS lb FROM b a JOIN b ON a.p_size = b.p_size AND a.p_brand < b.p_brand)
SELECT a, b, count(*) AS shared, arg_min(p_size, la) AS best_a, arg_min(p_size, lb) AS best_b FROM j GROUP BY a, b HAVING count(*) >= 3
""")
def shared_grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of families over the grid points that both have (three at least), with each one's best there."""
    best = _grid(spark, sf_dir).groupBy("p_brand", "p_size").agg(F.min("loss").alias("loss"))
    a, b = best.select(F.col("p_brand").alias("a"), "p_size", F.col("loss").alias("la")), best.select(F.col("p_brand").alias("b"), "p_size", F.col("loss").alias("lb"))
    joined = a.join(b, "p_size").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.min_by("p_size", "la").alias("best_a"), F.min_by("p_size", "lb").alias("best_b"))
    return joined.where("shared >= 3")


@query("""
WITH u AS (SELECT conv_id, min(turn) AS t, arg_min(text, turn) AS a FROM conversations WHERE role = 'user' GROUP BY 1), v AS (SELECT conv_id, arg_min(text, turn) AS b FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT u.conv_id, CAST(length(a) AS BIGINT) AS first_arm, CAST(length(b) AS BIGINT) AS second_arm, CAST(length(d.text) AS BIGINT) AS source FROM u JOIN v USING (conv_id) JOIN documents d ON d.doc_id = u.conv_id
""")
def two_arm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that both arms of a comparison have, with their source text looked up."""
    turns = table(spark, sf_dir, "conversations")
    arm = lambda role, name: turns.where(F.col("role") == role).groupBy("conv_id").agg(F.min_by(F.length("text"), "turn").cast("long").alias(name))
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.length("text").cast("long").alias("source"))
    return arm("user", "first_arm").join(arm("assistant", "second_arm"), "conv_id").join(sources, "conv_id")


@query("""
SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS median, round(avg(CASE WHEN n_chars > 1000 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS long_share FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 16
""")
def largest_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the sixteen domains with most rows (the report's definition)."""
    out = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.percentile("n_chars", 0.5), 6).alias("median"), F.round(F.avg((F.col("n_chars") > 1000).cast("double")), 6).alias("long_share"))
    return out.orderBy(F.desc("n"), "source").limit(16)


@query("""
WITH t AS (SELECT p_brand AS name, avg(p_retailprice) AS v FROM part WHERE p_size % 2 = 0 AND p_brand < 'Brand#3' GROUP BY 1 UNION ALL SELECT p_brand || ':' || CASE WHEN p_size <= 25 THEN 'lower' ELSE 'upper' END, avg(p_retailprice) FROM part GROUP BY 1),
k AS (SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM t p WHERE t.name LIKE '%:%' AND p.name = split_part(t.name, ':', 1)))
SELECT split_part(name, ':', 1) AS task, count(*) AS parts, round(avg(v), 6) AS score FROM k GROUP BY 1
""")
def suite_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtasks go where their parent is there, and the halves of a task are one mean."""
    part = table(spark, sf_dir, "part")
    whole = part.where("p_size % 2 = 0 and p_brand < 'Brand#3'").groupBy(F.col("p_brand").alias("name")).agg(F.avg("p_retailprice").alias("v"))
    half = F.concat("p_brand", F.lit(":"), F.when(F.col("p_size") <= 25, "lower").otherwise("upper"))
    rows = whole.unionByName(part.groupBy(half.alias("name")).agg(F.avg("p_retailprice").alias("v"))).withColumn("task", F.split_part("name", F.lit(":"), F.lit(1)))
    present = whole.select(F.col("name").alias("task"))
    kept = rows.where(~F.col("name").contains(":")).unionByName(rows.where(F.col("name").contains(":")).join(present, "task", "left_anti").select("name", "v", "task"))
    return kept.groupBy("task").agg(F.count("*").alias("parts"), F.round(F.avg("v"), 6).alias("score"))


@query(f"""
WITH {_GRID}, m AS (SELECT p_size, p_type, min(loss) AS best FROM g GROUP BY ALL), p AS (SELECT p_size, p_brand, avg(loss - best) AS penalty, count(*) AS cells FROM g JOIN m USING (p_size, p_type) GROUP BY ALL)
SELECT p_size, arg_min(p_brand, penalty + CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) * 1e-9) AS p_brand, round(min(penalty), 6) AS penalty FROM p GROUP BY p_size
""")
def panel_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every panel the one setting with the least mean penalty over its cells."""
    grid = _grid(spark, sf_dir)
    best = grid.groupBy("p_size", "p_type").agg(F.min("loss").alias("best"))
    mean = grid.join(best, ["p_size", "p_type"]).groupBy("p_size", "p_brand").agg(F.avg(F.col("loss") - F.col("best")).alias("penalty"))
    out = mean.groupBy("p_size").agg(F.min_by("p_brand", F.col("penalty") + F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("double") * 1e-9).alias("p_brand"), F.min("penalty").alias("penalty"))
    return out.withColumn("penalty", F.round("penalty", 6))
