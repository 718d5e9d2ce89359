"""Run logs and run tables: binning, last writes, joins of manifests and metrics, choices of the best."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.order import interval_join


def binned_means(log: DataFrame, keys: Sequence[str], step: str, loss: str, last: str, order: str, width: int = 50) -> DataFrame:
    """Per bin of ``width`` steps (from 1): mean finite loss, last step and last value of ``last``, all in ``order``."""
    finite = F.when(~F.isnan(loss) & (F.abs(F.col(loss)) < float("inf")), F.col(loss))
    binned = log.withColumn("bin", F.floor((F.col(step) - 1) / width).cast("long"))
    return binned.groupBy(*keys, "bin").agg(F.avg(finite).alias("mean_loss"), F.max(step).cast("long").alias("last_step"), F.max_by(last, order).alias("last_value"), F.count(finite).alias("n"))


def at_step(manifest: DataFrame, metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every manifest row with its metrics at exactly its step; absent ones are null."""
    return manifest.join(metrics, list(keys), "left")


def gaps_filled(primary: DataFrame, fallback: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The primary's values where it has the key, else the fallback's; ``filled`` marks those."""
    p, q = primary.withColumnRenamed(value, "_p"), fallback.withColumnRenamed(value, "_q")
    return p.join(q, list(keys), "full_outer").select(*keys, F.coalesce("_p", "_q").alias(value), F.col("_p").isNull().alias("filled"))


def overridden(main: DataFrame, branch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union in which a branch's row replaces the main row of the same key."""
    return main.join(branch.select(*keys).distinct(), list(keys), "left_anti").unionByName(branch)


def against_reference(df: DataFrame, run: str, step: str, value: str, reference: object) -> DataFrame:
    """``delta`` to the reference run at the same step; steps that it lacks are dropped."""
    ref = df.where(F.col(run) == reference).select(step, F.col(value).alias("_ref"))
    return df.where(F.col(run) != reference).join(ref, step).withColumn("delta", F.col(value) - F.col("_ref")).drop("_ref")


def common_step(df: DataFrame, metric: str, run: str, step: str) -> DataFrame:
    """Per metric, the latest step that all its runs have."""
    runs = df.groupBy(metric).agg(F.count_distinct(run).alias("_runs"))
    have = df.groupBy(metric, step).agg(F.count_distinct(run).alias("_have"))
    return have.join(runs, metric).where("_have = _runs").groupBy(metric).agg(F.max(step).alias("common_step"), F.max("_runs").alias("n_runs"))


def best_of(df: DataFrame, group: Sequence[str], value: str, *keep: str, least: bool = True) -> DataFrame:
    """The row of least (or largest) value of every group, ties by the kept columns in order."""
    packed = F.struct(F.col(value) if least else (-F.col(value)).alias(value), *keep)
    best = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.min(packed).alias("_b"), F.count("*").alias("n"))
    return best.select(*group, *[F.col(f"_b.{c}").alias(c) for c in keep], (F.col(f"_b.{value}") if least else -F.col(f"_b.{value}")).alias(value), "n")


def complete_mean(df: DataFrame, group: Sequence[str], value: str, expected: int) -> DataFrame:
    """``n``, ``mean``, ``complete`` and ``mean_if_complete`` of each group."""
    return df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).withColumns({"complete": F.col("n") == expected, "mean_if_complete": F.when(F.col("n") == expected, F.col("mean"))})


def banded_delta(delta: Column, lower_is_better: Column, band: float = 5e-4) -> Column:
    """``better``, ``worse`` or ``same`` within the dead band, by the metric's direction."""
    gain = F.when(lower_is_better, -delta).otherwise(delta)
    return F.when(F.abs(delta) <= band, "same").when(gain > 0, "better").otherwise("worse")


def routed(df: DataFrame, doc: str, expert: str, nll: str) -> DataFrame:
    """The expert of least loss for every document, ties to the least expert."""
    return df.groupBy(doc).agg(F.min(F.struct(nll, expert)).alias("_b")).select(doc, F.col(f"_b.{expert}").alias(expert), F.col(f"_b.{nll}").alias(nll))


def schedule_at(overrides: DataFrame, steps: DataFrame, step: str = "step") -> DataFrame:
    """For every asked step, the latest overrides at or before it (only those: skipped milestones do not add up): ``asked``, the
    milestone and its ``weights``, null before the first. Steps meet milestones by an interval join."""
    asked = steps.select(F.col(step).alias("asked"))
    marks = overrides.groupBy(step).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "weight")))).alias("weights"))
    bounds = marks.agg(F.min(step).alias("first"), F.count("*").alias("n")).first()
    if not bounds["n"]:
        return asked.select("asked", F.lit(None).cast("long").alias(step), F.lit(None).cast("map<string,double>").alias("weights"))
    end = max(asked.agg(F.max("asked")).first()[0] or 0, bounds["first"]) + 1
    spans = marks.withColumn("_until", F.coalesce(F.lead(step).over(Window.orderBy(step)), F.lit(end)))  # one row a milestone
    width = max(1, (end - bounds["first"]) // (4 * bounds["n"]))
    found = interval_join(asked, spans.where(F.col(step) < end), "asked", step, "_until", width).drop("_until")
    before = asked.where(F.col("asked") < bounds["first"]).select("asked", F.lit(None).cast("long").alias(step), F.lit(None).cast("map<string,double>").alias("weights"))
    return found.select("asked", step, "weights").unionByName(before)


def streaks(df: DataFrame, keys: Sequence[str], order: str, bad: Column) -> DataFrame:
    """Runs of consecutive bad rows: first and last of ``order`` and length."""
    whole, of = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys, "_bad").orderBy(order)
    marked = df.withColumn("_bad", bad).withColumn("_at", F.row_number().over(whole))
    marked = marked.withColumn("_island", F.col("_at") - F.row_number().over(of)).where("_bad")
    return marked.groupBy(*keys, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_island")


def retained(checkpoints: DataFrame, keys: Sequence[str], step: str, every: int, keep: int) -> DataFrame:
    """Checkpoints to keep: multiples of ``every``, the last ``keep`` others, and those marked ``extra``."""
    regular = (F.col(step) % every == 0) | F.col("extra")
    rank = F.row_number().over(Window.partitionBy(*keys, "_regular").orderBy(F.desc(step)))
    ranked = checkpoints.withColumn("_regular", regular).withColumn("_rank", rank)
    return ranked.withColumn("retained", F.col("_regular") | (F.col("_rank") <= keep)).drop("_regular", "_rank")


def controlled_weights(windows: DataFrame, source: str, window: str, excess: str, alpha: float, low: float, high: float) -> DataFrame:
    """Per window and source: exponential moving average of the excess, clipped and renormalised over the sources of the window."""
    folded = windows.groupBy(source).agg(F.sort_array(F.collect_list(F.struct(window, excess))).alias("_x"))  # one entry a window
    start = F.array().cast(f"array<struct<{window}:bigint,ema:double>>")
    ema = F.aggregate(
        "_x",
        start,
        lambda acc, x: F.concat(
            acc,
            F.array(
                F.struct(
                    x[window].cast("long").alias(window),
                    F.when(F.size(acc) == 0, x[excess]).otherwise(F.lit(1 - alpha) * F.try_element_at(acc, F.lit(-1))["ema"] + F.lit(alpha) * x[excess]).alias("ema"),
                )
            ),
        ),
    )
    rows = folded.select(source, F.explode(ema).alias("_e")).select(source, f"_e.{window}", "_e.ema")
    clipped = F.least(F.greatest(F.col("ema"), F.lit(low)), F.lit(high))
    return rows.withColumn("_c", clipped).withColumn("weight", F.col("_c") / F.sum("_c").over(Window.partitionBy(window))).drop("_c")


def reweighted(windows: DataFrame, source: str, window: str, excess: str, beta: float, eta: float, low: float, high: float, zscore: bool = False, least_spread: float = 1e-6, base: dict[str, float] | None = None) -> DataFrame:
    """``ema, weight`` of every source in every window from the first (0) on: base weights (equal by default) times the exponential of
    ``eta`` times the moving average of the excess, less its weighted mean and, with ``zscore``, over its weighted deviation; held within
    ``low`` and ``high`` times the base and renormalised. A source without data in a window keeps its average (0 before its first).

    Windows are one row a source each, so what is folded and spread out here is small whatever the log's size.
    """
    names = sorted(r[0] for r in windows.select(source).distinct().collect())  # few by nature
    share = {n: (base or {}).get(n, 1.0) / sum((base or {}).get(m, 1.0) for m in names) for n in names}
    last = windows.agg(F.max(window)).first()[0] or 0
    found = windows.groupBy(source).agg(F.map_from_entries(F.collect_list(F.struct(F.col(window).cast("long"), excess))).alias("_m"))
    steps = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")), lambda w: F.col("_m")[w])

    def add(acc: Column, x: Column) -> Column:
        before = F.try_element_at(acc, F.lit(-1))
        now = F.when(x.isNull(), before).when(before.isNull(), x).otherwise(F.lit(beta) * before + F.lit(1 - beta) * x)
        return F.concat(acc, F.array(now))

    ema = F.aggregate(steps, F.array().cast("array<double>"), add)
    rows = found.select(source, F.posexplode(ema).alias(window, "_e")).select(source, F.col(window).cast("long").alias(window), F.coalesce("_e", F.lit(0.0)).alias("ema"))
    weight = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, share[n])]), F.col(source))
    per = Window.partitionBy(window)
    rows = rows.withColumn("_b", weight).withColumn("_c", F.col("ema") - F.sum(F.col("_b") * F.col("ema")).over(per))
    if zscore:
        spread = F.sum(F.col("_b") * F.col("_c") * F.col("_c")).over(per)
        rows = rows.withColumn("_c", F.col("_c") / F.sqrt(F.greatest(spread, F.lit(least_spread * least_spread))))
    raw = F.least(F.greatest(F.col("_b") * F.exp(F.lit(eta) * F.col("_c")), F.lit(low) * F.col("_b")), F.lit(high) * F.col("_b"))
    return rows.withColumn("_r", raw).select(source, window, "ema", (F.col("_r") / F.sum("_r").over(per)).alias("weight"))
