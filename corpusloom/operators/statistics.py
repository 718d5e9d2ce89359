"""Statistics with the definitions that the analyses use, as aggregates where they can be."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.draws import tiles
from corpusloom.operators.order import value_ranked


def gate(df: DataFrame, value: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``tau``, the exact q-quantile (linear interpolation) of its group or of all rows, and ``fired``: value <= tau."""
    if by:
        tau = df.groupBy(*by).agg(F.percentile(value, q).alias("tau"))
        return df.join(tau, list(by)).withColumn("fired", F.col(value) <= F.col("tau"))
    tau = df.agg(F.percentile(value, q).alias("tau")).first()["tau"]
    return df.withColumn("tau", F.lit(tau)).withColumn("fired", F.col(value) <= F.lit(tau))


def concentration(df: DataFrame, value: str, tie: str, by: Sequence[str]) -> DataFrame:
    """``n, top10, top20, gini, mean, median, p99`` of absolute values per group."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_v", F.abs(F.col(value)))
    ranked = value_ranked(rows, "_v", tie, "_rank", by)
    totals = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_v").alias("_sum"), F.avg("_v").alias("mean"), F.percentile("_v", 0.5).alias("median"), F.percentile("_v", 0.99).alias("p99"))
    joined = ranked.join(totals.select(*by, F.col("n").alias("_n")), list(by))
    top = lambda share: F.sum(F.when(F.col("_rank") > F.col("_n") - F.greatest(F.lit(1), F.floor(F.col("_n") * share)), F.col("_v")))
    parts = joined.groupBy(*by).agg(top(0.1).alias("_t1"), top(0.2).alias("_t2"), F.sum(F.col("_rank") * F.col("_v")).alias("_w"))
    out = totals.join(parts, list(by))
    gini = 2 * F.col("_w") / (F.col("n") * F.col("_sum")) - (F.col("n") + 1) / F.col("n")
    return out.select(*by, "n", (F.col("_t1") / F.col("_sum")).alias("top10"), (F.col("_t2") / F.col("_sum")).alias("top20"), gini.alias("gini"), "mean", "median", "p99")


def moments(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``n, mean, std`` (sample), ``skew`` and ``kurtosis`` (not excess) over the sample deviation, ``abs_mean, least, largest``."""
    v = F.col(value).cast("double")
    centre = df.groupBy(*by).agg(F.avg(v).alias("_m"))
    d = v - F.col("_m")
    sums = df.join(centre, list(by)).groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.sum(d * d).alias("_2"), F.sum(d * d * d).alias("_3"), F.sum(d * d * d * d).alias("_4"), F.avg(F.abs(v)).alias("abs_mean"), F.min(v).alias("least"), F.max(v).alias("largest"))
    std = F.sqrt(F.col("_2") / (F.col("n") - 1))
    return sums.select(*by, "n", "mean", std.alias("std"), (F.col("_3") / F.col("n") / F.pow(std, 3)).alias("skew"), (F.col("_4") / F.col("n") / F.pow(std, 4)).alias("kurtosis"), "abs_mean", "least", "largest")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str]) -> DataFrame:
    """``bin, n, density`` over fixed bins of [low, high); values outside are not counted."""
    width = (high - low) / bins
    inside = df.where((F.col(value) >= low) & (F.col(value) < high)).withColumn("bin", F.floor((F.col(value) - low) / width).cast("long"))
    counted = inside.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    totals = inside.groupBy(*by).agg(F.count("*").alias("_all"))
    return counted.join(totals, list(by)).select(*by, "bin", "n", (F.col("n") / (F.col("_all") * width)).alias("density"))


def spearman(df: DataFrame, x: str, y: str, tie: str, by: Sequence[str] = (), average_ties: bool = False) -> DataFrame:
    """Rank correlation; ties keep their position, or share their average rank."""
    ranked = value_ranked(value_ranked(df, x, tie, "_rx", by), y, tie, "_ry", by)
    if average_ties:
        for value, rank in ((x, "_rx"), (y, "_ry")):
            mean = ranked.groupBy(*by, value).agg(F.avg(rank).alias("_mean"))
            ranked = ranked.drop(rank).join(mean.withColumnRenamed("_mean", rank), [*by, value])
    return ranked.groupBy(*by).agg(F.corr(F.col("_rx").cast("double"), F.col("_ry").cast("double")).alias("spearman"), F.count("*").alias("n"))


def pareto(df: DataFrame, cost: str, loss: str, id_col: str, slack: float = 1.02) -> DataFrame:
    """Rows that no row of at most ``slack`` times their cost beats in loss, costs being compared by their logarithms; ``slack`` > 1.

    Costs go to logarithmic buckets of half the slack, so a row reaches all of its own bucket and all below, and stays only at the least
    loss found there. What could still beat it lies above: the cheapest row of less than that loss, which is the cheapest one below all
    earlier buckets in the next bucket that has any. So rows meet one row of their bucket and never each other; for the usual slack the
    bucket table has at most 150,000 rows, as doubles span no more.
    """
    if slack <= 1:
        raise ValueError("the slack must exceed 1")
    reach = round(math.log(slack), 16)  # as many digits as the SQL twin writes
    step = reach / 2
    bucket = F.when(F.isnan("_x"), F.lit(1 << 60)).otherwise(F.floor(F.least(F.col("_x") / step, F.lit(1e15))))  # NaN above infinity
    rows = df.select(id_col, cost, loss, F.log(cost).alias("_x")).where("_x IS NOT NULL").withColumn("_b", bucket)
    small = F.broadcast if 1500 / step < 200_000 else lambda table: table
    up = Window.orderBy("_b")  # one row a bucket
    least = rows.groupBy("_b").agg(F.min(loss).alias("_least"))
    least = least.select("_b", F.min("_least").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.min("_least").over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"))
    first = rows.join(small(least.select("_b", "_below")), "_b").where(F.col(loss) < F.col("_below")).groupBy("_b").agg(F.min("_x").alias("_first"))
    nearest = least.join(first, "_b", "left").select("_b", "_upto", F.min("_first").over(up.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    beaten = F.coalesce(F.col("_next") <= F.col("_x") + reach, F.lit(False))
    return rows.join(small(nearest), "_b").where((F.col(loss) <= F.col("_upto")) & ~beaten).select(id_col, cost, loss)


def vertex(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Place of the extremum of the parabola through three points; null where they lie on a line."""
    a, b = (x1 - x0) * (y1 - y2), (x1 - x2) * (y1 - y0)
    return F.when(a - b != 0, x1 - 0.5 * ((x1 - x0) * a - (x1 - x2) * b) / F.nullif(a - b, F.lit(0.0)))


def line_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``slope, intercept, r, sigma`` (residual deviation with n - 2) and ``n`` of least squares."""
    fit = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"), F.count("*").alias("n"))
    return fit.withColumn("sigma", F.sqrt(F.greatest(F.lit(0.0), F.col("_syy") - F.col("slope") * F.col("_sxy")) / (F.col("n") - 2))).drop("_syy", "_sxy")


def plane_fit(df: DataFrame, x1: str, x2: str, y: str) -> DataFrame:
    """``c0, c1, c2`` of y = c0 + c1 x1 + c2 x2 by least squares, and the root mean square residual, from centred sums."""
    s = df.agg(F.covar_pop(x1, x1).alias("a"), F.covar_pop(x1, x2).alias("b"), F.covar_pop(x2, x2).alias("c"), F.covar_pop(x1, y).alias("d"), F.covar_pop(x2, y).alias("e"), F.var_pop(y).alias("f"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    s = s.withColumns({"c1": (F.col("d") * F.col("c") - F.col("e") * F.col("b")) / det, "c2": (F.col("e") * F.col("a") - F.col("d") * F.col("b")) / det})
    rms = F.sqrt(F.greatest(F.lit(0.0), F.col("f") - F.col("c1") * F.col("d") - F.col("c2") * F.col("e")))
    return s.select((F.col("my") - F.col("c1") * F.col("m1") - F.col("c2") * F.col("m2")).alias("c0"), "c1", "c2", rms.alias("rms"))


def partial_correlation(df: DataFrame, x: str, y: str, control: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of x and y with the control's linear part removed from both."""
    r = df.groupBy(*by).agg(F.corr(x, y).alias("xy"), F.corr(x, control).alias("xc"), F.corr(y, control).alias("yc"), F.count("*").alias("n"))
    return r.withColumn("partial_r", (F.col("xy") - F.col("xc") * F.col("yc")) / F.sqrt((1 - F.col("xc") * F.col("xc")) * (1 - F.col("yc") * F.col("yc"))))


#: Draws of one call and into how many calls a slice's draws are cut at most; values of a group that a worker holds, and values a row.
DRAWS, CALLS, HELD, RUN = 1 << 24, 32, 1 << 22, 512


def bootstrap(df: DataFrame, row: str, value: str, reps: int, seed: int, by: Sequence[str], held: int = HELD) -> DataFrame:
    """Standard error of the group means' unweighted mean, resampling rows within groups.

    A draw picks row ``h32(seed, rep, *by, row) mod n`` of the group, so every resample is a function of the seed. ``row`` numbers the rows
    of each group from 0. Draws are neither shuffled nor joined: a worker holds a group's values by position and adds up what a range of
    resamples draws. Of a group of more than ``held`` values (rounded up to whole runs) it holds a slice, makes all draws and adds up
    those that fall into it; so memory is bounded, and the draws of such a group are made once a slice.
    """
    runs = -(-held // RUN)
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    cut = df.groupBy(*by, F.floor(F.col(row) / RUN).alias("_run")).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col(value).cast("double").alias("v")))).alias("_rows"))
    cut = cut.join(sizes, list(by)).withColumns({"_slice": F.floor(F.col("_run") / runs), "_values": F.col("_rows.v")}).drop("_rows")
    calls = F.least(F.lit(CALLS), F.lit(reps), F.ceil(F.col("_n") * reps / DRAWS)).cast("int")
    middle = F.concat(F.lit("|"), *[x for c in by for x in (F.col(c).cast("string"), F.lit("|"))])
    units = cut.withColumns({"_calls": calls, "_middle": middle}).withColumn("_call", F.explode(F.sequence(F.lit(0), F.col("_calls") - 1)))
    keys = [*by, "_slice", "_call"]
    spread = units.repartition(16 * df.sparkSession.sparkContext.defaultParallelism, *keys)  # a fixed number: few bytes stand for many draws
    kinds = T.StructType([df.schema[c] for c in by]).add("rep", "long").add("_sum", "double").add("_count", "long")

    def drawn(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        n, calls, middle = (part.column(c)[0].as_py() for c in ("_n", "_calls", "_middle"))
        *group, nth, call = (k.as_py() for k in key)
        low, high, first = reps * call // calls, reps * (call + 1) // calls, nth * runs * RUN
        size = min(runs * RUN, n - first)
        values, counted = np.zeros(size + 1), np.zeros(size + 1, np.int64)  # the last stands for other slices
        for run, found in zip(part.column("_run").to_pylist(), (x.values for x in part.column("_values")), strict=True):
            at = slice(run * RUN - first, run * RUN - first + len(found))
            values[at], counted[at] = found.fill_null(0.0).to_numpy(), found.is_valid().to_numpy(zero_copy_only=False)
        whole = int(counted.sum()) == n
        sums, counts = np.zeros(high - low), np.zeros(high - low, np.int64)
        for rep, h in tiles(f"{seed}|", middle, (low, high), n):
            place = (h if n < 1 << 32 else h.astype(np.uint64)) % n
            at = np.minimum(place - first, size).astype(np.intp)  # unsigned: what lies before the slice wraps round to beyond it
            mine = slice(rep - low, rep - low + len(h))
            sums[mine] += values[at].sum(axis=1)
            counts[mine] += h.shape[1] if whole else counted[at].sum(axis=1)
        same = [pa.array([g] * (high - low), k.type) for g, k in zip(group, key, strict=False)]
        return pa.Table.from_arrays([*same, pa.array(range(low, high), pa.int64()), pa.array(sums), pa.array(counts)], names=kinds.names)

    added = spread.groupBy(*keys).applyInArrow(drawn, kinds).groupBy("rep", *by).agg(F.sum("_sum").alias("_sum"), F.sum("_count").alias("_count"))
    means = added.select("rep", F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count")).alias("_mean"))
    return means.groupBy("rep").agg(F.avg("_mean").alias("macro")).agg(F.count("*").alias("reps"), F.avg("macro").alias("mean"), F.stddev_pop("macro").alias("se"))


def class_means(df: DataFrame, probabilities: str, by: Sequence[str]) -> DataFrame:
    """``class, p``: mean probability of every class per group."""
    return df.select(*by, F.posexplode(probabilities).alias("class", "_p")).groupBy(*by, "class").agg(F.avg(F.col("_p").cast("double")).alias("p"))


def variation(means: DataFrame, by: str, reference: object) -> DataFrame:
    """``tv, entropy`` of each group's class distribution, the first against a reference group."""
    ref = means.where(F.col(by) == reference).select("class", F.col("p").alias("_q"))
    log = F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)
    return means.join(ref, "class").groupBy(by).agg((0.5 * F.sum(F.abs(F.col("p") - F.col("_q")))).alias("tv"), (-F.sum(log)).alias("entropy"))


def saturating_fit(x: Sequence[float], y: Sequence[float]) -> tuple[float, float, float, float]:
    """``e, a, b, rms`` of y = e + a x^-b with a, e >= 0: a grid over b with a linear solution for the rest, refined around the best.

    For a table of results, on the driver.
    """
    xs, ys = np.asarray(x, float), np.asarray(y, float)
    low, high, best = 0.01, 3.0, (0.0, 0.0, 0.0, np.inf)
    for _ in range(6):
        for b in np.linspace(low, high, 61):
            m = np.column_stack((np.ones_like(xs), xs**-b))
            (e, a), *_ = np.linalg.lstsq(m, ys, rcond=None)
            if e < 0:
                e, a = 0.0, float((m[:, 1] @ ys) / (m[:, 1] @ m[:, 1]))
            if a < 0:
                e, a = float(ys.mean()), 0.0
            rms = float(np.sqrt(np.mean((e + a * m[:, 1] - ys) ** 2)))
            if rms < best[3]:
                best = (float(e), float(a), float(b), rms)
        span = (high - low) / 30
        low, high = max(0.001, best[2] - span), best[2] + span
    return best
