"""Host-level quality rules, with DataFrame expressions only.

Each document is measured once and held against four rules. Per host and rule, failures (a measure beyond the rule's strict limit) are
counted, partially aggregated, so a hot host is no hot task. A host's failure rate is shrunk towards the corpus rate with a beta prior
whose strength comes from the spread of the hosts' rates. The host's verdict on a rule is its tolerance, the corpus rate over its
shrunk rate, between 1 / ``RANGE`` and ``RANGE``: how far its documents may go beyond the rule's limit. Verdicts then go back to the
documents by host, and a document is kept if all its measures are within its host's limits:

* on a host that fails like the corpus, the limit is the rule's own;
* on a host that fails more often, failures are no accident, and the limit is stricter, down to the strict limit;
* on a host that fails less often, the limit is laxer, up to ``RANGE`` times the rule's own;
* a document within the strict limits of all rules is kept, whatever its host.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its own; repeated rows are judged row by
row; texts are taken whole; extra columns stay, except that the measures replace columns of their own names and names that begin with
an underscore are reserved; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.scratch import Scratch

_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
#: Limits of the rules: symbols a word, share of duplicate lines, letters a word beyond or below the usual (as a factor), share of
#: repeated words. The strict limits, beyond which a document counts as a failure of its host, are these over ``RANGE``.
LIMITS = {"symbols": 0.2, "dup_lines": 0.6, "word_length": 4.0, "repeats": 0.4}
#: Word lengths that are usual: the rule measures how many times shorter or longer the mean is.
USUAL_LENGTH = (5.0, 7.0)
RANGE = 2.0
RULES = [*LIMITS]
#: Bounds of the prior's strength, as a number of documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words within 3-word windows that occur at least twice. Only texts with a repeated window pay for the sort by window."""

    def of(hashes: Column) -> Column:
        def places(sorted_: Column) -> Column:
            last = F.size(sorted_) - 1
            same = lambda x, i: (sorted_[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]) & (i > 0) | (sorted_[F.least(i + 1, last)]["h"] == x["h"]) & (i < last)
            hit = F.filter(sorted_, same)
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(F.sort_array(pairs), places))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(words, lambda w: _let(windows(w), of)))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base measures of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.translate(text, _BLANKS, "")
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    out = docs.withColumn("_words", split)
    return out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(plain).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"),
            "_lines": _let(lines, lambda x: F.array(F.size(x), F.size(F.array_distinct(x)))),
            "n_repeat_words": _repeat_words(F.col("_words")).cast("long"),
        }
    ).withColumns({"n_lines": F.col("_lines")[0].cast("long"), "n_dup_lines": (F.col("_lines")[0] - F.col("_lines")[1]).cast("long")}).drop("_words", "_lines")


def failures(measured: DataFrame) -> DataFrame:
    """``base_failed``, and for each rule how far the document goes: its measure over the rule's limit (1: at the limit)."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    least, most = USUAL_LENGTH
    mean = F.col("word_chars") / words
    odd = F.when(F.col("n_words") == 0, 0.0).otherwise(F.greatest(F.lit(least) / mean, mean / F.lit(most)))
    return measured.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbols": F.col("n_symbols") / words / F.lit(LIMITS["symbols"]),
            "dup_lines": F.col("n_dup_lines") / lines / F.lit(LIMITS["dup_lines"]),
            "word_length": odd / F.lit(LIMITS["word_length"]),
            "repeats": F.col("n_repeat_words") / words / F.lit(LIMITS["repeats"]),
        }
    )


def host_verdicts(failed: DataFrame, host_col: str = "source") -> DataFrame:
    """One row a host with its tolerance of every rule, ``allowed_<rule>``.

    With f of n documents of a host failing and m the corpus rate, the hosts' rates differ by the variance

        v = (sum of n (f/n - m)^2 - (hosts - 1) m (1 - m)) / (N - sum of n^2 / N)

    beyond what binomial sampling alone gives (method of moments, every host weighted by its documents). The prior's strength is
    s = m (1 - m) / v - 1 within its bounds (the largest one where v is not positive), the host's rate (f + m s) / (n + s), and its
    tolerance m over that rate within ``RANGE``.
    """
    hosts = failed.groupBy(F.col(host_col).alias("host")).agg(F.count("*").cast("double").alias("n"), *[F.sum(F.when(F.col(r) > 1 / RANGE, 1.0).otherwise(0.0)).alias(r) for r in RULES])
    sums = [F.count("*").alias("hosts"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0)).alias("nn")]
    for r in RULES:
        sums += [F.sum(r).alias(f"f_{r}"), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"s_{r}")]
    total = hosts.agg(*sums).first()  # one row
    out = hosts
    for r in RULES:
        m, s = prior(total["hosts"], total["n"], total["nn"], total[f"f_{r}"] or 0.0, total[f"s_{r}"] or 0.0)
        rate = (F.col(r) + m * s) / (F.col("n") + s)
        out = out.withColumn(f"allowed_{r}", F.when(rate > 0, F.least(F.lit(RANGE), F.greatest(F.lit(1 / RANGE), F.lit(m) / rate))).otherwise(1.0))
    return out.select("host", *[f"allowed_{r}" for r in RULES])


def prior(hosts: int, n: float, squares: float, fails: float, spread: float) -> tuple[float, float]:
    """Corpus rate and prior strength from the number of hosts, and the sums of n, n^2, f and f^2 / n over them."""
    if n <= 0:
        return 0.0, MOST_STRENGTH
    m = fails / n
    noise, apart = m * (1 - m), n - squares / n
    v = (spread - n * m * m - (hosts - 1) * noise) / apart if apart > 0 else 0.0
    return m, min(MOST_STRENGTH, max(LEAST_STRENGTH, noise / v - 1)) if v > 0 else MOST_STRENGTH


def judge(docs: DataFrame, scratch: Scratch, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with its measures, ``base_failed``, ``host_failed`` and ``kept``, of every row. The measured rows are written once and
    read for the hosts' counts and for the verdicts."""
    return verdicts(scratch.table(failures(measures(docs, text_col)), "measured"), scratch, host_col)


def verdicts(failed: DataFrame, scratch: Scratch, host_col: str = "source") -> DataFrame:
    """The rows of ``failures`` (a written table, since it is read twice) with ``host_failed`` (a measure is beyond what the host's
    verdict allows) and ``kept``."""
    hosts = scratch.table(host_verdicts(failed, host_col), "hosts").withColumnRenamed("host", "_host")
    joined = failed.join(hosts, failed[host_col].eqNullSafe(hosts["_host"]), "left")
    beyond = F.lit(False)
    for r in RULES:
        beyond = beyond | (F.col(r) > F.col(f"allowed_{r}"))
    judged = joined.withColumns({"host_failed": beyond, "kept": ~(F.col("base_failed") | beyond)})
    return judged.drop("_host", *[f"allowed_{r}" for r in RULES])
