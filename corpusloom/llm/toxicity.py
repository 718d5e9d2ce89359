"""Toxicity from two class-conditional Kneser-Ney models over words and the characters of words.

A word is read with its boundaries. Given up to ``ORDER - 1`` characters before it in the word, a character has in each class the
probability

    p_c(x | h) = max(c_c(h x) - d, 0) / c_c(h) + (sum of the discounts d after h) / c_c(h) * p(x | h')

with c_c the class's counts, d = ``DISCOUNT`` (a count of 1 is discounted whole) and h' the context shortened to ``SHARED - 1``
characters or less. The lower orders p are interpolated Kneser-Ney with continuation counts that both classes share, so that what
neither class has seen is neutral: there the two likelihoods differ by the backoff weights only. The shared counts need no labels and
are those of the words of all texts, labelled or not. A word's probability is the product over its characters, and after another word
it is

    p_c(w | v) = max(c_c(v w) - D, 0) / c_c(v) + (sum of the discounts after v) / c_c(v) * p_c(w)

where c_c counts the class's documents with that pair of words and D = ``PAIR_DISCOUNT``, so that only expressions of several labelled
documents count beyond their words.

A word's evidence is the difference of its log-likelihoods, and a text's is the mean over its ``BEST`` most toxic words (missing ones
count 0): a few toxic words make a long text toxic, one that an ordinary text has by chance does not. A logistic curve, fitted on
labelled rows that the models have not seen, turns it into a score.

Labels come from rows whose crc32(doc_id) mod 5 is 1, 2 or 3 for the counts and 4 for the curve; rows with remainder 0 are held out.
The classes' counts and the curve are fitted on at most about ``MOST_DOCS`` labelled documents and ``MOST_BYTES`` of text of each class
and set, which bounds what the driver gathers and broadcasts. They are chosen by a hash of the id, as evenly over the languages of
``lang`` (where there is such a column) as these have documents; scoring reads every text whole.

Defined cases: a null or wordless text has no evidence and gets the curve's score for none; repeated rows are scored row by row; a
missing label is no label, and of several labels of one id the largest counts; without labels of both classes all scores are 0; where
the rows for the curve lack a class, ``DEFAULT_CURVE`` takes its place; other extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe_count import PART, parts, slices
from corpusloom.llm.ragged import Sorted, Words
from corpusloom.plans.scratch import Scratch

ORDER, SHARED, DISCOUNT, PAIR_DISCOUNT = 10, 6, 0.75, 5
BEST = 3
#: Slope and intercept where they can't be fitted.
DEFAULT_CURVE = (2.0, -10.0)
MOST_DOCS, MOST_BYTES = 6000, 64 << 20
STRATA = 1024
#: Grams, words and documents that are handled at once.
SLICE, AT_ONCE, SOME_DOCS = 100_000, 10_000, 500
REMEMBERED = 300_000
_WORD = regex.compile(r"\p{L}+")
_OPEN, _CLOSE = "\x02", "\x03"


def _bounded(words: list[str]) -> Words:
    return Words([f"{_OPEN}{w}{_CLOSE}" for w in words])


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every character after the first of each word: its position, and fingerprints of its context and of both together, with
    contexts of at most ``ORDER - 1`` characters that begin at the word's start or later."""
    at = np.flatnonzero(words.place > 0)
    width = np.minimum(words.place[at], ORDER - 1)
    context, gram = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    short = np.zeros(0, np.uint64)
    for length, sums in enumerate(words.sums(ORDER), 1):
        mine = np.flatnonzero(width == length - 1)
        if length > 1 and len(mine):
            first = at[mine] - length + 1
            context[mine] = words.finished(short[first], length - 1)
            gram[mine] = words.finished(sums[first], length)
        short = sums.copy()
    return at, context, gram


def _continued(words: Words) -> np.ndarray:
    """Distinct rows of fingerprints (longer, short, head): a gram of 1 to ``SHARED - 1`` characters, with the character before it, and
    without its last character."""
    at = np.flatnonzero(words.place > 0)
    prints = [np.zeros(len(words.chars), np.uint64), *[words.finished(s, k) for k, s in enumerate(words.sums(SHARED), 1)]]
    rows = []
    for w in range(1, SHARED):  # grams of w characters, heads of w - 1
        mine = at[words.place[at] >= w]  # a longer gram exists
        longer, first = np.unique(prints[w + 1][mine - w], return_index=True)
        mine = mine[first]
        rows.append(np.column_stack((longer, prints[w][mine - w + 1], prints[w - 1][mine - w + 1])))
    return np.concatenate(rows)


def own_lower(words: list[str]) -> tuple[np.ndarray, ...]:
    """Of these words alone: fingerprints of grams of less than ``SHARED`` characters, the number of distinct one-longer grams that end
    with each, and the sum of these numbers and the number of grams over all that differ in the last character only."""
    rows = _continued(_bounded(words))
    rows = rows[np.unique(rows[:, 0], return_index=True)[1]]
    short, first, n = np.unique(rows[:, 1], return_index=True, return_counts=True)
    _, back = np.unique(rows[first, 2], return_inverse=True)
    return short, n, np.bincount(back, n)[back], np.bincount(back)[back]


def shared_probabilities(words: Words, lower: tuple[np.ndarray, ...]) -> np.ndarray:
    """p(last character | the others) of grams that begin at the word's start or are ``ORDER`` long: interpolated over orders below
    ``SHARED``, with the number of distinct one-longer grams as counts. ``lower`` is in the order of its fingerprints."""
    keys, count, total, types = lower
    rows = Sorted(keys)
    last = words.start + words.size - 1
    prob = np.full(len(words.size), 1.0 / 256)
    for w, sums in enumerate(words.sums(SHARED - 1), 1):  # grams of w characters
        mine = np.flatnonzero(words.size > w)  # a longer gram exists
        row = rows.find(words.finished(sums[last[mine] - w + 1], w))
        mine, row = mine[row >= 0], row[row >= 0]
        prob[mine] = np.maximum(count[row] - DISCOUNT, 0) / total[row] + DISCOUNT * types[row] / total[row] * prob[mine]
    return prob


def _discounted(count: Column) -> Column:
    return F.when(count < 2, count.cast("double")).otherwise(F.lit(DISCOUNT))


class Contrast:
    """Log-likelihood differences of the two classes, as tables of grams, contexts and word pairs."""

    def __init__(self, grams: dict[str, list], pairs: dict[str, list], lower: tuple[np.ndarray, ...]) -> None:
        """``grams``: columns gram, o, t (its counts in the ordinary and in the toxic class), so, st (its context's) and do, dt (the
        discounts after its context); all grams with a count of 2 or more. ``pairs``: the same of words (after, word) of documents."""
        lower = tuple(c[np.argsort(lower[0])] for c in lower)
        text, keys, context, base = pa.chunked_array([grams["gram"]] if isinstance(grams["gram"], list) else grams["gram"].chunks, pa.string()), [], [], []
        for start in range(0, max(len(text), 1), SLICE):
            some = text.slice(start, SLICE).to_pylist()
            words = Words(some)
            keys.append(words.whole())
            base.append(shared_probabilities(words, lower))
            context.append(Words([g[:-1] for g in some]).whole())
        keys, context, base = np.concatenate(keys), np.concatenate(context), np.concatenate(base)
        order = np.argsort(keys)
        logs, backs = [], []
        for n, total, left in (("o", "so", "do"), ("t", "st", "dt")):
            n, total, left = (np.asarray(grams[c], dtype=float)[order] for c in (n, total, left))
            full = np.maximum(total, 1)
            weight = np.where(total > 0, left / full, 1.0)
            seen = np.where(n < 2, 0, n - DISCOUNT)
            backs.append(np.log(np.maximum(weight, 1e-12)))
            logs.append(np.log(seen / full + weight * base[order]))
        self.gram, self.gram_llr = Sorted(keys[order]), (logs[1] - logs[0]).astype(np.float32)
        short, first = np.unique(context[order], return_index=True)
        self.context, self.context_llr = Sorted(short), (backs[1] - backs[0])[first].astype(np.float32)
        self._pairs(pairs, logs)

    def _pairs(self, pairs: dict[str, list], logs: list[np.ndarray]) -> None:
        """Evidence of the second word of each pair, and what a first word adds to any other word after it."""
        after, word = pairs["after"], pairs["word"]
        self.ids = {w: i for i, w in enumerate(sorted({*after, *word}), 1)}
        self.number = len(self.ids) + 1
        kept = _bounded(word)
        at, _, gram = _grams(kept)
        row = self.gram.find(gram)  # a pair of several documents has grams of several occurrences
        each, backs = [], []
        for k, (n, total, left) in enumerate((("o", "so", "do"), ("t", "st", "dt"))):
            n, total, left = (np.asarray(pairs[c], dtype=float) for c in (n, total, left))
            full = np.maximum(total, 1)
            weight = np.where(total > 0, left / full, 1.0)
            spelt = np.exp(np.bincount(kept.word[at], np.where(row >= 0, logs[k][row], 0.0), len(word)))
            each.append(np.log(np.maximum(n - PAIR_DISCOUNT, 0) / full + weight * spelt + 1e-300))
            backs.append(np.log(np.maximum(weight, 1e-12)))
        key = np.array([self.ids[v] * self.number + self.ids[w] for v, w in zip(after, word, strict=True)], dtype=np.int64)
        order = np.argsort(key)
        self.pair, self.pair_llr = key[order], (each[1] - each[0])[order]
        self.after = np.full(self.number, np.nan)
        self.after[[self.ids[v] for v in after]] = backs[1] - backs[0]

    def llr(self, words: list[str]) -> np.ndarray:
        """Difference of each word's log-likelihoods, toxic less ordinary, by its characters."""
        if not words:
            return np.zeros(0)
        kept = _bounded(words)
        at, context, gram = _grams(kept)
        distinct, back = np.unique(gram, return_inverse=True)
        row = self.gram.find(distinct)[back]
        value = np.where(row >= 0, self.gram_llr[row] if len(self.gram_llr) else 0.0, 0.0)
        rest = np.flatnonzero(row < 0)
        crow = self.context.find(context[rest])
        value[rest] = np.where(crow >= 0, self.context_llr[crow] if len(self.context_llr) else 0.0, 0.0)
        return np.bincount(kept.word[at], value, len(words))

    def in_sequence(self, ids: np.ndarray, alone: np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
        """Evidence of words in a row, from their numbers (0: in no pair) and their evidence by characters; ``begins``: the places of
        words that begin a text."""
        out = alone.copy()
        back = self.after[ids[:-1]]
        if begins is not None:
            back[begins[begins > 0] - 1] = np.nan
        known = np.flatnonzero(~np.isnan(back))  # never 0, whose entry is not a number
        if len(known):
            key = ids[known] * self.number + ids[known + 1]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            out[known + 1] = np.where(self.pair[at] == key, self.pair_llr[at], alone[known + 1] + back[known])
        return out


class Scorer:
    """Evidence of whole texts; remembers words between batches in a table of bounded size."""

    def __init__(self, model: Contrast) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def evidence(self, texts: list[str]) -> np.ndarray:
        if any(len(t) > PART for t in texts):
            return np.array([self._long(t) for t in texts])
        return np.array([best.sum() / BEST for best in self._best([_WORD.findall(t.lower()) for t in texts])])

    def _long(self, text: str) -> float:
        """A long text part by part; each goes on from the last word of the one before."""
        best, before = np.zeros(0), None
        for part in parts(text):
            words = _WORD.findall(part.lower())
            if words:
                found = self._best([words], before)[0]
                best, before = np.sort(np.concatenate((best, found)))[-BEST:], words[-1]
        return float(best.sum() / BEST)

    def _best(self, split: list[list[str]], before: str | None = None) -> list[np.ndarray]:
        """The largest evidence of each text's words; ``before`` is the word before the first of each."""
        split = [[before, *words] for words in split] if before is not None else split
        fresh = [*set().union(*split).difference(self.known)] if split else []
        if len(self.known) + len(fresh) > REMEMBERED:
            self._forget()
            fresh = [*set().union(*split)]
        if fresh:
            new = [self.model.llr(fresh[a : a + AT_ONCE]) for a in range(0, len(fresh), AT_ONCE)]
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.values = np.concatenate([self.values, *new])
            self.ids = np.concatenate([self.ids, np.fromiter((self.model.ids.get(w, 0) for w in fresh), np.int64, len(fresh))])
        ends = np.cumsum([len(words) for words in split], dtype=np.int64) if split else np.zeros(0, np.int64)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return [np.zeros(0)] * len(split)
        rows = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, total)
        found = self.model.in_sequence(self.ids[rows], self.values[rows], ends[:-1][ends[:-1] < total])
        out = []
        for first, last in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            part = found[first + (before is not None) : last]
            out.append(np.partition(part, -BEST)[-BEST:] if len(part) > BEST else part)
        return out


def curve(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic regression of the label on the evidence, by Newton steps with a small ridge."""
    x = np.column_stack((evidence, np.ones(len(evidence))))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-4])
        step = np.linalg.solve(h, x.T @ (label - p) - np.array([1e-2, 1e-4]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fold(key: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id is in no fold."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5))


def levels(counts: dict[int, int], most: int) -> int:
    """The number of documents that each stratum gives at most, for ``most`` over all: small ones give all they have."""
    left, level = most, most
    for k, n in enumerate(sorted(counts.values())):
        level = -(-left // (len(counts) - k))
        if n > level:
            return level
        left -= n
    return max(level, most)


def labelled(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int = MOST_DOCS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``fold, toxic, doc_id, text`` of at most about ``most`` documents of each class for the counts, and as many for the curve, spread
    over the languages; fewer where their texts would have more than ``most_bytes``."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("fold", fold(F.col("doc_id"))).where("fold > 0")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    strata = docs.groupBy("doc_id").agg(F.min(F.pmod(F.xxhash64(lang), F.lit(STRATA))).cast("int").alias("stratum"), F.sum(F.octet_length("text")).alias("bytes"))
    marks = scratch.table(marks.join(strata, "doc_id").withColumn("curve", F.col("fold") == 4), "marks")
    sizes: dict[tuple[bool, int], dict[int, tuple[int, int]]] = defaultdict(dict)
    for r in marks.groupBy("curve", "toxic", "stratum").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect():  # 4 * STRATA rows at most
        sizes[r["curve"], r["toxic"]][r["stratum"]] = (r["n"], r["bytes"] or 0)
    shares = []
    for (in_curve, toxic), counts in sizes.items():
        level = levels({k: n for k, (n, _) in counts.items()}, most)
        each = {k: min(1.0, level / n) for k, (n, _) in counts.items()}
        fits = min(1.0, most_bytes / max(1.0, sum(each[k] * size for k, (_, size) in counts.items())))
        shares += [(in_curve, toxic, k, share * fits) for k, share in each.items()]
    share = docs.sparkSession.createDataFrame(shares, "curve boolean, toxic int, stratum int, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = marks.join(F.broadcast(share), ["curve", "toxic", "stratum"]).where(draw < F.col("share")).select("doc_id", "toxic", "fold")
    if chosen.count() <= 8 * most:  # twice what is expected at most
        chosen = F.broadcast(chosen)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(chosen, "doc_id")


def _found(column: str) -> Column:
    return F.expr(rf"regexp_extract_all(lower({column}), '\\p{{L}}+', 0)")


def _continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_continued`` of words, distinct within each batch."""
    for batch in batches:
        rows = _continued(_bounded(batch.column(0).to_pylist())).astype(np.int64)
        yield pa.record_batch([pa.array(rows[:, k]) for k in range(3)], ["longer", "key", "head"])


def lower_orders(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, n, total, types``: what ``own_lower`` gives, of the words of all texts, as a written table."""
    words = scratch.table(docs.select(F.explode(_found("text")).alias("word")).distinct(), "words")
    rows = words.mapInArrow(_continuations, "longer long, key long, head long").groupBy("longer").agg(F.first("key").alias("key"), F.first("head").alias("head"))
    counts = scratch.table(rows.groupBy("key").agg(F.count("*").alias("n"), F.first("head").alias("head")), "continuations")
    heads = counts.groupBy("head").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    return scratch.table(counts.join(heads, "head").select("key", "n", "total", "types"), "lower")


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``gram, o, t``: every character with its context, of words (word, o, t), added up within each batch."""
    for batch in batches:
        o: dict[str, int] = defaultdict(int)
        t: dict[str, int] = defaultdict(int)
        for word, ordinary, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = f"{_OPEN}{word}{_CLOSE}"
            for j in range(2, len(s) + 1):
                gram = s[max(0, j - ORDER) : j]
                o[gram] += ordinary
                t[gram] += toxic
        yield pa.record_batch([pa.array([*o], pa.string()), pa.array([*o.values()], pa.int64()), pa.array([t[g] for g in o], pa.int64())], ["gram", "o", "t"])


def _next_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``after, word, o, t``: documents of each class with a pair of words, of documents (toxic, w), added up over a few of them."""
    for batch in batches:
        for start in range(0, batch.num_rows, SOME_DOCS):
            part = batch.slice(start, SOME_DOCS)
            counts: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
            for toxic, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for pair in {*zip(words, words[1:], strict=False)}:
                    counts[pair][toxic] += 1
            columns = ([p[0] for p in counts], [p[1] for p in counts], *([n[c] for n in counts.values()] for c in (0, 1)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["after", "word", "o", "t"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the ends of less than ``SHARED`` characters of grams."""
    for batch in batches:
        words = Words(batch.column(0).to_pylist())
        last, keys = words.start + words.size, []
        for w, sums in enumerate(words.sums(SHARED - 1), 1):
            keys.append(words.finished(sums[last[words.size > w] - w], w))
        yield pa.record_batch([pa.array(np.unique(np.concatenate(keys)).astype(np.int64))], ["key"])


def _with_contexts(counted: DataFrame, context: Column, discounted: Callable[[Column], Column], strong: Column, scratch: Scratch) -> DataFrame:
    """The ``strong`` rows of ``counted`` (with counts ``o`` and ``t``), with their context's totals ``so, st`` and discounts ``do, dt``."""
    rows = scratch.table(counted.withColumn("_c", context), "counted")
    found = rows.where(strong)
    contexts = scratch.table(found.select("_c").distinct(), "contexts")  # most contexts have no strong row
    o, t = discounted(F.col("o")), discounted(F.col("t"))
    totals = rows.join(contexts, "_c", "left_semi").groupBy("_c").agg(F.sum("o").alias("so"), F.sum("t").alias("st"), F.sum(o).alias("do"), F.sum(t).alias("dt"))
    return found.join(totals, "_c").drop("_c")


def _counts(sample: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What ``Contrast`` needs of the grams and of the pairs of a labelled sample."""
    split = scratch.table(sample.where("fold < 4").select("toxic", _found("text").alias("w")), "split")
    both = (F.sum(1 - F.col("toxic")).alias("o"), F.sum("toxic").alias("t"))
    counted = scratch.table(split.select("toxic", F.explode("w").alias("word")).groupBy("word").agg(*both), "words")
    grams = counted.mapInArrow(_spelt, "gram string, o long, t long").groupBy("gram").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
    grams = _with_contexts(grams, F.expr("substring(gram, 1, length(gram) - 1)"), _discounted, (F.col("o") >= 2) | (F.col("t") >= 2), scratch)
    pairs = split.where(F.size("w") > 1).mapInArrow(_next_to, "after string, word string, o long, t long").groupBy("after", "word").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
    capped = lambda n: F.least(n, F.lit(PAIR_DISCOUNT)).cast("double")
    return grams, _with_contexts(pairs, F.col("after"), capped, (F.col("o") > PAIR_DISCOUNT) | (F.col("t") > PAIR_DISCOUNT), scratch)


_NUMBERS = ("o", "t", "so", "st", "do", "dt")
_GRAM, _PAIR, _LOWER = range(3)


def _together(grams: DataFrame, pairs: DataFrame, lower: DataFrame) -> DataFrame:
    """Rows of three kinds in the same few columns."""
    no, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    numbers = [F.col(c).cast("double").alias(c) for c in _NUMBERS]
    zeros = [F.lit(0.0).alias(c) for c in _NUMBERS[3:]]
    rows = grams.select(F.lit(_GRAM).alias("kind"), F.col("gram").alias("name"), none.alias("word"), no.alias("key"), *numbers)
    rows = rows.unionByName(pairs.select(F.lit(_PAIR).alias("kind"), F.col("after").alias("name"), "word", no.alias("key"), *numbers))
    counts = [F.col(c).cast("double").alias(n) for c, n in zip(("n", "total", "types"), _NUMBERS[:3], strict=True)]
    return rows.unionByName(lower.select(F.lit(_LOWER).alias("kind"), none.alias("name"), none.alias("word"), "key", *counts, *zeros))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds the tables in one task from the rows of ``_counts`` and those of ``lower_orders`` that these need, since the sample that
    they come from is bounded, and yields them pickled in parts."""
    names, words, keys, numbers = [[], [], []], [[], [], []], [[], [], []], [[], [], []]
    for whole in batches:
        for kind in np.unique(whole.column(0).to_numpy()).tolist():
            batch = whole.filter(pc.equal(whole.column(0), kind))
            names[kind].append(batch.column(1))
            words[kind] += batch.column(2).to_pylist() if kind == _PAIR else []
            keys[kind].append(batch.column(3).to_numpy().astype(np.uint64) if kind == _LOWER else np.zeros(0, np.uint64))
            numbers[kind].append(np.column_stack([c.to_numpy() for c in batch.columns[4:]]))
    if not names[_GRAM]:
        return
    each = [np.concatenate([np.zeros((0, len(_NUMBERS))), *n]) for n in numbers]
    grams = {"gram": pa.chunked_array(names[_GRAM], pa.string())} | dict(zip(_NUMBERS, each[_GRAM].T, strict=True))
    pairs = {"after": pa.chunked_array(names[_PAIR], pa.string()).to_pylist(), "word": words[_PAIR]} | dict(zip(_NUMBERS, each[_PAIR].T, strict=True))
    del numbers
    data = pickle.dumps(Contrast(grams, pairs, (np.concatenate([np.zeros(0, np.uint64), *keys[_LOWER]]), *each[_LOWER][:, :3].T)), protocol=5)
    for at in range(0, len(data), 4 << 20):
        yield pa.record_batch([pa.array([data[at : at + (4 << 20)]], pa.binary())], ["part"])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCS) -> tuple[Contrast, float, float] | None:
    """The models and the curve; None without both classes."""
    with Scratch(docs.sparkSession) as scratch:
        return _train(docs, labels, scratch, most)


def _train(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int) -> tuple[Contrast, float, float] | None:
    rows = scratch.table(labelled(docs, labels, scratch, most), "sample")
    words = rows.where("fold < 4").where(F.col("text").rlike(r"\p{L}")).groupBy("toxic").count().count()
    if words < 2:
        return None
    grams, pairs = _counts(rows, scratch)
    grams = scratch.table(grams, "grams")
    needed = grams.select("gram").mapInArrow(_suffixes, "key long").distinct()
    lower = scratch.table(lower_orders(docs, scratch).join(needed, "key", "left_semi"), "needed")
    pairs = scratch.table(pairs, "pairs")
    packed = _together(grams, pairs, lower).coalesce(1).mapInArrow(_fitted, "part binary").collect()
    nothing = ({c: [] for c in ("gram", *_NUMBERS)}, {c: [] for c in ("after", "word", *_NUMBERS)}, (np.zeros(0, np.uint64), *[np.zeros(0)] * 3))
    model = pickle.loads(b"".join(r["part"] for r in packed)) if packed else Contrast(*nothing)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [scorer.evidence(texts[part]) for part in slices(texts, 1_000_000)]
            yield pa.record_batch([pa.array(np.concatenate(found) if found else np.zeros(0)), batch.column(1)], ["evidence", "toxic"])

    seen = rows.where("fold = 4").select("text", "toxic").mapInArrow(run, "evidence double, toxic int").toPandas()  # the bounded sample
    held.destroy()
    if seen["toxic"].nunique() < 2:
        return model, *DEFAULT_CURVE
    return model, *curve(seen["evidence"].to_numpy(), seen["toxic"].to_numpy().astype(float))


def scores(docs: DataFrame, model: tuple[Contrast, float, float] | None, carried: list[str]) -> DataFrame:
    """``carried`` columns of ``docs`` with ``_score`` for every row's ``text``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema) + ", _score double"
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.value
        scorer = Scorer(found[0]) if found else None
        for whole in batches:
            for at in range(0, whole.num_rows, SOME_DOCS):
                batch = whole.slice(at, SOME_DOCS)
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                out = np.zeros(len(texts))
                if scorer:
                    for part in slices(texts, 1_000_000):
                        out[part] = 1 / (1 + np.exp(-np.clip(found[1] * scorer.evidence(texts[part]) + found[2], -30, 30)))
                yield pa.record_batch([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], "_score"])

    return docs.select(*carried, F.col("text").alias("_text")).mapInArrow(run, schema)
