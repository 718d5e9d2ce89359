"""Language identification with unigram piece models, marginalised over segmentations.

The vocabulary is a fixed public one (a SentencePiece model's pieces); only the probabilities of its pieces are learnt, per language.
The probability of a word is the sum over all ways to cut it into pieces, found by a forward pass that runs over all distinct words of
a batch at once; since no piece crosses a word's start, the log-probability of a text is the sum over its words. Probabilities come
from expectation maximisation over all segmentations of the training words, and each language's are interpolated with the pooled ones.
Each round adds up the expected counts of all words' partitions; only the sums, one per piece and language, reach the driver.

Words are runs of letters, lower-cased, of any length; the piece that starts a word carries the vocabulary's word mark. Words of more
than ``LONGEST`` letters take the same pass in logarithms, since their probabilities are too small for floating point. The score is the
posterior probability of the predicted language under equal priors, with the log-likelihood taken per word and weighted by the square
root of the number of words.

The models are fitted on at most about ``MOST_DOCS`` documents and ``MOST_BYTES`` of text of each language (chosen by a hash of the
id); every text is scored whole. A model has a number per piece and language, which is broadcast; more than ``MOST_LANGS`` languages
are an error.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a null id is in no fold, neither learnt from nor held out;
repeated rows are scored row by row; a null language is not learnt; without any language to learn everything is ``und``; ties go to
the first language in order; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe_count import PART, parts, slices
from corpusloom.llm.ragged import Table, Words
from corpusloom.llm.toxicity import fold
from corpusloom.plans.scratch import Scratch

MOST_DOCS, MOST_BYTES = 800, 8 << 20
#: Letters up to which a word's probabilities are multiplied as they are.
LONGEST = 48
#: Numbers that a pass holds at once.
CELLS = 4_000_000
MOST_LANGS = 1000
ROUNDS = 3
REMEMBERED = 400_000
#: Weight of the pooled probabilities, and the probability of a letter that no piece covers.
POOLED, UNKNOWN = 0.02, 1e-7
#: Scale of probabilities by character, so that products stay near 1.
_SCALE = 16.0
_WORD = regex.compile(r"\p{L}+")
_MARK = "▁"


def vocabulary(path: str) -> list[str]:
    """Pieces of a SentencePiece model without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Lattice:
    """All pieces at all places of a batch of words, longest words first."""

    def __init__(self, words: list[str], table: Table, lengths: list[int]) -> None:
        self.order = np.argsort([-len(w) for w in words], kind="stable")
        self.words = Words([_MARK + words[i] for i in self.order.tolist()])
        self.unknown = len(table.rows)
        n = len(self.words.chars)
        left = self.words.size[self.words.word] - self.words.place
        self.ids: dict[int, np.ndarray] = {}
        for length, sums in enumerate(self.words.sums(lengths[-1]), 1):
            fits = np.flatnonzero(left >= length)
            if not len(fits):
                break
            if length not in lengths:
                continue
            ids = np.full(n, -1, dtype=np.int64)
            ids[fits] = table.find(self.words.finished(sums[fits], length))
            if length == 1:
                ids[ids < 0] = -2  # an uncovered letter
            if (ids != -1).any():
                self.ids[length] = ids
        #: words with at least e characters: a prefix, since longer words come first
        self.reach = np.searchsorted(-self.words.size, -np.arange(self.words.size.max() + 1), side="right") if len(words) else np.zeros(1, int)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, characters so far, language]; ``p`` has a row per piece, then one of zeros and one for uncovered letters, and is
        read with the indices -1 (uncovered: -2) from its end."""
        alpha = np.zeros((len(self.words.size), len(self.reach), p.shape[1]))
        alpha[:, 0] = 1
        for e in range(1, len(self.reach)):
            k = self.reach[e]
            for length, ids in self.ids.items():
                if length <= e:
                    alpha[:k, e] += alpha[:k, e - length] * p[ids[self.words.start[:k] + e - length]]
        return alpha

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each row of ``p``, given how often each word (in the caller's order) occurs by language."""
        alpha = self.forward(p)
        weight = counts[self.order]
        last = np.arange(len(self.words.size))
        total = np.maximum(alpha[last, self.words.size], 1e-300)
        beta = np.zeros_like(alpha)
        beta[last, self.words.size] = weight / total
        out = np.zeros_like(p)
        for e in range(len(self.reach) - 1, 0, -1):
            k = self.reach[e]
            for length, ids in self.ids.items():
                if length <= e:
                    piece = ids[self.words.start[:k] + e - length]
                    flow = p[piece] * beta[:k, e]
                    beta[:k, e - length] += flow
                    use = alpha[:k, e - length] * flow
                    for j in range(p.shape[1]):
                        out[:, j] += np.bincount(piece % len(p), use[:, j], len(p))
        return out


class Runs:
    """The same for words of any length, longest first, in logarithms."""

    def __init__(self, words: list[str], table: Table, lengths: list[int]) -> None:
        self.lattice = Lattice(words, table, lengths)
        self.size, self.start = self.lattice.words.size, self.lattice.words.start
        self.lengths = np.array(sorted(self.lattice.ids))
        self.ids = np.column_stack([self.lattice.ids[k] for k in self.lengths.tolist()])

    @staticmethod
    def _sum(x: np.ndarray) -> np.ndarray:
        most = x.max(axis=1)
        return most + np.log(np.exp(x - most[:, None]).sum(axis=1))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """log alpha[word, characters so far, language]."""
        reach = self.lattice.reach
        alpha = np.full((len(self.size), len(reach), logp.shape[1]), -np.inf)
        alpha[:, 0] = 0
        for e in range(1, len(reach)):
            k, back = reach[e], e - self.lengths[: np.searchsorted(self.lengths, e, side="right")]
            pieces = self.ids[self.start[:k, None] + back, np.arange(len(back))]
            alpha[:k, e] = self._sum(alpha[:k, back] + logp[pieces])
        return alpha

    def backward(self, logp: np.ndarray) -> np.ndarray:
        reach = self.lattice.reach
        beta = np.full((len(self.size), len(reach), logp.shape[1]), -np.inf)
        beta[np.arange(len(self.size)), self.size] = 0
        for e in range(len(reach) - 2, -1, -1):
            k, on = reach[e + 1], e + self.lengths[self.lengths < len(reach) - e]
            beta[:k, e] = self._sum(beta[:k, on] + logp[self.ids[self.start[:k] + e, : len(on)]])
        return beta

    def total(self, logp: np.ndarray) -> np.ndarray:
        """Log-probability of each word (in the caller's order) by language."""
        out = np.zeros((len(self.size), logp.shape[1]))
        each = max(1, CELLS // (len(self.size) * len(self.lattice.reach)))
        for a in range(0, logp.shape[1], each):
            out[self.lattice.order, a : a + each] = self.forward(logp[:, a : a + each])[np.arange(len(self.size)), self.size]
        return out

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out, words = np.zeros(logp.shape), self.lattice.words
        weight = counts[self.lattice.order]
        each = max(1, CELLS // (len(self.size) * len(self.lattice.reach)))
        for a in range(0, logp.shape[1], each):
            part = logp[:, a : a + each]
            alpha, beta = self.forward(part), self.backward(part)
            total = alpha[np.arange(len(self.size)), self.size]
            for j, length in enumerate(self.lengths.tolist()):
                at = np.flatnonzero(self.ids[:, j] >= 0)
                piece, word, place = self.ids[at, j], words.word[at], words.place[at]
                use = np.exp(alpha[word, place] + part[piece] + beta[word, place + length] - total[word]) * weight[word, a : a + each]
                for k in range(use.shape[1]):
                    out[:, a + k] += np.bincount(piece, use[:, k], len(out))
        return out


def _groups(words: list[str], langs: int) -> Iterator[list[int]]:
    """Numbers of words that take a pass together: of similar length, and not too many."""
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    at = 0
    while at < len(order):
        n = max(1, CELLS // ((len(words[order[at]]) + 2) * langs))
        yield order[at : at + n]
        at += n


class Unigrams:
    """Piece probabilities of every language over one vocabulary."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        kept = Words(pieces)
        self.lengths = sorted(set(kept.size.tolist()))
        self.table = Table(kept.whole())
        self.scale = _SCALE ** np.concatenate((kept.size, [1, 1])).astype(float)

    def start(self, langs: int) -> None:
        """Equal probabilities."""
        self._set(np.full((len(self.pieces) + 2, langs), 1 / len(self.pieces)))

    def uses(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language, given how often each word occurs by language."""
        out = np.zeros(self.p.shape)
        for rows in _groups(words, counts.shape[1]):
            some, n = [words[i] for i in rows], counts[rows]
            if len(some[0]) > LONGEST:
                out += Runs(some, self.table, self.lengths).expected(self.logp, n)
            else:
                out += Lattice(some, self.table, self.lengths).expected(self.p, n)
        return out[: len(self.pieces)]

    def update(self, uses: np.ndarray) -> None:
        """Probabilities from expected uses."""
        own = uses / np.maximum(uses.sum(axis=0), 1e-9)
        pooled = uses.sum(axis=1, keepdims=True) + 0.01
        self._set(np.concatenate(((1 - POOLED) * own + POOLED * pooled / pooled.sum(), np.zeros((2, uses.shape[1])))))

    def fit(self, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> None:
        """``counts``: occurrences of each word by language."""
        self.start(counts.shape[1])
        for _ in range(rounds):
            self.update(self.uses(words, counts))

    def _set(self, p: np.ndarray) -> None:
        p[-2], p[-1] = UNKNOWN, 0
        self.p = p * self.scale[:, None]
        with np.errstate(divide="ignore"):
            self.logp = np.log(p)

    def score(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word by language."""
        out = np.zeros((len(words), self.p.shape[1]))
        for rows in _groups(words, self.p.shape[1]):
            some = [words[i] for i in rows]
            if len(some[0]) > LONGEST:
                out[rows] = Runs(some, self.table, self.lengths).total(self.logp)
            else:
                lattice = Lattice(some, self.table, self.lengths)
                alpha, size = lattice.forward(self.p), lattice.words.size
                whole = np.log(np.maximum(alpha[np.arange(len(size)), size], 1e-300)) - (size * np.log(_SCALE))[:, None]
                out[np.array(rows)[lattice.order]] = whole
        return out


def letters(text: str) -> list[str]:
    """Words of a text."""
    return _WORD.findall(text.lower())


class Identifier:
    """Scores whole texts; remembers words between batches in a table of bounded size."""

    def __init__(self, model: Unigrams, langs: list[str]) -> None:
        self.model, self.langs = model, langs
        self.known: dict[str, int] = {}
        self.values = np.zeros((0, len(langs)))

    def _totals(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """Log-probabilities by language, and the number of words, of each text."""
        if any(len(t) > PART for t in texts):
            out = []
            for t in texts:
                each = [self._short([p])[0] for p in parts(t)]
                out.append((sum(x for x, _ in each), sum(n for _, n in each)))
            return out
        return self._short(texts)

    def _short(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        split = [letters(t) for t in texts]
        fresh = [*set().union(*split).difference(self.known)] if split else []
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, self.values = {}, np.zeros((0, len(self.langs)))
            fresh = [*set().union(*split)]
        if fresh:
            new = [self.model.score(fresh[a : a + 100_000]) for a in range(0, len(fresh), 100_000)]
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.values = np.concatenate([self.values, *new])
        return [(self.values[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0), len(words)) for words in split]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for total, n in self._totals(texts):
            if not n:
                langs.append("und")
                scores.append(0.0)
                continue
            total = total / n**0.5
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def train(docs: DataFrame, path: str, most: int = MOST_DOCS, rounds: int = ROUNDS) -> tuple[Unigrams, list[str]] | None:
    """The models and their languages in order, learnt from ``text`` and ``lang`` of rows that are not held out."""
    with Scratch(docs.sparkSession) as scratch:
        return _train(docs, path, most, rounds, scratch)


def _train(docs: DataFrame, path: str, most: int, rounds: int, scratch: Scratch) -> tuple[Unigrams, list[str]] | None:
    spark = docs.sparkSession
    texts = docs.select("doc_id", "lang", "text").where("lang is not null and doc_id is not null and text is not null").where(fold(F.col("doc_id")) != 0)
    sizes = texts.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"models of more than {MOST_LANGS} languages are too large to broadcast")
    share = spark.createDataFrame([(r["lang"], min(1.0, most / r["n"], MOST_BYTES / max(1, r["bytes"]))) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    drawn = texts.join(F.broadcast(share), "lang").where(draw < F.col("share"))
    words = drawn.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("word"))
    counted = scratch.table(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "counted")
    langs = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").collect()]  # at most MOST_LANGS
    if not langs:
        return None
    number = F.element_at(F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))]), F.col("lang"))
    each = counted.groupBy("word").agg(F.collect_list(F.struct(number.alias("lang"), F.col("n").cast("double").alias("n"))).alias("n"))
    each = scratch.table(each.repartition(spark.sparkContext.defaultParallelism, "word").select("word", F.transform("n", lambda x: x["lang"]).alias("langs"), F.transform("n", lambda x: x["n"]).alias("counts")), "words")
    model = Unigrams(vocabulary(path))
    model.start(len(langs))
    for _ in range(rounds):
        model.update(_expected(each, model, len(langs)))
    return model, langs


def _expected(words: DataFrame, model: Unigrams, langs: int) -> np.ndarray:
    """Expected uses of each piece by language over all partitions of ``word, langs, counts``."""
    held = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                counts, sizes = np.zeros((batch.num_rows, langs)), np.diff(batch.column(1).offsets)
                counts[np.repeat(np.arange(batch.num_rows), sizes), batch.column(1).flatten().to_numpy()] = batch.column(2).flatten().to_numpy()
                total = total + held.value.uses(batch.column(0).to_pylist(), counts)
        if not isinstance(total, float):
            piece, lang = np.nonzero(total)
            yield pa.record_batch([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "uses"])

    sums = words.mapInArrow(run, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()  # the model's size
    held.destroy()
    out = np.zeros((len(model.pieces), langs))
    out[sums["piece"].to_numpy(), sums["lang"].to_numpy()] = sums["uses"].to_numpy()
    return out


def identify(docs: DataFrame, path: str, most: int = MOST_DOCS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, path, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.value
        identifier = Identifier(*found) if found else None
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if identifier:
                for part in slices(texts, 1_000_000):
                    langs[part], scores[part] = identifier.predict(texts[part])
            yield pa.record_batch([*batch.columns[:2], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held_out, "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
