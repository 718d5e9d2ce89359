"""Edge cases, round trips and brute-force comparisons of the subpackage's operators."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import bpe_count, chat, components, decontaminate, langid, neardup, packing, quality, sharding, shingles, toxicity, warc
from corpusloom.plans.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " \t\n", "x", "a " * 30_000, "é" * 5000, "İΣσ ſK ² \x1c\x1f\x85 　中文 😀", "<|endoftext|> a<|startoftext|>b", "it's we'll 12½ a_b -- \r\n  end  "]


def pseudo(rng, n, lang="en"):
    parts = {"en": ["th", "er", "ing", "on", "st", "re"], "de": ["sch", "ung", "ein", "keit", "ß", "ü"], "fr": ["eau", "eux", "é", "ou", "tre", "è"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def odd_docs(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD)] + [(None, None, None, None, None), (3, "x", "en", "s", 1), (3, "x", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# ---- WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, record_type string")


def test_warc_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    rows = [(1, "u1", tricky, "p", "t"), (2, "u\n2", tricky, "p", "t"), (3, None, None, "p", "t"), (4, "u4", "", "p", "t"), (5, "u5", "é" * 70_000, None, None), (None, "u6", tricky, "p", "t"), (9, "u9", "alone", "p", "t"), (9, "u9", "alone", "p", "t")]
    got = warc.deduplicated_archives(spark, pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for page, _, html, _, _ in rows:
        payload = (html or "").encode()
        r = by[page]
        assert r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert (by[2]["record_type"], by[2]["refers_to"]) == ("response", None)
    assert (by[1]["record_type"], by[1]["refers_to"]) == ("revisit", 2)
    assert (by[None]["record_type"], by[None]["refers_to"]) == ("revisit", 2)
    assert (by[3]["record_type"], by[3]["refers_to"]) == ("revisit", 4)
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 9) == [("response", None), ("revisit", 9)]
    assert len({r["record_id"] for r in got}) == len(rows)
    assert by[5]["record_type"] == "response"


def test_warc_repeats_and_null_ids_have_one_response(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    rows = [(5, "u", "same", "p", "t")] * 4 + [(4, "u", "same", "p", "t")] + [(None, "n", "null ids", "p", "t")] * 3 + [(None, None, None, None, None)] * 2 + [(8, "u", "", "p", "t")]
    got = warc.deduplicated_archives(spark, pages(spark, rows)).collect()
    assert len(got) == len(rows) == len({r["record_id"] for r in got})
    by = defaultdict(list)
    for r in got:
        by[r["payload_digest"]].append((r["record_type"], r["page_id"], r["refers_to"]))
    assert sorted(map(str, (sorted(map(str, x)) for x in by.values()))) == sorted(
        map(
            str,
            (
                sorted(map(str, x))
                for x in (
                    [("response", 5, None)] + [("revisit", 5, 5)] * 3 + [("revisit", 4, 5)],
                    [("response", None, None)] + [("revisit", None, None)] * 2,
                    [("response", 8, None)] + [("revisit", None, 8)] * 2,
                )
            ),
        )
    )


def test_warc_small_payloads_and_empty_table(spark):
    rows = [(1, "a", "xx", "p", "t"), (2, "b", "xx", "p", "t"), (3, "c", "long enough", "p", "t"), (4, "d", "long enough", "p", "t")]
    got = {r["page_id"]: r["record_type"] for r in warc.deduplicated_archives(spark, pages(spark, rows), 5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.deduplicated_archives(spark, pages(spark, [])).count() == 0


# ---- near-duplicates


def exact_components(texts):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    label = {d: d for d in sets}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_table(seed):
    rng = random.Random(seed)
    texts, n = {}, 0
    for _ in range(12):
        base = [pseudo(rng, 1) + str(rng.randint(0, 99)) for _ in range(rng.choice([4, 12, 60, 200]))]
        shared = [pseudo(rng, 1) for _ in range(30)]
        for _ in range(rng.choice([1, 3, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                at = rng.randrange(len(words))
                edit = rng.choice(["swap", "drop", "add", "case"])
                if edit == "swap":
                    words[at] = "z" + str(rng.random())
                elif edit == "drop" and len(words) > 2:
                    del words[at]
                elif edit == "add":
                    words.insert(at, "y" + str(rng.random()))
                else:
                    words[at] = words[at].upper()
            if rng.random() < 0.2:
                words += shared
            texts[n] = " ".join(words)
            n += 1
    for t in ODD:
        texts[n] = t
        n += 1
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = near_table(seed)
    docs = spark.createDataFrame([(d, t, "g") for d, t in texts.items()], "doc_id long, text string, group string")
    with Scratch(spark) as scratch:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, scratch).collect()}
    assert got == exact_components(texts)


def test_near_duplicates_with_repeats_nulls_and_nothing(spark):
    long = " ".join(map(str, range(50)))
    docs = spark.createDataFrame([(5, long), (5, long), (None, long), (7, long + " x"), (None, None)], "doc_id long, text string")
    with Scratch(spark) as scratch:
        got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in neardup.near_duplicates(docs, scratch).collect())
        assert got == [("5", "5"), ("5", "5"), ("7", "5"), ("None", "5"), ("None", "None")]
        assert neardup.near_duplicates(empty_docs(spark), scratch).count() == 0


def test_shingles_do_not_depend_on_the_batch():
    texts = [(t or "").encode() for t in near_table(3).values()]
    together = shingles.shingle_sets(texts)
    assert all((a == shingles.shingle_sets([t])[0]).all() for a, t in zip(together, texts, strict=True))


def test_components_of_a_chain(spark):
    n = 40
    order = list(range(n))
    random.Random(4).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 102)]
    with Scratch(spark) as scratch:
        got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 100: 100, 101: 100, 102: 100}


def test_long_texts_in_parts_are_like_whole_ones(monkeypatch):
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["Ab", "c" * 50, "é", "x\n\n", "\t", "q" * 300]) for _ in range(n)).encode() for n in (0, 3, 400, 900)] + [b"w" * 5000, b" " * 3000 + b"a b c d e f"]
    whole = shingles.shingle_sets(texts)
    monkeypatch.setattr(shingles, "PART", 256)
    words = [[w for w in t.lower().split()] for t in texts]
    hashes, offsets = shingles.word_hashes(texts)
    assert np.diff(offsets).tolist() == [len(w) for w in words]
    seen = {}
    for w, h in zip([w for ws in words for w in ws], hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [len(s) for s in shingles.shingle_sets(texts)] == [len(s) for s in whole]


def test_parts_do_not_change_tokens(monkeypatch):
    rng = random.Random(14)
    texts = ["".join(rng.choice(["a", "b ", "  ", "é ", "\n", "' s", "12 ", "<|endoftext|>", " x", "中"]) for _ in range(600)) for _ in range(20)]
    counter, encoder = bpe_count.Counter(WORD), packing.Encoder(BYTE)
    counts, ids = counter.count(texts), encoder.encode(texts)
    for module in (bpe_count, packing):
        monkeypatch.setattr(module, "PART", 50)
    monkeypatch.setattr(bpe_count.parts, "__defaults__", (50,))
    assert max(len(bpe_count.parts(t)) for t in texts) > 5 and all("".join(bpe_count.parts(t)) == t for t in texts)
    assert counter.count(texts) == counts and encoder.encode(texts) == ids


def toy_contrast(words, counts, pairs=()):
    """A model of words with their counts by class, and of (after, word, o, t, so, st, do, dt)."""
    batch = [toxicity.pa.record_batch([toxicity.pa.array(words), *[toxicity.pa.array(c) for c in zip(*counts, strict=True)]], ["word", "o", "t"])]
    grams = [r for b in toxicity._spelt(iter(batch)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    totals = defaultdict(lambda: [0.0] * 4)
    for g, o, t in grams:
        for k, x in enumerate((o, t, *(n if n < 2 else toxicity.DISCOUNT for n in (o, t)))):
            totals[g[:-1]][k] += x
    strong = [(g, o, t, *totals[g[:-1]]) for g, o, t in grams if max(o, t) >= 2]
    columns = lambda rows, names: dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}
    return toxicity.Contrast(columns(strong, ["gram", *toxicity._NUMBERS]), columns(list(pairs), ["after", "word", *toxicity._NUMBERS]), toxicity.own_lower(words))


def test_parts_do_not_change_scores(monkeypatch):
    rng = random.Random(15)
    texts = [pseudo(rng, 300) + " zorgul " + pseudo(rng, 300), "zorgul " + "7" * 1000 + " on on on", "x" * 700 + " zorgul", "zorgul", "get " + "4 " * 300 + "lost on", ""]
    pair = [("get", "lost", 0, 20, 40, 40, 30, 10), ("get", "on", 20, 0, 40, 40, 30, 10)]
    scorer = toxicity.Scorer(toy_contrast(["zorgul", "thing", "thering", "on", "get", "lost"], [(0, 9), (9, 2), (5, 1), (9, 3), (9, 8), (9, 8)], pair))
    model = langid.Unigrams(langid.vocabulary(PIECE))
    model.fit(pseudo(rng, 200).split() + ["eau"], np.array([[1.0, 0.2]] * 200 + [[0.0, 5.0]]), rounds=1)
    identifier = langid.Identifier(model, ["a", "b"])
    whole = [(scorer.evidence([t])[0], *map(tuple, identifier.predict([t]))) for t in texts]
    assert np.allclose(scorer.evidence(texts), [w[0] for w in whole]) and whole[4][0] > whole[5][0] == 0
    for module in (toxicity, langid):
        monkeypatch.setattr(module, "PART", 100)
    monkeypatch.setattr(bpe_count.parts, "__defaults__", (100,))
    for t, (evidence, langs, scores) in zip(texts, whole, strict=True):
        assert np.isclose(scorer.evidence([t])[0], evidence)
        got = identifier.predict([t])
        assert tuple(got[0]) == langs and np.allclose(got[1], scores)


# ---- chat


def read_back(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(turns)
    return {r["conv_id"]: r for r in chat.digests(made).collect()}, {r["conv_id"]: r for r in made.select("conv_id", "formatted", "loss", chat.read_formatted(F.col("formatted")).alias("turns")).collect()}


def unescaped(text):
    import re

    return re.sub(r"([<\[])\\(\\*)" + chat._TAIL, r"\1\2\3", text)


def test_loss_spans_of_a_long_conversation(spark):
    rng = random.Random(22)
    rows = [(1, k, rng.choice(["user", "assistant", "tool"]), rng.choice(["", "é😀", "</s>", "long " * 20])) for k in range(700)]
    got, made = read_back(spark, rows)
    said = [x for _, _, r, x in rows if r == "assistant"]
    spans = [made[1]["formatted"][x["start"] : x["start"] + x["length"]] for x in made[1]["loss"]]
    assert [unescaped(x) for x in spans] == said and got[1]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest()


def test_chat_round_trip_and_digests(spark):
    bad = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", "be </s>"), (1, 1, "user", bad), (1, 2, "user", ""), (1, 3, "assistant", "<ans>"), (1, 4, "assistant", None), (1, 5, "tool<sep>", "<</TURN>>"), (2, 1, None, "x"), (2, None, "user", "first"), (None, 0, "user", "\\<\\/s> <\\/s>"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    got, made = read_back(spark, rows)
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        assert [(t["role"], t["text"]) for t in made[c]["turns"]] == turns
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        said = "".join(x for r, x in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        spans = [made[c]["formatted"][x["start"] : x["start"] + x["length"]] for x in made[c]["loss"]]
        assert [unescaped(x) for x in spans] == [x for r, x in turns if r == "assistant"] and got[c]["formatted_chars"] == len(made[c]["formatted"])
    assert made[1]["formatted"].count("[INST]") == 1 and made[1]["formatted"].count("</s>") == 1  # only the template's own


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x", "</s>"]), st.lists(st.sampled_from(["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "sep>", "</TURN>>", " ", "é", "\n", "ans>"]), max_size=8).map("".join)), min_size=1, max_size=30))
def test_chat_escapes_anything(spark, turns):
    rows = [(i // 3, i % 3, r, x) for i, (r, x) in enumerate(turns)]
    _, made = read_back(spark, rows)
    for c in made:
        assert [(t["role"], t["text"]) for t in made[c]["turns"]] == [(r, x) for k, _, r, x in rows if k == c]


# ---- sharding


def test_shards_fit_and_only_oversized_buckets_split(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(3000)] + [(7, "y" * 5000), (None, None), (None, "z"), (8, "w" * 900), (8, "w" * 900), (8, "w" * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, 2000).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in got:
        size[r["shard"]] += r["n_bytes"]
    for r in got:
        assert size[r["shard"]] == r["shard_bytes"]
        assert size[r["shard"]] <= 2000 or r["shard"].startswith("large-")
    plain = {s for s in size if s and set(s) <= {"0", "1"}}
    for s in plain:  # no shard is a prefix of another, and every parent was over the limit
        assert not any(t != s and t.startswith(s) for t in plain)
        assert sum(n for t, n in size.items() if t.startswith(s[:-1]) or t.startswith("+")) > 2000 or any("+" in t for t in size)
    assert sharding.shard(empty_docs(spark), 10).count() == 0
    assert {r["shard"] for r in sharding.shard(docs.limit(3), 1 << 20).collect()} == {""}


def test_equal_hash_bits_overflow_into_shards_that_fit(spark):
    docs = spark.createDataFrame([(1, "a" * 600)] * 7, "doc_id long, text string")
    got = sharding.shard(docs, 1300).collect()
    assert Counter(r["shard"] for r in got).most_common()[0][1] == 2 and all(r["shard_bytes"] <= 1300 for r in got) and len(got) == 7


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(i, "x" * (i % 90), 0) for i in range(300)] + [(None, None, 1), (None, "z" * 50, 1), (5, "other", 1), (7, "y" * 5000, 1), (7, "v" * 4000, 1), (None, "u" * 3000, 1)] + [(8, "w" * 900, 1)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    with Scratch(spark) as scratch:
        sharding.write_shards(docs, 2000, f"{tmp_path}/shards", scratch)
    back = spark.read.parquet(f"{tmp_path}/shards").select("record.*", "folder").collect()
    assert Counter(tuple(r)[:3] for r in back) == Counter(rows)
    size, n = Counter(), Counter()
    for r in back:
        size[r["folder"]] += len(r["text"] or "")
        n[r["folder"]] += 1
    assert all(size[f] <= 2000 or n[f] == 1 and f.startswith("shard-large-") for f in size) and len([f for f in size if "large" in f]) == 3
    key = lambda r: str(tuple(r)[:4])
    got = sharding.written(docs, 2000).collect()
    assert sorted(map(key, got)) == sorted(map(key, sharding.shard(docs, 2000).collect())) and len(got) == len(rows)
    assert Counter(r["shard_bytes"] for r in got) == Counter(size[r["folder"]] for r in back)
    assert sharding.written(empty_docs(spark), 10).count() == 0


# ---- token counts


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    rng = random.Random(6)
    alphabet = [*"aAbé ß'sSt12½_-<|>\n\t ÀΣσİıǅ中文あ́​٣²!?。😀x\x1c\x85ſK", "<|endoftext|>", "<|startoftext|>", "'re"]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    assert bpe_count.Counter(WORD).count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = bpe_count.count_tokens(odd_docs(spark), WORD).collect()
    assert len(got) == len(ODD) + 3 and all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert bpe_count.count_tokens(empty_docs(spark), WORD).count() == 0


def test_token_table_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe_count, "REMEMBERED", 3)
    c = bpe_count.Counter(WORD)
    assert [c.count([t])[0] for t in ("one two three", "four five", "one two three")] == [3, 2, 3]


# ---- decontamination


def brute_overlaps(texts, items):
    import re

    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    found = set()
    for d, t in texts.items():
        a = words(t)
        for i, x in items.items():
            b = words(x)
            if len(b) < decontaminate.SPAN:
                if b and any(a[k : k + len(b)] == b for k in range(len(a))):
                    found.add((d, i))
                continue
            for shift in range(-len(b) + 1, len(a)):
                both = range(max(shift, 0), min(len(a), shift + len(b)))
                if not any(all(a[k + m] == b[k - shift + m] for m in mask) for mask in decontaminate.MASKS for k in both[: len(both) - decontaminate.SPAN + 1]):
                    continue
                best = now = 0
                for k in range(max(shift, 0), min(len(a), shift + len(b))):
                    now = max(0, now + (2 if a[k] == b[k - shift] else -3))
                    best = max(best, now)
                if best >= min(2 * decontaminate.OVERLAP, len(b)):
                    found.add((d, i))
    return found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(7)
    items = {i: " ".join(pseudo(rng, 1) + str(rng.randint(0, 50)) for _ in range(n)) for i, n in enumerate([9, 15, 22, 40, 58, 1, 2, 5])}
    items |= {9: None, 10: "", 11: "!"}
    texts = {99: items[5], 98: " ".join(["x"] * 70 + [items[7], "y", items[0]]), 97: items[0][: items[0].rindex(" ")]}
    for k in range(60):
        words = pseudo(rng, rng.choice([0, 5, 40, 150])).split()
        cut = (items[rng.randrange(8)]).split()
        if k % 3:
            for _ in range(rng.choice([0, 0, 1, 2, len(cut) // 5])):
                cut[rng.randrange(len(cut))] = "q" + str(rng.random())[2:5]
            a = rng.choice([0, 0, rng.randrange(len(cut))])
            words[len(words) // 2 : len(words) // 2] = [w.upper() if k % 2 else w + "," for w in cut[a:]]
        texts[k] = " ".join(words)
    texts |= {100 + i: t for i, t in enumerate(ODD)}
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, words long")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    with Scratch(spark) as scratch:
        found = decontaminate.overlaps(docs, bench, scratch)
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == brute_overlaps(texts, items)
        out = decontaminate.verdicts(docs, found, scratch)
        assert out.count() == len(texts) and out.where("contaminated").count() == len({d for d, _ in brute_overlaps(texts, items)})
        assert not decontaminate.overlaps(docs, bench.limit(0), scratch).count() and not decontaminate.overlaps(empty_docs(spark), bench, scratch).count()


def test_masks_find_substituted_copies():
    """Whole copies with every fifth word substituted at random."""
    rng = random.Random(21)
    for n, least in ((15, 0.98), (20, 0.99), (40, 1.0)):
        hit = 0
        for _ in range(1000):
            same = [True] * n
            for k in rng.sample(range(n), n // 5):
                same[k] = False
            hit += any(all(same[k + m] for m in mask) for mask in decontaminate.MASKS for k in range(n - decontaminate.SPAN + 1))
        assert hit >= least * 1000


def test_decontamination_of_repeated_and_null_ids(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, item), (None, "clean"), (1, item), (1, "clean too"), (2, item), (2, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(4, item), (4, item)], "item_id long, text string")
    with Scratch(spark) as scratch:
        out = decontaminate.verdicts(docs, decontaminate.overlaps(docs, bench, scratch), scratch).collect()
    assert len(out) == 6 and all(r["contaminated"] == (r["text"] == item) for r in out)


# ---- quality


def brute_measures(t):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_measures_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [*ODD, "a b c a b c", "a a a a", "x\nx\n \nx\n", "\x0b\x0c#\n#\n", "a\x0bb c d"] + ["".join(rng.choices(["a", "b", " ", "\n", "c ", "# "], k=rng.randint(0, 80))) for _ in range(60)]
    docs = spark.createDataFrame([(i, "s", t, 1) for i, t in enumerate(texts)], "doc_id long, source string, text string, n_words long")
    for r in quality.measures(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_measures(texts[r["doc_id"]]), texts[r["doc_id"]][:50]


def judged_by_hosts(spark, rows):
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string")
    with Scratch(spark) as scratch:
        got = {r["doc_id"]: r for r in quality.judge(docs, scratch).collect()}
        hosts = {r["host"]: r for r in quality.host_verdicts(quality.failures(quality.measures(docs))).collect()}
    assert len(got) == len(rows)
    return got, hosts


def test_quality_verdicts_by_host(spark):
    rng = random.Random(9)

    def repeated(lines):
        """A text of 10 lines of which so many repeat the first."""
        own = [f"{pseudo(rng, 12)} {rng.random()}" for _ in range(10 - lines)]
        return "\n".join([*own, *[own[0]] * lines])

    good = [pseudo(rng, 80) for _ in range(400)]
    strict, usual = repeated(4), repeated(7)
    lax = " ".join(w if i % 4 else w + "$" for i, w in enumerate(good[0].split()))  # a quarter of a symbol a word, limit 0.2
    rows = [("sound", t) for t in good[:300]] + [("junk", repeated(4)) for _ in range(60)] + [("junk", t) for t in good[300:310]]
    rows += [("mixed", t if i % 8 else t.replace(" ", "$ ")) for i, t in enumerate(good[310:390])]
    at = len(rows)
    rows += [("sound", strict), ("junk", strict), ("sound", usual), ("junk", usual), ("sound", lax), ("mixed", lax), (None, lax), (None, good[0]), ("sound", None), ("sound", "short")]
    got, hosts = judged_by_hosts(spark, rows)
    assert hosts["junk"]["allowed_dup_lines"] < 0.6 and hosts["sound"]["allowed_dup_lines"] == quality.RANGE
    assert hosts["mixed"]["allowed_symbols"] < 0.8 < hosts["sound"]["allowed_symbols"]
    assert all(got[i]["kept"] for i in range(300)) and all(got[i]["kept"] for i in range(360, 370))  # a clean text on a bad host stays
    assert not any(got[i]["kept"] for i in range(300, 360))  # what is usual there is no accident
    kept = [got[i]["kept"] for i in range(at, len(rows))]
    # a few repeated lines, or more symbols than the rule has it, are forgiven where they are rare
    assert kept[:2] == [True, False] and kept[3] is False and kept[4:6] == [True, False] and kept[7:] == [True, False, False]
    # without the hosts the same texts are judged alike
    alone, _ = judged_by_hosts(spark, [("one", t) for _, t in rows])
    assert {i for i in got if got[i]["kept"] != alone[i]["kept"]} and alone[at]["kept"] == alone[at + 1]["kept"] and alone[at + 4]["kept"] == alone[at + 5]["kept"]
    with Scratch(spark) as scratch:
        assert quality.judge(empty_docs(spark), scratch).count() == 0


def test_prior_strength_by_moments():
    rng = np.random.default_rng(3)
    for strength in (5.0, 60.0):
        n = rng.integers(20, 4000, 3000).astype(float)
        fails = rng.binomial(n.astype(int), rng.beta(0.1 * strength, 0.9 * strength, len(n))).astype(float)
        m, s = quality.prior(len(n), n.sum(), (n * n).sum(), fails.sum(), (fails**2 / n).sum())
        assert abs(m - 0.1) < 0.02 and 0.75 * strength < s + 1 < 1.3 * (strength + 1)
    fails = rng.binomial(50, 0.1, 200).astype(float)  # hosts that do not differ
    assert quality.prior(200, 10_000.0, 200 * 2500.0, fails.sum(), (fails**2 / 50).sum())[1] > 100
    assert quality.prior(0, 0.0, 0.0, 0.0, 0.0) == (0.0, quality.MOST_STRENGTH)


# ---- language


def test_forward_sums_all_segmentations():
    model = langid.Unigrams(["▁", "▁a", "a", "b", "ab", "▁ab", "aba"])
    counts = np.array([[3.0, 1.0], [1.0, 4.0]])
    words = ["aba", "bab"]
    model.fit(words, counts, rounds=2)
    p = {x: model.p[i] / langid._SCALE ** len(x) for i, x in enumerate(model.pieces)}

    def total(rest):
        if not rest:
            return np.ones(2)
        out = sum((p[rest[:k]] * total(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in p), np.zeros(2))
        return out if rest[0] in p else out + langid.UNKNOWN * total(rest[1:])

    for w in [*words, "abc", "c", "aaab"]:
        assert np.allclose(model.score([w])[0], np.log(total("▁" + w)), atol=1e-9)
        assert np.allclose(langid.Runs([w], model.table, model.lengths).total(model.logp)[0], np.log(total("▁" + w)), atol=1e-9)


def all_cuts(word, pieces):
    """Every way to cut a word into pieces; a letter without a piece of its own stands alone."""
    if not word:
        return [[]]
    heads = [word[:k] for k in range(1, len(word) + 1) if word[:k] in pieces] + ([word[0]] if word[0] not in pieces else [])
    return [[h, *rest] for h in heads for rest in all_cuts(word[len(h) :], pieces)]


def test_expectation_maximisation_equals_brute_force(monkeypatch):
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "aba"]
    words, counts = ["aba", "bab", "ab", "acab"], np.array([[3.0, 1.0], [1.0, 4.0], [2.0, 0.0], [1.0, 1.0]])
    p = {x: np.full(2, 1 / len(pieces)) for x in pieces}
    for _ in range(2):
        uses = {x: np.zeros(2) for x in pieces}
        for w, n in zip(words, counts, strict=True):
            cuts = all_cuts("▁" + w, p)
            weights = np.array([np.prod([p.get(x, np.full(2, langid.UNKNOWN)) for x in cut], axis=0) for cut in cuts])
            for cut, share in zip(cuts, weights / weights.sum(axis=0), strict=True):
                for x in cut:
                    if x in uses:
                        uses[x] += share * n
        total = sum(uses.values())
        pooled = {x: u.sum() + 0.01 for x, u in uses.items()}
        p = {x: (1 - langid.POOLED) * u / total + langid.POOLED * pooled[x] / sum(pooled.values()) for x, u in uses.items()}
    for longest in (48, 1):  # by products, and by logarithms
        monkeypatch.setattr(langid, "LONGEST", longest)
        model = langid.Unigrams(pieces)
        model.fit(words, counts, rounds=2)
        assert np.allclose(np.exp(model.logp[:-2]), [p[x] for x in pieces])


def test_long_runs_are_summed_whole(monkeypatch):
    rng = random.Random(19)
    model = langid.Unigrams(langid.vocabulary(PIECE))
    learnt = sorted({*pseudo(rng, 300).split(), "eau"})
    model.fit(learnt, np.array([[1.0 + i % 2, 2.0] for i in range(len(learnt))]), rounds=1)
    runs = ["".join(rng.choices(["th", "ing", "sch", "é", "中"], k=n)) for n in (10, 20, 40, 200, 3)]
    p = {x: model.logp[i] for i, x in enumerate(model.pieces)}
    longest = max(map(len, p))

    def brute(word):
        at = [np.zeros(2)]
        for e in range(1, len(word) + 1):
            found = [at[e - k] + p[word[e - k : e]] for k in range(1, min(e, longest) + 1) if word[e - k : e] in p]
            found += [] if word[e - 1] in p else [at[e - 1] + np.log(langid.UNKNOWN)]
            at.append(np.logaddexp.reduce(found, axis=0))
        return at[-1]

    assert np.allclose(model.score(runs), [brute("▁" + w) for w in runs], atol=1e-6)
    monkeypatch.setattr(langid, "CELLS", 50)
    assert np.allclose(model.score(runs), [brute("▁" + w) for w in runs], atol=1e-6)


def test_language_of_a_compound_without_spaces(spark):
    docs, n = lang_docs(spark)
    model, langs = langid.train(docs, PIECE)
    rng = random.Random(20)
    for lang in ("de", "fr", "en"):
        text = "".join(pseudo(rng, 60, lang).split())
        assert len(text) > langid.LONGEST and langid.Identifier(model, langs).predict([text])[0] == [lang]
    # the fit over partitions is the fit in one place
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect() if r["doc_id"] is not None and r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    counts = defaultdict(lambda: np.zeros(3))
    for _, lang, text in rows:
        for w in langid.letters(text):
            counts[w][langs.index(lang)] += 1
    one = langid.Unigrams(langid.vocabulary(PIECE))
    one.fit(list(counts), np.array(list(counts.values())))
    assert np.allclose(one.p, model.p, atol=1e-9)


def lang_docs(spark, n=240):
    rng = random.Random(10)
    rows = [(i, pseudo(rng, 40, lang), lang, "s", 1) for i in range(n) for lang in [("en", "de", "fr")[i % 3]]]
    return spark.createDataFrame(rows + [(n, None, "en", "s", 1), (n + 1, "12 ² !", "en", "s", 1), (None, pseudo(rng, 40, "de"), "en", "s", 1), (n + 2, pseudo(rng, 40, "fr"), None, "s", 1), (n + 3, "the" * 200, "en", "s", 1)], DOCS), n


def test_language_of_held_out_documents(spark):
    docs, n = lang_docs(spark)
    got = {r["doc_id"]: r for r in langid.identify(docs, PIECE).collect()}
    truth = {i: ("en", "de", "fr")[i % 3] for i in range(n)}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in truth)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    assert (got[n]["lang_pred"], got[n]["score"]) == ("und", 0.0) and got[n + 1]["lang_pred"] == "und"
    assert got[None]["lang_pred"] == "de" and not got[None]["held_out"] and got[n + 2]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(empty_docs(spark), PIECE).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), PIECE).collect()} == {"und"}


# ---- toxicity


def brute_kneser_ney(texts, labelled):
    """p(c, x, h) for class c, a character and all characters before it in its word, and the words' log-likelihood difference."""
    order, low, d = toxicity.ORDER, toxicity.SHARED, toxicity.DISCOUNT
    longer = {w[a : a + k + 1] for t in texts for w in bounded(t) for k in range(1, low) for a in range(len(w) - k)}
    kinds, total, types = Counter(g[1:] for g in longer), Counter(), Counter()
    for g, n in kinds.items():
        total[g[:-1]] += n
        types[g[:-1]] += 1
    seen, after = [Counter(), Counter()], [defaultdict(list), defaultdict(list)]
    for t, c in labelled:
        for w in bounded(t):
            seen[c].update(w[max(0, j - order) : j] for j in range(2, len(w) + 1))
    for c in (0, 1):
        for g, n in seen[c].items():
            after[c][g[:-1]].append(n)
    off = lambda n: n if n < 2 else d

    def shared(x, h):
        p = 1 / 256
        for k in range(min(low - 1, len(h))):  # the last k characters are the context
            c = h[len(h) - k :]
            if total[c]:
                p = max(kinds[c + x] - d, 0) / total[c] + d * types[c] / total[c] * p
        return p

    def p(c, x, h):
        h = h[-(order - 1) :]
        counts = after[c][h]
        if not counts:
            return shared(x, h)
        return (seen[c][h + x] - off(seen[c][h + x])) / sum(counts) + sum(map(off, counts)) / sum(counts) * shared(x, h)

    return p


def bounded(text):
    return [f"\x02{w}\x03" for w in toxicity._WORD.findall((text or "").lower())]


def test_kneser_ney_equals_brute_force_and_sums_to_one(spark):
    rng = random.Random(17)
    syllables = ["ab", "ba", "ca", "dd", "é"]
    texts = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 6))) for _ in range(12)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 3 % 2) for i in range(25)], "doc_id long, quality int, toxic int")
    learnt = [(texts[i], i % 3 % 2) for i in range(25) if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    model = toxicity.train(docs, labels)[0]
    p = brute_kneser_ney(texts, learnt)
    alphabet = [*"abcdé\x03", *map(chr, range(0x1000, 0x1000 + 250))]
    for h in ("\x02", "\x02ab", "\x02abba", "\x02ddddab", "\x02zz", "\x02abcabaab"):
        for c in (0, 1):
            assert abs(sum(p(c, x, h) for x in alphabet) - 1) < 1e-9, h
    words = sorted({w for t in texts for w in t.split()})[:60] + ["zzz", "abzz", "é"]
    want = [sum(np.log(p(1, w[j], w[:j])) - np.log(p(0, w[j], w[:j])) for j in range(1, len(w))) for w in (f"\x02{x}\x03" for x in words)]
    assert np.allclose(model.llr(words), want, atol=1e-4)


def test_expressions_of_two_words(spark):
    """A pair of ordinary words that only toxic documents have next to each other."""
    rng = random.Random(18)
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(["get", "lost", "now", "the", "way", "of", "it"], k=30)
        words = [w for k, w in enumerate(words) if not (w == "lost" and k and words[k - 1] == "get")]
        if i % 4 == 0:
            words[10:10] = ["get", "lost"]
        else:
            words = [w if (v, w) != ("get", "lost") else "it" for v, w in zip(["", *words], words, strict=False)]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    model = toxicity.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))[0]
    scorer = toxicity.Scorer(model)
    one, two = scorer.evidence(["now get lost now", "now lost get now"])
    assert one > two + 1
    # the pair's probability, from the documents that have it
    learnt = [(t, i) for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    after = [Counter(), Counter()]
    for t, i in learnt:
        after[i % 4 == 0].update({w for v, w in zip(t.split(), t.split()[1:], strict=False) if v == "get"})
    p = brute_kneser_ney([t for _, t, *_ in rows], [(t, int(i % 4 == 0)) for t, i in learnt])
    spelt = [np.prod([p(c, w[j], w[:j]) for w in ["\x02lost\x03"] for j in range(1, len(w))]) for c in (0, 1)]
    d = toxicity.PAIR_DISCOUNT
    each = [max(n["lost"] - d, 0) / sum(n.values()) + sum(min(k, d) for k in n.values()) / sum(n.values()) * spelt[c] for c, n in enumerate(after)]
    ids = np.array([model.ids["get"], model.ids["lost"]])
    assert np.allclose(model.in_sequence(ids, np.zeros(2))[1], np.log(each[1] / each[0]), atol=1e-4)


def toxic_tables(spark, n=900):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        words, toxic = pseudo(rng, rng.choice([5, 60, 400])).split(), int(i % 6 == 0)
        for _ in range(rng.randint(1, 4) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["zorgul", "zorgum", "blatz", "zorgist"]))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, toxic))
    odd = [(n + k, t, "en", "s", 1) for k, t in enumerate(ODD)] + [(None, "zorgul blatz", None, None, None)]
    return spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame([*labels, (0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), n


def test_toxicity_of_held_out_documents(spark):
    docs, labels, n = toxic_tables(spark)
    got = {r["doc_id"]: r["_score"] for r in toxicity.scores(docs, toxicity.train(docs, labels), ["doc_id"]).collect()}
    held = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 6 == 0) for i in held]) > 0.97
    assert got[None] > 0.5 and got[n] < 0.5 and got[n + 1] == got[n]
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == n + len(ODD) + 1


def test_toxicity_without_both_classes(spark):
    docs, labels, _ = toxic_tables(spark, 60)
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r["_score"] for r in toxicity.scores(docs, None, ["doc_id"]).collect()} == {0.0}
    assert toxicity.scores(empty_docs(spark), None, ["doc_id"]).count() == 0


def test_shared_counts_cover_all_texts(spark):
    """Continuation counts by brute force over every document, most of which have no label."""
    texts = ["abab cab", "Bad abba", None, "", "zażółć gęślą", "abab abab", "cabab bad"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    with Scratch(spark) as scratch:
        got = sorted((r["n"], r["total"], r["types"]) for r in toxicity.lower_orders(docs, scratch).collect())
    words = {f"\x02{w}\x03" for t in texts for w in (t or "").lower().split()}
    longer = {w[a : a + k + 1] for w in words for k in range(1, toxicity.SHARED) for a in range(len(w) - k)}
    n = Counter(g[1:] for g in longer)
    total, types = Counter(), Counter()
    for g, k in n.items():
        total[g[:-1]] += k
        types[g[:-1]] += 1
    assert got == sorted((k, total[g[:-1]], types[g[:-1]]) for g, k in n.items())


def test_fit_uses_counts_of_unlabelled_texts(spark):
    docs, labels, n = toxic_tables(spark, 120)
    more = spark.createDataFrame([(10_000 + i, "zorgulon blatzing thering zorg", "en", "s", 1) for i in range(3)], DOCS)
    one, two = toxicity.train(docs, labels)[0], toxicity.train(docs.unionByName(more), labels)[0]
    assert len(one.gram_llr) == len(two.gram_llr) and not np.array_equal(one.gram_llr, two.gram_llr)


def test_labels_are_drawn_from_every_language(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 40 == 0, "xx").otherwise("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    with Scratch(spark) as scratch:
        got = toxicity.labelled(docs, labels, scratch, 200).where("fold < 4").collect()
    drawn = Counter((r["toxic"], r["doc_id"] % 40 == 0) for r in got)
    kept = Counter((int(i % 3 == 0), i % 40 == 0) for i in range(4000) if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3))
    for toxic in (0, 1):
        assert drawn[toxic, True] == kept[toxic, True] and 100 < drawn[toxic, False] + drawn[toxic, True] < 300


# ---- packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), min_size=1, max_size=20))
def test_plan_equals_best_fit_decreasing(histogram):
    import bisect

    bins, made = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            k = bisect.bisect_left(bins, length)
            room = bins.pop(k) if k < len(bins) else 64
            made += room == 64
            if room - length:
                bisect.insort(bins, room - length)
    filled, ranks = defaultdict(list), defaultdict(list)
    for length, rank, number, first, offset in packing.plan(histogram, 64):
        ranks[length] += range(rank, rank + number)
        for j in range(number):
            filled[first + j].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(filled) == made


def test_packed_pieces(spark):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(BYTE), random.Random(12)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, pseudo(rng, rng.randint(0, 900))) for i in range(60)] + [(None, "x"), (100, "x"), (100, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length long")
    got = packing.pack(docs, BYTE).collect()
    want = Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1.02 * sum(r["length"] for r in got) / 1024 + 1
    assert packing.pack(empty_docs(spark), BYTE).count() == 0


@pytest.mark.parametrize("run", [" ", "\t", "\n", " \t\r\n"])
def test_long_blanks_are_encoded_like_the_library(run):
    encoder = packing.Encoder(BYTE)
    for n in (1000, 1_000_000, 2_000_000):
        text = "a b" + run * (n // len(run)) + "c d"
        assert encoder.encode([text]) == [np.array(encoder.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()]


def test_repeated_rows_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKS", 16)
    docs = spark.createDataFrame([(None, "the same")] * 5000 + [(1, "x y z " * 3000)] * 3, "doc_id long, text string")
    rows = packing.pieces(docs, BYTE)
    by = Counter(r["spread"] % 64 for r in rows.where("doc_id is null").collect())
    assert len(by) == 64 and max(by.values()) < 4 * 5000 / 64
    got = packing.pack(docs, BYTE).collect()
    at = {(r["sequence_id"], r["offset"]) for r in got}
    assert len(at) == len(got) == rows.count()


# ---- all of them


def test_extra_columns_with_clashing_names(spark):
    rng = random.Random(16)
    names = ["n_bytes", "bits", "shard", "key", "sig", "words", "place", "seed", "item", "shift", "evidence", "score", "held_out", "length", "piece", "rank", "bucket", "n_words", "base_failed", "kept", "host", "group", "n", "own", "turn", "pieces", "formatted"]
    docs = spark.createDataFrame([(i, pseudo(rng, 60), "en", f"s{i % 2}", 1, *["mine"] * len(names)) for i in range(8)], DOCS + "".join(f", `{n}` string" for n in names))
    bench = spark.createDataFrame([(1, pseudo(rng, 20), "mine", "mine")], "item_id long, text string, words string, doc_id string")
    turns = spark.createDataFrame([(1, 0, "user", "x", "mine", "mine")], "conv_id long, turn long, role string, text string, loss string, formatted string")
    labels = spark.createDataFrame([(i, 1, i % 2, "mine") for i in range(8)], "doc_id long, quality int, toxic int, text string")
    with Scratch(spark) as scratch:
        assert neardup.near_duplicates(docs, scratch).count() == 8
        assert decontaminate.verdicts(docs, decontaminate.overlaps(docs, bench, scratch), scratch).count() == 8
        judged = quality.judge(docs, scratch)
        assert judged.count() == 8 and judged.where("host = 'mine' and rank = 'mine'").count() == 8
    assert chat.digests(chat.format_conversations(turns)).count() == 1
    assert sharding.shard(docs, 1000).count() == 8
    assert bpe_count.count_tokens(docs, WORD).count() == 8
    assert langid.identify(docs, PIECE).count() == 8
    assert toxicity.scores(docs, toxicity.train(docs, labels), ["doc_id", "score"]).count() == 8
    assert packing.pack(docs, BYTE).count() == 8
