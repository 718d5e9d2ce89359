"""The subpackage's queries on the smallest tables, against their SQL where there is some, and the pipeline against its stages."""

from __future__ import annotations

import importlib
import math
import os
import zlib

import duckdb
import pytest

DATA = os.environ.get("CORPUSLOOM_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
queries = importlib.import_module("corpusloom.llm.queries")
oracles = importlib.import_module("corpusloom.llm.oracles")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int | float):
        return f"{value:.9g}"
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'").fetchall()
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = df.collect()
    assert got
    if name in oracles.SQL:
        cur = duck.execute(oracles.SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, [tuple(r) for r in got]) == rows(names, cur.fetchall())


def test_registry(spark):
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 11)} == {name.split("_")[0] + "_" for name in entry.queries() if name.startswith("op")}
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_pipeline_equals_its_operators(spark, duck):
    """Every stage's decisions against the operator's own query, each over what the stage before kept."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    from corpusloom.llm import decontaminate, neardup, quality
    from corpusloom.plans.scratch import Scratch

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("group", F.lit(1)).withColumn("n_words", F.lit("mine"))
    columns = docs.columns
    toxic = {r["doc_id"] for r in queries.op9_toxicity(spark, DATA).where("predicted = 1").collect()}
    with Scratch(spark) as scratch:
        stage = dict(corpus_pipeline.STAGES)
        one = scratch.table(stage["toxicity"](spark, docs, DATA))
        assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in docs.collect()} - toxic
        two = scratch.table(stage["quality"](spark, one, DATA))
        kept = {r["doc_id"] for r in quality.judge(one.drop("n_words"), scratch).where("kept").collect()}
        assert two.columns == columns and {r["doc_id"] for r in two.collect()} == kept
        three = scratch.table(stage["near_duplicates"](spark, two, DATA))
        groups = {r["component_id"] for r in neardup.near_duplicates(two.select("doc_id", "text"), scratch).collect()}
        assert three.columns == columns and {r["doc_id"] for r in three.collect()} == groups
        four = scratch.table(stage["decontamination"](spark, three, DATA))
        bad = {r["doc_id"] for r in decontaminate.overlaps(three, spark.read.parquet(f"{DATA}/benchmark.parquet"), scratch).collect()}
        assert four.columns == columns and {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in three.collect()} - bad
        five = stage["packing"](spark, four, DATA)
        assert {r["doc_id"] for r in five.select("doc_id").distinct().collect()} == {r["doc_id"] for r in four.collect()}


def test_pipeline_keeps_one_of_exact_repeats(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1), (3, "", "en", "s", 1), (4, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, DATA).collect()
    assert sorted(str(r["doc_id"]) for r in got) in (["1", "3", "4"], ["3", "4", "None"])


def test_held_out_scores(spark, duck):
    """Accuracy on rows that were not learnt from."""
    langs = duck.execute("SELECT doc_id, lang FROM documents").fetchall()
    truth = dict(langs)
    got = [r for r in queries.op8_language_id(spark, DATA).where("held_out").collect()]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.9 * len(got)


def written_tables(spark, folder):
    """Documents of every kind that a stage decides on, with labels and benchmark."""
    import random

    from test_llm_operators import pseudo

    rng = random.Random(31)
    rows, labels = [], []

    def add(text, source=None, toxic=None):
        rows.append((len(rows), text, rng.choice(["en", "de"]), source or f"s{rng.randint(0, 3)}", 1))
        if toxic is not None:
            labels.append((len(rows) - 1, 1, toxic))

    for i in range(240):  # learnt from
        words = pseudo(rng, rng.choice([60, 90, 150])).split()
        for _ in range(4 if i % 5 == 0 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zorgul", "blatzen", "zorgist"]))
        add(" ".join(words), toxic=int(i % 5 == 0))
    items = {i: " ".join(pseudo(rng, 1) + str(rng.randint(0, 99)) for _ in range(n)) for i, n in enumerate([14, 25, 40, 5])}
    for i in range(12):
        add(pseudo(rng, 70) + " " + items[i % 4] + " " + pseudo(rng, 40))
    for n in (70, 200, 900):
        base = pseudo(rng, n).split()
        for k in range(4):
            add(" ".join([*base[:-2], *["zz"] * (k % 2), *base[-2:]]))
    for i in range(8):
        add(" ".join(w + "$" * (i % 4) for w in pseudo(rng, 80).split()))
        add("\n".join([f"{pseudo(rng, 20)} {i}"] * (2 + i % 4) + [pseudo(rng, 30) for _ in range(4)]), "junk")
    for text in (None, "", "short", " \t\n", "w " * 3000, "the " + "7" * 300, pseudo(rng, 3000)):
        add(text)
    rows.append(rows[250])  # a repeated row, and one without an id
    rows.append((None, *rows[3][1:]))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, labels, items


def test_pipeline_run_equals_brute_force(spark, tmp_path):
    """All of run() against plain Python, with the toxicity model's own numbers (which another test holds against brute force)."""
    from collections import Counter, defaultdict

    import corpus_pipeline
    import numpy as np
    from test_llm_operators import BYTE, brute_measures, brute_overlaps, exact_components
    from tokenizers import Tokenizer

    from corpusloom.llm import quality, toxicity

    rows, labels, items = written_tables(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model, slope, start = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))

    def evidence(text):
        words = toxicity._WORD.findall((text or "").lower())
        alone = model.llr(words)
        value = [model.in_sequence(np.array([model.ids.get(v, 0), model.ids.get(w, 0)]), alone[k : k + 2])[1] if k >= 0 else alone[0] for k, (v, w) in enumerate(zip([None, *words], words, strict=False), -1)]
        return sum(sorted(value)[-toxicity.BEST :]) / toxicity.BEST

    rows = [r for r in rows if slope * evidence(r[1]) + start < 0]
    assert {i for i, _, toxic in labels if toxic} - {r[0] for r in rows}

    measured, hosts = [], defaultdict(lambda: [0] * 5)
    for r in rows:
        n, chars, symbols, dup, repeat = brute_measures(r[1])
        lines = [x for x in (r[1] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        mean = chars / max(n, 1)
        far = [symbols / max(n, 1) / 0.2, dup / max(len(lines), 1) / 0.6, 0.0 if not n else max(5 / mean, mean / 7) / 4, repeat / max(n, 1) / 0.4]
        measured.append((n < 50 or 100 * repeat > 50 * n, far))
        hosts[r[3]][0] += 1
        for k, x in enumerate(far):
            hosts[r[3]][k + 1] += x > 0.5
    allowed = defaultdict(list)
    for k in range(4):
        n, f = np.array([h[0] for h in hosts.values()], float), np.array([h[k + 1] for h in hosts.values()], float)
        m, s = quality.prior(len(n), n.sum(), (n * n).sum(), f.sum(), (f * f / n).sum())
        for host, rate in zip(hosts, (f + m * s) / (n + s), strict=True):
            allowed[host].append(min(2.0, max(0.5, m / rate)) if rate > 0 else 1.0)
    kept = [r for r, (base, far) in zip(rows, measured, strict=True) if not base and all(x <= a for x, a in zip(far, allowed[r[3]], strict=True))]
    assert len(kept) < sum(not base for base, _ in measured)  # the hosts' verdicts decide

    groups = exact_components(dict(enumerate(r[1] for r in kept)))
    alike = defaultdict(list)
    for k, r in enumerate(kept):
        alike[groups[k][1]].append(r)
    sizes = Counter(len(g) for g in alike.values())
    assert len(sizes) > 1

    library = Tokenizer.from_file(BYTE)
    want = {}
    for group in alike.values():
        choices = []
        for r in group:
            if not brute_overlaps({0: r[1]}, items):
                n = len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1
                choices.append((r[0], n))
            else:
                choices.append(None)
        want[id(group)] = choices
    made = defaultdict(int)
    for r in got:
        made[r["doc_id"]] += r["length"]
    made = sorted(made.items(), key=str)
    # one of every group, the one with the least id (null ids last resort), unless it holds a benchmark item
    expected = []
    for group, choices in zip(alike.values(), want.values(), strict=True):
        first = min(range(len(group)), key=lambda k: (group[k][0] is not None, group[k][0] or 0))
        if choices[first]:
            expected.append(choices[first])
    assert made == sorted(expected, key=str)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
