"""Invariants and hand-made cases of the library outside the optional subpackage."""

from __future__ import annotations

import gzip
import hashlib
import json
import math
import random
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import catalog
from corpusloom.functions import arrays, draws, text, tokenizers
from corpusloom.operators import align, dedup, experiments, layout, minhash, scoring, statistics, tokens, vectors
from corpusloom.operators.order import hash_ranked, interval_join, numbered, running_sum, value_ranked
from corpusloom.plans.scratch import Scratch
from corpusloom.sources import columnar, jsonl, sinks
from corpusloom.streaming import state

SCHEMA = T.StructType().add("text", "string").add("content", "string").add("original_text", "string")


def test_jsonl_numbers_lines_before_dropping(spark, tmp_path):
    lines = ['{"text": "a"}', "not json", "", '{"content": "b"}', '{"other": 1}', '{"original_text": "c"}']
    (tmp_path / "x.chunk.0.jsonl").write_text("\n".join(lines))  # the last line has no line feed
    with gzip.open(tmp_path / "x.chunk.1.jsonl.gz", "wt") as f:
        f.write("\n".join(lines[:1]) + "\n")
    got = jsonl.valid(jsonl.parsed(jsonl.numbered_lines(spark, str(tmp_path)), SCHEMA)).withColumn("t", jsonl.text_of("record", SCHEMA))
    rows = sorted((r["file"][-2:], r["line_no"], r["t"]) for r in got.collect())
    assert rows == [("gz", 0, "a"), ("nl", 0, "a"), ("nl", 3, "b"), ("nl", 4, ""), ("nl", 5, "c")]


def test_jsonl_numbers_survive_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"text": str(i)}) + "\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = jsonl.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["line_no"], json.loads(r["value"])["text"]) for r in rows) == [(i, str(i)) for i in range(5000)]


def test_strict_reader_stops(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "a"}\n{oops\n')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        jsonl.parsed(jsonl.numbered_lines(spark, str(tmp_path)), SCHEMA, strict=True).collect()


def test_chunks_are_checked():
    assert jsonl.checked_chunks(["b", "a", "c"], 2) == ["a", "b"]
    assert jsonl.checked_chunks(["b", "a"], 4) == ["a", "b"]
    with pytest.raises(ValueError):
        jsonl.checked_chunks(["a", "b", "c"], 4)
    with pytest.raises(ValueError):
        layout.quota(F.lit(0), 3, 4)


def test_round_trip_of_layout(spark, tmp_path):
    df = spark.range(103).select(F.col("id").alias("row"), F.col("id").cast("string").alias("text"))
    sinks.write_round_robin(df, str(tmp_path / "o"), "row", 16, 3)
    back = spark.read.json(str(tmp_path / "o"))
    assert back.where("split = 'val'").count() == 3
    assert {r["row"] for r in back.collect()} == set(range(103))
    assert all((r["row"] - 3) % 16 == r["chunk"] for r in back.where("split = 'train'").collect())
    dealt = sinks.with_chunks(df, "row", 16)
    assert dealt.where(layout.from_round_robin(F.col("chunk"), F.col("line"), 16) != F.col("row")).count() == 0


def test_two_level_sums_equal_sequential_ones(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i * 7000, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, n long")
    got = {(r["g"], r["i"]): (r["start"], r["k"]) for r in numbered(running_sum(df, "n", "i", "start", by=["g"]), "i", "k", by=["g"]).collect()}
    sums, seen = {}, {}
    for g, i, n in rows:
        assert got[g, i] == (sums.get(g, 0), seen.get(g, 0))
        sums[g], seen[g] = sums.get(g, 0) + n, seen.get(g, 0) + 1
    ranks = [r["k"] for r in hash_ranked(df, F.md5(F.col("i").cast("string")), "k", tie="i").orderBy(F.md5(F.col("i").cast("string"))).collect()]
    assert ranks == list(range(300))
    byvalue = [(r["k"], r["k_sum"]) for r in value_ranked(df, "n", "i", "k", amount="n").orderBy("n", "i").collect()]
    assert byvalue == list(zip(range(1, 301), np.cumsum(sorted(r[2] for r in rows)).tolist(), strict=True))


def test_interval_join_equals_nested_loop(spark):
    rng = random.Random(2)
    spans = [(a, a + rng.randint(0, 50)) for a in (rng.randint(0, 500) for _ in range(40))]
    points = [rng.randint(0, 560) for _ in range(100)]
    got = interval_join(spark.createDataFrame([(p,) for p in points], "p long"), spark.createDataFrame(spans, "a long, b long"), "p", "a", "b", 16)
    assert sorted(map(tuple, got.collect())) == sorted((p, a, b) for p in points for a, b in spans if a <= p < b)


def test_every_id_has_its_file(spark, tmp_path):
    ids = [0, 96, 97, 97, 9_699_999, 9_700_000, 12_345_678, 2**53 + 1, 2**60 + 5, -1]
    spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["row_to_file"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((i, i // 97 * 97, i // 97 * 97 + 97) for i in ids)


def test_texts(spark):
    df = spark.createDataFrame([("x ", ["INFEASIBLE ", "c1", None, "c2"]), ("y\n", ["UNFEASIBLE"])], "t string, c array<string>")
    got = df.select(text.with_contexts(F.col("t"), F.col("c"), "append", "|").alias("a"), text.with_contexts(F.col("t"), F.col("c"), "prepend", "|").alias("p"), text.context_boundary(F.col("t"), F.col("c"), "|").alias("b"), text.with_newline(F.col("t")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("x |c1|c2", "c1|c2|x ", 6, "x \n"), ("y\n", "y\n", 0, "y\n")]
    with pytest.raises(ValueError):
        text.with_contexts(F.col("t"), F.col("c"), "around")
    md = spark.createDataFrame([("# H\n- a *b* **c**\n2. d\n```py\ne\n```",)], "t string").select(text.stripped_markup(F.col("t"))).first()[0]
    assert md == "H\na b c\nd\n\ne\n"
    row = spark.createDataFrame([("aé",), ("",), (None,)], "t string").select(text.byte_tokens(F.col("t"))).collect()
    assert [r[0] for r in row] == [[256, 97, 195, 169, 257], [256, 257], [256, 257]]


def test_arrays(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1, 2, 257]), ([0.0, 0.0], [1])], "v array<double>, t array<int>")
    got = df.select(arrays.norm(F.col("v")), arrays.normalized(F.col("v")), arrays.without_trailing(F.col("t"), 257), arrays.last_n(F.col("t"), 2)).collect()
    assert [tuple(r) for r in got] == [(5.0, [0.6, 0.8], [1, 2], [2, 257]), (0.0, [0.0, 0.0], [1], [1])]


def test_independent_and_greedy_keep_differ(spark):
    # A and B share a text, B and C an id: independently B is dropped by A and C by B; greedily C stays, as B was dropped
    df = spark.createDataFrame([(0, "t", "i"), (1, "t", "j"), (2, "u", "j")], "row long, text string, id string")
    kept = dedup.keep_first(df, "row", {"text": F.col("text"), "id": F.col("id")})
    assert {r["row"]: r["keep"] for r in kept.collect()} == {0: True, 1: False, 2: False}
    edges = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    with Scratch(spark) as scratch:
        greedy = {r["node"]: r["kept"] for r in dedup.greedy_keep(df.select(F.col("row").alias("node")), edges, scratch).collect()}
    assert greedy == {0: True, 1: False, 2: True}


def test_greedy_keep_equals_the_fold(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}
    kept: dict[int, bool] = {}
    for n in range(60):
        kept[n] = not any(kept.get(a) for a, b in edges if b == n)
    with Scratch(spark) as scratch:
        got = dedup.greedy_keep(spark.range(60).select(F.col("id").alias("node")), spark.createDataFrame(sorted(edges), "a long, b long"), scratch)
        assert {r["node"]: r["kept"] for r in got.collect()} == kept


def test_null_keys_are_equal_in_keep_first(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, "")], "row long, text string")
    assert {r["row"]: r["keep"] for r in dedup.keep_first(df, "row", {"t": F.col("text")}).collect()} == {0: True, 1: False, 2: True}


def test_alignment_states(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row long, id string")
    b = spark.createDataFrame([(0, "a", 1), (1, "x", 2), (3, "d", 3)], "row long, id string, v long")
    assert {r["row"]: r["state"] for r in align.aligned(a, b, "row", "id").collect()} == {0: "aligned", 1: "mismatch", 2: "missing", 3: "extra"}
    with pytest.raises(Exception, match="row"):
        align.aligned(a, b, "row", "id", strict=True).collect()


def test_packing_invariants(spark):
    rng = random.Random(4)
    docs, at = [], 0
    for i, n in enumerate([1, 40, 3, 8, 8, 1, 25] + [rng.randint(0, 12) for _ in range(20)]):
        docs.append((i, [i * 100 + k for k in range(n)], n, at))
        at += n
    stream = [t for d in docs for t in d[1]]
    df = spark.createDataFrame(docs, "row_id long, tokens array<int>, n_tokens long, start long")
    assert [r["start"] for r in tokens.with_offsets(df.drop("start")).orderBy("row_id").collect()] == [d[3] for d in docs]
    rows = tokens.packed(df, 8).orderBy("seq").collect()
    assert len(rows) == (len(stream) - 1) // 8
    for r in rows:
        assert r["inputs"] == stream[r["seq"] * 8 : r["seq"] * 8 + 8] and r["labels"] == stream[r["seq"] * 8 + 1 : r["seq"] * 8 + 9]
        inside = [d[3] - r["seq"] * 8 for d in docs if d[2] and 0 < d[3] - r["seq"] * 8 < 8]
        assert r["cu_seqlens"] == [0, *inside, 8]


def test_mixing_ratio_is_exact(spark):
    for a, b in ((1, 5), (1, 3), (2, 7)):
        rows = [(r["stream"], r["at"]) for r in tokens.interleaved(spark.range(200), "id", a, b).orderBy("id").collect()]
        assert all(sum(s == 2 for s, _ in rows[i : i + b]) == a for i in range(200 - b))
        assert [x for s, x in rows if s == 2] == list(range(sum(s == 2 for s, _ in rows))) and [x for s, x in rows if s == 1] == list(range(sum(s == 1 for s, _ in rows)))
    with pytest.raises(ValueError):
        tokens.mixed_sources(spark.range(3), "id", [("a", -1.0)], 1)


def test_windows_score_every_label_once(spark):
    df = spark.createDataFrame([(n, n) for n in (0, 1, 2, 8, 9, 10, 25)], "doc long, n_tokens long")
    rows = tokens.rolling_windows(df, 8).collect()
    for n in (2, 8, 9, 10, 25):
        labels = sorted(x for r in rows if r["doc"] == n for x in range(r["first_label"], r["first_label"] + r["scored"]))
        assert labels == list(range(1, n))
        assert all(r["first_label"] + r["scored"] - 1 - r["input_from"] <= 8 for r in rows if r["doc"] == n)
    assert not [r for r in rows if r["doc"] < 2]
    assert tokens.chunks(df, 8).where("doc = 0").count() == 1


def test_repeat_mode_reads_the_pool_each_pass(spark):
    df = spark.createDataFrame([(i, 7) for i in range(10)], "row_id long, n_tokens long")
    rows = tokens.repeated(df, 40, 3, 5).orderBy("start").collect()
    assert [r["start"] for r in rows][0] == 0 and rows[-1]["start"] + rows[-1]["n_tokens"] == 120
    orders = [tuple(r["row_id"] for r in rows if r["pass"] == p) for p in range(3)]
    assert all(sorted(o) == list(range(6)) for o in orders) and len(set(orders)) > 1


def test_next_fit_and_least_loaded():
    assert tokens.next_fit([5, 5, 1, 9, 20, 1], 10) == [0, 0, 1, 1, 2, 3]
    assert tokens.least_loaded([1, 9, 5, 5], 2) == [0, 0, 1, 1]


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 6)).round(2)
    m[10] = m[11]  # a tie
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int")
    with Scratch(spark) as scratch:
        rows = vectors.nearest(df.where("vec_id % 10 = 0"), df, 4, scratch).collect()
        sims = m @ m.T
        for q in range(0, 60, 10):
            best = sorted((i for i in range(60) if i != q), key=lambda i: (-round(sims[q, i], 9), i))[:4]
            assert [r["neighbour"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query"] == q] == best
        back = vectors.reverse_nearest(df.where("vec_id % 10 = 0"), df, scratch).where("scope = 'all'").collect()
        assert all(r["key_id"] == min(range(0, 60, 10), key=lambda k: (-round(sims[r["vec_id"], k], 9), k)) for r in back)
    unit = df.withColumn("embedding", F.array(*[F.when(F.col("vec_id") % 6 == k, 1.0).otherwise(0.0) for k in range(6)]))
    assert abs(vectors.vendi(unit)[0] - 6) < 1e-9


def test_experiments(spark):
    log = spark.createDataFrame([("r", 1, 2.0, 9), ("r", 1, 3.0, 8), ("r", 2, float("nan"), 7)], "run string, step long, loss double, line long")
    assert {r["step"]: r["loss"] for r in dedup.latest(log.where("step = 1"), ["run", "step"], [F.col("line")]).collect()} == {1: 2.0}
    bins = experiments.binned_means(log, ["run"], "step", "loss", "line", "line").collect()
    assert [(r["mean_loss"], r["n"]) for r in bins] == [(2.5, 2)]
    asof = experiments.schedule_at(spark.createDataFrame([(5, "a", 1.0), (9, "b", 2.0)], "step long, source string, weight double"), spark.createDataFrame([(4,), (5,), (20,)], "step long"))
    assert {r["asked"]: r["weights"] for r in asof.collect()} == {4: None, 5: {"a": 1.0}, 20: {"b": 2.0}}


def test_statistics_on_small_tables(spark):
    rows = [(float(x), 3.0 + 2.0 * x**-0.5) for x in range(1, 40)]
    e, a, b, rms = statistics.saturating_fit([x for x, _ in rows], [y for _, y in rows])
    assert abs(e - 3) < 0.02 and abs(b - 0.5) < 0.02 and rms < 1e-3 and abs(a - 2) < 0.02
    rng = random.Random(6)
    pts = [(i, rng.uniform(1, 100), rng.random()) for i in range(300)]
    got = {r["i"] for r in statistics.pareto(spark.createDataFrame(pts, "i long, c double, y double"), "c", "y", "i").collect()}
    assert got == {i for i, c, y in pts if not any(d <= c * 1.02 and z < y for _, d, z in pts)}


def test_pareto_of_repeated_ids_ties_and_odd_values(spark):
    rng = random.Random(8)
    inf, nan = float("inf"), float("nan")
    pts = [(rng.choice([None, 1, 2, 3]), rng.choice([rng.uniform(1, 3), 2.0, 2.04, 10.0 ** rng.randint(-300, 300)]), rng.choice([0.5, 0.25, rng.random()])) for _ in range(400)]
    pts += [(7, 1e-305, 2.0), (7, 1e-305, 2.0), (8, 1.01e-305, 2.0), (9, inf, 0.0), (None, inf, 0.0), (10, nan, -1.0), (11, 5.0, nan), (12, 5.0, None), (13, None, -2.0), (14, -1.0, -2.0)]
    key = lambda c: (1, 0.0) if math.isnan(c) else (0, math.log(c))
    real = [(i, key(c), c, y) for i, c, y in pts if c is not None and not c <= 0 and y is not None and not math.isnan(y)]
    reach = lambda k: (k[0], k[1] + 0.0198026272961797)
    want = sorted(repr((i, c, y)) for i, k, c, y in real if not any(o <= reach(k) and z < y for _, o, _, z in real))
    got = statistics.pareto(spark.createDataFrame(pts, "i long, c double, y double"), "c", "y", "i").collect()
    assert sorted(repr(tuple(r)) for r in got) == want and len(want) > 5
    with pytest.raises(ValueError):
        statistics.pareto(spark.range(1), "id", "id", "id", 1.0)


def test_pareto_of_many_rows_at_about_one_cost(spark):
    """200,000 rows that all reach each other: comparing them in pairs would take hours."""
    rows = spark.range(200_000).select("id", (F.lit(1000.0) + F.col("id") % 1000 / 100).alias("c"), (F.col("id") * 7919 % 199_999).cast("double").alias("y"))
    out = []
    worker = threading.Thread(target=lambda: out.extend(statistics.pareto(rows, "c", "y", "id").collect()), daemon=True)
    worker.start()
    worker.join(60)
    if worker.is_alive():
        spark.sparkContext.cancelAllJobs()
    assert sorted(r["id"] for r in out) == [0, 199_999]


def test_draws_are_h32_of_their_texts():
    for middle, reps, rows in (("|a|", (8, 13), 1203), ("|é" + "x" * 43 + "|", (98, 102), 130), ("|" + "x" * 200 + "|", (0, 3), 11), ("|", (999, 1001), 40_000)):
        got = {}
        for rep, h in draws.tiles("31|", middle, reps, rows):
            for k in range(len(h)):
                got.setdefault(rep + k, []).extend(h[k].tolist())
        assert got == {rep: [int(hashlib.md5(f"31|{rep}{middle}{r}".encode()).hexdigest()[:8], 16) for r in range(rows)] for rep in range(*reps)}


def resampled(groups, reps, seed):
    """Bootstrap in plain Python; values by group, None for nulls."""
    macro = []
    for rep in range(reps):
        means = []
        for g, values in groups.items():
            found = [values[int(hashlib.md5(f"{seed}|{rep}|{g}|{r}".encode()).hexdigest()[:8], 16) % len(values)] for r in range(len(values))]
            found = [v for v in found if v is not None]
            means += [sum(found) / len(found)] if found else []
        macro += [sum(means) / len(means)] if means else []
    return (reps, np.mean(macro), np.std(macro))


def test_bootstrap_of_nulls_slices_and_many_calls(spark, monkeypatch):
    rng = random.Random(9)
    groups = {"a": [rng.choice([None, rng.uniform(-5, 5)]) for _ in range(1700)], "é|": [rng.random() for _ in range(513)], "": [2.5], "none": [None, None]}
    rows = [(g, r, v) for g, values in groups.items() for r, v in enumerate(values)]
    df = spark.createDataFrame([*rows, (None, 0, 1e9)], "g string, r long, v double").repartition(5)
    want = resampled(groups, 23, 4)
    assert tuple(statistics.bootstrap(df, "r", "v", 23, 4, ["g"]).first()) == pytest.approx(want)
    monkeypatch.setattr(statistics, "DRAWS", 3000)
    assert tuple(statistics.bootstrap(df, "r", "v", 23, 4, ["g"], held=1000).first()) == pytest.approx(want)
    assert tuple(statistics.bootstrap(df.where("false"), "r", "v", 23, 4, ["g"]).first()) == (0, None, None)


def test_bootstrap_shuffles_no_draws(spark):
    """20,000,000 draws of 10,000 rows: no row of the plan may be one draw."""
    df = spark.range(10_000).select((F.col("id") % 2).cast("string").alias("g"), F.floor(F.col("id") / 2).alias("r"), F.col("id").cast("double").alias("v"))
    out = statistics.bootstrap(df, "r", "v", 2000, 31, ["g"])
    out.collect()
    tracker = spark.sparkContext._jsc.sc().statusStore()
    stages = tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    most = max(stages.apply(k).shuffleWriteRecords() for k in range(min(20, stages.size())))
    assert 0 < most <= 10_000


def test_reports(spark):
    df = spark.createDataFrame([(1, float("nan"), "</script>")], "a long, b double, c string")
    assert sinks.finite(df).first()["b"] is None
    assert "</script>" not in sinks.page(df, "t").removesuffix("</script>")
    assert sinks.markdown(df.select("a")) == "| a |\n| - |\n| 1 |"
    assert json.loads(sinks.provenance(df, seed=3)) == {"rows": 1, "seed": 3}
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(3), 2)


def test_epochs_of_nothing_stop(spark):
    assert layout.epochs(spark.range(3), 2).count() == 6
    with pytest.raises(ValueError):
        layout.epochs(spark.range(0), 2)


def test_pluggable_scorer(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    assert {r["id"]: r["value"] for r in scoring.applied(df, "doc_id", "text", lambda: lambda texts: [float(len(t)) for t in texts]).collect()} == {1: 3.0, 2: 0.0}
    embedded = scoring.applied(df, "doc_id", "text", lambda: lambda texts: [[1.0, 0.5] for _ in texts], "array<double>")
    assert embedded.first()["value"] == [1.0, 0.5]


def test_streams(spark, tmp_path):
    rows = [(i, i % 3, float(i)) for i in range(30)]
    spark.createDataFrame(rows, "id long, source long, value double").repartition(3).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    first = state.finished(state.keep_first(state.read_files(spark, str(tmp_path / "in"), schema, 1), ["source"]), "first", "append", str(tmp_path / "c1"))
    assert first.count() == 3
    ema = state.finished(state.excess_controller(state.read_files(spark, str(tmp_path / "in"), schema, 1), "source", "value", 0.5), "ema", "update", str(tmp_path / "c2"))
    assert {r["source"] for r in ema.collect()} == {"0", "1", "2"} and all(r["batches"] >= 1 for r in ema.collect())
    spark.createDataFrame([(0, 2.0), (1, 3.0)], "source long, weight double").write.parquet(str(tmp_path / "w"))
    state.with_refreshed_weights(state.read_files(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "w"), "source", str(tmp_path / "out"), str(tmp_path / "c3")).awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 30 and {(r["source"], r["weight"]) for r in back.collect()} == {(0, 2.0), (1, 3.0), (2, 0.0)}


def test_minhash_finds_near_duplicates(spark):
    """Signatures against plain Python, estimates and recall against true Jaccard similarities."""
    rng = random.Random(7)
    texts = {}
    for i in range(60):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([30, 120, 400]))]
        for j in range(3):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, 10]) * len(words) // 200):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
            texts[i * 10 + j] = " ".join(words)
    texts |= {1000: "", 1001: None, 1002: "One two!", 1003: "one TWO", 1004: "a b c d e"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    with Scratch(spark) as scratch:
        signed = scratch.table(minhash.signatures(docs), "signed")
        got = {r["doc_id"]: r["signature"] for r in signed.collect()}
        pairs = {(r["a"], r["b"]): r["equal"] for r in minhash.class_pairs(signed, scratch).collect()}
        flags = {r["doc_id"]: r["near"] for r in minhash.near_flags(signed.where("doc_id % 10 = 0"), signed.where("doc_id % 10 > 0"), scratch).collect()}
    assert set(got) == {d for d, t in texts.items() if t} and got[1002] == got[1003]
    times, scramble = minhash.weights()

    def plain(text):
        numbers = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in text.lower().replace("!", "").split()]
        k = min(5, len(numbers))
        values = []
        for i in range(len(numbers) - k + 1):
            v = sum(n * m for n, m in zip(numbers[i : i + k], times, strict=False)) % 2**32
            v = ((v ^ (v >> 15)) * scramble) % 2**32
            values.append(v ^ (v >> 13))
        moved = lambda u: ((u ^ (u >> 16)) * scramble) % 2**32
        return [min(moved((a * v + b) % 2**32) for v in values) for a, b in zip(*minhash.parameters(), strict=True)]

    assert all(got[d] == plain(texts[d]) for d in (0, 11, 22, 1002, 1004))
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, t.split()) for d, t in texts.items() if t)}
    jaccard = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b < 1000 and a // 10 == b // 10}
    errors = [sum(x == y for x, y in zip(got[a], got[b], strict=True)) / 128 - j for (a, b), j in jaccard.items()]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    near = [p for p, j in jaccard.items() if 0.78 <= j < 1]
    first = {d: min(e for e in got if got[e] == got[d]) for d in got}
    assert len(near) > 20 and np.mean([(min(first[a], first[b]), max(first[a], first[b])) in pairs or first[a] == first[b] for a, b in near]) > 0.95
    assert all(n >= 0.7 * 128 for n in pairs.values()) and not [p for p in pairs if p[0] // 10 != p[1] // 10]
    assert all(flags[a] for a, _ in near if a % 10 == 0)


def test_greedy_keep_by_keys_equals_the_fold(spark):
    rng = random.Random(8)
    rows = [(n, rng.choice([None, *range(40)]), rng.choice([None, *range(60)]), rng.choice([None, *range(50)])) for n in range(120)]
    edges = {tuple(sorted(rng.sample(range(50), 2))) for _ in range(25)}
    kept: dict[int, tuple] = {}
    for n, a, b, g in rows:
        shares = any((a is not None and a == x) or (b is not None and b == y) or (g is not None and z is not None and (g == z or tuple(sorted((g, z))) in edges)) for x, y, z in kept.values())
        if not shares:
            kept[n] = (a, b, g)
    with Scratch(spark) as scratch:
        nodes = spark.createDataFrame(rows, "node long, a long, b long, g long")
        got = dedup.greedy_keep_by_keys(nodes, ["a", "b"], "g", spark.createDataFrame(sorted(edges), "a long, b long"), scratch).collect()
        assert dedup.greedy_keep_by_keys(nodes.limit(0), ["a", "b"], "g", nodes.limit(0).select("a", "b"), scratch).count() == 0
    assert len(got) == 120 and {r["node"] for r in got if r["kept"]} == set(kept)


@pytest.mark.parametrize("padded", [False, True])
def test_batches_equal_one_pass(spark, padded):
    rng = random.Random(9)
    groups = {"a": [rng.randint(0, 30) for _ in range(300)], "b": [0] * 70 + [500, 0, 3], "c": [9], "d": [1] * 200, "e": [100, 400, 0, 0, 100]}
    if padded:
        groups = {g: sorted(sizes, reverse=True) for g, sizes in groups.items()}
    rows = [(g, k, n) for g, sizes in groups.items() for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "g string, k long, n long").repartition(3)
    with Scratch(spark) as scratch:
        for block in (1, 7, 1000):
            got = {(r["g"], r["k"]): r["batch"] for r in tokens.batches(df, "g", "n", 100, scratch, padded, block).collect()}
            for g, sizes in groups.items():
                if padded:
                    want, at = [], 0
                    while len(want) < len(sizes):
                        want += [at] * max(100 // max(sizes[len(want)], 1), 1)
                        at += 1
                    want = want[: len(sizes)]
                else:
                    want = tokens.next_fit(sizes, 100)
                assert [got[g, k] for k in range(len(sizes))] == want, (g, block)


def test_shifted_views(spark):
    df = spark.createDataFrame([(0, list(range(10)), 10, 0), (1, list(range(10, 23)), 13, 10)], "row_id long, tokens array<int>, n_tokens long, start long")
    rows = tokens.packed_views(df, 5, 3).orderBy("seq").collect()
    assert [r["views"] for r in rows] == [[list(range(5 * s + k, 5 * s + k + 5)) for k in range(3)] for s in range(4)]


def test_exact_ratio_of_large_indices(spark):
    big = 2**55 + 11
    rows = tokens.interleaved(spark.range(big, big + 21), "id", 2, 7).orderBy("id").collect()
    assert [(r["stream"], r["at"]) for r in rows] == [(2, i * 2 // 7) if (i + 1) * 2 // 7 > i * 2 // 7 else (1, i - i * 2 // 7) for i in range(big, big + 21)]


def test_markup_equals_pythons_rules(spark):
    pieces = ["# ", "   ### ", "#x", "**b**", "__u__", "*i*", "* i*", "**", "*", "- ", "• ", "1. ", "1.2) ", "12.3.4. ", "```py\n", "```\n", "\n", " \n", "word ", "é ", "\t", " ", "٣. ", "a*b*c"]
    rng = random.Random(10)
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(500)]

    def plain(t):
        for pattern, kept in text.MARKUP:
            t = re.sub(pattern, kept.replace("$1", r"\1"), t)
        return t

    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", text.stripped_markup(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in sorted(got)] == [plain(t) for t in texts]


def test_tokenizers(spark):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["Hello  world, 12½ é 中文 😀", "", "a\nb\t c"]
    made = {"bytes": tokenizers.built("bytes"), "pieces": tokenizers.built("pieces", public.path("piece_bpe_32k.model")), "library": tokenizers.built("library", public.path("byte_bpe_50k.json"))}
    made["ranks"] = tokenizers.built("ranks", public.path("byte_bpe_50k.tiktoken"), r"\s+|\S+")
    for t in texts:
        for name, tokenizer in made.items():
            ids, offsets = tokenizer.encode(t), tokenizer.offsets(t)
            assert len(offsets) == len(ids) and offsets == sorted(offsets) and all(0 <= x <= len(t) for x in offsets)
            if name != "pieces":
                assert tokenizer.decode(ids) == t
    assert made["bytes"].encode("é", True, True) == [256, 195, 169, 257] and made["bytes"].decode([256, 195, 169, 257]) == "é"
    assert made["pieces"].encode(texts[0]) == sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model")).encode(texts[0])
    assert made["library"].encode(texts[0]) == Tokenizer.from_file(public.path("byte_bpe_50k.json")).encode(texts[0], add_special_tokens=False).ids
    long = "x" * 60_000 + " " * 60_000 + "y z " * 110_000
    assert "".join(made["ranks"].parts(long)) == long and max(map(len, made["ranks"].parts(long))) <= tokenizers.MOST_CHARS
    assert made["ranks"].decode(made["ranks"].encode(long)) == long
    assert tokenizers.built("given").encode("5 6") == [5, 6]
    with pytest.raises(ValueError):
        tokenizers.built("other")
    df = spark.createDataFrame([(1, "aé"), (2, None)], "doc_id long, text string")
    assert {r["id"]: r["tokens"] for r in tokenizers.tokenized(df, "bytes", begin=True).collect()} == {1: [256, 97, 195, 169], 2: [256]}


def test_columns_and_rows(spark):
    df = spark.createDataFrame([(1, ("x", (2, "y z"))), (2, ("q", None))], "id long, m struct<a: string, n: struct<b: long, `c d`: string>>")
    flat = columnar.flattened(df)
    assert flat.columns == ["id", "m_a", "m_n_b", "m_n_c d"] and [tuple(r) for r in flat.orderBy("id").collect()] == [(1, "x", 2, "y z"), (2, "q", None, None)]
    assert [r["id"] for r in columnar.taken(flat, spark.createDataFrame([(2,), (2,), (9,)], "id long"), "id").collect()] == [2]


def test_publishing_and_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "p")
    assert sinks.publish(spark.range(5), path) and not sinks.publish(spark.range(7), path)
    assert spark.read.parquet(path).count() == 5 and [x.name for x in tmp_path.iterdir()] == ["p"]
    sinks.write_parquet_shards(spark.range(2500).coalesce(1), str(tmp_path / "s"), 1000, 300)
    files = sorted((tmp_path / "s").glob("*.parquet"))
    assert sorted(pq.ParquetFile(f).metadata.num_rows for f in files) == [500, 1000, 1000]
    assert all(pq.ParquetFile(f).metadata.row_group(g).num_rows <= 300 for f in files for g in range(pq.ParquetFile(f).metadata.num_row_groups))


def test_diversity_of_subsets(spark):
    vecs = spark.createDataFrame([(i, "even" if i % 2 else "one", [1.0, 0.0, 0.0] if not i % 2 else [float(k == i // 2 % 3) for k in range(3)]) for i in range(120)], "vec_id long, g string, embedding array<double>")
    got = {r["g"]: r for r in vectors.vendi_of_subsets(vecs, "g", 30, 4, 1).collect()}
    assert abs(got["one"]["mean"] - 1) < 1e-9 and got["one"]["deviation"] < 1e-9 and 2.7 < got["even"]["mean"] <= 3 and got["even"]["repeats"] == 4
    assert vectors.vendi_of_subsets(vecs, "g", 61, 4, 1).count() == 0


def test_reweighting_holds_and_scales(spark):
    rows = [("a", 0, 1.0), ("b", 0, 3.0), ("a", 1, 2.0), ("a", 2, 2.0), ("b", 2, 0.0)]  # b has no data in window 1
    got = {(r["s"], r["w"]): r for r in experiments.reweighted(spark.createDataFrame(rows, "s string, w long, x double"), "s", "w", "x", 0.5, 1.0, 0.5, 2.0, zscore=True).collect()}
    assert [got["b", w]["ema"] for w in range(3)] == [3.0, 3.0, 1.5] and [got["a", w]["ema"] for w in range(3)] == [1.0, 1.5, 1.75]
    for w in range(3):
        c = (got["a", w]["ema"] - got["b", w]["ema"]) / 2
        a, b = (min(max(0.5 * np.exp(np.sign(s * c)), 0.25), 1.0) for s in (1, -1))
        assert abs(got["a", w]["weight"] - a / (a + b)) < 1e-9 and abs(got["a", w]["weight"] + got["b", w]["weight"] - 1) < 1e-9


def test_streams_resume_from_their_checkpoint(spark, tmp_path):
    """A stream that stops after its first files goes on with the rest, with its state and without repeats."""
    schema = "id long, source string, value double"
    folder, first, second = str(tmp_path / "in"), str(tmp_path / "c1"), str(tmp_path / "c2")

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        read = lambda: state.read_files(spark, folder, spark.createDataFrame([], schema).schema, 1)
        state.append_log(state.keep_first(read(), ["source"]), str(tmp_path / "kept"), first).awaitTermination()
        state.logged_updates(state.excess_controller(read(), "source", "value", 0.5), str(tmp_path / "ema"), second).awaitTermination()
        last = spark.read.parquet(str(tmp_path / "ema")).groupBy("source").agg(F.max(F.struct("batches", "ema")).alias("x"))
        return sorted(r["source"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()), {r["source"]: tuple(r["x"]) for r in last.collect()}

    arrive([(1, "a", 4.0), (2, "b", 1.0)])
    assert run() == (["a", "b"], {"a": (1, 4.0), "b": (1, 1.0)})
    arrive([(3, "a", 2.0), (4, "c", 5.0)])
    assert run() == (["a", "b", "c"], {"a": (2, 3.0), "b": (1, 1.0), "c": (1, 5.0)})
    assert run() == (["a", "b", "c"], {"a": (2, 3.0), "b": (1, 1.0), "c": (1, 5.0)})


def test_scratch_on_a_cluster(spark, monkeypatch):
    from corpusloom.plans import scratch as module

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="share"):
        module.shared_folder(Session())
    with Scratch(spark) as scratch:
        kept = scratch.keep(spark.range(3))
    assert kept.count() == 3
    path = next(p for p in module._KEPT if scratch.folder in p)
    module.release()
    assert not module._KEPT and not __import__("os").path.exists(path.removeprefix("file://"))
