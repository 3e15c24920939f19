"""The reference-style operators on planted inputs, and every query with SQL against DuckDB."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from prosemill.functions import patterns as P
from prosemill.functions import text as T
from prosemill.operators import answers, corpus, evaluation, logs, models, pairs, sampling, tokens, vectors
from prosemill.plans import registry
from prosemill.sources import io
from prosemill.streaming import stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    same(duck, name, registry.QUERIES[name](spark, SF))


def same(duck, name, got):
    """A query's rows against its SQL's, as Python values: a nullable whole number stays one."""
    want = duck.sql(registry.SQL[name])
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    plain = lambda rows, names: sorted(repr([r[names.index(c)] for c in cols]) for r in rows)
    assert plain(want.fetchall(), want.columns) == plain([tuple(r) for r in got.collect()], got.columns)


def apply(spark, f, *values):
    d = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in d.select(f(F.col("t"))).collect()]


def test_text_functions(spark):
    assert apply(spark, T.strip, "\t a \xa0", None) == ["a", None]
    assert apply(spark, T.dewrap, "One line\ngoes on\nNew one") == ["One line goes on\n\nNew one"]
    assert apply(spark, T.clip_sentence, "One. Two", "Done.", "none", "") == ["One.", "Done.", "none", ""]
    assert apply(spark, T.strip_boilerplate, "a\nSTART OF THIS PROJECT GUTENBERG EBOOK X\nbody END OF THIS PROJECT GUTENBERG EBOOK", "plain") == ["body ", "plain"]
    assert apply(spark, T.clean_book, "Café un-\nder\r\nnext") == ["Caf under next"]
    assert apply(spark, T.dedup_key, "What's UP, döc?") == ["whatsupdöc"]
    assert apply(spark, T.strip_gloss, "Lima (pronounced LEE-ma) is", "Lima (city) is") == ["Lima is", "Lima (city) is"]
    assert apply(spark, lambda c: T.distinct_values(c, P.YEAR, 2), "in 1999, 2001 and 1999", "in 1999") == [["1999", "2001"], None]
    assert apply(spark, T.clean_reply, "a\x00 \n b\t\tc�") == ["a b c"]
    assert apply(spark, T.cut_at_markers, "ans\nQuestion: x", "ok\n\nrest") == ["ans", "ok"]
    assert apply(spark, T.group_key, "Context: a\nQuestion: b", "Context: N/A\nQuestion: b") == ["Context: a", "Context: N/A\nQuestion: b"]
    assert apply(spark, lambda c: T.after(c, "\nAnswer:"), "q\nAnswer: a\nAnswer: b", "none") == [" a\nAnswer: b", None]
    pairs = apply(spark, T.parse_pairs, '[{"question":"q","answer":"a"},{"question":"","answer":"x"}]', "[{'question':'q','answer':'a'}]", '[{"question":"q","answer":"a"}] zz', "no")
    assert [[tuple(p) for p in x] for x in pairs] == [[("q", "a")], [], [], []]


def test_split_and_rejoin(spark):
    d = spark.createDataFrame([(1, "a" + P.SHARD_SEPARATOR + "b"), (2, "")], "doc_id long, text string")
    s = corpus.split_records(d)
    assert sorted(map(tuple, s.collect())) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "")]
    assert sorted(map(tuple, corpus.rejoin_records(s).collect())) == sorted(map(tuple, d.collect()))


@pytest.mark.parametrize("keys,share", [("aabbb", 0.4), ("aaaaa", 0.4), ("abcde", 0.4), ("abcdd", 0.2), ("ab", 0.0)])
def test_context_safe_split(spark, keys, share):
    n, b = len(keys), len(keys) - int(len(keys) * share)
    while 0 < b < n and keys[b - 1] == keys[b]:
        b += 1
    d = spark.createDataFrame(list(enumerate(keys)), "o long, key string")
    assert [r.is_val for r in corpus.context_safe_split(d, "key", "o", share).orderBy("o").collect()] == [i >= b for i in range(n)]


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """300,000 documents in 8 files, with texts as payload, and as many turns."""
    sf = str(tmp_path_factory.mktemp("large"))
    n = 300_000
    words = F.concat_ws(" ", F.array_repeat(F.concat(F.lit("w"), F.col("id").cast("string")), (F.col("id") % 7).cast("int")))
    d = spark.range(0, n, 1, 8).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("doc_id"), words.alias("text"), F.lit("fr").alias("lang"), F.concat(F.lit("src"), (F.col("id") % 5).cast("string")).alias("source"), (F.col("id") % 900).alias("n_chars"))
    d.write.parquet(f"{sf}/documents.parquet")
    turn = F.col("id") % 2
    c = spark.range(0, n, 1, 8).select(F.floor(F.col("id") / 2).alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    c.write.parquet(f"{sf}/conversations.parquet")
    e = spark.range(0, n, 1, 8).select(F.col("id").alias("event_id"), (F.col("id") % 11).alias("user_id"), F.lit("one").alias("event_type"), (F.pmod(F.xxhash64("id"), F.lit(100000)) / 7.0).alias("value"), F.timestamp_seconds(F.col("id")).alias("ts"))
    e.write.parquet(f"{sf}/events.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "conversations", "events", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    return sf, c


@pytest.mark.parametrize("name", ["stream_split", "group_split_snap", "group_shuffle", "ordered_concat", "log_order", "target_limit", "byte_offsets", "running_best"])
def test_order_holds_over_many_files(spark, large, name):
    sf, duck = large
    same(duck, name, registry.QUERIES[name](spark, sf))


def test_offsets_split_ties_and_keep_payload(spark):
    d = spark.range(0, 60_000, 1, 6).select((F.col("id") % 3).alias("k"), F.lit(1).alias("n"), F.concat(F.lit("payload "), F.col("id").cast("string")).alias("p"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    o = corpus.Ordered(d, F.col("n"), "k", parts=12)
    assert o.sums.count() > 6 and o.total() == 60_000
    got = o.offsets().select("k", "p", "offset").toPandas().sort_values("offset")
    assert got["offset"].tolist() == list(range(60_000)) and got["k"].is_monotonic_increasing and got["p"].nunique() == 60_000
    empty = corpus.Ordered(d.where("k > 5"), F.col("n"), "k")
    assert empty.offsets().count() == 0 and empty.total() == 0


def test_arrays(spark):
    d = spark.createDataFrame([([1, 2, 3], [1, 2]), ([1, 2, 3], [9])], "full array<int>, prompt array<int>")
    assert [r[0] for r in d.select(corpus.loss_mask(F.col("full"), F.col("prompt"))).collect()] == [[0, 0, 1], [1, 1, 1]]
    assert d.select(corpus.masked_targets(F.col("full"), F.array(F.lit(0), F.lit(1), F.lit(1)))).first()[0] == [-100, 2, 3]
    w = spark.createDataFrame([(1, 1024), (2, 1025), (3, 2049)], "doc_id int, n long")
    assert sorted((r.doc_id, r.start) for r in corpus.windows(w).collect()) == [(2, 0), (3, 0), (3, 1024)]


def test_search_ties_and_gate(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, vec array<float>")
    hits = vectors.top_k(v.where("id = 0").selectExpr("id query_id", "vec qvec"), v, 2)
    assert [(r.id, r["rank"]) for r in hits.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert vectors.gate(hits, 1.5, "id").where("context is null").count() == 2


def test_evaluation(spark):
    d = spark.createDataFrame([("a", 3, False), ("b", 3, True), ("c", 2, False)], "run string, score int, inc boolean")
    assert evaluation.champion(d, "score", "inc", "run").first().run == "b"
    o = spark.createDataFrame([("k", "old", 1, "ok"), ("k", "new", 2, "ok"), ("k", "", 3, "ok"), ("k", "bad", 4, "error")], "k string, p string, n int, status string")
    assert evaluation.last_override(o, "k", "p", "n").first().p == "new"


def test_logs(spark):
    line = "[eval] step  10/99 | train loss 2.5 x | val loss 3.25 y | best val 3.1@5 z | 30,700 tok/s"
    d = spark.createDataFrame([(line,), (line.replace("3.25", "nan"),), ("noise",)], "value string")
    assert [tuple(r) for r in logs.parse_eval(d).collect()] == [(10, 2.5, 3.25, 3.1, 30700.0)]
    s = spark.createDataFrame([("r", i, x) for i, x in enumerate([3.0, 2.0, 2.0, 2.5, 1.0])], "run string, step long, loss double")
    best = logs.running_best(s, "run", "step", "loss")
    assert [(r.best_step, r.stale) for r in best.orderBy("step").collect()] == [(0, 0), (1, 0), (1, 1), (1, 2), (4, 0)]
    assert logs.early_stop(best, "run", "step", 2).count() == 4
    c = spark.createDataFrame([("r", t, 1.7 + 5 * t**-0.5) for t in range(1, 400, 7)], "run string, step long, loss double")
    f = logs.fit_power_law(c, "run", "step", "loss").first()
    assert abs(f.floor - 1.7) < 0.002 and abs(f.alpha - 0.5) < 0.001 and abs(f.a - 5) < 0.01 and f.sse < 1e-4


def test_losses_that_are_no_number(spark):
    losses = [None, float("nan"), 2.0, None, 3.0, 1.0, float("nan")]
    s = spark.createDataFrame([("r", i, x) for i, x in enumerate(losses)] + [("none", 0, None), ("none", 1, None), (None, 5, 1.0)], "run string, step long, loss double")
    got = {(r.run, r.step): (r.best, r.best_step, r.improved, r.stale) for r in logs.running_best(s, "run", "step", "loss").collect()}
    assert [got["r", i] for i in range(7)] == [(None, None, False, 1), (None, None, False, 2), (2.0, 2, True, 0), (2.0, 2, False, 1), (2.0, 2, False, 2), (1.0, 5, True, 0), (1.0, 5, False, 1)]
    assert got["none", 1] == (None, None, False, 2) and got[None, 5] == (1.0, 5, True, 0)


def test_running_best_over_many_pieces(spark, monkeypatch):
    import random

    monkeypatch.setattr(logs, "RANGE_ROWS", 7)
    rng = random.Random(4)
    rows = [(rng.choice("aab"), i, round(rng.random(), 2)) for i in range(300)]
    got = {(r.run, r.step): (r.best, r.best_step, r.stale) for r in logs.running_best(spark.createDataFrame(rows, "run string, step long, loss double").repartition(5), "run", "step", "loss").collect()}
    best = {}
    for run, step, loss in rows:
        b = best.get(run, (9.0, 0, 0))
        best[run] = (loss, step, 0) if loss < b[0] else (b[0], b[1], b[2] + 1)
        assert got[run, step] == best[run]
    assert len(logs.early_stop(logs.running_best(spark.createDataFrame(rows, "run string, step long, loss double"), "run", "step", "loss"), "run", "step", 3).columns) == 7


@pytest.mark.parametrize("planted", [(0.5, 30.0, 0.9), (2.2, 0.4, 0.05), (1.0, 100.0, 2.5)])
def test_planted_curves(spark, planted):
    floor, a, alpha = planted
    c = spark.createDataFrame([("r", t, floor + a * t**-alpha) for t in range(1, 3000, 3)] + [("r", 0, 99.0), ("r", 5, None), ("none", 0, 1.0)], "run string, step long, loss double")
    found = logs.fit_power_law(c, "run", "step", "loss").collect()
    assert len(found) == 1
    f = found[0]
    assert f.sse < 1e-3 and max(abs(f.floor + f.a * t**-f.alpha - floor - a * t**-alpha) for t in (1, 10, 100, 2000)) < 0.02


def test_sampling(spark):
    d = spark.createDataFrame([("q", i, x) for i, x in enumerate([2.0, 1.0, 1.0, 0.0])], "q string, token int, logit double")
    got = sampling.top_k_softmax(d, "q", 2, 1.0).collect()
    assert len(got) == 3 and abs(sum(r.p for r in got) - 1) < 1e-12
    assert d.select(sampling.penalize(F.lit(-1.0), F.lit(True), 2.0)).first()[0] == -2.0
    b = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "b int, loss double")
    assert sampling.mean_of_means(b, "b", "loss").first().loss == 3.5


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.txt").write_bytes(b"x\r\ny\xff")
    assert io.read_files(spark, str(tmp_path / "a")).first().text == "x\ny�"
    (tmp_path / "b.txt").write_text("one\n<|endoftext|>\n \n<|endoftext|>\ntwo\n<|endoftext|>\n")
    assert [r.block for r in io.read_blocks(spark, str(tmp_path / "b.txt")).collect()] == ["one\n", "two\n"]
    (tmp_path / "s.json").write_text(json.dumps({"run_name": "r", "timestamp_utc": "2020", "tally": {"success": 3}}, indent=1))
    assert io.read_summaries(spark, str(tmp_path / "*.json")).first().tally == {"success": 3}
    import numpy as np

    np.arange(5, dtype="<u2").tofile(tmp_path / "t.bin")
    assert io.read_token_file(spark, str(tmp_path / "t.bin"), window=3).orderBy("start").first().ids == [0, 1, 2]
    d, out = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), str(tmp_path / "out")
    assert io.append_new(d.where("k = 1"), out, "k") == 1 and io.append_new(d, out, "k") == 1
    io.swap(spark.read.parquet(out).where("k = 2"), out)
    assert [r.k for r in spark.read.parquet(out).collect()] == [2]
    with pytest.raises(ValueError):
        io.requested_runs(spark.createDataFrame([("x",)], "run_name string"), ["nope"])


def test_model_boundary(spark):
    d = spark.createDataFrame([("a",), ("b",)], "prompt string")
    r = spark.createDataFrame([("a", "ra")], "prompt string, reply string")
    assert {x.prompt: x.reply for x in models.replay(d, r).collect()} == {"a": "ra", "b": None}


def test_streaming(spark, tmp_path):
    src, out, rows = str(tmp_path / "in"), str(tmp_path / "out"), "run string, step long, loss double"
    spark.createDataFrame([("r", i, x) for i, x in enumerate([3.0, 2.0, 2.0, 2.5])], rows).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(rows).parquet(src)
    q = stateful.until_target(stateful.first_seen(stream, "loss"), out, 100, str(tmp_path / "c"))
    q.awaitTermination(60)
    assert spark.read.parquet(out).count() == 3


def test_text_queries_take_whole_texts(spark, tmp_path):
    head = "Aé b. " * 60
    texts = {2: head + "One end. and a rest", 4: head + "Two ends!\nmore"}
    spark.createDataFrame([(k, x, "en") for k, x in texts.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {q: {r.doc_id: r.out for r in registry.QUERIES[q](spark, str(tmp_path)).collect()} for q in ("dedup_key", "clip_sentence", "fence_strip", "prompt_template")}
    assert got["dedup_key"] == {2: "aéb" * 60 + "oneendandarest", 4: "aéb" * 60 + "twoendsmore"}
    assert got["clip_sentence"] == {2: head + "One end.", 4: head + "Two ends!"}
    assert got["fence_strip"] == texts
    assert got["prompt_template"] == {k: f"Context: {x}\nQuestion: en\nAnswer:" for k, x in texts.items()}


def test_top_k_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[50] = x[7]
    d = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None), (901, []), (None, [1.0] * 8)], "id long, vec array<double>").repartition(5)
    asked = d.where("id % 10 = 7").selectExpr("id query_id", "vec qvec")
    got = {}
    for r in vectors.top_k(asked, d, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q in range(7, 300, 10):
        s = [(-float((x[q] * x[i]).cumsum()[-1]), i) for i in range(300) if i != q]
        assert [i for _, i in sorted(got[q])] == [i for _, i in sorted(s)[:4]]
    assert len(got) == 30 and vectors.top_k(asked.where("query_id < 0"), d, 4).count() == 0


def test_validator_reasons(spark):
    rows = [("1999", "When?", "it was in 1999", None), ("2005", "When?", "it was in 2005", "unknown target"), ("1999", "When?", "it was in 1998 or so", "answer lacks target"), ("1999", "When?", "from 1998 to 1999 it was", "sibling in answer"),
            ("1999", "Was it 1999?", "it was in 1999", "question leaks answer"), ("1999", "When?", "in 1999", "bare answer"), (None, None, None, "unknown target")]
    d = spark.createDataFrame([(*r, ["1998", "1999"]) for r in rows], "v string, q string, a string, want string, vs array<string>")
    for r in d.withColumn("got", pairs.validate(F.col("v"), F.col("q"), F.col("a"), F.col("vs"), P.YEAR)).collect():
        assert r.got == r.want


def test_contexts_and_fetches(spark):
    q = spark.createDataFrame([("a", "factual"), ("b", "non_factual"), ("c", "factual")], "question string, category string")
    over = spark.createDataFrame([("a", "pa")], "question string, passage string")
    got = {r.question: (r.context, r.missing_override) for r in answers.choose_context(q, "override", overrides=over).collect()}
    assert got == {"a": ("pa", False), "b": (None, False), "c": (None, True)}
    assert answers.choose_context(q, "none").where("context is null and not missing_override").count() == 3
    with pytest.raises(ValueError):
        answers.choose_context(q, "other")

    def get(title):
        return {"ok": (200, "body", 0.0), "gone": (404, None, 0.0)}.get(title, (503, None, 0.0))

    t = spark.createDataFrame([("ok",), ("gone",), ("down",)], "title string")
    waits = []
    out = {r.title: (r.body, r.failed) for r in answers.fetch_all(t, get, lambda d: spark.createDataFrame(d.collect(), d.schema), passes=2, wait=lambda s: None, retries=1).collect()}
    assert out == {"ok": ("body", False), "gone": (None, False), "down": (None, True)} and waits == []


def test_token_files(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("byte_bpe_50k.json"))
    text = "The first sentence is here. " * 200
    d = spark.createDataFrame([(1, text), (2, "Short one. And a tail"), (3, None), (4, "")], "doc_id long, text string")
    e = tokens.encode(d, path)
    assert {r.doc_id: r.t for r in tokens.decode(e, path, out="t").collect()} == {1: text, 2: "Short one. And a tail", 3: "", 4: ""}
    got = {r.doc_id: r.passage for r in tokens.fit_budget(d, path, most=50).collect()}
    assert got[1].endswith("here.") and len(got[1]) < len(text) and got[2] == "Short one." and got[3] is None and got[4] == ""
    fine, told = tokens.within_limit(e, most=100)
    assert fine.count() == 3 and told.get == {"rows": 4, "oversized": 1}
    ids = [i for r in e.orderBy("doc_id").collect() for i in r.ids]
    s = tokens.stream_split(e, "ids", "doc_id", 0.3).orderBy("doc_id").collect()
    train, val = [i for r in s for i in r.train], [i for r in s for i in r.val]
    assert train + val == ids and len(val) == int(len(ids) * 0.3)
    assert tokens.stream_split(e.where("doc_id = 9"), "ids", "doc_id", 0.3).count() == 0
    assert 0 < tokens.undecodable(path, spark).count() < 2000


def test_examples_in_one_pass(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("byte_bpe_50k.json"))
    rows = [(1, "Context: c\nQuestion: q?\nAnswer: yes"), (2, " \n"), (3, None), (4, "no mark"), (5, "Context: N/A\nQuestion: q?\nAnswer:" + " long" * 2000), (6, "Context: N/A\nQuestion: z\nAnswer: no")]
    d = spark.createDataFrame([(i, b, "old") for i, b in rows], "o long, block string, key string").repartition(2)
    shaped, seen = tokens.shape_examples(d, path, 50256)
    got = {r.o: r for r in shaped.collect()}
    assert sorted(got) == [1, 6] and seen.get == {"rows": 6, "blank": 2, "no_answer": 1, "oversized": 1, "mismatched": 0}
    assert got[1].key == "Context: c" and got[6].key == got[6].prompt and got[1].ids[-1] == 50256
    assert got[1].mask == sorted(got[1].mask) and sum(got[1].mask) == 2 and got[1].prompt.endswith("\nAnswer:")
    counts = io.write_split(spark.range(10).withColumn("is_val", F.col("id") >= 7), str(tmp_path / "s"), odd=F.col("id") % 2 == 1)
    assert counts == {"val": 3, "train": 7, "odd": 5} and spark.read.parquet(str(tmp_path / "s" / "rows")).where("split = 'val'").count() == 3
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "s" / "rows" / "split=train"))
    q = stream.observe("seen", *io.count_columns(odd=F.col("id") % 2 == 1)).writeStream.format("noop").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert q.lastProgress["observedMetrics"]["seen"]["rows"] == 7 and q.lastProgress["observedMetrics"]["seen"]["odd"] == 3


def test_files_in_order(spark, tmp_path):
    for folder, names in (("x", ("10.txt", "2.txt", "1.txt")), ("w", ("b.txt", "a b.txt"))):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_text(f"{folder}/{n}")
    folders = str(tmp_path / "x"), str(tmp_path / "w")
    index = io.file_index(spark, *folders).orderBy("place").collect()
    assert [(r.folder, r.name) for r in index] == [(0, "1.txt"), (0, "10.txt"), (0, "2.txt"), (1, "a b.txt"), (1, "b.txt")]
    assert [r.before for r in index] == [0, 7, 15, 22, 31]
    first = io.read_first(spark, 4, *folders)
    assert [r.text for r in first.orderBy("place").collect()] == ["x/1.txt", "x/10.txt", "x/2.txt", "w/a b.txt"]
    assert len(first.inputFiles()) == 4 and io.read_first(spark, 0, *folders).count() == 0


def test_search_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(1)
    d = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(200)], "id long, vec array<double>").repartition(3)
    asked = d.where("id % 5 = 0").selectExpr("id query_id", "vec qvec")
    whole = sorted(map(tuple, vectors.top_k(asked, d, 3).collect()))
    monkeypatch.setattr(vectors, "SENT_BYTES", 300)
    assert sorted(map(tuple, vectors.top_k(asked, d, 3).collect())) == whole and len(whole) == 120


def test_resume_promote_and_swap(spark, tmp_path):
    path, calls = str(tmp_path / "stage"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert io.resume(spark, path, build).count() == io.resume(spark, path, build).count() == 3 and calls == [1]
    spark.range(5).write.parquet(str(tmp_path / "winner"))
    io.promote(spark, str(tmp_path / "winner"), path, losers=(str(tmp_path / "loser"),))
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "stage.old").exists()
    assert io.write_literal(spark.createDataFrame([(2, 'b "x"'), (1, "a")], "i int, q string"), "q", "i", "QS") == 'QS = [\n    "a",\n    "b \\"x\\"",\n]\n'


def test_tail_cut_and_candidates(spark):
    d = spark.createDataFrame([(["a.", "b", "c", "d", "e. f"], 5), (["a.", "b", "c"], 5), (["a", "b"], 2), ([], 0)], "c array<string>, n int")
    assert [r[0] for r in d.select(answers.cut_tail(F.col("c"), F.col("n"))).collect()] == ["a.bcde.", "a.bc", "ab...", "..."]
    assert logs.parameter_count(12, 768, 50257, 1024) == 50257 * 768 + 1024 * 768 + 12 * (12 * 768**2 + 2 * 768) + 768
    assert apply(spark, T.quoted_lines, ' "a",,\nno\n"b "c" d" \n"') == [["a", 'b "c" d']]
