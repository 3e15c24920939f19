"""Generators of pairs and questions: prompts, retries, replies of every shape, waves; scores of pairs."""

import json

import pytest
from pyspark.sql import functions as F

from prosemill.functions import patterns as P
from prosemill.operators import generators as G
from prosemill.operators import pairs, vectors


def read(spark, shape, *replies):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = rows.withColumn("x", G.read_reply(F.col("r"), shape)).orderBy("i").collect()
    return [None if r.x is None else [tuple(x) for x in r.x] for r in got]


def test_pairs_of_replies(spark):
    good = [{"question": " a? ", "answer": "b"}, 3, {"question": "", "answer": "b"}, {"answer": "b"}, {"question": 1.5, "answer": "b"}, ["x"], {"question": "ü", "answer": "c\n", "more": {}}]
    want = [("a?", "b", None), ("ü", "c", None)]
    replies = [json.dumps(good), f"```json\n{json.dumps(good)}\n```", "[]", '{"question": "a", "answer": "b"}', json.dumps(good)[:-1], json.dumps(good) + " so", json.dumps(good) + json.dumps(good), '["a"], ["b"]', "", None, "'a'"]
    assert read(spark, "pairs", *replies) == [want, want, [], None, None, None, None, None, None, None, None]


def test_targets_keep_what_is_malformed(spark):
    items = [{"value": 1850, "question": "q", "answer": "a"}, {"value": "", "question": "q", "answer": "a"}, "x", {"value": 0, "question": "q", "answer": ["a"]}]
    assert read(spark, "targets", json.dumps(items)) == [[("q", "a", "1850"), ("q", "a", None), (None, None, None), ("q", None, None)]]


def test_questions_and_their_lines(spark):
    got = read(spark, "questions", '[" a? ", 1, "", "b"]', '[\n  "What is "x"?",\n  "two",\n no quotes\n]', "nothing", '{"a": 1}', None)
    assert [x and [q for q, _, _ in x] for x in got] == [["a?", "b"], ['What is "x"?', "two"], None, None, None]


def test_fill_takes_values_as_they_are(spark):
    d = spark.createDataFrame([("{n} {x}", None)], "passage string, title string")
    assert d.select(G.fill("{n}: {passage}|{title}|{}", n=2, passage=F.col("passage"), title=F.col("title"))).first()[0] == "2: {n} {x}||{}"
    with pytest.raises(ValueError, match="title"):
        G.fill("{title} {passage}", passage=F.col("passage"))


def test_every_generator_fills_its_template(spark):
    d = spark.createDataFrame([("p", "t", "c", ["1", "2"])], "passage string, title string, category string, `values` array<string>")
    model = lambda prompt, bound, heat: G.Reply(json.dumps([prompt, bound, heat]))
    for g in G.GENERATORS.values():
        prompt, bound, heat = json.loads(G.generate(d, g, model).first().reply)
        assert "{" not in prompt and (bound, heat) == (g.max_tokens, g.temperature)
    with pytest.raises(ValueError, match="context"):
        G.add_generator(G.GENERATORS["context"])


def test_busy_and_refused(spark, tmp_path):
    def model(prompt, bound, heat):
        calls = tmp_path / prompt
        n = len(calls.read_text()) if calls.exists() else 0
        calls.write_text("x" * (n + 1))
        if prompt == "refused":
            raise G.ModelError
        if prompt == "busy" or prompt == "later" and n < 2:
            raise G.Busy
        return G.Reply('["a"]', G.TRUNCATED if prompt == "cut" else "end")

    def wait(seconds):
        with open(tmp_path / "waits", "a") as f:
            f.write(f"{seconds} ")

    g = G.Generator("t", "{p}", "questions", 1)
    d = spark.createDataFrame([("fine",), ("refused",), ("busy",), ("later",), ("cut",)], "p string").coalesce(1)
    got = G.generate(d, g, model, wait=wait, concurrency=1, retries=3)
    first = {r.p: (r.status, r.tries, r["items"] and r["items"][0].question) for r in got.collect()}
    assert first == {"fine": ("ok", 1, "a"), "refused": ("failed", 1, None), "busy": ("failed", 4, None), "later": ("ok", 3, "a"), "cut": ("truncated", 1, None)}
    assert sorted((tmp_path / "waits").read_text().split()) == ["10.0", "10.0", "20.0", "5.0", "5.0"]
    got.count(), got.select("items").collect()
    assert (tmp_path / "fine").read_text() == "x"  # a reply is asked for once
    with pytest.raises(Exception, match="raise the bound"):
        G.generate(d.where("p = 'cut'"), g, model, strict=True).collect()
    assert G.generate(d.where("false"), g, model).count() == 0


def test_discrimination_ends_in_reasons(spark):
    values = ["1800", "1850", "1900"]
    d = spark.createDataFrame([("In 1800, 1850 and 1900.", values)], "passage string, `values` array<string>")
    reply = [
        {"value": 1800, "question": "When first?", "answer": "It was first in 1800."},
        {"value": "1850", "question": "When then?", "answer": "It was then in 1850 and 1900."},
        {"value": "1900", "question": "When last?", "answer": "It was last in 1900."},
        {"value": "1900", "question": "When last?"},
    ]
    rows = G.item_rows(G.generate(d, G.GENERATORS["discrimination"], lambda *_: G.Reply(json.dumps(reply))))
    got = {r.seq: r.reason for r in pairs.judge_pairs(rows, P.YEAR).collect()}
    assert got == {0: None, 1: "sibling in answer", 2: None, 3: "malformed pair"}


def test_waves_end_at_the_target_or_with_the_rows(spark):
    d = spark.range(40).select(F.col("id").alias("pos"), F.concat(F.lit("p"), "id").alias("passage"))
    g = G.Generator("t", "{passage}", "pairs", 2)

    def model(prompt, bound, heat):  # a pair for every second passage; questions repeat after five
        i = int(prompt[1:])
        return G.Reply(json.dumps([{"question": f"Q {i % 10}?", "answer": prompt}] if i % 2 == 0 else []))

    got = G.generate_until(d, g, model, 6).collect()
    assert [r.pos for r in sorted(got, key=lambda r: r.pos)][:6] == [0, 2, 4, 6, 8, 10] and len(got) < 20
    assert G.generate_until(d, g, model, 100).count() == 20
    once = G.generate_until(d, g, model, 100, once=True, first=7).collect()
    assert sorted((r.pos, r.question) for r in once) == [(i, f"Q {i}?") for i in range(0, 10, 2)]
    assert G.generate_until(d.where("false"), g, model, 5).count() == 0


def test_scored_pairs_keep_both_scores(spark):
    d = spark.createDataFrame([(1, 1, 0.9, "a b", "c"), (1, 2, 0.8, "a b", "a b"), (1, 3, 0.7, "a b", None), (2, 1, 0.1, None, "x")], "query_id int, rank int, score double, question string, passage string")
    calls = lambda two: [float(len(set(a.split()) & set(b.split()))) for a, b in two]
    got = vectors.rerank(vectors.score_pairs(d, calls, batch=2)).collect()
    assert sorted((r.query_id, r.new_rank, r["rank"], r.score, r.ce_score) for r in got) == [(1, 1, 2, 0.8, 2.0), (1, 2, 1, 0.9, 0.0), (1, 3, 3, 0.7, 0.0), (2, 1, 1, 0.1, 0.0)]
    assert vectors.score_pairs(d.where("false"), calls).count() == 0
