"""What grows with the input is joined by shuffle: the driver holds none of it."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prosemill.llm import ann, common, minhash


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are staged meanwhile."""
    seen = []

    def kept(df, name, staged=common.staged):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    for module in (common, minhash, corpus_pipeline):
        monkeypatch.setattr(module, "staged", kept)
    return seen


def test_near_duplicates_broadcast_nothing_that_grows(spark, plans, monkeypatch):
    # up to so many ids are sent to pick texts
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    text = lambda seed: " ".join(f"w{(i * seed) % 997}" for i in range(120))
    rows = [(1, text(7)), (2, text(7).replace("w7 ", "changed ", 1)), (3, text(11)), (4, text(11)), (None, text(13)), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1L n_chars")
    found = minhash.near_duplicates(docs)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sorted(((r.doc_id, r.component_id) for r in found.collect()), key=str) == [(1, 1), (2, 1), (3, 3), (4, 3), (6, 6), (None, None)]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 6, None]
    assert plans and not any("Broadcast" in p for p in plans)


def test_queries_in_blocks_are_not_broadcast(spark):
    d = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    found = ann.permutation_search(d, F.col("id") % 20 == 0)
    assert found.count() == 15
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
