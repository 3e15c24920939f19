"""op12 against an exhaustive search: planted frames, the whole small tables, and terms beyond the sent bound."""

import math
import re
from collections import Counter

import duckdb
import pytest

from prosemill.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def exhaustive(docs, items, k=10):
    """docs: (doc_id, text); items: {id: text} -> {id: [(score, doc_id)]}, best first."""
    counts = [(i, Counter(fold(t))) for i, t in docs if fold(t)]
    size, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items.items():
        scores = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * size // total
            s = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(fold(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out[item] = [(-s, None if none else i) for s, none, i in sorted(scores)[:k]]
    return {k: v for k, v in out.items() if v}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item"], []).append((r.score, r.doc_id))
        assert len(out[r["item"]]) == r["rank"]
    return out


def search(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 7, "x", 1.0) for i, t in docs], "doc_id long, text string, n int, term string, row double").repartition(3)
    asked = lexical.query_terms(spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, term int"))
    return found(lexical.search(lexical.Postings(d, asked.select("term").distinct()), asked, **options))


def test_planted(spark):
    docs = [(1, "Apple pie, apple tart"), (2, "apple"), (3, None), (4, ""), (5, "-- \t"), (6, "ÉCLAIR Éclair éclair x2"), (7, "pie " * 500), (None, "apple"), (2, "apple"), (8, "lone"), (9, "apple pie"), *((100 + i, "common words here") for i in range(30))]
    items = [(1, "APPLE pie"), (2, "éclair"), (3, None), (4, "none_of_these"), (5, "common pie lone"), (None, "apple"), (6, "x2 X2")]
    want = exhaustive(docs, {i: t for i, t in items if i is not None})
    assert search(spark, docs, items) == want and 3 not in want and len(want[5]) == 10
    assert search(spark, docs, items, k=2) == {i: v[:2] for i, v in want.items()}


def test_empty(spark):
    assert search(spark, [], [(1, "a")]) == {} and search(spark, [(1, "a")], []) == {} and search(spark, [(1, None)], [(1, "a")]) == {}


@pytest.mark.parametrize("bound,asks", [(0, 200_000), (200_000, 150)])
def test_whole_tables(spark, monkeypatch, bound, asks):
    monkeypatch.setattr(lexical, "SENT_TERMS", bound)
    monkeypatch.setattr(lexical, "BLOCK_ASKS", asks)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = lexical.op12_lexical_search(spark, sf)
    assert found(got.withColumnRenamed("item_id", "item")) == exhaustive(docs, items)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = sorted(tuple(r) for r in lexical.op12_lexical_search(spark, sf).select("item_id", "rank", "doc_id", "score").collect())
    assert got == sorted(c.sql(lexical.OP12_SQL).fetchall())
