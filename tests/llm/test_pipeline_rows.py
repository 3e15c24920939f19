"""The near-duplicate stage of the pipeline by rows: null ids, repeated ids, repeated rows."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def text(n, seed):
    return " ".join(f"w{(i * seed) % 997}" for i in range(n))


def test_rows_stay_or_go_by_text(spark):
    a, b, c = text(120, 7), text(120, 11), text(120, 13)
    near = a.replace("w7 ", "changed ", 1)
    rows = [(1, a), (None, a), (None, b), (5, c), (5, text(120, 17)), (5, c), (6, near), (7, None), (8, "short one")]
    d = spark.createDataFrame([(i, t, "en", "s", 1, 9) for i, t in rows], SCHEMA).repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, d, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    texts = sorted(r.text or "" for r in got.collect())
    assert sum(t in (a, near) for t in texts) == 1
    assert [t for t in texts if t not in (a, near)] == sorted(["", b, c, text(120, 17), "short one"])
    assert corpus_pipeline.drop_near_duplicates(spark, d.where("doc_id = 99"), "").count() == 0
