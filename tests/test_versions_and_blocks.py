"""Versioned tables (readers during a swap, crashes, promotion, expiry) and the table function for blocks."""

import pytest

from prosemill.functions import blocks
from prosemill.sources.versions import Versioned


def ids(df):
    return sorted(r.id for r in df.collect())


def test_readers_during_a_swap(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"))
    with pytest.raises(LookupError):
        t.read()
    assert t.write(spark.range(3)) == 1
    pinned = t.read()
    assert t.write(t.read().where("id > 0")) == 2
    assert ids(pinned) == [0, 1, 2] and ids(t.read()) == [1, 2] and ids(t.read(1)) == [0, 1, 2]
    with pytest.raises(RuntimeError, match="another writer"):
        t.write(spark.range(9), after=1)
    assert ids(t.read()) == [1, 2]
    assert t.expire(keep=1) and t.versions() == [2] and ids(t.read()) == [1, 2]
    with pytest.raises(LookupError):
        t.read(1)


@pytest.mark.parametrize("step", ["_make", "rename"])
def test_a_crash_leaves_the_table(spark, tmp_path, monkeypatch, step):
    t = Versioned(spark, str(tmp_path / "t"))
    t.write(spark.range(3))

    def crash(*a):
        raise OSError("crash")

    bad = Versioned(spark, str(tmp_path / "t"))
    if step == "_make":
        monkeypatch.setattr(bad, "_make", crash)
    else:
        monkeypatch.setattr(bad, "_publish", crash)
    with pytest.raises(OSError, match="crash"):
        bad.write(spark.range(5))
    assert ids(t.read()) == [0, 1, 2] and t.versions() == [1]
    assert t.expire(keep=1, older_than=3600) == []
    assert len(t.expire(keep=1)) == 1 and ids(t.read()) == [0, 1, 2]


def test_promotion_moves_a_pointer(spark, tmp_path):
    best, a, b = (Versioned(spark, str(tmp_path / n)) for n in ("best", "a", "b"))
    best.write(spark.range(1))
    a.write(spark.range(4))
    b.write(spark.range(5))
    assert best.promote(b, losers=(a, b)) == 2 and ids(best.read()) == [0, 1, 2, 3, 4]
    assert best.info()["data"] == b.info()["data"] and a.versions() == []
    assert best.promote(b) == 2  # again: nothing new
    b.write(spark.range(2))
    b.drop()
    assert ids(best.read()) == [0, 1, 2, 3, 4]
    best.write(spark.range(7))
    best.expire(keep=1)
    b.expire(keep=1)
    assert not (tmp_path / "b" / "data").exists() or not list((tmp_path / "b" / "data").glob("[0-9a-f]*"))


def test_blocks_from_sql(spark):
    blocks.EXTRACTORS.pop("capitals", None)
    blocks.add_extractor("capitals", lambda t: [w for w in t.split() if w[0].isupper()])
    with pytest.raises(ValueError, match="there is an extractor"):
        blocks.add_extractor("years", "x")
    blocks.register(spark)
    text = "Context: In 1999 and 2001, in 1999\nQuestion: when?\nAnswer: 1999\nAnswer: b<|endoftext|>\n \n<|endoftext|>Context: N/A\nQuestion: Why 1850?\nAnswer: so<|endoftext|>\nno mark"
    spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Question: q\nAnswer:")], "doc_id long, text string").createOrReplaceTempView("block_docs")
    got = [tuple(r) for r in spark.sql("SELECT d.doc_id, b.* FROM block_docs d, LATERAL parse_blocks(d.text, 'years') b ORDER BY doc_id, pos").collect()]
    assert got == [
        (1, 0, "ok", "In 1999 and 2001, in 1999", "when?", "1999\nAnswer: b", ["1999", "2001"]), (1, 1, "ok", None, "Why 1850?", "so", ["1850"]), (1, 2, "no answer", None, None, None, None), (4, 0, "ok", None, "q", "", []),
    ]
    assert spark.sql("SELECT values FROM block_docs, LATERAL parse_blocks(text, 'capitals') WHERE pos = 0 AND doc_id = 1").first()[0] == ["In"]
    for bad in ("'nothing'", "text"):
        with pytest.raises(Exception, match="extractor must be one of"):
            spark.sql(f"SELECT * FROM block_docs, LATERAL parse_blocks(text, {bad})").collect()
