"""Incremental forms over several batches: cut characters, ends, timers, restarts, replays."""

import re
import time

import pytest
from pyspark.sql import functions as F

from prosemill.functions import patterns as P
from prosemill.functions import text as T
from prosemill.streaming import stateful

PIECES = "reply string, seq long, piece binary, last boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def feed(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def run(spark, tmp_path, f, schema):
    """One start of the query over what is new: each call is a restart from the checkpoint."""
    out = f(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    # a query with timers never ends by itself
    until = time.time() + 40
    while time.time() < until and not (q.lastProgress and q.lastProgress["numInputRows"] == 0 and not q.status["isDataAvailable"]) and q.isActive:
        time.sleep(0.2)
    q.stop()
    if q.exception():
        raise q.exception()


def cuts(reply, raw, at):
    edges = [0, *at, len(raw)]
    return [(reply, i, raw[a:b], b == len(raw)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def test_clean_deltas_over_restarts(rocks, tmp_path):
    spark = rocks
    text = "One \n\n  two\x07\t\tthrée 💩 x � y \n z  "
    raw = text.encode()
    half = raw.index("é".encode()) + 1
    smile = raw.index("💩".encode()) + 2
    rows = cuts("a", raw, [4, half, smile, len(raw) - 3])
    broken = [("b", 0, b"tail \xf0\x9f", False), ("b", 1, b"", True)]
    shown = ""
    for part in ([rows[0], rows[1]], [rows[2], rows[1], broken[0]], [rows[3]], [rows[4], broken[1]]):
        feed(spark, tmp_path, part, PIECES)
        run(spark, tmp_path, stateful.clean_deltas, PIECES)
        now = [r.delta for r in spark.read.parquet(str(tmp_path / "out")).where("reply = 'a'").collect()]
        assert len("".join(now)) >= len(shown) and not any("�" in x for x in now)
        shown = "".join(now)
    want = spark.createDataFrame([(text,)], "t string").select(T.clean_reply(F.col("t"))).first()[0]
    files = spark.read.parquet(str(tmp_path / "out")).withColumn("t", F.col("_metadata.file_modification_time"))
    assert "".join(r.delta for r in files.where("reply = 'a'").orderBy("t").collect()) == want
    assert "".join(r.delta for r in files.where("reply = 'b'").orderBy("t").collect()) == "tail "


def test_speech_chunks(rocks, tmp_path):
    spark = rocks
    words = " ".join(f"w{i}" for i in range(14))
    feed(spark, tmp_path, [("a", 0, b"Hello, wor", False), ("b", 0, words.encode(), False)], PIECES)
    run(spark, tmp_path, stateful.speech_chunks, PIECES)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "Hello,"), ("b", " ".join(words.split()[:13]))}
    feed(spark, tmp_path, [("a", 1, b"ld. And no pause", False), ("b", 1, b" end", True)], PIECES)
    run(spark, tmp_path, stateful.speech_chunks, PIECES)
    feed(spark, tmp_path, [("a", 2, None, True)], PIECES)
    run(spark, tmp_path, stateful.speech_chunks, PIECES)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "Hello,"), ("a", "world."), ("a", "And no pause"), ("b", " ".join(words.split()[:13])), ("b", "w13 end")}


def test_a_timer_gives_out_the_rest(rocks, tmp_path):
    spark = rocks
    feed(spark, tmp_path, [("a", 0, b"never ended", False)], PIECES)
    out = stateful.speech_chunks(spark.readStream.schema(PIECES).parquet(str(tmp_path / "in")), wait_ms=500)
    q = out.writeStream.format("memory").queryName("rest").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    until = time.time() + 60
    while time.time() < until and not spark.table("rest").count():
        time.sleep(0.5)
    q.stop()
    assert [r.chunk for r in spark.table("rest").collect()] == ["never ended"]


def test_log_tail_over_batches(spark, tmp_path):
    schema = "run string, step long, loss double"
    f = lambda s: stateful.tail_log(s, 2)
    for part in ([("r", 0, 3.0), ("r", 1, 2.0)], [("r", 2, 2.5), ("r", 1, 0.1)], [("r", 3, None), ("r", 4, 1.0)]):
        feed(spark, tmp_path, part, schema)
        run(spark, tmp_path, f, schema)
    got = [tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("step").collect()]
    assert got == [(0, 3.0, 0, 0, False), (1, 2.0, 1, 0, False), (2, 2.0, 1, 1, False), (3, 2.0, 1, 2, True), (4, 1.0, 4, 0, False)]


def test_windowed_counts_and_bounded_keys(spark, tmp_path):
    schema = "ts timestamp, kind string"
    rows = lambda *m: spark.createDataFrame([(x, "a") for x in m], "m int, kind string").select((F.timestamp_seconds(F.col("m") * 60)).alias("ts"), "kind")
    for part in (rows(1, 2, 11), rows(3, 40), rows(1, 41)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, tmp_path, lambda s: stateful.windowed_counts(s, "ts", "kind", "10 minutes", "5 minutes"), schema)
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]
    got = stateful.first_seen_within(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "kind", "ts", "5 minutes")
    assert got.isStreaming


def test_a_replayed_batch_is_written_once(spark, tmp_path, monkeypatch):
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    for i in range(4):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: stateful.read_bounded(spark, src, "id long", 1)
    calls, real = [], stateful.ledger_rows

    def fails(*a):
        calls.append(1)
        if len(calls) == 2:
            # between the write of batch 1 and its commit: what a crash there leaves
            spark.range(100, 110).write.mode("overwrite").parquet(f"{out}/batch=1")
            raise RuntimeError("crash")
        return real(*a)

    monkeypatch.setattr(stateful, "ledger_rows", fails)
    with pytest.raises(Exception, match="crash"):
        stateful.until_target(stream(), out, 25, check).awaitTermination(60)
    monkeypatch.setattr(stateful, "ledger_rows", real)
    stateful.until_target(stream(), out, 25, check).awaitTermination(60)
    assert real(spark, out) == [(0, 10), (1, 10), (2, 10)]
    ids = [r.id for r in spark.read.parquet(out).collect()]
    assert len(ids) == len(set(ids)) == 30 and max(ids) < 40
    stateful.until_target(stream(), out, 25, check).awaitTermination(60)
    assert spark.read.parquet(out).count() == 30


def test_pause_pattern():
    assert re.search(P.PAUSE, "a. b").end() == 3 and not re.search(P.PAUSE, "3.5")
