"""Incremental forms: seen-key dedup, log tails, reply streams, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import patterns as P
from ..sources.staging import ship, store


def first_seen(stream: DataFrame, key: str) -> DataFrame:
    """STR6: the first row of each key over the whole run; the state grows with the keys, as it must where a key may come back at any time."""
    return stream.dropDuplicates([key])


def first_seen_within(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """STR6 with bounded state: the first row of each key among those whose times lie within ``late`` of each other; keys beyond the watermark are forgotten."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str, by: str, width: str, late: str) -> DataFrame:
    """Event-time counts; rows later than the watermark are dropped."""
    w = F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def tail_log(rows: DataFrame, patience: int) -> DataFrame:
    """STR3: rows(run, step, loss) -> best so far, its step, stale rows and whether to stop, as batches arrive.

    Steps at or before the last seen one of a run come too late and are left out.
    """

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, best, best_step, stale = state.get if state.exists else (-1, float("inf"), -1, 0)
        out = []
        for step, loss in pd.concat(frames).sort_values("step")[["step", "loss"]].itertuples(index=False):
            if step <= last:
                continue
            last = int(step)
            best, best_step, stale = (float(loss), last, 0) if loss is not None and loss < best else (best, best_step, stale + 1)
            out.append((key[0], last, best, best_step, stale, stale >= patience))
        state.update((last, best, best_step, stale))
        yield pd.DataFrame(out, columns=["run", "step", "best", "best_step", "stale", "stop"])

    return rows.groupBy("run").applyInPandasWithState(
        update, "run string, step long, best double, best_step long, stale long, stop boolean", "last long, best double, best_step long, stale long", "append", GroupStateTimeout.NoTimeout
    )


class _Reply(StatefulProcessor):
    """Rows (seq, piece, last) of one reply -> what can be given out; the state is the part that later pieces may still change.

    A reply ends with a row whose ``last`` is true, or when nothing has come for ``wait_ms``: then the rest is given out and its state
    goes. Pieces are bytes, so a character may be cut anywhere. A seq that is not above the last one seen has come before and is left out.
    """

    def __init__(self, take, wait_ms: int, column: str):
        self.take, self.wait_ms, self.column = take, wait_ms, column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "seq bigint, raw binary, held string")

    def _rows(self, key, texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"reply": [key[0]] * len(texts), self.column: texts}, dtype="object")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import codecs

        seq, raw, held = self.kept.get() if self.kept.exists() else (None, b"", "")
        decoder, ended = codecs.getincrementaldecoder("utf-8")("replace"), False
        decoder.setstate((bytes(raw or b""), 0))
        for at, piece, last in pd.concat(rows).sort_values("seq", kind="stable")[["seq", "piece", "last"]].itertuples(index=False):
            if seq is None or at > seq:
                seq, held = int(at), held + decoder.decode(bytes(piece) if piece is not None else b"")
                ended |= bool(last) if last is not None else False
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if ended:
            yield self._rows(key, self.take(held + decoder.decode(b"", final=True), True)[0])
            self.kept.clear()
            return
        out, held = self.take(held, False)
        self.kept.update((seq, decoder.getstate()[0], held))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            _, raw, held = self.kept.get()
            yield self._rows(key, self.take(held + bytes(raw or b"").decode("utf-8", "replace"), True)[0])
            self.kept.clear()

    def close(self) -> None:
        pass


def _replies(pieces: DataFrame, take, wait_ms: int, column: str) -> DataFrame:
    ship(pieces.sparkSession)
    rows = pieces.select("reply", F.col("seq").cast("bigint").alias("seq"), F.col("piece").cast("binary").alias("piece"), F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("reply").transformWithStateInPandas(_Reply(take, wait_ms, column), f"reply string, {column} string", "Append", "ProcessingTime")


def _chunks(words: int):
    def take(held: str, ended: bool) -> tuple[list[str], str]:
        import re

        out = []
        while True:
            m = re.search(P.PAUSE, held)
            cut = m.end() if m else held.rfind(" ") + 1 if len(held.split()) >= words else 0
            if not cut:
                break
            out.append(held[:cut].strip())
            held = held[cut:]
        return [x for x in [*out, *([held.strip()] if ended else [])] if x], held

    return take


def speech_chunks(pieces: DataFrame, words: int = 10, wait_ms: int = 30_000) -> DataFrame:
    """STR2, TXT27: pieces(reply, seq, piece, last) -> reply, chunk: cut behind a pause, or at the last blank once ``words`` are held; the rest at the reply's end."""
    return _replies(pieces, _chunks(words), wait_ms, "chunk")


def _clean(text: str) -> str:
    import re

    for pattern, to in ((P.CONTROL, ""), (P.BREAKS, " "), (P.BLANKS, " "), ("\ufffd", ""), (P.BLANKS, " ")):
        text = re.sub(pattern, to, text)
    return text


def _readable(held: str, ended: bool) -> tuple[list[str], str]:
    import re

    # white space, control characters and broken ones depend on what follows their run, all else is final
    cut = len(held) if ended else re.search(f"[{P.WS}\\x00-\\x1f\\x7f\ufffd]*\\Z", held).start()
    shown = _clean(held[:cut])
    return [shown] if shown else [], held[cut:]


def clean_deltas(pieces: DataFrame, wait_ms: int = 30_000) -> DataFrame:
    """STR1: pieces(reply, seq, piece, last) -> reply, delta: the newly readable text; joined, a reply's deltas are clean_reply() of its whole text, wherever it was cut."""
    return _replies(pieces, _readable, wait_ms, "delta")


def read_bounded(spark: SparkSession, folder: str, schema: str, files: int) -> DataFrame:
    """STR5: a folder of Parquet files as a stream of at most ``files`` files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def until_target(stream: DataFrame, path: str, target: int, checkpoint: str):
    """SRT9/STR5: appends micro-batches until ``target`` rows are written; the batch that reaches it is still written whole.

    Each batch has a folder of its own below ``path``, and a line in the ledger with its observed rows. A batch that is played
    again, after a failure anywhere, replaces its folder: every row is written once.
    """
    spark = stream.sparkSession
    files, at = store(spark, path)
    ledger = f"{path}/_ledger"

    def write(batch: DataFrame, number: int) -> None:
        if sum(n for i, n in ledger_rows(spark, path) if i != number) >= target:
            return
        seen = Observation()
        batch.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        files.mkdirs(at(ledger))
        # the name holds the count: making it is one step
        for old in files.listStatus(at(ledger)):
            if old.getPath().getName().startswith(f"{number}-"):
                files.delete(old.getPath(), False)
        files.create(at(f"{ledger}/{number}-{seen.get['n']}"), True).close()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_rows(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(batch, rows) of what until_target() has written to path: a name for each batch, no table is read."""
    files, at = store(spark, path)
    if not files.exists(at(f"{path}/_ledger")):
        return []
    return sorted(tuple(map(int, f.getPath().getName().split("-"))) for f in files.listStatus(at(f"{path}/_ledger")))
