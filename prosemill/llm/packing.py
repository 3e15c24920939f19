"""Packing by vector bin packing with the dot-product heuristic.

Each task packs the pieces of its own partition, so nothing is shuffled: a partition leaves
at most one tail, which is cut into powers of two.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches

#: A segment has a token at least, so plain documents, however short, fill a sequence before its segments run out.
MAX_TOKENS, MAX_SEGMENTS = 1024, 1024
#: Items from which the heuristic chooses at once.
POOL = 512
END_ID = 0
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Of a piece of a turn besides: which turn, and how many of its ids bear loss.
TURN_SCHEMA = SCHEMA + ", turn bigint, loss bigint"


class Encoder:
    """Ids of a vocabulary file of the tokenizers library.

    Its ranks twin, where given, yields the same ids several times faster; texts that it
    cannot take go through the file itself.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.plain = Tokenizer.from_file(path)
        self.fast = None
        if ranks_path and pattern:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.plain.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)
            except BaseException as e:  # the fast form's panics are no Exceptions
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


class Packer:
    """Places items (doc_id, start, ids, doc_tokens, loss) into sequences under three limits.

    loss is the number of loss-bearing ids of an item, at most its ids. Among the pooled items
    that fit, the one with the largest dot product of its demand and the room left is
    placed, both as shares of the limits. If none fits but room is left, an item is cut to
    fill it, in proportion for loss.
    """

    def __init__(self, task: int, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, pool: int = POOL):
        self.limits = np.array([max_tokens, max_segments, max_loss or max_tokens], np.float64)
        self.size, self.next = pool, task << 33
        self.items: list = []
        self.need = np.zeros((pool + 2, 3))
        self.need[:, 1] = 1
        self.rows: list[tuple] = []
        self.bin: list = []
        self.room = self.limits.copy()

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int, loss: int) -> None:
        self._pool(doc_id, start, ids, doc_tokens, loss)
        while len(self.items) > self.size:
            self._place()

    def _pool(self, *item) -> None:
        self.need[len(self.items), 0], self.need[len(self.items), 2] = len(item[2]), item[4]
        self.items.append(item)

    def _take(self, k: int):
        item, last = self.items[k], self.items.pop()
        if k < len(self.items):
            self.items[k] = last
            self.need[k] = self.need[len(self.items)]
        return item

    def _place(self) -> None:
        need = self.need[: len(self.items)]
        fits = (need <= self.room).all(axis=1)
        if fits.any():
            score = need @ (self.room / self.limits**2)
            score[~fits] = -1
            self._put(self._take(int(score.argmax())))
        elif self.room[1] < 1 or not self._cut(need):
            self._close()
        if self.room[0] < 1:
            self._close()

    def _cut(self, need: np.ndarray) -> bool:
        """Fills the room with the front of the item whose loss share is nearest to the room's."""
        share = self.room[2] / self.room[0]
        k = int(np.abs(need[:, 2] / need[:, 0] - min(share, 1)).argmin())
        doc_id, start, ids, total, loss = self.items[k]
        n = int(min(self.room[0], len(ids) - 1, self.room[2] * len(ids) // loss if loss else len(ids)))
        if n < 1:
            return False
        mine = min(-(-loss * n // len(ids)), int(self.room[2]))
        self._take(k)
        self._put((doc_id, start, ids[:n], total, mine))
        self._pool(doc_id, start + n, ids[n:], total, loss - mine)
        return True

    def _put(self, item) -> None:
        self.bin.append(item)
        self.room -= (len(item[2]), 1, item[4])

    def _write(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, total, loss in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at, loss))
            at += len(ids)
        if pieces:
            self.next += 1

    def _close(self) -> None:
        self._write(self.bin)
        self.bin, self.room = [], self.limits.copy()

    def finish(self) -> None:
        while self.items:
            self._place()
        tail, self.bin = self.bin, []
        while tail:
            left = 1 << (sum(len(x[2]) for x in tail).bit_length() - 1)
            head = []
            while left:
                doc_id, start, ids, total, loss = tail.pop(0)
                n = min(left, len(ids))
                mine = -(-loss * n // len(ids))
                head.append((doc_id, start, ids[:n], total, mine))
                if n < len(ids):
                    tail.insert(0, (doc_id, start + n, ids[n:], total, loss - mine))
                left -= n
            self._write(head)


def _packed(encoder, limits: tuple[int, int, int], turns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = Encoder(*encoder), Packer(TaskContext.get().partitionId(), *limits)

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            rows = [(r[0][0], *r[1:7], r[0][1], r[7]) if turns else r[:7] for r in rows]
            names = [x.split()[0] for x in (TURN_SCHEMA if turns else SCHEMA).split(", ")]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            if turns:
                keys = list(zip(keys, batch.column(3).to_pylist(), strict=True))
            for doc_id, text, loss in zip(keys, batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = np.append(enc.ids(text.as_py() or ""), np.uint32(END_ID))
                step = limits[0] if not loss else min(limits[0], limits[2])
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    packer.add(doc_id, at, part, len(ids), len(part) if loss else 0)
            if len(packer.rows) > 5000:
                yield out()
        packer.finish()
        yield out()

    return run


def public_encoder(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """Paths of the public vocabulary and its twin; workers find them at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(f"{name}.json")), str(public_tokenizers.path(f"{name}.tiktoken")), public_tokenizers.PATTERN


def pack(docs: DataFrame, encoder: tuple[str, str | None, str | None] | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, bears_loss: str | None = None, turn: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece: its document's range, its sequence and offset there.

    A document is the ids of its text and a closing id 0; a null or empty text is that id alone. Pieces
    of one sequence are gapless from offset 0. ``bears_loss`` names a boolean column: all ids
    of such a row bear loss, those of others (and of a null) none; without it every id bears loss. ``turn`` names a whole
    number that tells a document's rows apart: pieces then have it, and the ids that bear loss, as turn and loss. Null
    and repeated ids are documents like others; no rows give no pieces. Other columns
    are not read. A retried task gives the same sequences: they follow from its partition.
    """
    small_batches(docs.sparkSession)
    run = _packed(encoder or public_encoder(), (max_tokens, max_segments, max_loss or max_tokens), turn is not None)
    loss = F.coalesce(F.col(bears_loss), F.lit(False)) if bears_loss else F.lit(True)
    more = [F.col(turn).cast("bigint").alias("turn")] if turn else []
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", loss.alias("loss"), *more)
    return rows.mapInArrow(run, TURN_SCHEMA if turn else SCHEMA)


def pack_turns(conversations: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = 8, max_loss: int = 640, **options) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> the pieces of all turns, doc_id being the conversation; with turn and loss.

    Only an assistant's turns bear loss; a sequence has at most ``max_loss`` such ids, so that prompts and
    answers are mixed. A turn is a row for itself: no conversation is gathered. A null role bears no loss, a null turn stays null.
    """
    turns = conversations.select(F.col("conv_id").alias("doc_id"), "turn", "text", (F.col("role") == "assistant").alias("loss"))
    return pack(turns, max_tokens=max_tokens, max_segments=max_segments, max_loss=max_loss, bears_loss="loss", turn="turn", **options)


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of conversations under the three limits; see pack() and pack_turns()."""
    return pack_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumnRenamed("doc_id", "conv_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; see pack() for nulls, ties, repeated rows and empty input."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
