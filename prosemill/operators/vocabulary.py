"""Training of a byte-level BPE vocabulary: pre-tokens stay partitioned, merge tables alone reach the driver.

The result is that of the sequential procedure: again and again the most frequent pair (of equal ones the one of the smaller ids) becomes
a token. Pairs are merged in batches. A batch is the longest beginning of the pairs by count whose members cannot touch each
other, cut where a pair that its merges create could come before one of its members.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..sources.staging import ship, staged

#: Pairs that a round looks at, and batches of merges after which the pre-tokens are written anew.
LOOK, REWRITE = 512, 4
#: Pre-tokens that a task has at least, where there are more tasks than one, and at most.
TASK_WORDS, LARGE_TASK = 50_000, 2_000_000
#: Pre-tokens as a pass reads them: many in a row, as numbers one behind the other, and the bytes of a row's pre-tokens.
STATE, ROW_SYMBOLS = "symbols binary, lengths binary, n binary", 1_000_000
#: The pre-tokens of all lines of a text, found at once: a line's white space ends with its line end.
LINE_PRE_TOKEN = P.PRE_TOKEN.replace(r"|\s+(?!\S)|\s+", r"|[^\S\n]*\n|[^\S\n]+(?!\S)|[^\S\n]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 shows it, else the next code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


def pretoken_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """word (bytes), n: the pre-tokens of all texts, line by line, counted in each task first. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        word = regex.compile(LINE_PRE_TOKEN)

        def counted(held: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.encode() for w in held], pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(word.findall(text.as_py() or ""))
                if len(held) > 200_000:
                    yield counted(held)
                    held = Counter()
        yield counted(held)

    return docs.select(column).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def merge_pass(sym: np.ndarray, word: np.ndarray, batch: dict[tuple[int, int], tuple[int, int]], creations: bool = False):
    """One batch over the symbols of words in a row: {pair: (place in the batch, new id)}, of pairs that cannot touch each other.

    Returns symbols and words after it; with ``creations`` also (left, right, place, word) of each pair that a merge makes with a
    neighbour of its moment: merged already where its place is lower.
    """
    keys = np.array(sorted(a << 32 | b for a, b in batch), np.int64)
    at = {a << 32 | b: v for (a, b), v in batch.items()}
    place, new = (np.array([at[k][i] for k in keys.tolist()], np.int64) for i in (0, 1))
    # few places have a left symbol before a right one; only these are searched
    begins, ends = np.zeros((2, max(int(sym.max(initial=0)), *map(max, batch)) + 1), bool)
    begins[keys >> 32] = ends[keys & 0xFFFFFFFF] = True
    near = np.flatnonzero(begins[sym[:-1]] & ends[sym[1:]] & (word[:-1] == word[1:]))
    key = sym[near].astype(np.int64) << 32 | sym[near + 1]
    found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    fine = keys[found] == key
    hit, found = near[fine], found[fine]
    # a pair of one symbol overlaps itself: every other place of a run, from the left
    run = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1] + 1]) if len(hit) else hit
    odd = (np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0
    hit, which = hit[odd], found[odd]
    out, keep = sym.copy(), np.ones(len(sym), bool)
    out[hit] = new[which]
    keep[hit + 1] = False
    made = None
    if creations:
        turn = np.full(len(sym), len(batch) + 1)
        turn[hit] = turn[hit + 1] = place[which]
        merged = sym.copy()
        merged[hit] = merged[hit + 1] = new[which]
        rows = []
        for beside, left in ((hit - 1, True), (hit + 2, False)):
            fine = (beside >= 0) & (beside < len(sym))
            fine[fine] = word[beside[fine]] == word[hit[fine]]
            o, h = beside[fine], hit[fine]
            own, now = new[which[fine]], place[which[fine]]
            # of two merges of one place the left one comes first; it has been counted from there
            before = (turn[o] < now) | ((turn[o] == now) & left)
            other = np.where(before, merged[o], sym[o])
            rows.append((other, own, now, word[h]) if left else (own, other, now, word[h]))
        made = tuple(np.concatenate(c) for c in zip(*rows, strict=True))
    return out[keep], word[keep], made


def _packed(symbols_of: np.ndarray):
    """(word, n) -> STATE rows: the symbols of up to ROW_SYMBOLS bytes of words, one behind the other. Words of one symbol have no pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, size = [], [], 0
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(w) < 2:
                    continue
                words.append(w)
                counts.append(n)
                size += len(w)
                if size >= ROW_SYMBOLS:
                    yield _state(symbols_of[np.frombuffer(b"".join(words), np.uint8)], [len(w) for w in words], counts)
                    words, counts, size = [], [], 0
        yield _state(symbols_of[np.frombuffer(b"".join(words), np.uint8)], [len(w) for w in words], counts)

    return run


def _state(sym: np.ndarray, lengths, n) -> pa.RecordBatch:
    cols = (np.asarray(sym, np.int32), np.asarray(lengths, np.int32), np.asarray(n, np.int64))
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], names=["symbols", "lengths", "n"])


def _merged(batches: Iterator[pa.RecordBatch], steps: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each state row its symbols after some batches of merges, the word of each, and the words' counts."""
    for batch in batches:
        for symbols, lengths, n in zip(*batch.columns, strict=True):
            sym, lengths, n = (np.frombuffer(x.as_buffer(), t) for x, t in ((symbols, np.int32), (lengths, np.int32), (n, np.int64)))
            word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            for step in steps:
                sym, word, _ = merge_pass(sym, word, step)
            yield sym, word, n


def _rewritten(steps: list[dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sym, word, n in _merged(batches, steps):
            lengths = np.bincount(word, minlength=len(n))
            long = lengths > 1
            yield _state(sym[long[word]], lengths[long], n[long])

    return run


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and the sum of each."""
    if len(keys) and (size := int(keys.max()) + 1) <= 4 * len(keys):
        # exact: counts of a task are far below 2 ** 53
        total = np.bincount(keys, weights=n, minlength=size)
        keys = np.flatnonzero(total)
        return keys, total[keys].astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _counted(steps: list[dict], next_batch: dict | None, symbols: int):
    """Counts of pairs after some batches, of ``symbols`` symbols; or, with a next batch, of the pairs that it makes, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for sym, word, n in _merged(batches, steps):
            if next_batch is None:
                inside = np.flatnonzero(word[:-1] == word[1:])
                key, of = sym[inside] * np.int64(symbols) + sym[inside + 1], word[inside]
            else:
                left, right, place, of = merge_pass(sym, word, next_batch, True)[2]
                key = (place * np.int64(symbols) + left) * np.int64(symbols) + right
            more = _sums(key, n[of])
            keys, sums = _sums(np.append(keys, more[0]), np.append(sums, more[1]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys // symbols % symbols, keys % symbols, keys // symbols**2, sums)], names=["l", "r", "place", "n"])

    return run


def next_batch(ranked: list[tuple[int, int, int]], most: int) -> list[tuple[int, int, int]]:
    """The longest beginning of ranked (left, right, n) whose pairs do not meet: none ends where another begins."""
    begins, ends, out = set(), set(), []
    for left, right, n in ranked[:most]:
        if left in ends or right in begins:
            break
        begins.add(left)
        ends.add(right)
        out.append((left, right, n))
    return out


def _held_back(batch: list[tuple[int, int, int]], made: list[tuple[int, int, int, int]], counts: dict[tuple[int, int], int]) -> int:
    """How many of the batch come before everything that their merges make. made: (left, right, place, n)."""
    so_far, by_place = {}, {}
    for left, right, place, n in made:
        by_place.setdefault(place, []).append((left, right, n))
    best = None
    for i, (left, right, n) in enumerate(batch):
        if best is not None and best >= (n, (-left, -right)):
            return i
        for a, b, more in by_place.get(i, []):
            so_far[a, b] = so_far.get((a, b), counts.get((a, b), 0)) + more
            best = max(x for x in (best, (so_far[a, b], (-a, -b))) if x is not None)
    return len(batch)


def train_bpe(docs: DataFrame, vocab_size: int = 50_257, min_frequency: int = 2, special: tuple[str, ...] = (P.END_OF_TEXT,), column: str = "text") -> tuple[list[str], list[tuple[int, int, int, int]]]:
    """AGG17: the tokens by id, and the merges (left id, right id, id, count) in order.

    Ids: special tokens, the 256 bytes in order of their stand-ins, then merges. A merge whose token is there already (made of other halves) takes its id. It ends at
    ``vocab_size`` tokens or where no pair is found ``min_frequency`` times. Driver and tasks hold the merge table, never more than the vocabulary's size;
    pre-tokens stay in the shared folder. No text gives the bytes alone.
    """
    ship(docs.sparkSession)
    stand_in = byte_symbols()
    tokens = [*special, *sorted(stand_in)]
    known = {t: i for i, t in enumerate(tokens)}
    first = [known[c] for c in stand_in]
    words = staged(pretoken_counts(docs, column), "words")
    # a pass is short: few tasks, but several for each core where there are many pre-tokens, and none of more than LARGE_TASK
    n = words.count()
    tasks = max(min(n // TASK_WORDS + 1, 2 * docs.sparkSession.sparkContext.defaultParallelism), n // LARGE_TASK + 1)
    state, pending, merges = staged(words.repartition(tasks).mapInArrow(_packed(np.array(first, np.int32)), STATE), "pre-tokens"), [], []

    def counted(batch=None):
        # the batch's own new tokens are counted too
        return state.mapInArrow(_counted(pending, batch, len(tokens) + len(batch or ())), "l long, r long, place long, n long")

    while len(tokens) < vocab_size:
        rows = counted().groupBy("l", "r").agg(F.sum("n").alias("n")).where(F.col("n") >= min_frequency).orderBy(F.desc("n"), "l", "r").limit(LOOK).collect()
        ranked = [(r.l, r.r, r.n) for r in rows]
        batch = next_batch(ranked, vocab_size - len(tokens))
        if not batch:
            break
        new, ids = {}, dict(known)
        for i, (left, right, _) in enumerate(batch):
            new[left, right] = (i, ids.setdefault(tokens[left] + tokens[right], len(ids)))
        if len(batch) > 1:
            # only a pair that is as frequent as the batch's last can come before a member; pairs that were not looked at count as the last that was
            weight, low = {(a, b): n for a, b, n in ranked}, ranked[-1][2] if len(ranked) == LOOK else min_frequency - 1
            old = state.sparkSession.createDataFrame([(a, b, n) for (a, b), n in weight.items()], "l long, r long, m long")
            made = counted(new).groupBy("l", "r").agg(F.sum("n").alias("t"), F.collect_list(F.struct("place", "n")).alias("made")).join(F.broadcast(old), ["l", "r"], "left")
            often = made.where((F.col("t") + F.col("m") >= batch[-1][2]) | (F.col("m").isNull() & (F.col("t") + F.when((F.col("l") < len(tokens)) & (F.col("r") < len(tokens)), low).otherwise(0) >= batch[-1][2])))
            found = [(r.l, r.r, x.place, x.n) for r in often.select("l", "r", "made").collect() for x in r.made]
            before = {(a, b): weight.get((a, b), low if max(a, b) < len(tokens) else 0) for a, b, _, _ in found}
            batch = batch[: _held_back(batch, found, before)]
        step = {}
        for i, (left, right, n) in enumerate(batch):
            token = tokens[left] + tokens[right]
            if token not in known:
                known[token] = len(tokens)
                tokens.append(token)
            step[left, right] = (i, known[token])
            merges.append((left, right, known[token], n))
        pending.append(step)
        # a pass goes over what is pending again, so that stays short
        if len(pending) >= REWRITE:
            state, pending = staged(state.mapInArrow(_rewritten(pending), STATE), "pre-tokens"), []
    return tokens, merges
