"""Interpolated modified Kneser-Ney trigram model, counted in Spark.

Trigrams are shuffled once, to shards by their middle word. So a shard has all trigrams of a
context, and all left neighbours of a bigram: bigrams are never shuffled by themselves, their
continuation counts come from the shard. A middle word with more than half a shard's worth of tokens is spread by
its left neighbour, and by the right one too where the left one is as frequent; what
is then partial (a bigram's left neighbours, such a context's sums) is added up in a second, small step.

The model is a folder of sorted arrays in the folder that all executors share: words as
64-bit hashes (a word's id is its place), statistics by id, bigrams as sorted keys
with their continuation counts, and trigrams as sorted keys of their contexts with, for each, its sorted
followers and their counts. A key is the rank of the middle word in its shard and the other word's
id in as few bits as all need, kept as its high 32 bits and the rest. Counts take one byte,
those above lie in a list. Scoring workers map the files into memory and look up batches of
distinct keys.

Each text starts behind two start marks, which are contexts only.
"""

from __future__ import annotations

import gc
import os
import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_path, scratch, small_batches, staged
from .shingles import words

#: Hash of the end of a text, a token like others; no word has a space.
END = xxhash.xxh3_64_intdigest(b" end")
#: Id of the start of a text; it only is a context.
START = np.uint64(2**32 - 1)
ADD = 0.1
#: Words to a shard of the vocabulary, tokens to a shard of the trigrams, distinct words held before counts are given out.
SHARD_WORDS, SHARD_TOKENS, HELD_WORDS = 250_000, 1_500_000, 400_000
#: Ids to a file of statistics.
STAT_IDS = 500_000
#: Tokens that are sorted at once when counting, and looked up at once when scoring.
COUNT_TOKENS, SCORE_TOKENS = 2_000_000, 800_000
#: Contexts with fewer followers have no stored sums: these are read off the followers.
SHORT = 8
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
WIDTHS = ("<u1", "<u2", "<u4", "<u8")
#: A count of a byte that stands for a listed one; contexts to a block, whose starts are kept from the block's.
LISTED, BLOCK = 255, 32


def is_held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text mod 10 is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def put(uri: str, name: str, array: np.ndarray) -> None:
    """Writes an array as raw bytes; a repeated or parallel attempt of the task leaves the same whole file."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base)
        with store.open_output_stream(f"{base}/{name}") as f:
            f.write(array.tobytes())
        return
    os.makedirs(path, exist_ok=True)
    own = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    array.tofile(own)
    os.replace(own, f"{path}/{name}")


def view(uri: str, name: str, dtype) -> np.ndarray:
    """A memory-mapped array; from a store that is no mounted folder, mapped from a local copy."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        path = tempfile.mkdtemp(prefix="prosemill-")
        with store.open_input_file(f"{base}/{name}") as src, open(f"{path}/{name}", "wb") as out:
            while part := src.read(1 << 24):
                out.write(part)
    if not os.path.getsize(f"{path}/{name}"):
        return np.zeros(0, dtype)
    return np.memmap(f"{path}/{name}", dtype, "r")


@dataclass
class Layout:
    """What a worker needs to find its way in the model's folder; bounded by the number of shards."""

    uri: str
    bits: int = 0
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    tokens: int = 0
    shards: int = 1
    #: Shards of what is added up in the second step.
    hot_shards: int = 1
    #: Words with more than half a shard's worth of tokens, sorted, and over how many shards each is spread.
    hot_ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    hot_parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    discounts: list = field(default_factory=lambda: [(0.5, 1.0, 1.5)] * 3)
    continuations: int = 0
    #: Types of the statistics by column, for each shard of them.
    stats: dict[int, dict[str, str]] = field(default_factory=dict)
    #: Mass of the lowest order that goes to the uniform distribution.
    gamma0: float = 1.0

    @property
    def vocabulary(self) -> int:
        return int(self.starts[-1])

    def word_shard(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def parts(self, ids: np.ndarray) -> np.ndarray:
        """Over how many shards each word is spread; 0 for those that are not."""
        if not len(self.hot_ids):
            return np.zeros(len(ids), np.uint64)
        k = np.minimum(np.searchsorted(self.hot_ids, ids), len(self.hot_ids) - 1)
        return np.where(self.hot_ids[k] == ids, self.hot_parts[k], np.uint64(0))

    def shard(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each context (middle word, left word): its first shard, and over how many from there its followers are spread (0: none but this)."""
        v, u = contexts >> _HALF, contexts & _LOW
        first, pv = (v * _SPREAD) >> np.uint64(20), self.parts(v)
        pu = np.where(pv > 0, self.parts(u), np.uint64(0))
        first = first + ((u * _SPREAD) >> np.uint64(33)) % np.maximum(pv, np.uint64(1))
        return (first % np.uint64(self.shards)).astype(np.int64), np.minimum(pv, pu)

    def spread(self, first: np.ndarray, over: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The shard of each trigram, by shard() of its context and its last word."""
        if not over.any():
            return first
        more = ((w.astype(np.uint64) * _SPREAD) >> np.uint64(33)) % np.maximum(over, np.uint64(1))
        return (first + more.astype(np.int64)) % self.shards

    def keys(self, ranks: np.ndarray, ids: np.ndarray, middles: int) -> tuple[np.ndarray, np.ndarray, str]:
        """Keys of middle words' ranks in a shard and ids: the high 32 bits, the rest, and the type of that."""
        bits = self.vocabulary.bit_length()
        low = max(0, bits + int(middles).bit_length() - 32)
        keys = (ranks.astype(np.uint64) << np.uint64(bits)) | np.minimum(ids.astype(np.uint64), np.uint64(self.vocabulary))
        kind = next(t for t in WIDTHS if low <= 8 * np.dtype(t).itemsize)
        return (keys >> np.uint64(low)).astype("<u4"), (keys & np.uint64((1 << low) - 1)).astype(kind), kind

    def hot_shard(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) * _SPREAD >> np.uint64(33)) % np.uint64(self.hot_shards)).astype(np.int64)


class Words:
    """Ids of words by the mapped vocabulary; unknown words get -1."""

    def __init__(self, layout: Layout):
        self.layout, self.maps, self.known = layout, {}, {}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes."""
        out = np.full(len(h), -1, np.int64)
        shard = self.layout.word_shard(h)
        for s in np.unique(shard):
            if s not in self.maps:
                self.maps[s] = view(self.layout.uri, f"words-{s}", "<u8") if self.layout.starts[s + 1] > self.layout.starts[s] else np.zeros(0, "<u8")
            at, mine = self.maps[s], shard == s
            if len(at):
                k = np.minimum(np.searchsorted(at, h[mine]), len(at) - 1)
                out[mine] = np.where(at[k] == h[mine], k + self.layout.starts[s], -1)
        return out

    def ids(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        known = self.known
        if len(known) > HELD_WORDS:
            known.clear()
        fresh = list(set().union(*texts).difference(known)) if texts else []
        if fresh:
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in fresh], np.uint64)
            order = np.argsort(h)
            got = np.empty(len(h), np.int64)
            got[order] = self.find(h[order])
            known.update(zip(fresh, got.tolist(), strict=True))
        return [np.fromiter(map(known.__getitem__, t), np.int64, len(t)) for t in texts]

    def end(self) -> int:
        return int(self.find(np.array([END], np.uint64))[0])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    ends = 0

    def out():
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in held] + [END], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array([*held.values(), ends], pa.int64())], names=["h", "n"])

    for batch in batches:
        for text in batch.column(0):
            held.update(words(text.as_py()))
            ends += 1
        if len(held) > HELD_WORDS:
            yield out()
            held.clear()
            ends = 0
    if ends or held:
        yield out()


def _write_words(uri: str):
    def run(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        shard = table.column("shard")[0].as_py()
        put(uri, f"words-{shard}", h[order])
        put(uri, f"counts-{shard}", table.column("n").to_numpy()[order].astype("<u8"))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(h)], pa.int64())})

    return run


def planes(a: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of all, compressed: the high bytes of small ones take nothing."""
    return zstandard.compress(np.ascontiguousarray(a.astype("<u4").view("u1").reshape(-1, 4).T).tobytes(), 1)


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), "u1").reshape(4, -1).T).view("<u4").ravel()


def put_counts(uri: str, name: str, shard: int, counts: np.ndarray) -> None:
    """One byte for each count; those that don't fit are listed by place."""
    many = np.flatnonzero(counts >= LISTED)
    put(uri, f"{name}-{shard}", np.minimum(counts, LISTED).astype("u1"))
    put(uri, f"{name}-many-{shard}", many.astype("<u4"))
    put(uri, f"{name}-counts-{shard}", counts[many].astype("<u8"))


def put_keys(layout: Layout, name: str, shard: int, ranks: np.ndarray, ids: np.ndarray, middles: int) -> None:
    high, low, _ = layout.keys(ranks, ids, middles)
    put(layout.uri, f"{name}-{shard}", high)
    put(layout.uri, f"{name}-low-{shard}", low)


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and how long they are."""
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(a)))


def _trigram_counts(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Words(layout)
        end, held, size = np.uint64(lex.end()), [], 0
        few = np.uint16 if layout.shards < 2**16 else np.int64

        def out(seq: np.ndarray):
            """Counts of the trigrams that end at the third place of ``seq`` or later."""
            here = seq[2:] != START
            distinct, at = np.unique(((seq[1:-1] << _HALF) | seq[:-2])[here], return_inverse=True)
            keys, counts = np.unique((at.astype(np.uint64) << _HALF) | seq[2:][here], return_counts=True)
            at, w = (keys >> _HALF).astype(np.int64), keys & _LOW
            first, over = layout.shard(distinct)
            shard = layout.spread(first[at], over[at], w)
            order = np.argsort(shard.astype(few), kind="stable")
            shard, at, w, counts = shard[order], at[order], w[order], counts[order]
            # contexts of a shard follow each other; one that is spread starts anew in each
            cfirst, clong = _runs(at + shard * np.int64(len(distinct)))
            contexts, cshard = distinct[at[cfirst]], shard[cfirst]
            vfirst, vlong = _runs((contexts >> _HALF).astype(np.int64) + (cshard << np.int64(32)))
            v, vshard = contexts[vfirst] >> _HALF, cshard[vfirst]
            found = np.unique(vshard)
            vc, cc, wc = ([*np.searchsorted(x, found), len(x)] for x in (vshard, cshard, shard))
            rows = [
                (int(s), planes(v[vc[i] : vc[i + 1]]), planes(vlong[vc[i] : vc[i + 1]]), planes((contexts & _LOW)[cc[i] : cc[i + 1]]), planes(clong[cc[i] : cc[i + 1]]), planes(w[wc[i] : wc[i + 1]]), planes(counts[wc[i] : wc[i + 1]]))
                for i, s in enumerate(found)
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] + [pa.binary()] * 6, strict=True)], names=["shard", "v", "vn", "u", "un", "w", "n"])

        def parts():
            seq = np.concatenate(held)
            for a in range(2, len(seq), COUNT_TOKENS):
                part = seq[a - 2 : a + COUNT_TOKENS]
                if (part[2:] != START).any():
                    yield out(part)

        for batch in batches:
            for ids in lex.ids([words(t.as_py()) for t in batch.column(0)]):
                held.append(np.concatenate([[START, START], ids.astype(np.uint64), [end]]))
                size += len(held[-1])
            if size > COUNT_TOKENS:
                yield from parts()
                held, size = [], 0
        if held:
            yield from parts()

    return run


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *[np.add.reduceat(v[order].astype(np.int64), first) if len(first) else v.astype(np.int64) for v in values]


def _classes(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    return counts, counts == 1, counts == 2, counts > 2


def _narrow(counts: np.ndarray) -> str:
    """The least type that holds all."""
    return next(t for t in WIDTHS if not len(counts) or counts.max() <= np.iinfo(t).max)


def _seen(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _bigram_rows(keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Sums by the first word of bigrams, and numbers of first words by the second, to be added up by id."""
    contexts, *sums = _sums(keys >> _HALF, *_classes(counts))
    after, before = _sums(keys & _LOW, np.ones(len(keys), np.int64))
    rows = []
    for kind, ids, stats in ((b"c", contexts, np.stack(sums, 1)), (b"w", after, before[:, None])):
        at = (ids // np.uint64(STAT_IDS)).astype(np.int64)
        for s in np.unique(at):
            rows.append((int(s), kind, planes(ids[at == s]), stats[at == s].astype("<u4").tobytes()))
    return rows


_ROWS = "part int, kind binary, ids binary, stats binary"


def _table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("part", "kind", "ids", "stats"), columns, [pa.int32()] + [pa.binary()] * 3, strict=True)})


def _merge_trigrams(layout: Layout):
    """Writes a shard's trigrams and bigrams; gives sums by id, counts of counts, and what the second step adds up."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda c: [unplanes(x.as_py()) for x in table.column(c)]
        contexts = np.concatenate([(np.repeat(v, n).astype(np.uint64) << _HALF) | u for v, n, u in zip(read("v"), read("vn"), read("u"), strict=True)])
        distinct, at = np.unique(np.repeat(contexts, np.concatenate(read("un"))), return_inverse=True)
        keys, counts = _sums((at.astype(np.uint64) << _HALF) | np.concatenate(read("w")), np.concatenate(read("n")))
        at, w = (keys >> _HALF).astype(np.int64), keys & _LOW
        shard = table.column("shard")[0].as_py()
        starts, long = _runs(at)
        stats = np.stack([np.add.reduceat(x.astype(np.int64), starts) for x in _classes(counts)], 1)
        over = layout.shard(distinct)[1] > 0
        middles, rank = np.unique(distinct >> _HALF, return_inverse=True)
        put(layout.uri, f"middles-{shard}", middles.astype("<u4"))
        put_keys(layout, "contexts", shard, rank, distinct & _LOW, len(middles))
        starts = np.append(starts, len(w))
        inside = starts - np.repeat(starts[::BLOCK], BLOCK)[: len(starts)]
        width = _narrow(inside)
        put(layout.uri, f"blocks-{shard}", starts[::BLOCK].astype("<u4"))
        put(layout.uri, f"starts-{shard}", inside.astype(width))
        put(layout.uri, f"followers-{shard}", w.astype("<u4"))
        put_counts(layout.uri, "trigrams", shard, counts)
        stored = np.flatnonzero(long >= SHORT)
        put(layout.uri, f"long-{shard}", stored.astype("<u4"))
        put(layout.uri, f"longstats-{shard}", stats[stored].astype("<u8"))
        # every trigram is one left neighbour of its bigram
        pairs, lefts = np.unique((distinct[at] & ~_LOW) | w, return_counts=True)
        hot = layout.parts(pairs >> _HALF) > 0
        put_keys(layout, "keys", shard, np.searchsorted(middles, pairs[~hot] >> _HALF), pairs[~hot] & _LOW, len(middles))
        put_counts(layout.uri, "ngrams", shard, lefts[~hot])
        rows = [(-1, width.encode(), shard.to_bytes(8, "little"), np.array(_seen(counts) + _seen(lefts[~hot]), "<u8").tobytes())]
        rows += _bigram_rows(pairs[~hot], lefts[~hot])
        for kind, ids, sums in ((b"b", pairs[hot], lefts[hot][:, None]), (b"x", distinct[over], stats[over])):
            to = layout.hot_shard(ids)
            for s in np.unique(to):
                rows.append((int(s), kind, ids[to == s].astype("<u8").tobytes(), sums[to == s].astype("<u4").tobytes()))
        return _table(rows)

    return run


def _merge_hot(layout: Layout):
    """The second step: writes bigrams behind frequent words and sums of spread contexts; gives rows like the first."""

    def run(table: pa.Table) -> pa.Table:
        shard, kinds = table.column("part")[0].as_py(), [x.as_py() for x in table.column("kind")]

        def added(kind: bytes, wide: int):
            own = [i for i, k in enumerate(kinds) if k == kind]
            ids = np.concatenate([np.zeros(0, "<u8")] + [np.frombuffer(table.column("ids")[i].as_py(), "<u8") for i in own])
            stats = np.concatenate([np.zeros((0, wide), "<u4")] + [np.frombuffer(table.column("stats")[i].as_py(), "<u4").reshape(-1, wide) for i in own])
            return _sums(ids, *stats.T)

        pairs, lefts = added(b"b", 1)
        put(layout.uri, f"hotkeys-{shard}", pairs.astype("<u8"))
        put(layout.uri, f"hotngrams-{shard}", lefts.astype("<u4"))
        contexts, *sums = added(b"x", 4)
        put(layout.uri, f"hotcontexts-{shard}", contexts.astype("<u8"))
        put(layout.uri, f"hotstats-{shard}", np.stack(sums, 1).astype("<u8"))
        return _table([(-1, b"", b"", np.array([0, 0, 0, 0] + _seen(lefts), "<u8").tobytes())] + _bigram_rows(pairs, lefts))

    return run


#: The columns of statistics by id: sums of a context (all, seen once, twice, oftener), and a word's left neighbours.
STATS = ("c0", "c1", "c2", "c3", "w0")


def _merge_stats(uri: str):
    """Writes a stat shard's sorted ids with their sums; gives the counts of counts of the lowest order."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        kinds = [x.as_py() for x in table.column("kind")]
        got, types = {}, {}
        for kind, wide in ((b"c", 4), (b"w", 1)):
            own = [i for i, k in enumerate(kinds) if k == kind]
            ids = np.concatenate([np.zeros(0, "<u4")] + [unplanes(table.column("ids")[i].as_py()) for i in own])
            stats = np.concatenate([np.zeros((0, wide), "<u4")] + [np.frombuffer(table.column("stats")[i].as_py(), "<u4").reshape(-1, wide) for i in own])
            ids, *sums = _sums(ids, *stats.T)
            name = kind.decode()
            put(uri, f"{name}ids-{part}", ids.astype("<u4"))
            # stats by column, each in the least type
            for k, x in enumerate(sums):
                t = types[name + str(k)] = _narrow(x)
                put(uri, f"{name}stats{k}-{part}", x.astype(t))
            got[kind] = sums
        n = got[b"w"][0]
        return pa.table({"t": pa.array([np.array([*[(n == k).sum() for k in (1, 2, 3, 4)], (n > 2).sum(), n.sum()], "<u8").tobytes()], pa.binary()), "part": pa.array([part], pa.int32()), "types": pa.array([" ".join(types[k] for k in STATS)])})

    return run


def discounts(t) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen 1 to 4 times; fixed ones where these are degenerate."""
    t1, t2, t3, t4 = (float(x) for x in t)
    if min(t1, t2, t3, t4) <= 0:
        return 0.5, 1.0, 1.5
    y = t1 / (t1 + 2 * t2)
    d = (1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3)
    return d if all(0 <= x <= k for x, k in zip(d, (1, 2, 3), strict=True)) else (0.5, 1.0, 1.5)


def train(texts: DataFrame) -> tuple[Layout, dict[int, str]]:
    """texts(text) -> the model's layout and the type of each shard's starts.

    The driver gets one row for each shard and each frequent word, of which there are at most
    twice as many as shards.
    """
    spark = texts.sparkSession
    small_batches(spark)
    texts = texts.select("text")
    uri = scratch(spark, "lm")
    counts = staged(texts.mapInArrow(_word_counts, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "words")
    size = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    if not size.v:
        return Layout(uri), {}
    layout = Layout(uri, bits=max(0, int(np.ceil(np.log2(size.v / SHARD_WORDS)))), tokens=size.n)
    shard = F.shiftrightunsigned("h", 64 - layout.bits).cast("int") if layout.bits else F.lit(0)
    sizes = dict(counts.withColumn("shard", shard).groupBy("shard").applyInArrow(_write_words(uri), "shard int, n bigint").collect())
    layout.starts = np.cumsum([0] + [sizes.get(s, 0) for s in range(1 << layout.bits)])
    if size.v >= 2**32 - 1:
        raise ValueError("more distinct words than 32-bit ids")
    layout.shards = max(1, -(-size.n // SHARD_TOKENS))
    # an end is never a context; the start mark is one as often as there are ends
    end = F.col("h") == int(np.uint64(END).astype(np.int64))
    hot = counts.where((F.col("n") > SHARD_TOKENS // 2) & ~end).collect()
    h = np.array([r.h for r in hot], np.int64).view(np.uint64)
    order = np.argsort(h)
    ids, sizes = Words(layout).find(h[order]).astype(np.uint64), np.array([r.n for r in hot], np.int64)[order]
    ends = counts.where(end).first()
    if ends and ends.n > SHARD_TOKENS // 2:
        ids, sizes = np.append(ids, START), np.append(sizes, ends.n)
    layout.hot_ids, layout.hot_parts = ids, np.minimum(2 + 2 * sizes // SHARD_TOKENS, layout.shards).astype(np.uint64)
    layout.hot_shards = 1 + int(sizes.sum()) // SHARD_TOKENS
    # the words are written: let Spark's cleaner take their shuffles, which no plan uses any more
    del counts, shard
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    grams = texts.mapInArrow(_trigram_counts(layout), "shard int, v binary, vn binary, u binary, un binary, w binary, n binary")
    merged = staged(grams.groupBy("shard").applyInArrow(_merge_trigrams(layout), _ROWS), "trigrams")
    second = F.col("kind").isin(bytearray(b"b"), bytearray(b"x"))
    if len(ids):
        merged = merged.where(~second).union(staged(merged.where(second).groupBy("part").applyInArrow(_merge_hot(layout), _ROWS), "hot"))
    told = merged.where("part = -1").collect()
    widths = {int.from_bytes(r.ids, "little"): r.kind.decode() for r in told if r.kind}
    t = np.sum([np.frombuffer(r.stats, "<u8") for r in told], axis=0)
    stats = merged.where("part >= 0").groupBy("part").applyInArrow(_merge_stats(uri), "t binary, part int, types string").collect()
    low = np.sum([np.frombuffer(r.t, "<u8") for r in stats], axis=0)
    layout.stats = {r.part: dict(zip(STATS, r.types.split(), strict=True)) for r in stats}
    layout.discounts = [discounts(low[:4]), discounts(t[4:]), discounts(t[:4])]
    layout.continuations = int(low[5])
    layout.gamma0 = float(np.dot(layout.discounts[0], [low[0], low[1], low[4]]) / low[5])
    return layout, widths


class Scorer:
    """Probabilities by the mapped model."""

    def __init__(self, layout: Layout, widths: dict[int, str]):
        self.layout, self.widths, self.lex, self.maps = layout, widths, Words(layout), {}

    def _map(self, name: str, dtype):
        if name not in self.maps:
            self.maps[name] = np.asarray(view(self.layout.uri, name, dtype))
        return self.maps[name]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Token counts of sorted ids."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.layout.starts, ids, side="right") - 1
        for s in np.unique(shard[ids >= 0]):
            mine = (shard == s) & (ids >= 0)
            out[mine] = self._map(f"counts-{s}", "<u8")[ids[mine] - self.layout.starts[s]]
        return out

    def _stats(self, kind: str, wide: int, ids: np.ndarray) -> np.ndarray:
        """The sums of sorted ids, 0 where there are none."""
        out = np.zeros((len(ids), wide), np.int64)
        part = (ids // np.uint64(STAT_IDS)).astype(np.int64)
        for s in np.unique(part):
            if s not in self.layout.stats or not len(at := self._map(f"{kind}ids-{s}", "<u4")):
                continue
            mine = np.flatnonzero(part == s)
            k = np.minimum(np.searchsorted(at, ids[mine].astype(np.uint32)), len(at) - 1)
            hit = at[k] == ids[mine]
            for j in range(wide):
                out[mine[hit], j] = self._map(f"{kind}stats{j}-{s}", self.layout.stats[s][f"{kind}{j}"])[k[hit]]
        return out

    def _shards(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each shard that has files, with the places of its rows."""
        order = np.argsort(shard, kind="stable")
        first, long = _runs(shard[order])
        for a, n in zip(first, long, strict=True):
            if (s := int(shard[order[a]])) in self.widths:
                yield s, order[a : a + n]

    def _at(self, name: str, s: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted keys (middle word, other word) are in a shard's file, and which are."""
        middles, high = self._map(f"middles-{s}", "<u4"), self._map(f"{name}-{s}", "<u4")
        if not len(high):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        v = (keys >> _HALF).astype(np.uint32)
        rank = np.minimum(np.searchsorted(middles, v), len(middles) - 1)
        known = middles[rank] == v
        mine, rest, kind = self.layout.keys(rank, keys & _LOW, len(middles))
        low = self._map(f"{name}-low-{s}", kind)
        k = np.searchsorted(high, mine)
        last = len(high) - 1
        left = np.flatnonzero(known)
        while len(left):
            # past the smaller rests behind an equal high part
            here = np.minimum(k[left], last)
            left = left[(k[left] <= last) & (high[here] == mine[left]) & (low[here] < rest[left])]
            k[left] += 1
        k = np.minimum(k, last)
        return k, known & (high[k] == mine) & (low[k] == rest)

    def _starts(self, s: int, k: np.ndarray) -> np.ndarray:
        return self._map(f"blocks-{s}", "<u4")[k // BLOCK].astype(np.int64) + self._map(f"starts-{s}", self.widths[s])[k]

    def _byte_counts(self, name: str, s: int, k: np.ndarray) -> np.ndarray:
        out = self._map(f"{name}-{s}", "u1")[k].astype(np.int64)
        many = np.flatnonzero(out == LISTED)
        if len(many):
            out[many] = self._map(f"{name}-counts-{s}", "<u8")[np.searchsorted(self._map(f"{name}-many-{s}", "<u4"), k[many].astype(np.uint32))]
        return out

    def _hot(self, keys: np.ndarray, name: str, values: str, dtype: str, wide: int) -> np.ndarray:
        """Rows of the second step of sorted keys."""
        out = np.zeros((len(keys), wide), np.int64)
        shard = self.layout.hot_shard(keys)
        for s in np.unique(shard):
            try:
                mine = np.flatnonzero(shard == s)
                at = self._map(f"{name}-{s}", "<u8")
            except FileNotFoundError:
                continue
            if not len(at):
                continue
            k = np.minimum(np.searchsorted(at, keys[mine]), len(at) - 1)
            hit = at[k] == keys[mine]
            out[mine[hit]] = self._map(f"{values}-{s}", dtype).reshape(-1, wide)[k[hit]]
        return out

    def _bigrams(self, keys: np.ndarray) -> np.ndarray:
        """Left neighbours of sorted keys of two words."""
        out = np.zeros(len(keys), np.int64)
        hot = self.layout.parts(keys >> _HALF) > 0
        if hot.any():
            out[hot] = self._hot(keys[hot], "hotkeys", "hotngrams", "<u4", 1)[:, 0]
        cold = np.flatnonzero(~hot)
        for s, at in self._shards(self.layout.shard(keys[cold])[0]):
            mine = cold[at]
            k, hit = self._at("keys", s, keys[mine])
            out[mine[hit]] = self._byte_counts("ngrams", s, k[hit])
        return out

    def _trigrams(self, contexts: np.ndarray, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums (all, seen once, twice, oftener) of sorted distinct contexts, and counts of the trigrams contexts[at], w."""
        first, over = self.layout.shard(contexts)
        stats, lo, hi = np.zeros((len(contexts), 4), np.int64), np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        wide = over > 0
        if wide.any():
            stats[wide] = self._hot(contexts[wide], "hotcontexts", "hotstats", "<u8", 4)
        cold = np.flatnonzero(~wide)
        for s, mine in self._shards(first[cold]):
            mine = cold[mine]
            k, hit = self._at("contexts", s, contexts[mine])
            k, mine = k[hit], mine[hit]
            lo[mine], hi[mine] = self._starts(s, k), self._starts(s, k + 1)
            n = hi[mine] - lo[mine]
            few = n < SHORT
            if not few.all():
                stats[mine[~few]] = self._map(f"longstats-{s}", "<u8").reshape(-1, 4)[np.searchsorted(self._map(f"long-{s}", "<u4"), k[~few].astype(np.uint32))]
            mine, n = mine[few], n[few]
            for j in range(SHORT - 1):
                own = mine[n > j]
                c = self._byte_counts("trigrams", s, lo[own] + j)
                stats[own, 0] += c
                stats[own, np.minimum(c, 3)] += 1
        out = np.zeros(len(w), np.int64)
        lo, hi, spread = lo[at], hi[at], wide[at]
        shard = self.layout.spread(first[at], over[at], w)
        for s, mine in self._shards(shard):
            if (some := mine[spread[mine]]).size:
                k, hit = self._at("contexts", s, contexts[at[some]])
                lo[some], hi[some] = np.where(hit, self._starts(s, k), 0), np.where(hit, self._starts(s, k + hit), 0)
            mine = mine[hi[mine] > lo[mine]]
            if not len(mine):
                continue
            followers = self._map(f"followers-{s}", "<u4")
            a, b, want = lo[mine], hi[mine], w[mine]
            open_ = np.flatnonzero(b - a > 1)
            while len(open_):
                mid = (a[open_] + b[open_]) >> 1
                less = followers[mid] <= want[open_]
                a[open_[less]], b[open_[~less]] = mid[less], mid[~less]
                open_ = open_[b[open_] - a[open_] > 1]
            hit = followers[a] == want
            out[mine[hit]] = self._byte_counts("trigrams", s, a[hit])
        return stats, out

    @staticmethod
    def _off(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        """Counts less their discounts."""
        return counts - np.array([0.0, *d])[np.minimum(counts, 3)]

    def words_log10(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted distinct ids (-1: unknown): token counts and lowest-order probabilities."""
        lay = self.layout
        base = np.full(len(ids), lay.gamma0 / (lay.vocabulary + 1))
        known = ids >= 0
        if lay.continuations:
            base[known] += self._off(self._stats("w", 1, ids[known].astype(np.uint64))[:, 0], lay.discounts[0]) / lay.continuations
        return self.counts(ids), base

    def _pairs(self, contexts: np.ndarray, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._stats("c", 4, contexts), self._bigrams((contexts[at] << _HALF) | w)

    @classmethod
    def _interpolate(cls, p: np.ndarray, contexts: np.ndarray, w: np.ndarray, real: np.ndarray, d, look_up) -> np.ndarray:
        """The next order's probabilities from those of the order below; where a context is unknown or never seen, they stay."""
        use = np.flatnonzero(real)
        distinct, at = np.unique(contexts[use], return_inverse=True)
        known = np.flatnonzero(w[use] >= 0)
        keys, back = np.unique((at[known].astype(np.uint64) << _HALF) | w[use[known]].astype(np.uint64), return_inverse=True)
        stats, seen = look_up(distinct, (keys >> _HALF).astype(np.int64), keys & _LOW)
        total = np.maximum(stats[:, 0], 1)
        p = p.copy()
        p[use] *= np.where(stats[:, 0] > 0, stats[:, 1:] @ np.array(d) / total, 1.0)[at]
        p[use[known]] += cls._off(seen, d)[back] / total[at[known]]
        return p

    def score(self, texts: list[list[bytes]]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, log10 probability) of each text with its end."""
        lay = self.layout
        end = self.lex.end() if lay.tokens else -1
        ids = [np.append(x, end) for x in (self.lex.ids(texts) if lay.tokens else [np.full(len(t), -1) for t in texts])]
        cuts = np.cumsum([0] + [len(x) for x in ids])[:-1]
        w = np.concatenate(ids)
        start = np.int64(START)
        v = np.append(start, w[:-1])
        v[cuts] = start
        u = np.append(start, v[:-1])
        u[cuts] = start
        distinct, at = np.unique(w, return_inverse=True)
        counts, low = self.words_log10(distinct)
        base = np.log10((counts + ADD) / (lay.tokens + ADD * (lay.vocabulary + 1)))
        p = low[at]
        if lay.tokens:
            p = self._interpolate(p, v.astype(np.uint64), w, v >= 0, lay.discounts[1], self._pairs)
            p = self._interpolate(p, (v.astype(np.uint64) << _HALF) | (u.astype(np.uint64) & _LOW), w, (v >= 0) & (u >= 0), lay.discounts[2], self._trigrams)
        add = lambda x: np.add.reduceat(x, cuts)
        return list(zip([len(x) for x in ids], add((counts > 0)[at].astype(np.int64)).tolist(), add(base[at]).tolist(), add(np.log10(p)).tolist(), strict=True))


def perplexity(score: float, tokens: int) -> float:
    return 10 ** (-score / tokens)


def _score(layout: Layout, widths: dict[int, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, held, size = Scorer(layout, widths), [], 0

        def out():
            rows = scorer.score([t for _, t in held])
            cols = [[i for i, _ in held], *zip(*rows, strict=True)]
            cols.insert(3, [layout.tokens] * len(held))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()] * 2, strict=True)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((i, words(text.as_py())))
                size += len(held[-1][1]) + 1
                if size > SCORE_TOKENS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def score_texts(docs: DataFrame, layout: Layout, widths: dict[int, str]) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score; a row for each row.

    A null or empty text is its end alone. With nothing trained every token is unknown and
    has the probability 1 in the model. Ids pass through; other columns are not read.
    """
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_score(layout, widths), "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~is_held_out()))
    return score_texts(docs, *model).select("doc_id", is_held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
