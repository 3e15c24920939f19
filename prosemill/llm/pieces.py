"""SentencePiece BPE by vectorised merge rounds: whole batches of words are merged as flat arrays.

A text is cut into words where no piece can span the cut, each distinct word of a batch is merged
once, and every round merges, in all unfinished words at once, the leftmost pairs of a word's least rank.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SPACE = "▁"
#: Symbols are ids of pieces, or this and the code point where a character is no piece.
LONE = 1 << 21
NONE = np.iinfo(np.int64).max
#: Words (and their characters) whose pieces a worker keeps; beyond, it starts anew after the batch.
KEPT_WORDS, KEPT_CHARS = 500_000, 20_000_000

codecs.register_error("prosemill-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places starts[i] .. starts[i] + lengths[i] - 1 for each i, in a row."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """The tables of a model file: BPE with byte fallback, identity normalisation, a space in front, white space kept.

    Other kinds of model are refused with a ValueError.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        norm, kind = model.normalizer_spec, proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError(f"{path}: no BPE model with byte fallback and identity normalisation")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: pieces that users define, or that are not used, are not known here")
        self.eos, self.bos = model.trainer_spec.eos_id, model.trainer_spec.bos_id
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            raise ValueError(f"{path}: a piece spans two words")
        # equal scores have one rank: the leftmost of them goes first
        rank = {s: i for i, s in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}
        self.char = np.arange(LONE, LONE + 0x110000, dtype=np.int64)
        for p, i in normal.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        pairs = {}
        for p, i in normal.items():
            for at in range(1, len(p)):
                halves = p[:at], p[at:]
                if all(x in normal or len(x) == 1 for x in halves):
                    left, right = (normal.get(x, LONE + ord(x[0])) for x in halves)
                    pairs[left << 32 | right] = rank[model.pieces[i].score], i
        self.pairs, keys = pairs, sorted(pairs)
        self.keys = np.array([*keys, NONE], np.int64)
        self.ranks = np.array([*(pairs[k][0] for k in keys), NONE], np.int64)
        self.made = np.array([*(pairs[k][1] for k in keys), 0], np.int64)
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.byte = np.array([byte[b] for b in range(256)], np.int64)
        shown = [b"" if p.type == kind.CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else model.trainer_spec.unk_surface.encode() if p.type == kind.UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.control = np.array([p.type == kind.CONTROL for p in model.pieces])
        self.spaced = np.array([p.type == kind.NORMAL and p.piece[0] == SPACE for p in model.pieces])
        self.shown, self.shown_len = np.frombuffer(b"".join(shown), np.uint8), np.array([len(x) for x in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_len) - self.shown_len

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair makes; NONE where it makes none."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def in_order(self, sym: list[int]) -> list[int]:
        """One word, pair after pair: the best rank first, the leftmost of equal ones."""
        pairs, n = self.pairs, len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        todo: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (found := pairs.get(sym[i] << 32 | sym[after[i]])):
                heapq.heappush(todo, (found[0], i, sym[i], sym[after[i]]))

        for i in range(n - 1):
            offer(i)
        while todo:
            _, i, left, right = heapq.heappop(todo)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue
            sym[i], sym[j], after[i] = pairs[left << 32 | right][1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in sym if s >= 0]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row, and how many each has.

        A round takes each word's least rank and merges its occurrences from the left, those that overlap a
        merged one excepted. That equals one merge after the other unless a merged piece makes a pair, with a
        neighbour of that moment, of a rank as good: such a word is done pair after pair.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), lengths)
        out_sym, out_word = [], []
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], made[inside] = self.look(sym[inside], sym[inside + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            at = np.flatnonzero((rank == least) & (rank != NONE))
            run = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1]) if len(at) else at
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            new = made[at]
            # the neighbours at the moment of the merge: the one to the left may be merged already
            left = at > 0
            left[left] = word[at[left] - 1] == word[at[left]]
            glued = np.r_[False, at[1:] == at[:-1] + 2] & left if len(at) else left
            left_sym = np.where(glued, np.r_[0, new[:-1]] if len(at) else new, sym[at - 1])
            right = at + 2 < len(sym)
            right[right] = word[at[right] + 2] == word[at[right]]
            clash = left & (self.look(left_sym, new)[0] <= rank[at])
            clash |= right & (self.look(new, sym[np.minimum(at + 2, len(sym) - 1)])[0] <= rank[at])
            odd = np.zeros(len(words), bool)
            odd[word[at[clash]]] = True
            done = (least == NONE) | odd[word]
            if done.any():
                for k in np.flatnonzero(odd[word[starts]]):
                    w, ids = word[starts[k]], self.in_order(sym[starts[k] : starts[k] + sizes[k]].tolist())
                    out_sym.append(np.array(ids, np.int64))
                    out_word.append(np.full(len(ids), w))
                fine = done & ~odd[word]
                out_sym.append(sym[fine])
                out_word.append(word[fine])
            keep = ~done
            go = ~done[at]
            at, new = at[go], new[go]
            sym[at] = new
            keep[at + 1] = False
            # what stands at and before a merged piece makes new pairs
            fresh = np.zeros(len(sym), bool)
            fresh[at] = True
            sym, word, rank, made, fresh = sym[keep], word[keep], rank[keep], made[keep], fresh[keep]
            fresh[:-1] |= fresh[1:].copy()
            i = np.flatnonzero(fresh)
            rank[i] = NONE
            i = i[i + 1 < len(sym)]
            i = i[word[i] == word[i + 1]]
            rank[i], made[i] = self.look(sym[i], sym[i + 1])
        sym, word = np.concatenate([*out_sym, np.zeros(0, np.int64)]), np.concatenate([*out_word, np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        lone = np.flatnonzero(sym >= LONE)
        if len(lone):
            raw = [chr(c).encode() for c in (sym[lone] - LONE).tolist()]
            many = np.ones(len(sym), np.int64)
            many[lone] = [len(b) for b in raw]
            first = np.cumsum(many) - many
            word, sym = np.repeat(word, many), np.repeat(sym, many)
            sym[_gather(first[lone], many[lone])] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, np.bincount(word, minlength=len(words))

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each array of ids; control ids show nothing, bytes that are no UTF-8 show U+FFFD each."""
        flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
        lengths = self.shown_len[flat]
        ends = np.cumsum(np.r_[0, lengths])
        content = self.shown[_gather(self.shown_at[flat], lengths)].tobytes()
        out, at = [], 0
        for one in ids:
            first = np.flatnonzero(~self.control[one])[:1]
            skip = int(len(first) and self.spaced[one[first[0]]])
            # the bytes of a character stand together: a control id between them parts them
            cuts = np.maximum([ends[at], *ends[at + np.flatnonzero(self.control[one])], ends[at + len(one)]], ends[at] + skip)
            out.append("".join(content[a:b].decode("utf-8", "prosemill-each-byte") for a, b in pairwise(cuts)))
            at += len(one)
        return out


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Encoder:
    """Ids of texts, with the pieces of the words met so far."""

    def __init__(self, path: str):
        self.pieces = _pieces(path)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.count, self.chars = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(w for words in cut for w in words) if w not in self.place]
        if new:
            flat, count = self.pieces.merge(new)
            for w in new:
                self.place[w] = len(self.place)
            self.flat, self.count = np.r_[self.flat, flat], np.r_[self.count, count]
            self.chars += sum(map(len, new))
        starts = np.cumsum(self.count) - self.count
        out = []
        for words in cut:
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            out.append(self.flat[_gather(starts[at], self.count[at])])
        if len(self.place) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.clear()
        return out


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """df's columns, one of that name (upper or lower case) excepted, and the new one."""
    return T.StructType([f for f in df.schema.fields if f.name.lower() != name.lower()]).add(name, kind)


def encode(df: DataFrame, model: str, column: str = "text", out: str = "ids", eos: bool = True) -> DataFrame:
    """Adds ``out``, the ids of the whole text by the model file, with the end id where ``eos``.

    The ids are those of the sentencepiece library without sampling or start id. A null or empty text has none
    but the end id. All rows and other columns stay, repeated ones too; a column of the name ``out`` is replaced. No rows give no rows.
    """
    small_batches(df.sparkSession, 200)
    schema = _with(df, out, T.ArrayType(T.IntegerType()))
    rest = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        end = [encoder.pieces.eos] if eos else []
        for batch in batches:
            ids = [np.append(x, end).astype(np.int32) for x in encoder.encode([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])]
            at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            made = pa.ListArray.from_arrays(at, np.concatenate([*ids, np.zeros(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*rest, out])

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`").alias("_in")).mapInArrow(run, schema)


def decode(df: DataFrame, model: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the text of an array of ids, as the library's decode() gives it; null for null, empty for an empty array.

    Ids must be the model's. All rows and other columns stay; a column of the name ``out`` is replaced.
    """
    small_batches(df.sparkSession, 200)
    schema = _with(df, out, T.StringType())
    rest = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            texts = pieces.decode([np.asarray(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64) for x in ids])
            shown = pa.array([t if x.is_valid else None for t, x in zip(texts, ids, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], shown], names=[*rest, out])

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`").alias("_in")).mapInArrow(run, schema)


def public_model(name: str = "piece_bpe_32k.model") -> str:
    """The public model's path; workers find it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all whole documents and the texts decoded from them, as digests; see encode() and decode() for nulls, repeated rows and empty input."""
    model = public_model()
    ids = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), model).select("doc_id", "ids")
    return decode(ids, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )
