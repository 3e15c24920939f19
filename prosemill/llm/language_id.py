"""Language identification with string kernels.

The kernel of two texts is the number of hashed character n-grams (n from 1 to 3) that both
have, over the root of the product of both numbers. Landmarks (Nyström) turn it into a few
features, on which one-versus-rest ridge regression is fitted; batches of texts are scored by
matrix products with the landmarks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import lookup_join, small_batches, staged

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
#: The classifier is fitted on a sample of labelled texts: about TEXTS_PER_LANG of each language, and MAX_TEXTS (4 KB each) in all,
#: an equal share for each language. So all of up to MAX_TEXTS languages are learned.
TEXTS_PER_LANG, MAX_TEXTS = 300, 20_000
#: Landmarks of each language and in all; with more languages than MAX_LANDMARKS, some languages have none, but all have weights.
LANDMARKS_PER_LANG, MAX_LANDMARKS, RIDGE = 24, 512, 0.05
SCORE_ROWS, FIT_ROWS = 64, 512
#: Characters that are hashed at once; a long text is taken in such parts, which overlap.
PART = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, 1 for anything else."""
    table = np.ones(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        if (c := chr(i)).isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def presence(text: str | None) -> np.ndarray | None:
    """Which buckets the n-grams of the whole text hit, or None if it has no letter.

    Letters are lower-cased; every run of other characters counts as one gap.
    """
    if not text:
        return None
    out, any_letter = np.zeros(BUCKETS, bool), False
    overlap = max(ORDERS) - 1
    carry = np.ones(1, np.uint32)
    for at in range(0, len(text), PART):
        raw = np.frombuffer(text[at : at + PART].encode("utf-32-le", "replace"), np.uint32)
        x = np.concatenate([carry, _letters()[raw], [1] if at + PART >= len(text) else []]).astype(np.uint32)
        gap = x == 1
        x = x[np.append(True, ~(gap[1:] & gap[:-1]))]
        any_letter |= bool((x != 1).any())
        h = np.zeros(len(x), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(x) < n:
                break
            h = (h[: len(x) - n + 1] ^ x[n - 1 :]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if n in ORDERS:
                out[(h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)] = True
        carry = x[-overlap:]
    return out if any_letter else None


class Model:
    """Landmarks (rows scaled to unit kernel), weights on their kernel values, languages."""

    def __init__(self, landmarks: np.ndarray, weights: np.ndarray, langs: list[str]):
        self.landmarks, self.weights, self.langs = landmarks, weights, langs

    def kernel(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        return (x @ self.landmarks.T) / np.sqrt(x.sum(axis=1, keepdims=True))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the languages and scores; a score is the winner's regression value, from -1..1 put to 0..1."""
        f = self.kernel(x) @ self.weights
        best = f.argmax(axis=1)
        return best, (np.clip(f[np.arange(len(f)), best], -1, 1) + 1) / 2


def fit(packed: list[bytes], y: list[str]) -> Model | None:
    """Fits on packed presence rows and their labels; the first rows of a language are its landmarks.

    Rows are unpacked FIT_ROWS at a time, and only sums over them are kept.
    """
    langs = sorted(set(y))
    if not langs:
        return None
    rows = lambda of: np.unpackbits(np.frombuffer(b"".join(packed[i] for i in of), np.uint8).reshape(len(of), -1), axis=1)
    number = {v: i for i, v in enumerate(langs)}
    place = np.array([number[v] for v in y])
    each = max(1, min(LANDMARKS_PER_LANG, MAX_LANDMARKS // len(langs)))
    order = np.argsort(place, kind="stable")
    inside = np.arange(len(order)) - np.searchsorted(place[order], place[order])
    chosen = order[inside < each]
    if len(chosen) > MAX_LANDMARKS:
        chosen = chosen[np.linspace(0, len(chosen) - 1, MAX_LANDMARKS).astype(int)]
    z = rows(chosen).astype(np.float32)
    z /= np.sqrt(z.sum(axis=1, keepdims=True))
    model = Model(z, np.zeros(0), langs)
    kzz = np.concatenate([model.kernel(rows(chosen[at : at + FIT_ROWS])) for at in range(0, len(chosen), FIT_ROWS)]).astype(np.float64)
    vals, vecs = np.linalg.eigh((kzz + kzz.T) / 2)
    root = vecs / np.sqrt(np.maximum(vals, 1e-6)) @ vecs.T
    # every language weighs the same, whatever its number of texts
    weight = (1 / np.bincount(place))[place] * len(place) / len(langs)
    square, sums = np.zeros((len(chosen), len(chosen))), np.zeros((len(langs), len(chosen)))
    for at in range(0, len(place), FIT_ROWS):
        some = np.arange(at, min(at + FIT_ROWS, len(place)))
        phi = model.kernel(rows(some)).astype(np.float64) @ root
        mine = weight[some, None] * phi
        square += phi.T @ mine
        np.add.at(sums, place[some], mine)
    # the targets are 1 for a row's language and -1 for the others
    fitted = np.linalg.solve(square + RIDGE * np.eye(len(square)), (2 * sums - sums.sum(axis=0)).T)
    model.weights = (root @ fitted).astype(np.float32)
    return model


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, lang, np.packbits(x).tobytes()) for k, lang, text in zip(*[c.to_pylist() for c in batch.columns], strict=True) if (x := presence(text)) is not None]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["k", "lang", "x"])


def train(labelled: DataFrame) -> Model | None:
    """labelled(doc_id, text, lang) -> a model from about TEXTS_PER_LANG texts of each language, MAX_TEXTS in all.

    Rows are taken by a hash of the id (of the text where the id is null), at a rate set by the language's count, so the sample is
    bounded whatever the input. What reaches the driver is its packed presence rows. A label beyond
    MAX_TEXTS others may have no row in the sample, and is then not predicted.
    Null labels and texts without letters are left out; None if nothing is left.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    labelled = labelled.where("lang is not null").select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    counts = staged(counts, "langs")
    langs = counts.count()
    if not langs:
        return None
    rates = counts.select("lang", F.least(F.lit(1.0), min(TEXTS_PER_LANG, MAX_TEXTS / langs) / F.col("n")).alias("rate"))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(4))).otherwise(F.xxhash64("doc_id", F.lit(3)))
    picked = lookup_join(labelled.withColumn("k", key), rates, "lang", F.col("k"), "inner").where(F.shiftrightunsigned("k", 11) / float(1 << 53) < F.col("rate"))
    rows = picked.select("k", "lang", "text").mapInArrow(_featurize, "k bigint, lang string, x binary").collect()
    rows.sort(key=lambda r: (r.k, r.lang, r.x))
    return fit([bytes(r.x) for r in rows], [r.lang for r in rows]) if rows else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score; a row for each row.

    A null text or one without a letter is ``und`` with score 0, as is everything if there is no model.
    Only id and text are read; ids, also null or repeated ones, pass through.
    """
    tagged = tag(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), model)
    return tagged.select("doc_id", "lang_pred", "score")


def tag(docs: DataFrame, model: Model | None) -> DataFrame:
    """Any table with a column text -> its rows and columns, and lang_pred and score (which replace columns of these names)."""
    docs = docs.drop("lang_pred", "score")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            lang, score = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            rows, places = [], []

            def flush():
                if rows:
                    for i, b, s in zip(places, *model.predict(np.array(rows)), strict=True):  # noqa: B023
                        lang[i], score[i] = model.langs[b], float(s)  # noqa: B023
                    rows.clear()  # noqa: B023
                    places.clear()  # noqa: B023

            for i, text in enumerate(texts):
                if model and (x := presence(text.as_py())) is not None:
                    rows.append(x)
                    places.append(i)
                if len(rows) == SCORE_ROWS:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: str) -> Column:
    """crc32 of the id as text mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; see train() and identify() for nulls, ties, repeated rows and empty input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out("doc_id")))
    out = identify(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
