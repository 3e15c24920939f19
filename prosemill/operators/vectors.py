"""Vector search over unit vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Query rows that are multiplied with a batch of vectors at once.
QUERY_BLOCK = 256
#: Queries whose results are given out at once.
OUT_ROWS = 4096
#: Bytes of queries that driver and tasks hold at once.
SENT_BYTES = 16 << 20


def dot(a: Column, b: Column) -> Column:
    """ARR5 in double precision; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """ARR6; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def _best(sent, k: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = sent.value
        # the best so far as numbers, not objects: 16 bytes for each of k rows of a query
        scores, found, n = np.zeros((len(qids), k)), np.zeros((len(qids), k), np.int64), np.zeros(len(qids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            for at in range(0, len(qids), QUERY_BLOCK):
                near = q[at : at + QUERY_BLOCK] @ x.T
                if exclude_self:
                    near[qids[at : at + QUERY_BLOCK, None] == ids] = -np.inf
                m = min(k, len(ids))
                # the product rounds as it likes: what is as near as the k-th but for that is summed again in order
                least = np.partition(near, len(ids) - m, axis=1)[:, len(ids) - m]
                least -= 1e-9 * (1 + np.abs(least))
                # so does what is as near as the k-th of the batches before
                full = n[at : at + QUERY_BLOCK] == k
                last = scores[at : at + QUERY_BLOCK, -1]
                least = np.where(full, np.maximum(least, last - 1e-9 * (1 + np.abs(last))), least)
                for i in np.flatnonzero((near >= least[:, None]).any(axis=1)).tolist():
                    some = np.flatnonzero((near[i] >= least[i]) & (near[i] > -np.inf))
                    r = at + i
                    s = np.append(scores[r, : n[r]], (x[some] * q[r]).cumsum(axis=1)[:, -1])
                    v = np.append(found[r, : n[r]], ids[some])
                    order = np.lexsort((v, -s))[:k]
                    n[r] = len(order)
                    scores[r, : n[r]], found[r, : n[r]] = s[order], v[order]
        for at in range(0, max(1, len(qids)), OUT_ROWS):
            some = slice(at, at + OUT_ROWS)
            fine = np.arange(k) < n[some, None]
            cols = (np.repeat(qids[some], n[some]), found[some][fine], scores[some][fine])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "id", "score"])

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """JN3 + WIN1: queries(query_id, qvec) against vectors(id, vec) -> query_id, rank, id, score; integer ids, vectors of one length.

    Queries go to the tasks in blocks of at most some SENT_BYTES, one block at a time: a pass over the vectors each, whose results are
    written before the next block is sent. Batches of vectors are multiplied with blocks of queries; each task carries the best k of every
    query from batch to batch, so k rows a query and task are shuffled. Scores are summed in the order of the components; ties go to the
    smaller id. Null and empty vectors, and rows with null ids, take no part.
    """
    rows = queries.where("query_id is not null and size(qvec) > 0").select(F.col("query_id").cast("bigint"), F.col("qvec").cast("array<double>").alias("qvec"))
    asked, length = rows.agg(F.count("*"), F.coalesce(F.max(F.size("qvec")), F.lit(0))).first()
    spark = vectors.sparkSession
    blocks = vectors.where("id is not null and size(vec) > 0").select(F.col("id").cast("bigint").alias("id"), "vec")
    many = asked * length * 8 // SENT_BYTES + 1
    found = spark.createDataFrame([], "query_id bigint, id bigint, score double")
    for i in range(many if asked else 0):
        got = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(many)) == i).collect()
        if not got:
            continue
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.float64)))
        part = blocks.mapInArrow(_best(sent, k, exclude_self), "query_id bigint, id bigint, score double")
        if many > 1:
            part = staged(part, "hits")
            sent.unpersist()
        found = part if i == 0 else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def gate(hits: DataFrame, least: float, value: str = "passage") -> DataFrame:
    """FLT8: rows stay; the context is null below the score."""
    return hits.withColumn("context", F.when(F.col("score") >= least, F.col(value)))


def rerank(candidates: DataFrame) -> DataFrame:
    """SRT2: by ce_score, ties in the first order; both scores stay apart."""
    order = Window.partitionBy("query_id").orderBy(F.desc("ce_score"), "rank")
    return candidates.withColumn("new_rank", F.row_number().over(order))


def score_pairs(candidates: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], question: str = "question", passage: str = "passage", batch: int = 64) -> DataFrame:
    """MDL6: adds ce_score, what the scorer says of each (question, passage), ``batch`` pairs a call. Null texts are scored as empty ones.

    The score of the first search stays in its own column: the two have different scales.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            two = list(zip(f[question].fillna(""), f[passage].fillna(""), strict=True))
            yield f.assign(ce_score=[float(s) for at in range(0, len(two), batch) for s in scorer(two[at : at + batch])])

    fields = ", ".join(f"`{n}` {t}" for n, t in candidates.dtypes)
    return candidates.mapInPandas(run, f"{fields}, ce_score double")
