"""Approximate nearest neighbours by a permutation index.

A vector stands for the order of its nearest pivots. The index is split into blocks; a block
holds its vectors and, for each pivot, the list of rows that have it among their first
PREFIX pivots, with its place. A query walks the lists of its own first pivots, which
gives every row's footrule distance, and the nearest share of the block is ranked again by
the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Pivots are a sample of this many vectors; PREFIX of them represent a vector.
PIVOTS, PREFIX = 128, 32
#: Share of a block that is ranked again. Vectors without any structure need this much for a recall of 0.9.
SHARE = 0.3
BLOCK_ROWS, QUERY_ROWS = 8192, 1024


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, : min(PREFIX, pivots.shape[0])]


def search_block(ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, share: float) -> Iterator[tuple[int, int, float]]:
    """The k nearest rows of one block for each query, found through its inverted file."""
    by_id = np.argsort(ids, kind="stable")
    ids, x = ids[by_id], x[by_id]
    order = _orders(x, pivots)
    m = order.shape[1]
    flat = order.ravel()
    post = np.argsort(flat, kind="stable")
    ends = np.searchsorted(flat[post], np.arange(len(pivots) + 1))
    rows, places = (post // m), (post % m).astype(np.int32)
    norms = np.linalg.norm(x, axis=1)
    take = min(len(ids), max(int(np.ceil(share * len(ids))), 20 * k) + 1)
    for qid, v, firsts in zip(qids, q, _orders(q, pivots), strict=True):
        near = np.zeros(len(ids), np.int32)  # what the footrule distance is below that of disjoint orders
        for place, p in enumerate(firsts):
            s = slice(ends[p], ends[p + 1])
            near[rows[s]] += 2 * (m - np.maximum(place, places[s]))
        best = np.argsort((-near).astype(np.int16), kind="stable")[:take]
        best = best[ids[best] != qid]
        score = (x[best] @ v) / (norms[best] * np.linalg.norm(v))
        for i in np.lexsort((ids[best], -score))[:k]:
            yield int(qid), int(ids[best[i]]), float(score[i])


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows that take part, repeated (id, vector) rows once."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec")).dropDuplicates()


def _pack(table: pa.Table) -> pa.Table:
    dim = len(table.column("vec")[0])
    part = lambda c: table.column(c).slice(0, 1)
    return pa.table({"dim": part("dim"), "block": part("block"), "ids": pa.array([table.column("id").to_numpy().astype("<i8").tobytes()]), "vecs": pa.array([_matrix(table.column("vec"), dim).tobytes()])})


def permutation_search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", share: float = SHARE) -> DataFrame:
    """vectors(id, vector) -> query_id, rank, id, score: each query's k nearest other rows.

    ``is_query`` is a condition on the column id. Score is the cosine in double precision of the
    vectors as given; ties go to the smaller id. Rows of the query's own id are no
    candidates; repeated equal rows count once; with fewer than k candidates all are returned. Vectors of
    different lengths have no cosine: each length is an index of its own. Null ids,
    and vectors that are null, zero, or hold null or non-finite components take no part. Nothing valid gives no rows.

    Queries and rows meet in blocks: a task holds one block of each. Blocks are dealt by a
    hash of the id, so equal vectors are spread. The driver gets PIVOTS vectors and two counts of each length.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    good = staged(_valid(vectors, id_col, vec_col).withColumn("dim", F.size("vec")), "vectors")
    counts = {r.dim: (r.n, r.q) for r in good.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).collect()}
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not counts:
        return spark.createDataFrame([], schema)
    first = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id"))
    pivots: dict = {dim: [] for dim in counts}
    for r in good.withColumn("n", first).where(F.col("n") <= PIVOTS).orderBy("dim", "n").collect():
        pivots[r.dim].append(r.vec)
    pivots = {dim: (x := np.array(v)) / np.linalg.norm(x, axis=1, keepdims=True) for dim, v in pivots.items()}

    def blocks(place: int, rows: int):
        """The number of blocks of each length."""
        return F.element_at(F.create_map(*[F.lit(x) for dim, c in counts.items() for x in (dim, max(1, -(-c[place] // rows)))]), F.col("dim"))

    block = lambda count: F.pmod(F.xxhash64("id", F.lit(7)), count).cast("int").alias("block")
    packed = "dim int, block int, ids binary, vecs binary"
    index = staged(good.select("*", block(blocks(0, BLOCK_ROWS))).groupBy("dim", "block").applyInArrow(_pack, packed), "index")
    asked = good.where(is_query).select("*", block(blocks(1, QUERY_ROWS))).groupBy("dim", "block").applyInArrow(_pack, packed).toDF("dim", "qblock", "qids", "qvecs")
    meetings = sum(max(1, -(-n // BLOCK_ROWS)) * max(1, -(-q // QUERY_ROWS)) for n, q in counts.values())
    # shuffled: Spark takes the queries for small, but here they stand once for each block of the index, which the driver could not hold
    pairs = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks(0, BLOCK_ROWS) - 1))).repartition(max(2, min(meetings, 2000)), "dim", "block", "qblock").join(index.hint("shuffle_merge"), ["dim", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                at = {c: batch.column(batch.schema.get_field_index(c))[r].as_py() for c in ("dim", "ids", "vecs", "qids", "qvecs")}
                read = lambda a, b: (np.frombuffer(at[a], "<i8"), np.frombuffer(at[b]).reshape(-1, at["dim"]))  # noqa: E731, B023
                rows = list(search_block(*read("ids", "vecs"), pivots[at["dim"]], *read("qids", "qvecs"), k, share))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors; see permutation_search() for nulls, ties, repeated rows and empty input."""
    return permutation_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
