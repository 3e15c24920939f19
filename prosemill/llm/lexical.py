"""Ranked lexical search by TPUT over postings that are partitioned by term.

Three uniform phases, each a scan of the lists and a join: the head of every list gives lower bounds, one
threshold for all lists of an item fetches what can still matter, and the scores of the candidates that
are left are looked up exactly. Scores are whole numbers, so the result is the one of an exhaustive search.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, lookup_join, small_batches, staged

#: Documents for an item.
TOP = 10
#: Rows for each of the TOP whose whole scores are looked up for the first bound; more of them raise it.
PROBES = 10
#: Terms of items that are searched at once, and cells of a table of rows and items in a task.
BLOCK_ASKS, CELLS = 200_000, 2_000_000
RESULT = "item bigint, rank int, doc_id bigint, score bigint"
#: Distinct terms of the queries up to which they go to the workers, so that no other postings are made.
SENT_TERMS = 200_000
#: A slice of a term's list holds what this many tasks of the first scan found, as a power of two.
SLICE_TASKS = 3

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z lower-cased, what stands between terms as blanks, all else as it is.
_FOLD = bytes(ord(" ") if b not in _LETTERS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
TERM_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, in UTF-8: a byte of a character beyond ASCII never is a byte of ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def query_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): the distinct terms of each item; rows of one id are one item, null ids take no part."""
    found = F.split(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER), TERM_GAP)
    rows = items.where(F.col(f"`{item}`").isNotNull()).select(F.col(f"`{item}`").cast("bigint").alias("item"), F.explode(found).alias("term"))
    return rows.where("term <> ''").distinct()


def _counted(wanted: frozenset[bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own, counts, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                found = terms(text)
                n.append(len(found))
                times = Counter(found)
                some = list(times) if wanted is None else [t for t in times if t in wanted]
                own += some
                counts += [times[t] for t in some]
                ends.append(len(own))
            ends = pa.array(ends, pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(own, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return run


class Postings:
    """Lists (term, row, f) of the documents, f being a term's saturated frequency there, in order of term and falling f.

    A list is cut into slices that are written by tasks of their own, so a frequent term is no hot key. ``docs`` has a row
    (row, doc_id, n) for each document; ``weights`` one (term, df, w, f_max) for each term, which falls with df.
    """

    def __init__(self, docs: DataFrame, wanted: DataFrame | None = None):
        """docs(doc_id, text). Only the terms in ``wanted`` (term), where given, are posted; statistics are of all terms.

        A null or empty text is no document of the statistics and is never found. A null doc_id and a repeated
        one are documents of their own. Other columns are not read.
        """
        spark = docs.sparkSession
        small_batches(spark)
        sent = None
        if wanted is not None and wanted.count() <= SENT_TERMS:
            sent = frozenset(r[0].encode() for r in wanted.collect())
        read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
        rows = read.mapInArrow(_counted(sent), "doc_id bigint, n bigint, terms array<string>, tf array<int>").where("n > 0")
        # the number is fixed once the rows are written
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "term-counts")
        self.n_docs, self.n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.docs = rows.select("row", "doc_id", "n")
        one = rows.select("row", "n", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select(F.col("p.terms").alias("term"), "row", F.col("p.tf").cast("long").alias("tf"), "n")
        if wanted is not None and sent is None:
            one = lookup_join(one, wanted.select("term").distinct(), "term", F.col("row"), "left_semi")
        m = F.expr(f"10 + (90 * n * {self.n_docs}L) div {max(1, self.n_terms)}L")
        lists = one.withColumn("_m", m).select("term", "row", F.expr("(1000000000 * tf) div (1000 * tf + 8 * _m)").alias("f"))
        part = F.shiftright("row", 33 + SLICE_TASKS)
        self.lists = staged(lists.repartition("term", part).sortWithinPartitions("term", F.desc("f"), "row"), "postings")
        w = F.floor(1000 * F.log((2 * F.lit(float(self.n_docs)) + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
        self.weights = staged(self.lists.groupBy("term").agg(F.count("*").alias("df"), F.max("f").alias("f_max")).withColumn("w", w), "term-weights")


def _best(scores: DataFrame, k: int, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("s"), *order))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)


def _kth(scores: DataFrame, k: int) -> dict[int, int]:
    """The k-th best of (item, row, s) of each item; 0 where there are fewer."""
    best = _best(scores, k).groupBy("item").agg(F.count("*").alias("n"), F.min("s").alias("s"))
    return {r.item: r.s if r.n == k else 0 for r in best.collect()}


def _sums(items: list[tuple[int, int, int]], asks: list[tuple[int, int, int, int, int]], n_terms: int):
    """(row, t, f) in order of row -> (item, row, s, most): sums of the entries at or above the items' thresholds, where most, which no score exceeds, reaches the item's bound.

    items: (item, sum of caps, bound); asks: (term's number, place of the item, w, f_min, cap) in order of terms. Sums are
    of doubles, which are exact here: a weight is below 10^5, f at most 10^6, and an item has less than 9 * 10^4 terms.
    """
    ids, caps, bound = (np.array(c, np.int64) for c in zip(*items, strict=True))
    term, item, w, f_min, cap = (np.array(c, np.int64) for c in zip(*asks, strict=True))
    starts = np.searchsorted(term, np.arange(n_terms + 1))

    def scores(row: np.ndarray, t: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        place = np.cumsum(np.r_[False, row[1:] != row[:-1]])
        many = starts[t + 1] - starts[t]
        ends = np.cumsum(many)
        entry = np.repeat(np.arange(len(t)), many)
        ask = np.repeat(starts[t] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)
        fine = f[entry] >= f_min[ask]
        entry, ask = entry[fine], ask[fine]
        cell, size = place[entry] * len(ids) + item[ask], (place[-1] + 1) * len(ids)
        s = np.bincount(cell, w[ask] * f[entry], size).astype(np.int64)
        most = s - np.bincount(cell, cap[ask], size).astype(np.int64) + np.tile(caps, place[-1] + 1)
        some = np.flatnonzero((s > 0) & (most >= np.tile(bound, place[-1] + 1)))
        rows = row[np.flatnonzero(np.r_[True, row[1:] != row[:-1]])]
        cols = ids[some % len(ids)], rows[some // len(ids)], s[some], most[some]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "row", "s", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.r_[h, c.to_numpy(zero_copy_only=False).astype(np.int64)] for h, c in zip(held, batch.columns, strict=True)]
            # the last row may go on in the next batch; so many rows at once that their table stays small
            borders = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            step = max(1, CELLS // len(ids))
            cuts = np.r_[0, borders[step - 1 :: step], borders[-1:]] if len(borders) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    yield scores(*(h[a:b] for h in held))
            held = [h[cuts[-1] :] for h in held]
        if len(held[0]):
            yield scores(*held)

    return run


class _Block:
    """Some BLOCK_ASKS rows of (item, term, w, f_max), which the driver and every task hold, and the scores of rows for them."""

    def __init__(self, lists: DataFrame, q: DataFrame):
        self.lists, self.asks = lists, [tuple(r) for r in q.select("item", "term", "w", "f_max").collect()]
        self.items = sorted({a[0] for a in self.asks})
        self.terms = {t: i for i, t in enumerate(sorted({a[1] for a in self.asks}))}

    def scores(self, bound: dict[int, int], thresholds: dict[int, int] | None = None, rows: DataFrame | None = None) -> DataFrame:
        """(item, row, s, most): sums of the entries with w * f at or above the item's threshold (of all, without one), in ``rows`` (row) if given.

        Without thresholds s is the score. most is s and what the entries below the thresholds can add; where it stays below the item's bound, nothing is given.
        """
        spark, at = self.lists.sparkSession, {x: i for i, x in enumerate(self.items)}
        asks, caps, least = [], dict.fromkeys(self.items, 0), {}
        for item, term, w, f_max in self.asks:
            low = (thresholds or {}).get(item, 0)
            cap, f_min, t = max(0, min(low - 1, w * f_max)), -(-low // w), self.terms[term]
            asks.append((t, at[item], w, f_min, cap))
            caps[item] += cap
            least[t] = min(f_min, least.get(t, f_min))
        known = spark.createDataFrame([(x, t, least[t]) for x, t in self.terms.items()], "term string, t int, least bigint")
        given = self.lists
        if rows is not None:
            # a row has no more entries than its text has terms, so it is no hot key
            given = given.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "row")
        given = lookup_join(given, known, "term", F.col("row"), "inner").where("f >= least").select("row", "t", F.col("f").cast("int").alias("f"))
        run = _sums([(x, caps[x], bound.get(x, 0)) for x in self.items], sorted(asks), len(self.terms))
        return staged(given.repartition("row").sortWithinPartitions("row").mapInArrow(run, "item bigint, row bigint, s bigint, most bigint"), "scores")


def _search_block(postings: Postings, heads: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """search() for some BLOCK_ASKS rows of q(item, term, w, f_max)."""
    block = _Block(postings.lists, q)
    if not block.items:
        return q.sparkSession.createDataFrame([], RESULT)
    # 1: partial sums from the heads of the lists; the rows that are best by them are looked up whole, which raises the bound
    low = staged(heads.join(q, "term").groupBy("item", "row").agg(F.sum(F.col("w") * F.col("f")).alias("s")), "head-sums")
    probes = staged(_best(low, PROBES * k).select("row").distinct(), "probes")
    bound = _kth(block.scores(_kth(low, k), rows=probes), k)

    # 2: what lies below T = bound / m in each of m lists adds up to less than the bound; each list gives all else, once for all items
    many = Counter(a[0] for a in block.asks)
    seen = block.scores(bound, {x: -(-bound.get(x, 0) // m) for x, m in many.items()})
    better = {x: max(b, bound.get(x, 0)) for x, b in _kth(seen, k).items()}
    limits = q.sparkSession.createDataFrame(list(better.items()), "item bigint, least bigint")
    left = staged(lookup_join(seen, limits, "item", F.col("row"), "inner").where("most >= least").select("row").distinct(), "candidates")

    # 3: exact scores of the candidates that are left
    exact = block.scores({x: max(1, b) for x, b in better.items()}, rows=left)
    top = staged(exact.withColumn("_r", F.rank().over(Window.partitionBy("item").orderBy(F.desc("s")))).where(F.col("_r") <= k).select("item", "row", "s"), "best")
    named = postings.docs.select("row", "doc_id").join(top, "row")
    return _best(named, k, F.asc_nulls_last("doc_id"), F.col("row")).select("item", "rank", "doc_id", F.col("s").alias("score"))


def search(postings: Postings, asked: DataFrame, k: int = TOP) -> DataFrame:
    """asked(item, term) -> item, rank, doc_id, score: each item's k best documents with a score above 0, ties to the smaller doc_id.

    Items are searched in blocks of about BLOCK_ASKS terms, each a pass over the lists. Terms that no document holds, or that weigh
    nothing, add nothing; a null doc_id comes last among equals, and rows of one id and score follow each other. An item that no document answers has no row.
    """
    q = staged(asked.join(postings.weights.where("w > 0"), "term").select("item", "term", "w", "f_max"), "query-terms")
    head = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("f"), "row"))
    heads = staged(postings.lists.withColumn("_n", head).where(F.col("_n") <= k).drop("_n"), "heads")
    blocks = q.count() // BLOCK_ASKS + 1
    found = None
    for i in range(blocks):
        part = _search_block(postings, heads, q.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i), k)
        found = part if found is None else found.unionByName(part)
    return found


OP12_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS l FROM documents),
d AS (SELECT doc_id, r, len(l)::BIGINT AS n, l FROM t WHERE len(l) > 0), c AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM d),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(l) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, doc_id, r, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of all for each benchmark item; see Postings and search() for nulls, ties, repeated rows and empty input."""
    asked = staged(query_terms(spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "asked")
    postings = Postings(spark.read.parquet(f"{sf_dir}/documents.parquet"), asked.select("term").distinct())
    return search(postings, asked).withColumnRenamed("item", "item_id")
