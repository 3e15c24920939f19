"""MinHash near-dedup by a signature-coordinate inverted join.

A text is its set of 3-word shingles; equal sets are one node. Each node is posted under its
coordinate-value pairs. Pairs posted once are dropped, the others ordered by the length of
their list, rarest first: two nodes that agree in enough coordinates meet in the
prefix of both, so the long lists at the end are skipped. Nodes of one list whose
collisions reach least_matches() are candidates; candidates that hang together form a cluster, and
all of a cluster's pairs are confirmed on their full sets.

Lists and clusters are compared in blocks of at most BLOCK nodes by block, so a large one is
spread over tasks, and a task gives no pairs but, for each node, the first node of its block
pair that it hangs together with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, small_batches, staged
from .shingles import WordHash, hash_family, min_hashes, shingles, words

SHINGLE_WORDS = 3
PERCENT = 85
COORDINATES = 64


def least_matches(percent: int) -> int:
    """Agreements asked for: a pair at the threshold has fewer with a chance of about 3e-6 (40 of 64 at 0.85)."""
    s = percent / 100
    return max(1, int(COORDINATES * s - 4.75 * (COORDINATES * s * (1 - s)) ** 0.5))


#: Ids that are broadcast to pick texts; more are joined by shuffle. What grows with the input is never broadcast: files of numbers
#: pack so well that Spark's own limit, on their size, lets hundreds of MB of rows through to the driver.
BROADCAST_IDS = BROADCAST_ROWS
#: Nodes of a list or cluster that are compared with as many others at once.
BLOCK = 1024
EDGES = "a bigint, b bigint"


def _text_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    hashed = WordHash()
    for batch in batches:
        yield batch, [np.unique(shingles(hashed(words(t.as_py())), n)) for t in batch.column(1)]


def _node(x: np.ndarray) -> bytes | None:
    return hashlib.md5(x.tobytes()).digest() if len(x) else None


def _features(n: int):
    def run(batches):
        family = hash_family(COORDINATES, 7)
        for batch, sets in _text_sets(batches, n):
            sigs = [min_hashes(x, family).view(np.int32) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([_node(x) for x in sets], pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array([x is not None and x.astype(np.uint8).tobytes() or None for x in sigs], pa.binary())],
                names=["doc_id", "n_shingles", "node", "sig", "short"],
            )

    return run


def _sets(n: int):
    def run(batches):
        for _, sets in _text_sets(batches, n):
            rows = [(_node(x), x.view(np.int64)) for x in sets if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["node", "items"])

    return run


def in_blocks(members: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """members(g, nid, ...) -> its rows with a column part, dealt out by part and sorted by it.

    A group g of up to BLOCK members is one part. A larger one is cut into blocks by a hash of
    nid, and each pair of blocks is a part. Groups of one member are dropped.
    """
    counts = (members if sizes is None else sizes).groupBy("g").agg(F.count("*").alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("nid"), blocks).cast("int")
    rows = members.join(counts.hint("shuffle_merge"), "g").withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("part", F.struct("g", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j")))
    return rows.drop("g", "_n", "_own", "_other").repartition("part").sortWithinPartitions("part")


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part; a part's rows follow each other."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        part = table.column("part").combine_chunks().flatten()
        k = [x.to_numpy(zero_copy_only=False) for x in part]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
        cuts = [0, *new.tolist(), table.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = table.slice(a, b - a)
            if held and held[0].column("part")[0] != piece.column("part")[0]:
                yield pa.concat_tables(held)
                held = []
            held.append(piece)
    if held:
        yield pa.concat_tables(held)


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row that links reach."""
    n = len(linked)
    at = np.arange(n)
    while True:
        new = np.minimum(at, np.where(linked, at, n).min(axis=1))
        new = new[new]
        if (new == at).all():
            return at
        at = new


def _agree(matches: int):
    def run(short: list[bytes]) -> np.ndarray:
        """Which signatures agree in enough coordinates, by one byte of each."""
        x = np.frombuffer(b"".join(short), np.uint8).reshape(len(short), -1).T
        total = np.zeros((len(short), len(short)), np.uint8)
        for row in x:
            total += row[:, None] == row
        return total >= matches

    return run


#: An item of up to this many sets counts pair by pair, a more common one by matrix products.
FEW = 8


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many items each two of some sets (arrays without repeats) have in common."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(place, kind="stable")
    owner, ends = owner[order], np.cumsum(count)
    same = np.zeros((n, n), np.int64)
    for c in range(2, FEW + 1):
        who = owner[(ends[count == c] - c)[:, None] + np.arange(c)]
        for x in range(c):
            for y in range(x + 1, c):
                np.add.at(same, (who[:, x], who[:, y]), 1)
    same += same.T
    common = np.flatnonzero(count > FEW)
    dense = np.zeros((n, n), np.float32)
    for at in range(0, len(common), 1024):
        part = common[at : at + 1024]
        x = np.zeros((n, len(part)), np.float32)
        x[np.concatenate([owner[ends[k] - count[k] : ends[k]] for k in part]), np.repeat(np.arange(len(part)), count[part])] = 1
        dense += x @ x.T
    same += dense.astype(np.int64)
    np.fill_diagonal(same, sizes)
    return same


def _alike(percent: int):
    def run(items) -> np.ndarray:
        """Which sets are alike."""
        sets = [x.values.to_numpy() for x in items]
        sizes = np.array([len(x) for x in sets])
        same = common_counts(sets)
        return 100 * same >= percent * (sizes[:, None] + sizes - same)

    return run


def _hang_together(column: str, linked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or [np.zeros(0, np.int64)])), pa.array(np.concatenate(b or [np.zeros(0, np.int64)]))], names=["a", "b"])

        for part in parts(batches):
            nid = part.column("nid").to_numpy()
            values = part.column(column)
            root = _roots(linked(list(values) if column == "items" else values.to_pylist()))
            rest = root != np.arange(len(root))
            a.append(nid[rest])
            b.append(nid[root[rest]])
            if len(a) > 10_000:
                yield out()
                a, b = [], []
        yield out()

    return run


class NearDuplicates:
    """The stages of one run; see near_duplicates()."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.docs, self.n, self.percent = docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), n, percent
        self.matches = least_matches(percent)

    def documents(self) -> DataFrame:
        return staged(self.docs.mapInArrow(_features(self.n), "doc_id bigint, n_shingles bigint, node binary, sig array<int>, short binary"), "features")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """wanted(nid, rep, node) -> nid, items: the sets of these nodes, from the texts of their representatives."""
        small = wanted.count() <= BROADCAST_IDS
        sent = F.broadcast if small else lambda x: x.hint("shuffle_merge")
        ids = sent(wanted.select(F.col("rep").alias("doc_id")).distinct())
        texts = self.docs.alias("d").join(ids.alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi")
        return texts.mapInArrow(_sets(self.n), "node binary, items array<bigint>").join(sent(wanted.select("nid", "node")), "node").select("nid", "items")

    def active(self, nodes: DataFrame) -> DataFrame:
        """Nodes that share enough coordinate-value pairs with others, with these pairs, rarest first."""
        key = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        posted = nodes.select("nid", F.posexplode("sig").alias("pos", "value")).select("nid", key.alias("key"))
        shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        mine = posted.join(shared.hint("shuffle_merge"), "key").groupBy("nid").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("k"))
        mine = mine.where(F.size("k") >= self.matches).select("nid", F.transform("k", lambda x: x["key"]).alias("keys"))
        return staged(mine.join(nodes.select("nid", "rep", "node", "short").hint("shuffle_merge"), "nid"), "active")

    def clusters(self, active: DataFrame) -> DataFrame:
        """(nid, cluster) of the nodes that have a candidate."""
        lists = active.select("nid", "short", F.explode(F.slice("keys", F.lit(1), F.size("keys") - self.matches + 1)).alias("g"))
        return components(in_blocks(lists).mapInArrow(_hang_together("short", _agree(self.matches)), EDGES).distinct()).withColumnsRenamed({"node": "nid", "root": "g"})

    def confirmed(self, clusters: DataFrame, active: DataFrame) -> DataFrame:
        """(nid, root) of the nodes that links join to others."""
        clusters = staged(clusters, "clusters")
        sets = self.sets(active.select("nid", "rep", "node").join(clusters.select("nid").hint("shuffle_merge"), "nid", "left_semi"))
        # a document's repeated rows bring its set more than once
        found = in_blocks(clusters.join(sets.dropDuplicates(["nid"]).hint("shuffle_merge"), "nid"), clusters).mapInArrow(_hang_together("items", _alike(self.percent)), EDGES)
        return components(found)

    def run(self) -> DataFrame:
        small_batches(self.docs.sparkSession)
        found = self.documents()
        nodes = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("short").alias("short"))
        nodes = staged(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
        active = self.active(nodes)
        roots = self.confirmed(self.clusters(active), active)
        grouped = nodes.select("nid", "node", "rep").join(roots.withColumnRenamed("node", "nid").hint("shuffle_merge"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
        least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
        ids = staged(grouped.join(least.hint("shuffle_merge"), "root").select("node", "component_id"), "classes")
        out = found.select("doc_id", "n_shingles", "node").join(ids.hint("shuffle_merge"), "node", "left")
        return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
            "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
        )


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept; a row for each row.

    Documents are linked if 100 * common shingles >= percent * all shingles of both. component_id is
    the smallest id that links reach, kept whether that is the document's own. Null,
    empty and blank texts have no shingle, stand alone and are kept. Null ids are reached but
    name no component: it is null, and kept, only where all ids of the component are. Repeated
    rows share a component and what kept says. Empty input gives no rows; other columns are not read.
    """
    return NearDuplicates(docs, shingle_words, percent).run()


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
