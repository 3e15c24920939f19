"""Prefix trie of conversations by Patricia construction.

Distinct conversations are sorted, so those of one subtree stand together. A pass over the order keeps the
points of the current path only: where two neighbours part (branches), where a conversation ends, and leaves; an
edge holds the turns between two points. Sums are taken at the points, then edges are unfolded: a turn with one
child has its point's members and a suffix sum of the edge. Ranges of the order are built apart; what spans two
ranges is the path that their neighbours share, whose sums are added afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup_join, small_batches, staged

#: Ids in a piece of the list that a digest is taken of.
PIECE = 20_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
_TURNS = "array<struct<key:binary,n:bigint>>"
_POINT = "depth bigint, node binary, parent binary, open boolean, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, above bigint, summed bigint, ends string, edge array<bigint>"


def conversations(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, turns: a key of role and text, and the text's code points, in order of turn.

    A null turn comes first, rows of one turn are ordered by role and key; a null role or text is empty. Rows
    without a conv_id take no part. Texts are not gathered: a turn is 24 bytes from here on.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("set"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"), role.alias("role"), key.alias("key"), F.length(text).cast("bigint").alias("n")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["n"].alias("n"))).alias("turns"))


def rebuild(convs: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """conversations() -> the same columns: the first h turns of conversation c - c % block, then c's own after its first h; h = crc32(decimal c) % heads.

    All turns of the other if it has fewer, none if it is not there; so a conversation may be left without any.
    """
    base = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads - 1).alias("_first"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).cast("int")
    own = convs.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % block).alias("_base"), h.alias("_h"))
    first = F.coalesce(F.when(F.col("_h") > 0, F.slice("_first", F.lit(1), F.col("_h"))), F.array().cast(_TURNS))
    return own.join(base, "_base", "left").select("conv_id", F.concat(first, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, turns -> conv_id, node: a hash of the whole sequence, chained from turn to turn."""
    for batch in batches:
        out = []
        for turns in batch.column(1).to_pylist():
            node = b""
            for t in turns:
                node = hashlib.blake2b(node + t["key"], digest_size=16).digest()
            out.append(node)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(1)], names=["conv_id", "node", "turns"])


def _joined(most: int):
    """node, conv_id in order of both -> node, first conv_id, number of ids, the ids as decimals: pieces of at most ``most`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows, many = None, [], [], 0

        def close():
            rows.append((now, held[0], len(held), ",".join(map(str, held))))

        def flush():
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["node", "first", "n", "ids"])

        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (node != now or len(held) == most):
                    close()
                    held = []
                now, many = node, many + 1
                held.append(conv)
                if many >= PIECE:
                    yield flush()
                    many = len(held)
        if held:
            close()
        yield flush()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of node and first id -> node, conv_id (the least), n, ends: a digest is fed piece by piece."""
    rows: list[tuple] = []
    now, least, many, digest = None, 0, 0, None

    def flush():
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["node", "conv_id", "n", "ends"])

    for batch in batches:
        for node, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest is None or node != now:
                if digest is not None:
                    rows.append((now, least, many, digest.hexdigest()))
                now, least, many, digest = node, first, 0, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
            many += n
        if len(rows) > 5000:
            yield flush()
    if digest is not None:
        rows.append((now, least, many, digest.hexdigest()))
    yield flush()


def ends(paths: DataFrame) -> DataFrame:
    """paths(conv_id, node) -> node, conv_id (the least), n, ends: for each node that conversations end at, the SHA-256 of their ids in order.

    Ids are joined inside ranges of ids first, so a node at which a third of all end gives a few long rows, which its digest takes one after the other.
    """
    ranged = paths.select("node", "conv_id").repartitionByRange("conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ranged.mapInArrow(_joined(PIECE), "node binary, first bigint, n bigint, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, conv_id bigint, n bigint, ends string")


class _Path:
    """The points of the current path, from the root down; add() takes the next sequence of the order, close() ends a range."""

    def __init__(self, shared: int, shared_after: int):
        self.shared, self.after = shared, shared_after
        self.rows: list[tuple] = []
        self.points: list[dict] = []
        self.turns: list[tuple[bytes, int]] = []

    @staticmethod
    def _point(depth: int, begun: bool = False) -> dict:
        """begun: the point is on the path shared with the range before."""
        return {"depth": depth, "conv": None, "n": 0, "children": 0, "leaves": 0, "sum": 0, "ends": None, "begun": begun, "open": begun}

    def _pop(self, parent_depth: int) -> None:
        """Takes the last point off; its parent is the one before, or a new one at parent_depth below that."""
        p = self.points.pop()
        if not self.points or self.points[-1]["depth"] < parent_depth:
            self.points.append(self._point(parent_depth))
        up = self.points[-1]
        if not p["children"] and not p["open"]:
            p["leaves"] = 1
        self._give(p, up["depth"])
        for k in ("n", "leaves", "sum"):
            up[k] += p[k]
        up["conv"] = p["conv"] if up["conv"] is None else min(up["conv"], p["conv"])
        # a child that the range before has begun is counted there
        up["children"] += not p["begun"]

    def _give(self, p: dict, parent_depth: int) -> None:
        d = p["depth"]
        # for each turn of the edge, the characters from its own text to that before the point's
        edge = [self.chars[d - 1] - self.chars[i] for i in range(parent_depth, d)] if d else [0]
        self.rows.append((d, self.nodes[d], self.nodes[parent_depth] if d else None, p["open"], p["conv"], p["n"], p["children"], p["leaves"], self.chars[max(0, d - 1)], p["sum"], p["ends"], edge))

    def add(self, keys: list[bytes], lengths: list[int], conv: int, n: int, ends: str) -> None:
        first = not self.points
        if first:
            common = self.shared
        else:
            common = next((i for i, (a, b) in enumerate(zip(keys, self.keys, strict=False)) if a != b), min(len(keys), len(self.keys)))
            while self.points[-1]["depth"] > common:
                self._pop(max(common, self.points[-2]["depth"]))
        # what the new sequence shares stays, the rest is new: hashes and running lengths by depth
        self.nodes = [b""] if first else self.nodes[: common + 1]
        self.chars = [0] if first else self.chars[: common + 1]
        for k, x in zip(keys[len(self.nodes) - 1 :], lengths[len(self.nodes) - 1 :], strict=True):
            self.nodes.append(hashlib.blake2b(self.nodes[-1] + k, digest_size=16).digest())
            self.chars.append(self.chars[-1] + x)
        self.keys = keys
        if first:
            self.points = [self._point(d, begun=True) for d in range(common + 1)]
        self.points[-1]["sum"] += self.chars[common]
        if len(keys) > common:
            self.points.append(self._point(len(keys)))
        own = self.points[-1]
        own["conv"], own["ends"] = conv if own["conv"] is None else min(own["conv"], conv), ends
        own["n"] += n
        own["sum"] += (n - 1) * self.chars[-1]

    def close(self) -> None:
        """All points go; those shared with the range after stay open, each depth a point."""
        while self.points:
            depth = self.points[-1]["depth"]
            self.points[-1]["open"] |= depth <= self.after
            if depth == 0:
                self._give(self.points.pop(), 0)
            else:
                above = self.points[-2]["depth"] if len(self.points) > 1 else 0
                self._pop(max(above, min(depth - 1, self.after)))


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences in order of range and place -> points, complete ones and those of open paths."""
    names = [x.split()[0] for x in _POINT.split(", ")]
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.list_(pa.int64()))
    part, path, rows = None, None, []

    def flush():
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=names)

    for batch in batches:
        for p, turns, conv, n, ends, shared, after in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7)), strict=True):
            if p != part:
                if path is not None:
                    path.close()
                    rows += path.rows
                part, path = p, _Path(shared, after)
            path.add([t["key"] for t in turns], [t["n"] for t in turns], conv, n, ends)
            if len(path.rows) > 2000:
                rows += path.rows
                path.rows = []
                yield flush()
    if path is not None:
        path.close()
        rows += path.rows
    yield flush()


def _common(a: str, b: str):
    """Length of the longest common beginning of two arrays of turns; 0 where one is null."""
    both = F.expr(f"{a} is not null and {b} is not null")
    same = F.expr(f"array_position(zip_with(slice({a}, 1, least(size({a}), size({b}))), slice({b}, 1, least(size({a}), size({b}))), (x, y) -> x.key = y.key), false)")
    return F.when(both & (same > 0), same - 1).when(both, F.least(F.size(a), F.size(b)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def points(convs: DataFrame) -> DataFrame:
    """conversations(), rebuilt or not -> the points of their trie: branches, ends, leaves, the root, and those of paths over two ranges.

    Columns: depth, node (a hash of the path), parent (its point's), conv_id (smallest member), n_convs, n_children, n_leaves, saved, ends, and edge: for each
    turn from below the parent to the point, the characters of the edge's texts from that turn on, without the point's own. Conversations without turns are members of the root; no conversations give no points.
    """
    small_batches(convs.sparkSession)
    paths = staged(convs.select("conv_id", "turns").mapInArrow(_paths, f"conv_id bigint, node binary, turns {_TURNS}"), "paths")
    # of equal sequences one goes on; the smallest id stands for all
    last = staged(ends(paths), "ends")
    distinct = staged(paths.select("conv_id", "turns").join(last.select("conv_id", "n", "ends"), "conv_id"), "sequences")
    place = distinct.repartitionByRange(F.col("turns")).sortWithinPartitions("turns").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    order = staged(place.select("part", "place", "turns", "conv_id", "n", "ends"), "order")
    # a row for each range: its first and last sequence, and what they share with their neighbours'
    borders = order.groupBy("part").agg(F.min_by("turns", "place").alias("first"), F.max_by("turns", "place").alias("last"))
    by_part = Window.orderBy("part")
    borders = borders.withColumn("before", F.lag("last").over(by_part)).withColumn("next", F.lead("first").over(by_part))
    borders = borders.select("part", _common("before", "first").alias("shared"), _common("last", "next").alias("after"))
    ranged = lookup_join(order, staged(borders, "borders"), "part", F.col("place"), "inner").select("part", "place", "turns", "conv_id", "n", "ends", "shared", "after")
    made = staged(ranged.repartition("part").sortWithinPartitions("part", "place").mapInArrow(_built, _POINT), "points")
    whole = made.where("open").groupBy("depth", "node").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves")], F.max("above").alias("above"), F.sum("summed").alias("summed"), F.max("ends").alias("ends"), F.first("edge").alias("edge"), F.lit(True).alias("open")
    )
    found = made.where("not open").unionByName(whole)
    return found.withColumn("saved", F.col("summed") - (F.col("n_convs") - 1) * F.col("above")).drop("above", "summed")


def nodes(found: DataFrame) -> DataFrame:
    """points() -> a row for each node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The turns of an edge above its point have one child and the point's members; each saves the point's sum and that of the edge's turns from its own on.
    """
    found = staged(found, "trie")
    # parents on open paths, the root among them, may have any number of children
    shared = staged(found.where("open").select(F.col("node").alias("parent"), F.col("conv_id").alias("_up")), "open-points")
    own = found.where("not open").select(F.col("node").alias("parent"), F.col("conv_id").alias("_up"))
    below = lookup_join(found, shared, "parent", F.col("node"), "left")
    below = below.join(own.withColumnRenamed("_up", "_own"), "parent", "left").withColumn("_up", F.coalesce("_up", "_own"))
    step = below.select("*", F.posexplode("edge").alias("_i", "_below"))
    depth = F.when(F.col("depth") == 0, F.lit(0).cast("bigint")).otherwise(F.col("depth") - F.size("edge") + 1 + F.col("_i"))
    last = F.col("_i") == F.size("edge") - 1
    return step.select(
        "conv_id", depth.alias("depth"),
        F.when(F.col("depth") > 0, F.when(F.col("_i") == 0, F.col("_up")).otherwise(F.col("conv_id"))).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("bigint")).alias("n_children"), "n_leaves", (F.col("saved") + (F.col("n_convs") - 1) * F.col("_below")).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
    )


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(c::VARCHAR)), lambda k: CASE WHEN k % 8 = 0 THEN ord(substr(c::VARCHAR, k // 8 + 1, 1))::BIGINT ELSE 0::BIGINT END)), lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384::BIGINT) ELSE xor(a, x) >> 1 END), 4294967295::BIGINT)"
OP11_SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, {_CRC} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT i.c, 0 AS own, t.pos, t.k, t.n FROM i JOIN t ON t.c = i.c - i.c % 100 AND t.pos <= i.h UNION ALL SELECT i.c, 1, t.pos, t.k, t.n FROM i JOIN t ON t.c = i.c AND t.pos > i.h),
p AS (SELECT c, row_number() OVER w AS d, string_agg(k, '') OVER w AS p, n FROM r WINDOW w AS (PARTITION BY c ORDER BY own, pos) UNION ALL SELECT c, 0, '', 0 FROM i),
v AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM p GROUP BY p, d),
u AS (SELECT *, left(p, CAST(32 * (d - 1) AS INTEGER)) AS up FROM v WHERE d > 0), ch AS (SELECT up AS p, count(*) AS n_children FROM u GROUP BY up),
e AS (SELECT p, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(p, d) AS p FROM p GROUP BY c) GROUP BY p),
a AS (SELECT left(v.p, CAST(32 * k AS INTEGER)) AS p, CASE WHEN ch.p IS NULL THEN 1 ELSE 0 END AS leaf, (v.n_convs - 1) * v.n AS saved FROM (SELECT *, unnest(range(d + 1)) AS k FROM v) v LEFT JOIN ch ON ch.p = v.p),
s AS (SELECT p, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM a GROUP BY p)
SELECT v.conv_id, v.d AS depth, up.conv_id AS parent_conv_id, v.n_convs, coalesce(ch.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM v LEFT JOIN u ON u.p = v.p LEFT JOIN v up ON up.p = u.up LEFT JOIN ch ON ch.p = v.p LEFT JOIN e ON e.p = v.p JOIN s ON s.p = v.p"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations; see conversations(), rebuild() and points() for nulls, ties, repeated rows and empty input."""
    convs = staged(conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "conversations")
    return nodes(points(rebuild(convs)))
