"""op11 against a trie of dictionaries: planted and random conversations in many ranges, the whole small table, and SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from prosemill.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, n long, turns string, part int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 5, "x", 1) for r in rows], SCHEMA).repartition(parts)


def brute(rows, block=100, heads=6):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        full[c] = own.get(c - c % block, [])[:h] + v[h:]
    members, ends = {}, {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
        ends.setdefault(tuple(v), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], digest(ends.get(p, []))) for p, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def build(spark, rows):
    return found(trie.nodes(trie.points(trie.rebuild(trie.conversations(frame(spark, rows))))))


def test_planted(spark):
    rows = [(100, 0, "u", "a"), (100, 1, None, "bb"), (100, None, "s", "first"), (103, 0, "u", "x"), (104, 0, "u", "x"), (104, 0, "u", "x"), (205, 1, "u", None), (205, 2, None, None), (7, 0, "u", "é" * 3000), (None, 0, "u", "lost")]
    assert build(spark, rows) == brute(rows)
    turnless = [(c, 0, "u", "t") for c in range(201, 260)]  # no conversation 200: those with h > 0 have no turn
    assert build(spark, turnless) == brute(turnless)
    assert build(spark, []) == []


@pytest.mark.parametrize("seed", range(4))
def test_random_many_ranges(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(400):
        hot = rng.random() < 0.3
        n = 3 if hot else rng.randint(1, 9)
        rows += [(c, t, "u" if t % 2 else "s", "hot" if hot else rng.choice("ab") * (t + 1)) for t in range(n)]
    # one long conversation and copies of its beginning, so that paths span many ranges
    rows += [(1000 + k, t, "u", f"long {t}") for k in range(30) for t in range(20 + 3 * k)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert build(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_only_branches_ends_and_leaves(spark):
    rows = [(c, t, "u", f"same {t}" if t < 50 else f"{c} {t}") for c in (1, 2) for t in range(100)]
    convs = trie.conversations(frame(spark, rows))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        made = {(r.depth, r.n_convs, len(r.edge)) for r in trie.points(convs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert made == {(0, 2, 1), (50, 2, 50), (100, 1, 50)}


def test_pieces_of_digests(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c, 0, "u", "same") for c in range(100, 10000, 100)] + [(1, 0, "u", "other")]
    assert build(spark, rows) == brute(rows)


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = found(trie.op11_prefix_trie(spark, sf))
    assert got == brute(rows)
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert got == sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in c.sql(trie.OP11_SQL).fetchall())
