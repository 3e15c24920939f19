"""Each operator on small planted frames: nulls, empty texts, repeated rows, empty input, clashing columns."""

import base64
import gzip
import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosemill.llm import ann, html_text, language_id, lm, minhash, mixing, packing, passages, quality_rules, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, words string"
EN = "the of and that with this for are was his her from they have not which one all were when there "
FR = "le la les des une est pour dans qui sur pas plus avec sont mais nous vous ils elle cette comme "


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 7, 1, "x") for i, t, lang, s in rows], SCHEMA)


def prose(seed, n, words=EN):
    rng = np.random.default_rng(seed)
    return " ".join(f"{w}{k}" for w, k in zip(rng.choice(words.split(), n), rng.integers(0, 99, n), strict=True))


@pytest.fixture(scope="module")
def docs(spark):
    a, b = prose(1, 200), prose(2, 160)
    w = a.split()
    rows = [(1, a, "en", "s1"), (2, a, "en", "s1"), (3, " ".join(w[:100] + ["changed"] + w[101:]), "en", "s2"), (4, b, "en", None), (5, None, None, "s1"), (6, "", "en", "s3"), (7, " \n\t ", "en", "s3"),
            (8, "One", "en", "s2"), (9, prose(3, 80) + " " + " ".join(b.split()[40:110]) + " " + prose(4, 50), "en", "s1"), (None, b, "en", "s2"), (4, b, "en", None), (10, prose(5, 3000), "en", "s1")]
    return make(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [(1, "x", "en", "s")]).where("doc_id = 2")


def by_id(df, *cols):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *cols).collect()}


def words(t):
    return [x.decode() for x in (t or "").encode().split()]


def test_quality_rules(spark, docs, empty):
    d = docs.withColumn("host", F.col("source"))
    got = [tuple(r) for r in quality_rules.quality_rules(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    want = []
    for r in docs.collect():
        w = words(r.text)
        wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {i + o for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for o in range(3)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        want.append((r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert quality_rules.quality_rules(empty.withColumn("host", F.col("source"))).count() == 0


def test_repeated_words_and_lines(spark):
    d = make(spark, [(1, "a b c a b c d\nx y\nx y\n\n# <", "en", "h")]).withColumn("host", F.col("source"))
    r = quality_rules.measures(d).first()
    assert (r.n_repeat_words, r.n_dup_lines, r.n_symbols) == (6, 1, 2)


def test_bad_host_is_blocked(spark):
    good = [(i, prose(i, 60), "en", "good") for i in range(20)]
    bad = [(100 + i, "short", "en", "bad") for i in range(19)] + [(150, prose(9, 60), "en", "bad")]
    got = by_id(quality_rules.quality_rules(make(spark, good + bad).withColumn("host", F.col("source"))), "kept")
    assert got[0] == (True,) and got[150] == (False,)


def test_mixing(spark, docs, empty):
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rows = mixing.pareto_mix(sized).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.pareto_mix(sized.repartition(5)).collect()))
    assert mixing.pareto_mix(empty).count() == 0


def test_mixing_comes_near_targets(spark):
    d = spark.range(3000).selectExpr("id doc_id", "concat('s', id % 4) source", "1 + id % 97 size")
    for r in mixing.pareto_mix(d).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.g) <= r.m


def test_near_duplicates(spark, docs, empty):
    got = [tuple(r) for r in minhash.near_duplicates(docs).collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()) for w in (words((t or "").lower()) for _, t in rows)]
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        same = len(sets[i] & sets[j])
        if sets[i] and 100 * same >= 85 * len(sets[i] | sets[j]):
            root = [root[i] if x == root[j] else x for x in root]
    want = []
    for k, (i, _) in enumerate(rows):
        c = min((rows[m][0] for m in range(len(rows)) if root[m] == root[k] and rows[m][0] is not None), default=None) if sets[k] else i
        want.append((i, len(sets[k]), c, i == c or c is None))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert minhash.near_duplicates(empty).count() == 0


def test_large_near_duplicate_group_in_blocks(spark, monkeypatch):
    base = prose(20, 60).split()
    rows = [(i, " ".join(base[: i % 60] + [f"new{i}"] + base[i % 60 + 1 :]), "en", "s") for i in range(40)]
    got = by_id(minhash.near_duplicates(make(spark, rows), percent=80), "component_id")
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(58)} for i, t, _, _ in rows}
    root = {i: i for i in sets}
    for i, j in combinations(sets, 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = {k: a if v == b else v for k, v in root.items()}
    assert {i: c for i, (c,) in got.items()} == root


def test_alike_equals_brute_force():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(40)]
    got = minhash.common_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40))


def test_compact_windows_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, t = int(rng.integers(1, 50)), int(rng.integers(1, 10))
        h = rng.integers(0, rng.choice([5, 1000]), n).astype(np.uint64)
        want = []
        for c in range(n):
            a = b = c
            while a and h[a - 1] > h[c]:
                a -= 1
            while b < n - 1 and h[b + 1] >= h[c]:
                b += 1
            if b - a + 1 >= t:
                want.append((a, c, b))
        assert sorted(tuple(map(int, x)) for x in passages.compact_windows(h, t)) == sorted(want)


def test_repeated_passages(spark, docs, empty):
    got = by_id(passages.repeated_passages(docs), "class_id", "n_copies", "passages")
    assert got[1][:2] == (1, 1) and got[2][0] == 1 and got[3][0] == 1
    assert got[9][0] == 4 and got[4][0] == 4 and got[None][0] == 4
    assert "80:150" in got[9][2] and got[10] == (10, 0, "") and got[8] == (8, 0, "")
    assert passages.repeated_passages(empty).count() == 0


def test_a_passage_has_the_same_windows_in_texts_of_any_length():
    rng, least = np.random.default_rng(3), passages.MIN_TOKENS
    for _ in range(20):
        passage, centers = rng.integers(0, 2**63, 56).astype(np.uint64) * np.uint64(2), []
        for n in (56, 596, 9_996):
            h = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
            at = (n - 56) // 2
            h[at : at + 56] = passage
            # least tokens of the runs inside the passage
            centers.append({int(c) - at for a, c, b in passages.compact_windows(h).tolist() if at <= c < at + 56 and min(b, at + 55) - max(a, at) + 1 >= least})
        assert centers[0] == centers[1] == centers[2] == {k + int(passage[k : k + least].argmin()) for k in range(56 - least + 1)}


def test_common_passages_either_side_leads():
    a, seen = np.arange(60), np.zeros(400, bool)
    b = np.concatenate([np.arange(100, 130), a, np.arange(200, 330)])
    assert passages.common_passages(a, b, seen) == [(0, 60, 30, 90)]
    assert passages.common_passages(b, a, seen) == [(30, 90, 0, 60)]
    assert passages.common_passages(a, np.arange(100, 200), seen) == [] and not seen.any()


def test_longest_stretch_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        hit = rng.random(int(rng.integers(1, 60))) < rng.choice([0.5, 0.9, 0.97])
        # a stretch of at least one marked token, with eight in nine marked and the ends cut to marked ones
        want = max((b - a for a in range(len(hit)) for b in range(a, len(hit) + 1) if 9 * hit[a:b].sum() >= 8 * (b - a)), default=0)
        i, j = passages._longest(hit)
        assert j - i <= want <= j - i + 8 + want // 9 and (i == j or (hit[i] and hit[j - 1]))
        least = passages.MIN_TOKENS
        assert passages._stretch_left(hit) == (want >= least)


def test_passage_with_an_edited_word():
    a, seen = np.arange(76), np.zeros(400, bool)
    b = a.copy()
    b[36:41] = np.arange(200, 205)
    assert passages.common_passages(a, b, seen) == [(0, 76, 0, 76)]
    part = part_of([a, b, np.concatenate([np.arange(20), np.arange(300, 360)])])
    assert part.could(0, np.arange(1, 3), np.array([38])).tolist() == [1] and part.could(0, np.arange(3)).tolist() == [0, 1]


def test_passage_with_inserted_words():
    rng = np.random.default_rng(8)
    for words, most in ((50, 2), (60, 5), (70, 7), (80, 10)):
        for more in range(1, most + 1):
            for around in (0, 300):
                tokens, seen = words - 4, np.zeros(3_000, bool)
                a, at = np.arange(tokens), tokens // 2 - 2
                b = np.concatenate([a[:at], np.arange(500, 504 + more), a[at + 4 :]])
                assert (tokens - 4) / (tokens + 4 + more) >= 0.8
                a, b = (np.concatenate([rng.integers(lo, lo + 400, around), x, rng.integers(lo, lo + 400, around)]) for x, lo in ((a, 1_000), (b, 2_000)))
                want = [(around, around + tokens, around, around + tokens + more)]
                assert passages.common_passages(a, b, seen) == want
                assert [(k, m, i, j) for i, j, k, m in passages.common_passages(b, a, seen)] == want
                assert part_of([a, b, b]).could(0, np.arange(3)).tolist() == part_of([b, a, a]).could(0, np.arange(3)).tolist() == [0, 1, 2]


def part_of(sets, few=0):
    """A part of pieces with these tokens, each of a text of its own."""
    part = pa.StructArray.from_arrays([pa.array([1] * len(sets)), pa.array([0] * len(sets)), pa.array([0] * len(sets))], names=["g", "i", "j"])
    cols = [part, pa.array([0] * len(sets), pa.int32()), pa.array(range(1, len(sets) + 1), pa.int64()), pa.array([0] * len(sets), pa.int32()), pa.array([[0]] * len(sets), pa.list_(pa.int32())), pa.array([x.astype("<u4").tobytes() for x in sets])]
    before, passages.FEW_PIECES = passages.FEW_PIECES, few
    try:
        return passages._Part(pa.table(cols, names=["part", "kind", "nid", "a", "centers", "tokens"]))
    finally:
        passages.FEW_PIECES = before


def test_bounds_never_drop_what_is_alike():
    rng = np.random.default_rng(12)
    alike = 0
    for _ in range(60):
        base = rng.integers(0, 200, int(rng.integers(50, 120)))
        sets = []
        for _ in range(5):
            x = base.copy()
            for at in rng.integers(0, len(x) - 5, int(rng.integers(0, 5))):
                x[at : at + 5] = rng.integers(200, 900, 5)
            sets.append(np.concatenate([rng.integers(900, 1000, int(rng.integers(0, 60))), x]))
        part = part_of(sets)
        fine = set(part.could(0, np.arange(1, 5)).tolist())
        for j in range(1, 5):
            if passages.common_passages(part.tokens[0], part.tokens[j], part.seen):
                alike += 1
                assert j in fine
    assert alike > 50


def test_groups_of_any_size_give_the_same(spark, monkeypatch):
    short, line = prose(43, 38), prose(44, 9)
    # a passage that is too short for all, and a line that some repeat until it is long enough
    rows = [(k, " ".join([prose(50 + k, 60), short, prose(70 + k, 40), *[line] * (6 * (k > 3)), prose(90 + k, 20)]), "en", "s") for k in range(1, 7)]
    for block in (1024, 2):
        monkeypatch.setattr(passages, "BLOCK", block)
        monkeypatch.setattr(passages, "SLICE_PIECES", block)
        got = by_id(passages.repeated_passages(make(spark, rows)), "class_id", "n_links", "passages")
        assert got == {k: (k, 0, "") for k in (1, 2, 3)} | {k: (4, 2, "138:192") for k in (4, 5, 6)}


def test_links_of_all_pairs(spark, monkeypatch):
    one, two = prose(41, 60), prose(42, 60)
    # all share one passage; the last three share another that the first lacks
    rows = [(k, " ".join([prose(50 + k, 30), one, prose(70 + k, 30), *[two] * (k > 3), prose(90 + k, 10)]), "en", "s") for k in range(1, 7)]
    for block in (1024, 2):
        monkeypatch.setattr(passages, "BLOCK", block)
        got = by_id(passages.repeated_passages(make(spark, rows)), "class_id", "n_links", "passages")
        assert {k: v[:2] for k, v in got.items()} == dict.fromkeys(range(1, 7), (1, 5))
        assert [got[k][2] for k in range(1, 7)] == ["30:90"] * 3 + ["30:90,120:180"] * 3


def test_repeated_passages_equal_a_search_of_all_pairs(spark, monkeypatch):
    """All documents of sf0.001: classes and covered words as from comparing every two whole texts."""
    from prosemill.llm.shingles import shingles, word_hashes

    found = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    texts = sorted({t for _, t in found if t and len(words(t)) >= 50})
    flat = [shingles(word_hashes(t), 5) for t in texts]
    values, numbers = np.unique(np.concatenate(flat), return_inverse=True)
    numbers, seen = np.split(numbers, np.cumsum([len(x) for x in flat])[:-1]), np.zeros(len(values), bool)
    group, covered = {t: {t} for t in texts}, defaultdict(set)
    for (i, x), (j, y) in combinations(enumerate(numbers), 2):
        for p, q, r, s in passages.common_passages(x, y, seen):
            covered[texts[i]] |= set(range(p, q + 4))
            covered[texts[j]] |= set(range(r, s + 4))
            whole = group[texts[i]] | group[texts[j]]
            group |= dict.fromkeys(whole, whole)
    ids = defaultdict(list)
    for i, t in found:
        ids[t].append(i)
    want = {i: min(k for u in group.get(t, {t}) for k in ids[u]) for i, t in found}
    for block in (1024, 3):
        monkeypatch.setattr(passages, "BLOCK", block)
        got = by_id(passages.repeated_passages(spark.createDataFrame(found, "doc_id long, text string")), "class_id", "passages")
        assert {i: v[0] for i, v in got.items()} == want
        spans = {i: {w for x in v[1].split(",") if x for w in range(*map(int, x.split(":")))} for i, v in got.items()}
        missed = sum(len(covered[t] - spans[i]) for i, t in found)
        assert missed <= 0.002 * sum(len(covered[t]) for _, t in found) and sum(map(len, covered.values()))


def test_word_hashes_are_those_of_words():
    from prosemill.llm import shingles

    rng, known = np.random.default_rng(0), {}
    for _ in range(300):
        text = "".join(rng.choice(list("aBc \t\n\x0béÀ"), int(rng.integers(0, 60))))
        ws, hs = shingles.words(text), shingles.word_hashes(text).tolist()
        assert len(ws) == len(hs) and all(known.setdefault(w, h) == h for w, h in zip(ws, hs, strict=True))
    assert len(set(known.values())) == len(known) and not len(shingles.word_hashes(None))


def test_secrets_layers():
    key = "token=abcdefghijkl1234"
    b64 = base64.b64encode(key.encode()).decode()
    zipped = base64.b64encode(gzip.compress(b"password: hunter2hunter2", mtime=0)).decode()
    for text, kind in ((key, "assign"), (f"see {b64} end", "assign"), (f"see {base64.b64encode(b64.encode()).decode()} end", "assign"), (f"x {zipped} y", "assign"), ("token%3Dabcdefghijkl1234", "assign"), ("t\\u006fken=abcdefghijkl1234", "assign"), ("é AKIA" + "A" * 16, "access"), ("0123456789abcdef0", "hex")):
        base, spans = secrets.find_secrets(text)
        assert set(base) <= set(spans) and any(secrets.KINDS[k] == kind for _, k, _ in spans), text
        assert all(0 <= a < b <= len(text) for a, _, b in spans)
    assert secrets.find_secrets("token%3Dabcdefghijkl1234")[1][0] == (0, 0, 24)
    assert secrets.find_secrets("token=short AKIA12 0123456789abcde")[1] == []
    assert secrets.find_secrets(None) == ([], [])
    assert secrets.redacted("a token=abcdefghijkl b", [(2, 0, 20)]) == "a [secret] b"


def test_secrets_in_layers_of_any_bytes(monkeypatch):
    key = b"token=abcdefghijkl1234"
    odd = [x.encode() for x in ("\u00a0", "\ufeff", "\u200b", "\u00ad", "\0", "\x1b", "\v")] + [b"\xff\xfe", b"\xc3"]
    members = gzip.compress(b"nothing here", mtime=0) + gzip.compress(key, mtime=0)
    inner = [x + b" " + key for x in odd] + [members, gzip.compress(members, mtime=0), members + b"\xff", zlib.compress(key) + key, b"x^2 " + key]
    for raw in inner:
        text = f"see {base64.b64encode(raw).decode()} end"
        spans = secrets.find_secrets(text)[1]
        assert any(k == 0 and 4 <= a < b <= len(text) - 4 for a, k, b in spans), raw
        assert "[secret]" in secrets.redacted(text, spans)
    text = base64.b64encode(b"\xff\xff\xff" + key).decode()
    assert (4, 0, len(text.rstrip("="))) in secrets.find_secrets(text)[1]
    monkeypatch.setattr(secrets, "MAX_LAYER_BYTES", 1_000)
    monkeypatch.setattr(secrets, "OVERLAP", 200)
    for fill in (b"\0", b"ab cd\n", b"= ", b"A"):
        for n in (900, 980, 990, 1_000, 5_003):
            for raw in (fill * n + b" " + key + fill * n, fill * n + b" " + base64.b64encode(key)):
                for packed in (gzip.compress(raw, mtime=0), gzip.compress(gzip.compress(raw, mtime=0), mtime=0)):
                    assert secrets.find_secrets(base64.b64encode(packed).decode())[1], (fill, n)


def test_secret_scan_rows(spark, docs, empty):
    got = secret = secrets.secret_scan(docs)
    assert got.count() == docs.count() and secret.where("spans <> ''").count() == 0
    assert secrets.secret_scan(empty).count() == 0
    assert secrets.redact(docs).columns == docs.columns


def test_packing_round_trip(spark, docs, empty):
    d = docs.withColumn("doc_id", F.monotonically_increasing_id()).cache()
    enc = packing.Encoder(packing.public_encoder()[0])
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    pieces, rows = defaultdict(list), packing.pack(d).collect()
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids, at = np.append(enc.ids(t), 0).astype("<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty).count() == 0


def test_packer_limits():
    rng = np.random.default_rng(1)
    p = packing.Packer(0, 100, 4, 50)
    for i in range(200):
        n = int(rng.integers(1, 80))
        p.add(i, 0, np.arange(n, dtype=np.uint32), n, int(rng.integers(0, min(n, 50) + 1)))
        assert p.room.min() >= 0
    p.finish()
    bins = Counter(r[5] for r in p.rows)
    assert max(bins.values()) <= 4 or len(bins) > 1
    assert sum(r[2] for r in p.rows) == sum({r[0]: r[4] for r in p.rows}.values())


def test_fast_ids_equal_plain_ids():
    plain, fast = packing.Encoder(packing.public_encoder()[0]), packing.Encoder(*packing.public_encoder())
    for t in ("", "a<|endoftext|>b", "é 你好 \n\n  x\t", prose(7, 300), "1234567 'll don't", "  z", "👩‍👩‍👧 ok"):
        assert plain.ids(t).tolist() == fast.ids(t).tolist()


def test_language_id(spark, empty):
    rows = [(i, prose(i, 40 + i, FR if i % 2 else EN), "fr" if i % 2 else "en", "s") for i in range(80)]
    d = make(spark, rows + [(900, None, "en", "s"), (901, "12 !!", "en", "s"), (902, EN, None, "s")])
    model = language_id.train(d.where("doc_id < 60 or doc_id > 800"))
    got = by_id(language_id.identify(d, model), "lang_pred", "score")
    assert all(got[i][0] == ("fr" if i % 2 else "en") for i in range(80)) and got[900] == ("und", 0.0) and got[901] == ("und", 0.0) and got[902][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_id.train(empty) is None
    assert set(by_id(language_id.identify(d, None), "lang_pred").values()) == {("und",)}


def test_presence_does_not_depend_on_parts(monkeypatch):
    t = prose(8, 300) + " 12,, Ünïcode"
    whole = language_id.presence(t)
    monkeypatch.setattr(language_id, "PART", 97)
    assert (language_id.presence(t) == whole).all()


@pytest.mark.parametrize("shard_tokens", [1_500_000, 60, 12])
def test_language_model_equals_brute_force(spark, docs, empty, monkeypatch, shard_tokens):
    """Also with words, a pair and the start mark so frequent that they are spread over shards."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard_tokens)
    common = [(100 + i, f"of the w{i} of the x{i % 7} the of the w{i} " + "of the y " * (i % 4), "en", "s", 9) for i in range(40)]
    d = docs.where("doc_id is not null").select("doc_id", "text").union(spark.createDataFrame(common).toDF("doc_id", "text", "a", "b", "c").select("doc_id", "text")).cache()
    got = [tuple(r) for r in lm.score_texts(d, *lm.train(d.where("doc_id not in (9, 103)"))).collect()]
    tok = lambda t: (t or "").encode().lower().split() + [b" end"]
    rows = [(r.doc_id, r.text) for r in d.collect()]
    train = [tok(t) for i, t in rows if i not in (9, 103)]
    c = Counter(w for t in train for w in t)
    grams = lambda t: list(zip([None, None, *t[:-2]] if len(t) > 1 else [None], [None, *t[:-1]], t, strict=True))
    triples = Counter(g for t in train for g in grams(t))
    pairs = Counter((v, w) for _, v, w in triples)
    low = Counter(w for _, w in pairs)
    n, v, total = sum(c.values()), len(c), sum(low.values())
    counts = lambda x: [sum(y == k for y in x.values()) for k in (1, 2, 3, 4)]
    d1, d2, d3 = ([0, *lm.discounts(counts(x))] for x in (low, pairs, triples))
    g0 = sum(d1[min(x, 3)] for x in low.values()) / total

    def sums(of, off):
        context, gamma = Counter(), Counter()
        for (*u, _), k in of.items():
            context[tuple(u)] += k
            gamma[tuple(u)] += off[min(k, 3)]
        return context, gamma

    (c2, b2), (c3, b3) = sums(pairs, d2), sums(triples, d3)
    p1 = lambda w: (low[w] - d1[min(low[w], 3)]) / total + g0 / (v + 1)
    p2 = lambda v, w: p1(w) if not c2[v,] else (pairs[v, w] - d2[min(pairs[v, w], 3)] + b2[v,] * p1(w)) / c2[v,]
    p3 = lambda u, v, w: p2(v, w) if not c3[u, v] else (triples[u, v, w] - d3[min(triples[u, v, w], 3)] + b3[u, v] * p2(v, w)) / c3[u, v]
    known = [*c, b"never seen"]
    assert sum(p3(b"of", b"the", w) for w in known) == pytest.approx(1)
    want = []
    for i, t in rows:
        x = tok(t)
        want.append((i, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), sum(math.log10(p3(*g)) for g in grams(x))))
    key = lambda r: (r[0], r[1])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)
    assert [tuple(r)[1:] for r in lm.score_texts(d.where("doc_id = 6"), *lm.train(empty)).collect()] == [(1, 0, 0, 0.0, 0.0)]


def test_ann(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(700, rows[3][1]), (701, None), (702, [0.0] * 16), (703, [float("nan")] * 16), (None, rows[1][1]), (3, rows[3][1])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.permutation_search(d, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids = [i for i, v in rows[:601]]
    m = np.array([v for _, v in rows[:601]], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = m @ m[ids.index(q)]
        best = [ids[k] for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        hits += len(set(best) & {i for i, _ in found})
        assert [f[1] for f in found] == sorted((f[1] for f in found), reverse=True)
    assert hits >= 0.9 * 5 * len(got) and len(got) == 13
    assert ann.permutation_search(d.where("vec_id > 700"), F.col("id") % 50 == 0).count() == 0


def test_html():
    page = """<html><head><title>T</title><script>a<b</script></head><body><nav><a href=/>Home</a></nav><header>Site name</header>
    <article><h1>A &amp; title</h1><p>First   line<br>goes on&nbsp;here, with enough words to be read.<p>Second one, which isn't closed either.
    <div class="ad">Buy now!</div><ul><li>one<li>two</ul></article><aside>Other</aside><div id="comments"><p>Nice post, I liked it a lot.</p></div><form>x</form><footer>&copy; 2020</footer>"""
    assert html_text.main_text(page) == "A & title\nFirst line goes on here, with enough words to be read.\nSecond one, which isn't closed either.\none\ntwo"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""


def test_minimum_cut_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        u = rng.normal(0, 2, n).round(2).tolist()
        pairs = [(i, j, float(rng.uniform(0, 1.5))) for i, j in combinations(range(n), 2) if rng.random() < 0.4]
        cost = lambda x: sum(abs(a) for a, b in zip(u, x, strict=True) if (a > 0) != b and a) + sum(w for i, j, w in pairs if x[i] != x[j])  # noqa: B023, E731
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(html_text.minimum_cut(u, pairs)) == pytest.approx(best)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(i, 60 + i, FR if i % 2 else EN), "fr" if i % 2 else "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0"), (101, "12 34", "en", "s1"), (102, None, None, "s1"), (103, prose(77, 80) + " password=abcdefgh12345", "en", "s2")]
    make(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    a = corpus_pipeline.identify_language(spark, docs, "")
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in a.collect()} == {101, 102}
    b = corpus_pipeline.drop_near_duplicates(spark, a, "").cache()
    assert {r.doc_id for r in a.collect()} - {r.doc_id for r in b.collect()} == {100} and b.count() == 61
    c = corpus_pipeline.redact_secrets(spark, b, "").cache()
    assert c.columns == docs.columns and "abcdefgh12345" not in c.where("doc_id = 103").first().text
    d = corpus_pipeline.mix_sources(spark, c, "")
    assert d.columns == docs.columns and d.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
