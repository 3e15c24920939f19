"""op13 against the sentencepiece library: ids, decoded texts, odd texts and the query's digests."""

import hashlib
import random

import numpy as np
import pytest

from prosemill.llm import pieces

ODD = ["", " ", "  a", "a\tb\n\nc", "▁x", "\x00a", "日本語 💩", "a  b ", "é", "<s>x</s>", "<0x0A>", " " * 900, "a" * 3000, "=" * 77 + " " * 50 + "x", "abab" * 500, "\U0010ffff�", "the the  the   the"]


@pytest.fixture(scope="module")
def model():
    return pieces.public_model()


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def random_texts(seed, n):
    rng = random.Random(seed)
    parts = ["in", "the", "ing", "ion", "er", " ", "  ", "▁", "e", "st", "atio", "\n", "é", "日", "💩", "=", "-", "7", "T"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(model, library):
    encoder = pieces.Encoder(model)
    texts = ODD + random_texts(1, 3000)
    got = [x.tolist() for at in range(0, len(texts), 100) for x in encoder.encode(texts[at : at + 100])]
    assert got == library.encode(texts)
    assert encoder.pieces.decode([np.array(x, np.int64) for x in got]) == library.decode(got)


def test_any_ids_decode_as_in_the_library(model, library):
    rng = random.Random(2)
    ids = [[rng.choice((rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3))) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    assert pieces.Encoder(model).pieces.decode([np.array(x, np.int64) for x in ids]) == library.decode(ids)


def test_rounds_equal_one_merge_after_the_other(model):
    p = pieces._pieces(model)
    words = sorted({w for t in random_texts(3, 500) for w in pieces.WORD.findall(pieces.SPACE + t.replace(" ", pieces.SPACE)) if w.isascii()})
    flat, count = p.merge(words)
    ends = np.cumsum(count)
    for w, end, n in zip(words, ends, count, strict=True):
        one = p.in_order(p.char[[ord(c) for c in w]].tolist())
        if max(one) < pieces.LONE:
            assert one == flat[end - n : end].tolist()


def test_frames(spark, model, library):
    rows = [(1, "a b", "x", [9]), (1, "a b", "x", [9]), (2, None, None, None), (3, "", "y", []), (None, "long " * 30000, "z", [1])]
    d = spark.createDataFrame(rows, "doc_id long, text string, decoded string, IDS array<int>").repartition(2)
    e = pieces.encode(d, model)
    assert e.columns == ["doc_id", "text", "decoded", "ids"]
    out = pieces.decode(e, model)
    assert out.columns == ["doc_id", "text", "ids", "decoded"] and out.count() == 5
    for r in out.collect():
        assert r.ids == library.encode(r.text or "", add_eos=True) and r.decoded == (r.text or "")
    assert pieces.encode(d.where("doc_id = 8"), model).count() == 0
    assert pieces.encode(d, model, eos=False).where("size(ids) = 0").count() == 2
    nulls = pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), model)
    assert sorted(r.decoded is None for r in nulls.collect()) == [False, True]


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pieces.op13_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
