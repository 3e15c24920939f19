"""Distributed vocabulary training against one merge after the other."""

import random
from collections import Counter

import numpy as np
import pytest
import regex

from prosemill.functions import patterns as P
from prosemill.operators import vocabulary


def sequential(texts, vocab_size, min_frequency=2):
    stand_in = vocabulary.byte_symbols()
    tokens = [P.END_OF_TEXT, *sorted(stand_in)]
    known = {t: i for i, t in enumerate(tokens)}
    counts = Counter(w for t in texts for line in regex.findall("[^\n]*\n|[^\n]+", t or "") for w in regex.findall(P.PRE_TOKEN, line))
    words = [([known[stand_in[b]] for b in w.encode()], n) for w, n in counts.items()]
    pairs, where = Counter(), {}
    for i, (w, n) in enumerate(words):
        for p in zip(w, w[1:]):
            pairs[p] += n
            where.setdefault(p, set()).add(i)
    merges = []
    while len(tokens) < vocab_size and pairs:
        n, left, right = min((-n, *p) for p, n in pairs.items())
        if -n < min_frequency:
            break
        token = tokens[left] + tokens[right]
        if token not in known:
            known[token] = len(tokens)
            tokens.append(token)
        merges.append((left, right, known[token], -n))
        for i in where.pop((left, right)):
            w, m = words[i]
            for p in zip(w, w[1:]):
                pairs[p] -= m
            out, k = [], 0
            while k < len(w):
                hit = k + 1 < len(w) and (w[k], w[k + 1]) == (left, right)
                out.append(known[token] if hit else w[k])
                k += 1 + hit
            words[i] = out, m
            for p in zip(out, out[1:]):
                pairs[p] += m
                where.setdefault(p, set()).add(i)
        pairs = +pairs
    return tokens, merges


def train(spark, texts, vocab_size, **options):
    return vocabulary.train_bpe(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), vocab_size, **options)


def test_passes_merge_as_one_after_the_other():
    rng = random.Random(1)
    for _ in range(300):
        words = [[rng.randrange(5) for _ in range(rng.randint(1, 12))] for _ in range(4)]
        ranked = [(a, b, 9) for a, b in rng.sample([(a, b) for a in range(5) for b in range(5)], 8)]
        batch = {(a, b): (i, 100 + i) for i, (a, b, _) in enumerate(vocabulary.next_batch(ranked, 9))}
        flat, of = np.array(sum(words, []), np.int64), np.repeat(np.arange(4), [len(w) for w in words])
        got, word, made = vocabulary.merge_pass(flat, of, batch, True)
        born = Counter()
        for pair, (i, new) in batch.items():
            for k, w in enumerate(words):
                out, at = [], 0
                while at < len(w):
                    hit = tuple(w[at : at + 2]) == pair
                    out.append(new if hit else w[at])
                    at += 1 + hit
                was, now = Counter(zip(w, w[1:])), Counter(zip(out, out[1:]))
                for p in now - was:
                    born[(*p, i, k)] = (now - was)[p]
                words[k] = out
        assert got.tolist() == sum(words, [])
        counted = Counter(zip(*(c.tolist() for c in made)))
        assert all(counted[k] >= n for k, n in born.items())


@pytest.mark.parametrize("seed", range(2))
def test_small_corpora(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(60)) + "\n\n x" for _ in range(12)] + [None, "", "aaaaaaa aaaa"]
    assert train(spark, texts, 330) == sequential(texts, 330)


def test_ends(spark):
    tokens, merges = train(spark, [None, ""], 300)
    assert len(tokens) == 257 and tokens[0] == P.END_OF_TEXT and merges == []
    assert train(spark, ["ab ab cd"], 300)[1] == sequential(["ab ab cd"], 300)[1]
    assert len(train(spark, ["abc abc abc"], 258)[0]) == 258


def test_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert train(spark, texts, 900) == sequential(texts, 900)


def test_lines_of_a_text_at_once():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("ab1 .'s  \t\r\n\n\x0b\x1c\x85\xa0é") for _ in range(rng.randint(0, 14)))
        assert regex.findall(vocabulary.LINE_PRE_TOKEN, text) == [w for line in regex.findall("[^\n]*\n|[^\n]+", text) for w in regex.findall(P.PRE_TOKEN, line)]


def test_a_pass_does_not_repeat_all_merges(spark, monkeypatch):
    """What a pass over the pre-tokens merges again is bounded: the merges before have been written."""
    pending, counted = [], vocabulary._counted
    monkeypatch.setattr(vocabulary, "_counted", lambda steps, *more: pending.append(len(steps)) or counted(steps, *more))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()]
    assert train(spark, texts, 330) == sequential(texts, 330)
    assert len(pending) > 20 and max(pending) <= 4
