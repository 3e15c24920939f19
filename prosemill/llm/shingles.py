"""Words and word shingles of texts as 64-bit hashes, for the Python operators."""

from __future__ import annotations

import numpy as np
import xxhash

#: Hashed words that are kept before the table is cleared.
CACHE_WORDS = 200_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than space and \\t..\\r, with A-Z in lower case; none for null."""
    return text.encode("utf-8", "replace").lower().split() if text else []


class WordHash:
    """Hashes of words, each computed once as long as the table holds it."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, ws: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            return np.array([known[w] for w in ws], np.uint64)
        except KeyError:
            for w in ws:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in ws], np.uint64)


#: Bytes of a text that are hashed at once; a word is never cut.
CHUNK = 1 << 20
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(5).integers(0, 2**64 - 1, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_INVERSE = np.uint64(pow(int(_M1), -1, 2**64))
_powers: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, those that words() finds: polynomials over bytes mod 2^64, from running sums."""
    data, out, at = (text or "").encode("utf-8", "replace"), [], 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            x = np.frombuffer(data, np.uint8, CHUNK, at)
            gaps = np.flatnonzero(_GAP[x])
            while not len(gaps) and end < len(data):
                x = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - end), end)
                gaps, at_gap, end = np.flatnonzero(_GAP[x]), end, end + len(x)
                end = at_gap + int(gaps[0]) + 1 if len(gaps) else end
            if end == at + CHUNK:
                end = at + int(gaps[-1]) + 1
        x = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        at += len(x)
        if len(x) >= len(_powers[0]):
            for i, p in enumerate((_M1, _INVERSE)):
                _powers[i] = np.cumprod(np.append(np.uint64(1), np.full(2 * len(x), p, np.uint64)))
        gap = np.ones(len(x) + 2, bool)
        gap[1:-1] = _GAP[x]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE[x] * _powers[0][: len(x)], out=total[1:])
        start = edges[::2]
        out.append(mixed((total[edges[1::2]] - total[start]) * _powers[1][start]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(29))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of the whole sequence, if it is shorter and not empty."""
    n = min(n, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed((out * _M1) ^ h[i : len(h) - n + 1 + i])
    return out


def hash_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``count`` hash functions x -> a * x + b mod 2^64."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**64 - 1, count, np.uint64)


def min_hashes(x: np.ndarray, family: tuple[np.ndarray, np.ndarray], part: int = 2048) -> np.ndarray:
    """The least value of each hash function over a non-empty set, its upper 32 bits."""
    a, b = family
    out = np.full(len(a), np.uint64(2**64 - 1), np.uint64)
    for i in range(0, len(x), part):
        np.minimum(out, (a[:, None] * x[i : i + part] + b[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)
