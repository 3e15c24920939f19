"""Secret scans: a worklist of decoded layers, each scanned, with spans mapped to the text.

The root layer is the text. A layer is unwrapped in three ways: all URL and Unicode escapes
in it are decoded in place, which gives one further layer of the whole text; each URL-escaped run
of compressed bytes gives a layer of its content; and each base64 run that decodes to
(possibly compressed) bytes gives a layer for each of its four alignments, as other characters may be glued to its front; lines
of base64 are one run, too. Every layer keeps, for each character, the range of the root text that it came from.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ESCAPE = re.compile(r"((?:%[0-9A-Fa-f]{2})+)|\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINE_END = r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t>]*"
#: A run that is broken over lines (also by escaped ends): all but the last have 16 characters or more. A run is tried at its start only.
LINES64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{_LINE_END}[A-Za-z0-9+/_-]{{16,}}+)*+(?:{_LINE_END}[A-Za-z0-9+/_-]++)?+={{0,2}}")
LINE_END = re.compile(_LINE_END)
#: URL-escaped bytes that begin as gzip or zlib data do.
PACKED_URL = re.compile(r"(?:%1[fF]%8[bB]|(?:x|%78)(?:%(?:9[cC]|01|[dD][aA]|5[eE])|\^))(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9._~/+-])+")
#: Where gzip or zlib data may begin inside a base64 run.
PACKED64 = re.compile(r"H4sI|(?<=[/+_-])e(?:AE|F4|J[w-z]|N[o-r])")
#: A compressed layer is scanned in parts of about this many bytes, which may share the last of them.
MAX_LAYER_BYTES, OVERLAP = 1 << 25, 1 << 18
#: Bytes that no pattern takes.
BETWEEN = re.compile(rb"[\x00-\x1f!#$&(-*,;<>?@\[\]^`|~\x7f]")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns, leftmost and non-overlapping by kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text and its pieces, as arrays: place in the layer, root start, root end, whether characters map one to one."""

    def __init__(self, text: str, place, start, end, same):
        self.text = text
        self.place, self.start, self.end = (np.asarray(x, np.int64) for x in (place, start, end))
        self.same = np.asarray(same, bool)

    def roots(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The root ranges of characters i."""
        k = np.searchsorted(self.place, i, side="right") - 1
        at = self.start[k] + np.where(self.same[k], i - self.place[k], 0)
        return at, np.where(self.same[k], at + 1, self.end[k])

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The root range of a non-empty range; pieces of one layer lie in root order."""
        a, b = self.roots(np.array([start, end - 1]))
        return int(a[0]), int(b[1])

    def cut(self, start: int, end: int, place: int) -> tuple[np.ndarray, ...]:
        """The pieces of [start, end), moved to ``place`` in another layer."""
        k = slice(int(np.searchsorted(self.place, start, side="right")) - 1, int(np.searchsorted(self.place, end)))
        skip = np.maximum(0, start - self.place[k])
        return place + np.maximum(self.place[k], start) - start, self.start[k] + np.where(self.same[k], skip, 0), self.end[k], self.same[k]


def _unescaped(layer: Layer) -> Layer | None:
    """The layer with each URL and Unicode escape decoded, or None if it has none."""
    text, parts, pieces, size, last = layer.text, [], [], 0, 0
    for m in ESCAPE.finditer(text):
        if m[1]:
            chars, widths = _decoded(bytes.fromhex(m[1].replace("%", "")))
            ends = m.start() + 3 * np.cumsum(widths)
            begins = ends - 3 * np.array(widths)
        else:
            code = 0x10000 + ((int(m[2], 16) - 0xD800) << 10) + int(m[3], 16) - 0xDC00 if m[2] else int(m[4] or m[5] or m[6], 16)
            chars = "\ufffd" if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)
            begins, ends = np.array([m.start()]), np.array([m.end()])
        if m.start() > last:
            parts.append(text[last : m.start()])
            pieces.append(layer.cut(last, m.start(), size))
            size += m.start() - last
        parts.append(chars)
        pieces.append((size + np.arange(len(chars)), layer.roots(begins)[0], layer.roots(ends - 1)[1], np.zeros(len(chars), bool)))
        size += len(chars)
        last = m.end()
    if not last:
        return None
    if last < len(text):
        parts.append(text[last:])
        pieces.append(layer.cut(last, len(text), size))
    return Layer("".join(parts), *(np.concatenate(x) for x in zip(*pieces, strict=True)))


def _compressed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0)


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of chunks of gzip or zlib data, in pieces: all members, and as they are the bytes that are none."""
    d = None
    for raw in chunks:
        while raw:
            if d is None:
                if not _compressed(raw):
                    yield raw
                    break
                d = zlib.decompressobj(47)
            try:
                out = d.decompress(raw, MAX_LAYER_BYTES)
            except zlib.error:
                yield raw
                d = None
                break
            rest = d.unused_data if d.eof else d.unconsumed_tail
            if out:
                yield out
            d, raw = None if d.eof else d, rest


def _merged(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The pieces, joined to MAX_LAYER_BYTES each as long as there are more."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= MAX_LAYER_BYTES:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _plain(raw: bytes) -> Iterator[bytes]:
    """raw, or its content without gzip or zlib layers, to the fixpoint, in parts.

    A part ends behind a byte that no pattern takes; without one it ends anywhere, and the next repeats the last OVERLAP bytes.
    """
    if not _compressed(raw):
        yield raw
        return
    chunks, seen, first = iter([raw]), set(), raw
    while _compressed(first) and (key := hashlib.md5(first).digest()) not in seen:
        seen.add(key)
        chunks = _merged(_inflated(chunks))
        first = next(chunks, b"")
        chunks = chain([first], chunks)
    left = b""
    for part in chunks:
        part, left = left + part, b""
        if len(part) >= MAX_LAYER_BYTES:
            tail = part[-OVERLAP:]
            cut = max((m.end() for m in BETWEEN.finditer(tail)), default=0)
            left = tail[cut:]
            part = part[: len(part) - len(left)] if cut else part
        if part:
            yield part
    if left:
        yield left


def _decoded(raw: bytes) -> tuple[str, np.ndarray]:
    """A text of the bytes, and how many each character takes; bytes that are not UTF-8 are taken as latin-1."""
    if raw.isascii():
        return raw.decode(), np.ones(len(raw), np.int64)
    points = np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")
    lone = (points >= 0xDC80) & (points <= 0xDCFF)
    widths = np.where(lone, 1, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
    return np.where(lone, points - 0xDC00, points).astype("<u4").tobytes().decode("utf-32-le"), widths


def _whole(layer: Layer, start: int, end: int, raw: bytes) -> Iterator[Layer]:
    """Layers of the content of compressed bytes that came from [start, end)."""
    a, b = layer.span(start, end)
    for plain in _plain(raw):
        yield Layer(_decoded(plain)[0], [0], [a], [b], [False])


def _packed_layers(layer: Layer) -> Iterator[Layer]:
    for m in PACKED_URL.finditer(layer.text):
        yield from _whole(layer, m.start(), m.end(), unquote_to_bytes(m[0]))


def _lines_joined(layer: Layer) -> Iterator[Layer]:
    """Each run of base64 over several lines as one line. These texts are decoded, never scanned: lines that only look like base64 stay apart."""
    if "\n" not in layer.text and "\\n" not in layer.text:
        return
    for m in LINES64.finditer(layer.text):
        ends = [(e.start(), e.end()) for e in LINE_END.finditer(layer.text, m.start(), m.end())]
        if not ends:
            continue
        parts, pieces, size = [], [], 0
        for a, b in zip([m.start(), *(e for _, e in ends)], [*(a for a, _ in ends), m.end()], strict=True):
            if b > a:
                parts.append(layer.text[a:b])
                pieces.append(layer.cut(a, b, size))
                size += b - a
        yield Layer("".join(parts), *(np.concatenate(x) for x in zip(*pieces, strict=True)))


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    for m in BASE64.finditer(layer.text):
        run = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        for skip in (*range(4), *(p.start() for p in PACKED64.finditer(m[0]) if p.start() > 3)):
            own = run[skip : len(run) - ((len(run) - skip) % 4 == 1)]
            raw = base64.b64decode(own + "=" * (-len(own) % 4))
            if _compressed(raw):
                yield from _whole(layer, m.start() + skip, m.end(), raw)
            elif skip < 4:
                text, widths = _decoded(raw)
                # nothing to find, as in most words that look like base64
                if scan(text) or ESCAPE.search(text) or BASE64.search(text):
                    ends = np.cumsum(widths)
                    first, last = (ends - widths) * 8 // 6, (ends * 8 - 1) // 6
                    at = m.start() + skip
                    yield Layer(text, np.arange(len(text)), layer.roots(at + first)[0], layer.roots(at + last)[1], np.zeros(len(text), bool))


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and all spans of a text as sorted (start, kind's place, end); null is empty.

    Layers are processed until none is new; a layer with the same text from the same root
    range as an earlier one is not processed again, so cycles end. A decoded span is the
    root range that its characters came from; equal spans count once.
    """
    text = text or ""
    base = sorted(scan(text))
    spans = set(base)
    # layers are made when their turn comes, so a large one isn't held in all its parts
    todo = [iter([Layer(text, [0], [0], [len(text)], [True])] if text else [])]
    seen = set()
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        if not layer.text:
            continue
        key = (hashlib.md5(layer.text.encode("utf-8", "replace")).digest(), layer.span(0, len(layer.text)))
        if key in seen:
            continue
        if seen:
            spans |= {((at := layer.span(a, b))[0], k, at[1]) for a, k, b in scan(layer.text)}
        seen.add(key)
        if ("%" in layer.text or "\\" in layer.text) and (inner := _unescaped(layer)):
            todo.append(iter([inner]))
            todo.append(_packed_layers(layer))
        todo.append(chain(_base64_layers(layer), chain.from_iterable(map(_base64_layers, _lines_joined(layer)))))
    return base, sorted(spans)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, last = [], 0
    for a, _, b in spans:
        if b <= last:
            continue
        if a >= last:
            out += [text[last:a], mark]
        last = b
    return "".join(out) + text[last:]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base, spans = find_secrets(text)
            count = [sum(k == x for _, x, _ in base) for k in range(3)]
            rows.append((*count, hashlib.sha256(told(base).encode()).hexdigest(), told(spans), redacted(text, spans) if spans else text))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 3, strict=True)]],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean_text"],
        )


def secret_scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, counts of base spans, base_sha256, spans, clean_text; a row for each row.

    clean_text has every span replaced by a mark (null stays null). Rows are scanned for
    themselves, without a shuffle; null or repeated ids change nothing. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, clean_text string"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_scan_batches, schema)


def _redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        clean = [text and redacted(text, find_secrets(text)[1]) for text in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))


def redact(docs: DataFrame) -> DataFrame:
    """Any table with a column text -> the same rows and columns, with every secret in text replaced by a mark."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_redact_batches, docs.schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; see find_secrets() and secret_scan() for nulls, ties, repeated rows and empty input."""
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("clean_text")
