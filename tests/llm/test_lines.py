"""op8 on base64 over lines, against a plain recursive decoder of strings."""

import base64
import gzip
import random
import re
import time
import zlib
from urllib.parse import quote, unquote

import pytest

from prosemill.llm import secrets

SECRET = "password = hunter2hunter2"
LINE = re.compile(r"[A-Za-z0-9+/]{16,}(?:[ \t]*(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/]{16,})*(?:[ \t]*(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/]+)?={0,2}")


def wrap(raw, width, end="\n"):
    t = base64.b64encode(raw).decode()
    return end.join(t[i : i + width] for i in range(0, len(t), width))


def layers(text, depth=0):
    """All texts that a text unwraps to, by strings alone: no spans, no worklist."""
    yield text
    if depth > 5:
        return
    if "%" in text and unquote(text) != text:
        yield from layers(unquote(text), depth + 1)
    if "\\u" in text:
        yield from layers(re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text), depth + 1)
    for m in LINE.finditer(text):
        run = re.sub(r"\s|\\n", "", m[0]).rstrip("=")
        for skip in range(4):
            own = run[skip : len(run) - ((len(run) - skip) % 4 == 1)]
            raw = base64.b64decode(own + "=" * (-len(own) % 4))
            try:
                raw = zlib.decompressobj(47).decompress(raw)
            except zlib.error:
                pass
            yield from layers(raw.decode("latin-1"), depth + 1)


def has_secret(text):
    return any(len(m[2]) >= 12 for t in layers(text) for m in secrets.ASSIGN.finditer(t))


@pytest.mark.parametrize("width", [16, 40, 64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n    ", "\\n", " \n> "])
def test_lines(width, end):
    raw = b"some words in front; " + SECRET.encode() + b" and some more words behind it, to fill the lines"
    text = "head of it\ndata:\n" + wrap(raw, width, end) + "\n-- \nfoot"
    base, spans = secrets.find_secrets(text)
    assert base == [] and len(spans) == 1
    start, kind, stop = spans[0]
    assert kind == 0 and text.index("data:") < start < stop <= text.index("\n-- ")
    # the span begins with the character that the secret's first byte came from
    lines = re.sub(r"\s|>|\\n|\\r", "", text[text.index("data:") + 5 : start])
    assert len(lines) == 21 * 8 // 6


def test_nested_against_plain_decoder():
    rng = random.Random(7)
    steps = [lambda t: wrap(t.encode(), 40), lambda t: wrap(gzip.compress(t.encode()), 64), lambda t: wrap(zlib.compress(t.encode()), 76, "\r\n"), quote, lambda t: base64.b64encode(t.encode()).decode(), lambda t: "".join(f"\\u{ord(c):04x}" if c in "=pw" else c for c in t)]
    for i in range(120):
        t = f"note {i}: " + (SECRET if i % 3 else "nothing to hide in this line") + " end of the note"
        for step in rng.sample(steps, rng.randint(1, 3)):
            t = step(t)
        t = f"text in front:\n{t}\nand text behind it"
        assert bool(secrets.find_secrets(t)[1]) == has_secret(t), t


def test_lines_that_are_no_base64():
    hashes = "\n".join("0123456789abcdef" * 2 for _ in range(5))
    base, spans = secrets.find_secrets(hashes)
    assert spans == base and len(base) == 5
    assert secrets.redacted("a\n" + wrap(SECRET.encode() * 3, 40) + "\nb", secrets.find_secrets("a\n" + wrap(SECRET.encode() * 3, 40) + "\nb")[1]).count("[secret]") >= 1
    start = time.time()
    secrets.find_secrets("A" * 2_000_000)
    secrets.find_secrets("longerthansixteenletters\n" * 20_000)
    assert time.time() - start < 60
