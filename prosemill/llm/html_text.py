"""HTML extraction by minimum-cut labelling.

A page becomes a row of text blocks. A block's classifier cost is its capacity to one terminal:
bounded log odds from its text (length, links, punctuation, tag) and from its place in the document. Blocks that
are neighbours in the page or share a parent are joined by smoothness edges, weaker the further apart
they are in the DOM and the more their places differ. The minimum cut separates content from
boilerplate: a block whose own text tells little, or the wrong thing, goes with its surroundings.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "datalist"}
#: Of these, what runs to the end of a page if nothing closes it; the others end at once.
TO_THE_END = {"script", "style", "textarea", "title", "iframe"}
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = {"hr", "br", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}
#: A start tag of the key closes an open one of the values, up to the nearest of the fences.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}}
NOT_CONTENT = {"nav", "footer", "aside", "button", "menu", "dialog", "search", "fieldset", "head"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
BAD_WORDS = set("ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright cta disclaimer disqus footer footnav gdpr header hidden legal login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promos promoted promotion recommended related replies respond rss search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription tagcloud tags teaser teasers toolbar topbar widget widgets".split())
GOOD_WORDS = set("article articlebody body content entry main maincontent post postbody story storybody text".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ITEMS = {"li", "dt", "dd", "td", "th"}
TEXT_TAGS = {"p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"} | ITEMS
SENTENCE = re.compile(r"[.!?…。！？](?:\W|$)")
NOTE = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)
#: Log odds of a place: inside tags that never hold content, of a name of boilerplate, of an article or a name of content.
NEVER, BAD, GOOD = -12.0, -5.0, 1.5
#: Those of a form, unless it holds half of the page's text or more: then it wraps the page and says nothing.
FORM = -4.5
#: Parts of names that say what an element is made of, not what it is about.
NEUTRAL = set("area bar block box btn button buttons col column container group holder inner item items link links list outer page panel row section site top bottom left right wrap wrapper".split())
#: Capacity of an edge between neighbours of one parent; others get less with the distance.
EDGE = 2.0


class Node:
    """An element: its parent and its depth."""

    __slots__ = ("up", "depth")

    def __init__(self, up=None):
        self.up, self.depth = up, up.depth + 1 if up else 0


def apart(a: Node, b: Node) -> int:
    """Steps between two elements by their nearest common one. Over a page's blocks in order these add up to its tags at most."""
    n = 0
    while a is not b:
        down = a.depth - b.depth
        a, b, n = (a.up if down >= 0 else a), (b.up if down <= 0 else b), n + (2 if down == 0 else 1)
    return n


class Block:
    __slots__ = ("text", "linked", "mark", "node", "tag")

    def __init__(self, text, linked, mark, node, tag):
        self.text, self.linked, self.mark, self.node, self.tag = text, linked, mark, node, tag


def _mark(tag: str, attrs: str, inherited: float, in_article: bool) -> float:
    """The log odds of an element's place: NEVER, BAD, 0 (nothing known) or GOOD.

    What is inside a place that never holds content stays there. Otherwise the innermost mark holds, but
    a name of content inside one of boilerplate says nothing, unless it is an article or an itemprop.
    """
    if inherited <= NEVER:
        return inherited
    if tag in NOT_CONTENT or tag == "header" and not in_article:
        return NEVER
    if attrs and tag not in ("html", "body"):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs) if m[1]}
        if found.get("role", "").lower() in BAD_ROLES or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs):
            return NEVER
        names = [[w.lower() for w in WORDS.findall(name)] for k in ("class", "id", "itemprop") for name in found.get(k, "").split()]
        bad = 0.0
        for words in names if tag not in ("article", "main") else ():
            # "post-header" names a part of the content, "content-sidebar" does not
            odd = [w for w in words if w in BAD_WORDS and not (in_article and w in ("header", "byline"))]
            told = [w for w in words if w not in NEUTRAL or w in odd]
            # a name that is about something else as well, as "related-work", says as much less
            if odd:
                bad = min(bad, BAD * len(odd) / len([w for w in told if w not in GOOD_WORDS] or odd))
        good = found.get("role") == "main" or any(w in GOOD_WORDS for words in names for w in words)
        if bad and good and any(words and all(w in GOOD_WORDS for w in words) for words in names):
            # "post widget": one name against the other
            return min(inherited, max(bad, -GOOD))
        if bad:
            return min(inherited, bad) if bad <= BAD or inherited <= 0 else inherited + bad
        if good:
            return GOOD if inherited >= 0 or inherited == FORM or found.get("itemprop") else inherited
    if tag in ("article", "main"):
        # an article among comments or teasers is one of them
        return GOOD if inherited >= 0 or inherited == FORM else inherited
    return FORM if tag == "form" and inherited > FORM else inherited


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, white space collapsed, references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, float, Node, bool]] = [("", 0.0, Node(), False)]
    opened: Counter = Counter()
    endless: set[str] = set()
    parts: list[str] = []
    linked, in_link, pos = 0, False, 0

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            t = html.unescape(raw) if "&" in raw else raw
            parts.append(t)
            if in_link:
                linked += len(t.strip())

    def flush() -> None:
        nonlocal linked
        if parts:
            t = " ".join("".join(parts).split())
            if t:
                out.append(Block(t, min(1.0, linked / len(t)), stack[-1][1], stack[-1][2], stack[-1][0]))
            parts.clear()
        linked = 0

    n = len(page)
    while pos < n:
        m = TOKEN.search(page, pos)
        if not m:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        closing, attrs = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                # no end tag is looked for twice
                end = RAW_END[tag].search(page, pos) if tag not in endless else None
                if end:
                    pos = end.end()
                elif tag in TO_THE_END:
                    pos = n
                else:
                    endless.add(tag)
            parts.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            in_link = False
            if closing:
                if opened[tag]:
                    while pop() != tag:
                        pass
                continue
            if tag in CLOSES:
                fence = FENCES.get(tag, BLOCKS - CLOSES[tag])
                k = len(stack) - 1
                while k > 0 and stack[k][0] not in fence and stack[k][0] not in CLOSES[tag]:
                    k -= 1
                if k > 0 and stack[k][0] in CLOSES[tag]:
                    while len(stack) > k:
                        pop()
            elif stack[-1][0] == "p":
                pop()
            if tag not in VOID and not attrs.endswith("/"):
                top = stack[-1]
                mark = _mark(tag, attrs, top[1], top[3])
                opened[tag] += 1
                stack.append((tag, mark, Node(top[2]), top[3] or tag in ("article", "main")))
    flush()
    inside = sum(len(b.text) for b in out if b.mark == FORM)
    if 2 * inside >= sum(len(b.text) for b in out):
        for b in out:
            if b.mark == FORM:
                b.mark = 0.0
    return out


def text_odds(b: Block, words: int) -> float:
    """Log odds for content of a block's text and tag alone, within -8..4; ``words`` are those of its list, else its own.

    Calibrated on the rule that a paragraph of about eight words says nothing: longer ones speak for
    content with the logarithm of their length, shorter ones against it; so do links, and sentences for it.
    """
    x = min(2.2, max(-2.2, 0.9 * math.log2(words + 1) - 3.2))
    x -= 4.0 * b.linked if b.text.count(" ") < 24 else 2.0 * b.linked
    if SENTENCE.search(b.text):
        x += 0.5
    if b.tag in TEXT_TAGS:
        x += 0.4
    if NOTE.match(b.text):
        x -= 2.0
    return x


def odds(bs: list[Block]) -> list[float]:
    """The classifier's log odds for content of each block, from its text and place; items of a list count as one text for their length."""
    own = [b.text.count(" ") + 1 for b in bs]
    lists: dict[tuple, int] = {}
    for b, n in zip(bs, own, strict=True):
        if b.tag in ITEMS:
            lists[b.node.up] = lists.get(b.node.up, 0) + n
    return [b.mark + text_odds(b, lists[b.node.up] if b.tag in ITEMS else n) for b, n in zip(bs, own, strict=True)]


def edges(bs: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours, and the last block under the same parent; weaker between places of another mark."""
    out, last = [], {}
    for i, b in enumerate(bs):
        if i:
            far = max(0, apart(bs[i - 1].node, b.node) - 2)
            out.append((i - 1, i, EDGE * math.exp(-abs(bs[i - 1].mark - b.mark)) / (1 + far)))
        parent = b.node.up
        if (k := last.get(parent)) is not None and k != i - 1:
            out.append((k, i, EDGE * math.exp(-abs(bs[k].mark - b.mark)) / 2))
        last[parent] = i
    return out


def minimum_cut(unary: list[float], pairs: list[tuple[int, int, float]]) -> list[bool]:
    """Labels x with the least sum of |unary| over blocks labelled against its sign and of weights of cut pairs.

    A block whose terminal capacity exceeds all its edges keeps its sign in every minimum
    cut, so it is folded into its neighbours' capacities first; the rest is a maximum flow from positive to
    negative blocks, in phases of shortest paths. At a tie a block is content.
    """
    n = len(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in pairs:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    u, label = list(unary), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(u[i]) > sum(near[i].values()):
            label[i] = u[i] > 0
            for j, w in near[i].items():
                u[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    free = [i for i in range(n) if label[i] is None]
    low = _still_low(free, u, near)
    for i in free:
        label[i] = i not in low
    return label


def _still_low(free: list[int], u: list[float], near: list[dict[int, float]]) -> set[int]:
    """The nodes that reach the sink when the flow from positive to negative nodes is at its maximum."""
    place = {i: k for k, i in enumerate(free)}
    source, sink = len(free), len(free) + 1
    at, room, out = [], [], [[] for _ in range(len(free) + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(at))
        out[b].append(len(at) + 1)
        at.extend((b, a))
        room.extend((there, back))

    for k, i in enumerate(free):
        if u[i] > 0:
            edge(source, k, u[i], 0.0)
        elif u[i] < 0:
            edge(k, sink, -u[i], 0.0)
        for j, w in near[i].items():
            if place[j] > k:
                edge(k, place[j], w, w)
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue and level[sink] < 0:
            v = queue.popleft()
            for e in out[v]:
                if room[e] > 1e-12 and level[at[e]] < 0:
                    level[at[e]] = level[v] + 1
                    queue.append(at[e])
        if level[sink] < 0:
            break
        todo, path, v = [0] * len(out), [], source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                v = at[path[first] ^ 1]
                del path[first:]
            while todo[v] < len(out[v]) and not (room[out[v][todo[v]]] > 1e-12 and level[at[out[v][todo[v]]]] == level[v] + 1):
                todo[v] += 1
            if todo[v] < len(out[v]):
                path.append(out[v][todo[v]])
                v = at[path[-1]]
            elif path:
                v = at[path.pop() ^ 1]
                todo[v] += 1
            else:
                break
    low, queue = {sink}, deque([sink])
    while queue:
        v = queue.popleft()
        for e in out[v]:
            if room[e ^ 1] > 1e-12 and at[e] not in low:
                low.add(at[e])
                queue.append(at[e])
    return {free[k] for k in low if k < len(free)}


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by newlines; empty for null or no content."""
    bs = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(bs, minimum_cut(odds(bs), edges(bs)), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars; a row for each row.

    Null or empty html gives an empty text. Pages are taken one by one without a shuffle, so ties,
    repeated rows and null ids change nothing. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; see extract() for nulls, ties, repeated rows and empty input."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
