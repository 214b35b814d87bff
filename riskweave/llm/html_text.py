"""Main text of web pages by a minimum cut.

A page is cut into blocks of text at its block-level tags. A linear classifier
turns what surrounds a block (the innermost telling container), its length, links
and punctuation into the cost of calling it boilerplate or content; these costs
are the capacities of its edges to the two terminals. Neighbours in page order and
neighbours under one parent are joined by smoothness edges, weaker the further
apart they are in the tree. The minimum cut, found by maximum flow, labels all
blocks at once; the source side is the main text. A block whose own costs outweigh
all its edges is labelled before (it is so in every minimum cut), which leaves the
flow small.

Weights are fixed parameters below. Python's html.parser is not used: pages are read in
one linear pass of a regular expression, so broken mark-up costs no more.

Defined cases: a null or empty page, or one without text outside scripts, styles
and mark-up, has an empty text; unclosed tags end with their container; rows that repeat
a page_id are handled one by one; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import slices

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_OPENS = re.compile(r"</?[a-zA-Z]|<[!?]")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z]+")

# Element names of HTML by their part in the text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video textarea select button title head".split())
_RAW = frozenset("script style noscript template iframe textarea title".split())
# Looked for in the page itself: lower-casing changes the length of some texts.
_ENDS = {name: re.compile(f"</{name}", re.I | re.A) for name in _RAW}
_BLOCKS = frozenset(
    "html body article main section nav header footer aside form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th"
    " caption blockquote pre figure figcaption fieldset legend address hr details summary dialog menu center label option".split()
)
_CONTENT = {"article": 1.0, "main": 1.0}
_BOILERPLATE = frozenset("nav footer aside form dialog menu header".split())
_BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner cookie cookies consent notice notices menu nav navbar navigation sidebar footer header"
    " comment comments reply replies share sharing social related promo promoted promotion sponsor sponsored newsletter subscribe"
    " subscription breadcrumb breadcrumbs widget popup modal login signup search masthead toolbar pagination pager disclaimer copyright".split()
)
_GOOD_NAMES = frozenset("article content main post entry story body text".split())
#: An end tag, or a start tag of the same sort, closes these.
_SELF_CLOSING = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}

# Parameters of the classifier and of the cut.
_BIAS, _LENGTH, _LINKS, _SENTENCE, _HEADING = -1.0, 0.8, -3.0, 0.7, 0.5
_IN_CONTENT, _IN_NAMED, _IN_BOILERPLATE, _IN_HEADER = 5.0, 2.5, -8.0, 1.0
_SMOOTH = 0.6


class _Block:
    __slots__ = ("text", "score", "path", "parent")

    def __init__(self, text: str, score: float, path: tuple[int, ...]):
        self.text, self.score, self.path, self.parent = text, score, path, path[-1] if path else -1


def _container(name: str, attributes: str, inside_content: bool) -> float:
    """What an element says about the text in it: positive for content, negative for boilerplate, 0 for nothing."""
    if name in _CONTENT:
        return _IN_CONTENT
    if name in ("html", "body"):
        return 0.0
    named = 0.0
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                words = set(_WORDS.findall(value))
                if words & _BAD_NAMES:
                    return _IN_BOILERPLATE
                if words & _GOOD_NAMES:
                    named = _IN_NAMED
            elif key == "role":
                if value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog"):
                    return _IN_BOILERPLATE
                if value in ("main", "article"):
                    return _IN_CONTENT
            elif key == "style" and "display:none" in value.replace(" ", ""):
                return _IN_BOILERPLATE
            elif key == "aria-hidden" and value == "true":
                return _IN_BOILERPLATE
        if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
            return _IN_BOILERPLATE
    if name in _BOILERPLATE:
        return _IN_HEADER if name == "header" and inside_content else _IN_BOILERPLATE
    return named


def blocks(page: str) -> list[_Block]:
    """Blocks of text in page order, scored; the score is the log odds of content."""
    found: list[_Block] = []
    stack: list[tuple[str, int, float]] = []  # element, its number, the innermost telling container's weight
    parts: list[str] = []
    linked = 0
    in_link = False
    serial = 0
    skipping = 0

    def close_block() -> None:
        nonlocal linked
        if not parts:
            return
        raw = "".join(parts)
        parts.clear()
        links, linked = linked, 0
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if not text:
            return
        weight = stack[-1][2] if stack else 0.0
        words = text.count(" ") + 1
        score = _BIAS + weight + _LENGTH * math.log1p(words) + _LINKS * min(1.0, links / max(1, len(raw.strip())))
        if text[-1] in ".!?…。":
            score += _SENTENCE
        if stack and weight > 0 and len(stack[-1][0]) == 2 and stack[-1][0][0] == "h":
            score += _HEADING
        found.append(_Block(text, score, tuple(s[1] for s in stack)))

    def add(text: str) -> None:
        nonlocal linked
        if skipping or not text:
            return
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    def push(name: str, attributes: str) -> None:
        nonlocal serial, skipping
        serial += 1
        outer = stack[-1][2] if stack else 0.0
        own = _container(name, attributes, outer > 0)
        stack.append((name, serial, own or outer))
        if name in _SKIPPED:
            skipping += 1

    def pop_to(name: str) -> None:
        nonlocal skipping
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                skipping -= sum(1 for s in stack[i:] if s[0] in _SKIPPED)
                del stack[i:]
                return

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        m = _TAG.match(page, start)
        if m is None:
            if not _OPENS.match(page, start):
                add("<")
                at = start + 1
                continue
            # A tag with an open quote ends at the next ">"; one that never ends takes the rest with it.
            stop = page.find(">", start)
            if stop < 0:
                break
            m = _TAG.match(page[start : stop + 1].replace('"', " ").replace("'", " "))
            at = stop + 1
            if m is None:
                continue
        else:
            at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        closing = bool(m[1])
        if name == "a":
            in_link = not closing
            continue
        if name == "br":
            add(" ")
            continue
        if name in _VOID and name != "hr":
            continue
        if name not in _BLOCKS and name not in _SKIPPED:
            continue
        if name in _BLOCKS:
            close_block()
        if closing:
            pop_to(name)
            continue
        if name == "hr":
            continue
        if name == "body" and skipping:
            pop_to("head")
        # A block ends an open paragraph; an item ends the item before it in the same list.
        if name in _BLOCKS and stack and stack[-1][0] == "p":
            pop_to("p")
        if name in _SELF_CLOSING and stack and stack[-1][0] in (name, _SELF_CLOSING[name]):
            pop_to(stack[-1][0])
        if m[3].rstrip().endswith("/") and name in _SKIPPED:
            continue
        if name in _RAW:
            stop = _ENDS[name].search(page, at)
            if stop is None:
                break
            close = page.find(">", stop.start())
            at = end if close < 0 else close + 1
            continue
        push(name, m[3])
    close_block()
    return found


def _edges(rows: list[_Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours in page order and under one parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(rows):
        if i:
            a = rows[i - 1].path
            same = 0
            for x, y in zip(a, b.path, strict=False):
                if x != y:
                    break
                same += 1
            distance = len(a) + len(b.path) - 2 * same
            out.append((i - 1, i, _SMOOTH / (1 + distance)))
        group = b.path[-2] if len(b.path) > 1 else -1
        j = last.get(group)
        if j is not None and j != i - 1:
            out.append((j, i, _SMOOTH / 3))
        last[group] = i
    return out


def _max_flow(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of a minimum cut: shortest augmenting paths in level order."""
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def link(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(there)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        link(s, i, source[i], 0.0)
        link(i, t, sink[i], 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        used = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                path, a = [], s
                continue
            while used[a] < len(head[a]):
                e = head[a][used[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                used[a] += 1
            if used[a] < len(head[a]):
                path.append(head[a][used[a]])
                a = to[path[-1]]
            elif not path:
                break
            else:
                a = to[path.pop() ^ 1]
                used[a] += 1


def labels(rows: list[_Block]) -> list[bool]:
    """True for the blocks on the content side of the minimum cut."""
    edges = _edges(rows)
    pull = [0.0] * len(rows)
    for a, b, w in edges:
        pull[a] += w
        pull[b] += w
    label: list[bool | None] = [b.score > 0 if abs(b.score) > p else None for b, p in zip(rows, pull, strict=True)]
    open_rows = [i for i, x in enumerate(label) if x is None]
    if open_rows:
        number = {i: k for k, i in enumerate(open_rows)}
        source = [max(rows[i].score, 0.0) for i in open_rows]
        sink = [max(-rows[i].score, 0.0) for i in open_rows]
        inner = []
        for a, b, w in edges:
            if a in number and b in number:
                inner.append((number[a], number[b], w))
            elif a in number or b in number:
                mine, other = (a, b) if a in number else (b, a)
                (source if label[other] else sink)[number[mine]] += w
        for i, side in zip(open_rows, _max_flow(len(open_rows), source, sink, inner), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def main_text(page: str | None) -> str:
    rows = blocks(page or "")
    return "\n".join(b.text for b, kept in zip(rows, labels(rows), strict=True) if kept)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(_run, "page_id bigint, url string, text string, n_chars bigint")
