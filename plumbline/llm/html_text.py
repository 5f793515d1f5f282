"""Main text of web pages by minimum cut.

A page becomes a sequence of text blocks. A block's classifier score (containers
it stands in, length, share of linked text) is its capacity to the content or
the boilerplate terminal; blocks that follow each other, and blocks close in the
DOM, are tied by smoothness edges. The minimum cut separates content from
boilerplate. Pages are independent rows, so nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements by role, and words in class, id or role that name a container.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe svg math object select option button".split())
BOILERPLATE = set("nav header footer aside form menu dialog fieldset".split())
CONTENT = set("article main".split())
BOILERPLATE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar side nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar masthead header footer foot contentinfo complementary comment comments "
    "reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login search popup modal "
    "overlay widget widgets pagination pager copyright hidden disclaimer dialog form teaser outbrain taboola".split()
)
CONTENT_NAMES = set("article main content post entry story body maincontent articlebody".split())
IMPLIED_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

IN_CONTENT, IN_BOILERPLATE, LINKED, LONG, HEADING = 4.0, -8.0, -4.0, 2.0, 1.0
BESIDE_CONTENT, FREE = -2.5, 0.3  # in no container, on pages with and without a content container
FOLLOWS, NEAR = 0.6, 0.8
SCALE = 1000

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S
)
_ATTR = re.compile(r"""(?:^|[\s/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Za-z]+")


def _marker(tag: str, attributes: str) -> int:
    """1: opens a content container, -1: opens boilerplate, 0: neither."""
    if tag in BOILERPLATE:
        return -1
    names = set()
    if attributes and not attributes.isspace():
        for m in _ATTR.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return -1
            if name in ("class", "id", "role"):
                names.update(_NAME.findall(value))
    if names & BOILERPLATE_NAMES and tag not in ("html", "body", "article", "main"):
        return -1
    return 1 if tag in CONTENT or names & CONTENT_NAMES else 0


class _Element:
    __slots__ = ("tag", "parent", "depth", "side", "linked")

    def __init__(self, tag: str, parent: "_Element | None", side: int = 0) -> None:
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        # The innermost container that says something decides; but nothing inside boilerplate is content.
        self.side = -1 if parent and parent.side < 0 else side or (parent.side if parent else 0)
        self.linked = tag == "a" or bool(parent and parent.linked)


def blocks(page: str) -> list[tuple[str, _Element, float]]:
    """(text, block element, share of linked characters) of every block with text, in page order."""
    at = root = _Element("html", None)
    out, parts, linked, n = [], [], 0, 0
    holder = root

    def text(raw: str) -> None:
        nonlocal linked, n, holder
        if raw:
            piece = entities.unescape(raw) if "&" in raw else raw
            if n == 0:
                holder = at
            size = len(piece.strip())
            n += size
            linked += size if at.linked else 0
            parts.append(piece)

    def close() -> None:
        nonlocal linked, n
        words = "".join(parts).split()
        if words:
            element = holder
            while element.tag in INLINE and element.parent:
                element = element.parent
            out.append((" ".join(words), element, linked / n if n else 0.0))
        parts.clear()
        linked = n = 0

    position, find = 0, _TAG.search
    while m := find(page, position):
        text(page[position:m.start()])
        position = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag not in INLINE:
                close()
            up = at
            while up is not root and up.tag != tag:
                if tag in INLINE and up.tag not in INLINE:  # an inline end tag doesn't close blocks
                    up = root
                    break
                up = up.parent
            if up is not root:
                at = up.parent
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, position)
            position = end.end() if end else len(page)
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if tag not in INLINE:
            close()
            ends = IMPLIED_END.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            up = at
            while ends and up is not root and (up.tag in INLINE or up.tag in ends):
                if up.tag in ends:
                    at = up.parent
                up = up.parent
        if not attributes.endswith("/"):
            at = _Element(tag, at, _marker(tag, attributes))
    text(page[position:])
    close()
    return out


def score(text: str, element: _Element, linked: float, beside: float = FREE) -> float:
    """Classifier log-odds of content against boilerplate; ``beside`` is for blocks in no container."""
    own = (beside, IN_CONTENT, IN_BOILERPLATE)[element.side]
    return own + LINKED * linked + LONG * min(len(text), 200) / 200 + (HEADING if re.fullmatch("h[1-6]", element.tag) else 0.0)


def _distance(a: _Element, b: _Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(scores: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """True for the content side of a minimum cut: sum of |score| given up plus edges cut.

    A node whose score is at least the sum of its edges takes its own side in
    some minimum cut; it is fixed and its edges become scores of its neighbours.
    Max-flow by shortest augmenting paths decides the rest.
    """
    near: list[dict[int, int]] = [{} for _ in scores]
    for (i, j), c in edges.items():
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    value, side = list(scores), [None] * len(scores)
    work = deque(range(len(scores)))
    while work:
        i = work.popleft()
        if side[i] is None and abs(value[i]) >= sum(near[i].values()):
            side[i] = value[i] > 0
            for j, c in near[i].items():
                value[j] += c if side[i] else -c
                del near[j][i]
                work.append(j)
            near[i] = {}
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        source, sink = -1, -2
        flow: dict[int, dict[int, int]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
        for i in rest:
            a, b = (source, i) if value[i] > 0 else (i, sink)
            flow[a][b] = abs(value[i])
            flow[b].setdefault(a, 0)
        while True:
            came, queue = {source: source}, deque([source])
            while queue and sink not in came:
                u = queue.popleft()
                for v, c in flow[u].items():
                    if c > 0 and v not in came:
                        came[v] = u
                        queue.append(v)
            if sink not in came:
                break
            path, v = [], sink
            while v != source:
                path.append((came[v], v))
                v = came[v]
            least = min(flow[u][v] for u, v in path)
            for u, v in path:
                flow[u][v] -= least
                flow[v][u] = flow[v].get(u, 0) + least
        for i in rest:
            side[i] = i in came
    return side


def main_blocks(page: str | None) -> list[str]:
    """Texts of the content blocks of a page, in page order."""
    found = blocks(page or "")
    beside = BESIDE_CONTENT if any(b[1].side > 0 for b in found) else FREE
    scores = [round(SCALE * score(*b, beside)) for b in found]
    if all(s > 0 for s in scores):
        return [b[0] for b in found]
    edges: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, (_, element, _) in enumerate(found):
        if i:
            edges[i - 1, i] = round(SCALE * (FOLLOWS + NEAR / (1 + _distance(found[i - 1][1], element))))
        parent = id(element.parent)
        if last.get(parent, i - 1) < i - 1:
            edges[last[parent], i] = round(SCALE * NEAR / 2)
        last[parent] = i
    return [b[0] for b, content in zip(found, minimum_cut(scores, edges)) if content]


def main_text(page: str | None) -> str:
    return " ".join(main_blocks(page))


@F.pandas_udf(StringType())
def main_text_udf(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in pages:
        yield pd.Series([main_text(p) for p in part], dtype=object)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` instead of the html: the main text, empty if there is none or the html is null.

    Every row is handled alone, repeated rows alike; a column of ``pages``
    already called text is replaced.
    """
    keep = [c for c in pages.columns if c not in (html, "text")]
    return pages.select(*[F.col(f"`{c}`") for c in keep], main_text_udf(F.col(f"`{html}`")).alias("text"))
