"""Main text of web pages by classified text blocks (operator 2).

A page becomes a flat list of text blocks, as block-level tags cut it. A block's features are its
number of words and its link density, those of its neighbours, and what it stands in: the article, a
part of the page that is no article (menu, footer, notice, form ...), a heading. A decision tree
trained on the small labelled table below decides which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What element names and class, id or role words say about what they hold.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
APART = {
    "head", "nav", "footer", "header", "aside", "form", "menu", "dialog", "button", "select", "svg",
    "object", "canvas", "audio", "video", "map", "datalist", "fieldset",
}
MAIN = {"article", "main"}
SECTIONS = {"div", "section", "ul", "ol", "dl", "table", "body", "html", "figure", "details", "td"}
BLOCKS = {
    "address", "blockquote", "br", "caption", "center", "dd", "dt", "figcaption", "h1", "h2", "h3", "h4",
    "h5", "h6", "hr", "legend", "li", "option", "p", "pre", "summary", "tbody", "tfoot", "th", "thead", "tr",
}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
APART_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored",
    "promo", "promotion", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr", "notice",
    "notification", "alert", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal",
    "overlay", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination",
    "pager", "search", "copyright", "legal", "disclaimer", "complementary", "contentinfo", "dialog", "toc",
}
# the last word of a compound names the thing; if it only says "box", the words before it do
BOX_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "bottoms", "button", "buttons", "col", "column",
    "container", "entries", "entry", "form", "group", "holder", "icons", "inner", "item", "items", "left",
    "links", "list", "module", "outer", "panel", "region", "right", "row", "section", "slot", "thread",
    "tools", "top", "unit", "wrap", "wrapper", "zone",
}
# compounds with these say how a page is laid out, not what is inside
LAYOUT_WORDS = {"has", "no", "not", "with", "without", "by", "is", "js"}
READER_WORDS = {"comment", "comments", "disqus", "respond", "replies", "reply"}
MAIN_WORDS = {"article", "main", "post", "entry", "story", "content", "articlebody"}

# The labelled table: words and link density of a block, of the one before and after, whether it stands
# in an article, apart from it, and whether it is a heading; 1 marks main text.
COLUMNS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "apart", "heading")
LABELLED = [
    (8, 0.0, 6, 0.9, 60, 0.0, 1, 0, 1, 1), (60, 0.0, 8, 0.0, 45, 0.0, 1, 0, 0, 1),
    (45, 0.1, 60, 0.0, 2, 0.0, 1, 0, 0, 1), (2, 0.0, 45, 0.1, 1, 0.0, 1, 0, 0, 1),
    (1, 0.0, 2, 0.0, 9, 0.1, 1, 0, 0, 1), (12, 0.6, 30, 0.0, 25, 0.0, 1, 0, 0, 1),
    (3, 1.0, 30, 0.0, 25, 0.0, 1, 0, 0, 1), (120, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (5, 0.0, 0, 0.0, 12, 0.0, 1, 0, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0),
    (6, 0.9, 1, 1.0, 8, 0.0, 0, 1, 0, 0), (9, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0, 0),
    (40, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0, 0), (90, 0.0, 50, 0.0, 60, 0.0, 0, 1, 0, 0),
    (11, 0.1, 45, 0.0, 0, 0.0, 0, 1, 0, 0), (25, 0.0, 60, 0.0, 30, 0.0, 0, 1, 0, 0),
    (7, 0.0, 3, 1.0, 40, 0.0, 0, 1, 1, 0), (30, 0.0, 60, 0.0, 45, 0.0, 0, 1, 0, 0),
    (70, 0.0, 40, 0.0, 55, 0.0, 0, 0, 0, 1), (35, 0.05, 70, 0.0, 28, 0.0, 0, 0, 0, 1),
    (28, 0.2, 35, 0.0, 3, 0.0, 0, 0, 0, 1), (14, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 1),
    (7, 0.0, 2, 1.0, 50, 0.0, 0, 0, 1, 1), (9, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1, 1),
    (50, 0.0, 0, 0.0, 45, 0.0, 0, 0, 0, 1), (45, 0.0, 50, 0.0, 2, 1.0, 0, 0, 0, 1),
    (16, 0.0, 18, 0.0, 20, 0.0, 0, 0, 0, 1), (5, 0.0, 60, 0.0, 44, 0.0, 0, 0, 0, 1),
    # short texts among texts: lists, short paragraphs, a heading and what is below it
    (3, 0.0, 40, 0.0, 4, 0.0, 0, 0, 0, 1), (4, 0.0, 3, 0.0, 3, 0.0, 0, 0, 0, 1),
    (3, 0.0, 4, 0.0, 45, 0.0, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 6, 0.0, 0, 0, 1, 1),
    (6, 0.0, 3, 0.0, 7, 0.0, 0, 0, 0, 1), (7, 0.0, 6, 0.0, 0, 0.0, 0, 0, 0, 1),
    (2, 0.0, 12, 0.0, 2, 0.2, 0, 0, 0, 1), (2, 0.2, 2, 0.0, 9, 0.0, 0, 0, 0, 1),
    (5, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (12, 0.3, 30, 0.0, 22, 0.1, 0, 0, 0, 1),
    (8, 0.0, 2, 1.0, 9, 0.0, 0, 0, 0, 1), (9, 0.0, 8, 0.0, 2, 1.0, 0, 0, 0, 1),
    (6, 0.0, 4, 0.0, 1, 1.0, 0, 0, 0, 1), (33, 0.1, 3, 1.0, 3, 1.0, 0, 0, 0, 1),
    (26, 0.0, 2, 0.9, 2, 0.9, 0, 0, 0, 1), (21, 0.0, 5, 1.0, 1, 1.0, 0, 0, 0, 1),
    (2, 0.0, 2, 1.0, 40, 0.0, 0, 0, 1, 1), (3, 0.0, 1, 1.0, 25, 0.0, 0, 0, 1, 1),
    (4, 0.0, 2, 1.0, 35, 0.0, 0, 0, 0, 1), (1, 0.0, 1, 1.0, 6, 0.0, 0, 0, 1, 1),
    # among links: menus, lists of links, a word between two of them, the line at the end of a page
    (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0), (10, 0.9, 8, 0.8, 9, 1.0, 0, 0, 0, 0),
    (40, 0.8, 3, 1.0, 9, 1.0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0),
    (2, 0.0, 2, 1.0, 3, 0.9, 0, 0, 0, 0), (1, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0),
    (6, 0.0, 2, 0.9, 3, 0.8, 0, 0, 0, 0), (9, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0),
    (2, 1.0, 60, 0.0, 1, 1.0, 0, 0, 0, 0), (25, 0.7, 40, 0.0, 30, 0.6, 0, 0, 0, 0),
    (4, 0.0, 5, 0.9, 3, 0.9, 0, 0, 1, 0), (15, 0.9, 60, 0.0, 50, 0.0, 0, 0, 0, 0),
    (1, 1.0, 0, 0.0, 30, 0.0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 30, 0.0, 0, 0, 0, 0),
    (2, 1.0, 44, 0.0, 0, 0.0, 0, 0, 0, 0), (3, 0.7, 8, 0.0, 2, 1.0, 0, 0, 0, 0),
]


@dataclass
class Node:
    column: int = -1
    bound: float = 0.0
    low: Node | None = None
    high: Node | None = None
    answer: int = 0


def train_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 6) -> Node:
    """Greedy splits by Gini impurity; ties go to the first column and the smallest bound."""
    node = Node(answer=int(labels.mean() >= 0.5) if len(labels) else 0)
    if depth == 0 or len(set(labels.tolist())) < 2:
        return node
    best = None
    for column in range(rows.shape[1]):
        values = np.unique(rows[:, column])
        for bound in (values[1:] + values[:-1]) / 2:
            left = rows[:, column] <= bound
            cost = sum(len(y) * y.mean() * (1 - y.mean()) for y in (labels[left], labels[~left]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, column, float(bound), left)
    if best is None:
        return node
    _, node.column, node.bound, left = best
    node.low = train_tree(rows[left], labels[left], depth - 1)
    node.high = train_tree(rows[~left], labels[~left], depth - 1)
    return node


def default_tree() -> Node:
    table = np.array(LABELLED)
    return train_tree(table[:, :-1], table[:, -1].astype(int))


def is_main(tree: Node, row: tuple) -> bool:
    while tree.low is not None:
        tree = tree.low if row[tree.column] <= tree.bound else tree.high
    return tree.answer == 1


@dataclass
class Block:
    text: str
    words: int
    links: float
    article: int
    apart: int
    heading: int


@dataclass
class _Open:
    """An element that is open, and what it says about what it holds."""

    name: str
    side: str = ""  # "article", "apart" or "" for neither
    reader: bool = False
    hidden: bool = False
    # of text right inside: (article, apart); the same for a heading; whether an article is around
    place: tuple[int, int] = (0, 0)
    heading_place: tuple[int, int] = (0, 0)
    in_article: bool = False
    shut: bool = False


@dataclass
class _State:
    stack: list[_Open] = field(default_factory=list)
    open: Counter = field(default_factory=Counter)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    heading: int = 0


_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|([^<]+|<)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME = re.compile(r"[a-z]+")


def named_side(value: str) -> tuple[str, bool]:
    """What a class, id or role says: "article", "apart" or neither, and whether readers write inside.

    Each compound is read by its last word; ``main-content`` is content, ``cookie-bar`` is about cookies
    and ``legal-text`` is a text. Layout compounds like ``has-sidebar`` say nothing.
    """
    sides, reader = set(), False
    for token in value.split():
        words = _NAME.findall(token)
        if not words or LAYOUT_WORDS & set(words):
            continue
        head = words[-1]
        named = words if head in BOX_WORDS else [head]
        reader |= any(w in READER_WORDS for w in named)
        if any(w in APART_WORDS for w in named):
            sides.add("apart")
        elif any(w in MAIN_WORDS for w in named):
            sides.add("article")
    return ("apart" if "apart" in sides else "article" if sides else ""), reader


def _opened(name: str, attributes: str) -> _Open:
    out = _Open(name, "apart" if name in APART else "article" if name in MAIN else "")
    if not attributes.strip():
        return out
    lower = attributes.lower()
    if re.search(r"(?:^|\s)hidden(?:[\s=/]|$)", lower):
        out.hidden = True
    for found in _ATTRIBUTE.finditer(lower):
        key, value = found[1], found[2] or found[3] or found[4] or ""
        if (key == "aria-hidden" and value == "true") or (
            key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)
        ):
            out.hidden = True
        if key in ("class", "id", "role", "itemprop") and name not in ("html", "body"):
            side, reader = named_side(value)
            out.reader |= reader
            if side == "apart" or side and not out.side:
                out.side = side
    return out


def _settle(element: _Open, around: _Open | None) -> None:
    """Where text inside stands: the innermost element that says article or apart decides.

    Reader comments and hidden elements are apart whatever they contain. A heading in the header of an
    article belongs to the article.
    """
    around = around or _Open("")
    element.shut = around.shut or element.reader or element.hidden
    element.in_article = around.in_article or element.side == "article"
    element.place, element.heading_place = around.place, around.heading_place
    if element.shut:
        element.place = element.heading_place = (0, 1)
    elif element.side == "apart":
        element.place = (0, 1)
        if element.name != "header" or not around.in_article:
            element.heading_place = (0, 1)
    elif element.side == "article":
        element.place = element.heading_place = (1, 0)


def _flush(state: _State) -> None:
    text = " ".join(html.unescape("".join(state.parts)).split())
    if text:
        inside = state.stack[-1] if state.stack else _Open("")
        article, apart = inside.heading_place if state.heading else inside.place
        words = text.count(" ") + 1
        links = min(1.0, state.linked / max(words, 1))
        state.blocks.append(Block(text, words, links, article, apart, int(state.heading > 0)))
    state.parts, state.linked = [], 0


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order. Broken markup is read as far as it makes sense: elements that are
    never closed end with the element around them or the page."""
    state, at = _State(), 0
    while at < len(page):
        found = _TOKEN.match(page, at)
        if found is None:  # an attribute value without end: the tag is text up to the next '<'
            end = page.find("<", at + 1)
            end = len(page) if end < 0 else end
            state.parts.append(page[at:end])
            at = end
            continue
        at = found.end()
        closing, name, attributes, text = found.groups()
        if text is not None:
            state.parts.append(text)
            if state.links:
                state.linked += len(text.split())
            continue
        if name is None:
            continue
        name = name.lower()
        if not closing and name in RAW:
            _flush(state)
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|$)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "a":
            state.links = max(0, state.links + (-1 if closing else 1))
            continue
        if name in BLOCKS or name in APART or name in MAIN or name in SECTIONS:
            _flush(state)
        if name in HEADINGS:
            state.heading = 0 if closing else 1
        if closing:
            if state.open[name]:
                _flush(state)
                while _pop(state) != name:
                    pass
                if name in APART or name in MAIN or name in SECTIONS:
                    state.links = state.heading = 0
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            element = _opened(name, attributes)
            held = element.side or element.reader or element.hidden
            if held or name in SECTIONS:
                if held:
                    _flush(state)
                if name in ("article", "main", "footer", "body"):  # these end what was left open
                    _close_left_open(state)
                _settle(element, state.stack[-1] if state.stack else None)
                state.stack.append(element)
                state.open[name] += 1
    _flush(state)
    return state.blocks


def _pop(state: _State) -> str:
    name = state.stack.pop().name
    state.open[name] -= 1
    return name


def _close_left_open(state: _State) -> None:
    """Inline and paragraph elements that were never closed don't reach into the next part."""
    while state.stack and state.stack[-1].name not in SECTIONS | APART | MAIN:
        _pop(state)
    state.links = 0


def main_blocks(page: str | None, tree: Node) -> list[str]:
    blocks = blocks_of(page or "")
    out = []
    for i, b in enumerate(blocks):
        before = blocks[i - 1] if i else None
        after = blocks[i + 1] if i + 1 < len(blocks) else None
        row = (
            b.words, b.links,
            before.words if before else 0, before.links if before else 0.0,
            after.words if after else 0, after.links if after else 0.0,
            b.article, b.apart, b.heading,
        )
        if is_main(tree, row):
            out.append(b.text)
    return out


def extracted(pages: DataFrame, name: str = "text", source: str = "html") -> DataFrame:
    """``pages`` with the main text in column ``name``: blocks in page order, joined by a space.

    Null and empty pages, and pages without main text, give an empty string. Whole pages are read, rows
    stay where they are, repeated rows get the same text; an empty table stays empty.
    """
    tree = default_tree()

    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([" ".join(main_blocks(page, tree)) for page in batch], dtype=object)

    return pages.withColumn(name, text(F.col(source)))
