"""Main text of raw web pages by line-block distribution.

Markup is stripped to lines, one for each block of text, in one pass over the
page. Elements that are never article text (scripts, styles, forms, navigation,
headers, footers, asides) leave no lines. Every line has a weight, the length of
its text; a line of nothing but links weighs 0. What a page says of itself only
moves weights: lines in containers whose class or id names nothing but page
furniture (an advert, menu, sidebar, notice, reader comments) weigh 0, and where
an ``article`` or ``main`` element or a named container of text is marked, so do
lines outside - unless these hold more than twice as much text, sentences among
it, as around cards of other articles. Where that would leave a page
without text, names are ignored.

The weights are summed over sliding windows of lines. A stretch begins where the
sum rises from 0 (surge) and ends where it falls back to 0 (dive). It is text if
its largest sum is over ``LIMIT_SHARE`` of the page's largest, or if one of its
lines is a sentence, so that a short last block counts. What stands from the
first such stretch to the last one is kept, but for lines that weigh 0 by their
place or name and for menus, which are two or more lines of links in a row.

Defined cases: a null or empty page has empty text, as has a page of links only.
A container that is opened and never closed is not skipped. Very long pages are
read whole, in time that grows with their length however broken they are.
Repeated pages are kept, row by row; an empty table gives an empty result. Only
page_id, url and html are read, so further columns may bear any name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces

WINDOW = 3
LIMIT_SHARE = 0.2
# No part can read on beyond the next "<", so that a page is scanned once.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^'"<>]++|"[^"]*+"|'[^']*+')*+)>|<[!?][^<>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_RAW = frozenset("script style noscript template textarea iframe svg math canvas title".split())
_RAW_END = {tag: re.compile(rf"</{tag}\b[^<>]*+>", re.I) for tag in _RAW}
_SKIPPED = frozenset("head nav header footer aside form button select option menu dialog audio video object".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("div section ul ol dl table figure article center details".split())
_STACKED = _SKIPPED | _CONTAINERS
#: Words that name what is no article text.
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs sidebar aside header masthead topbar footer banner notice notices alert cookie cookies consent gdpr popup modal overlay "
    "login newsletter subscribe subscription signup share sharing social comment comments commentlist respond reply replies disqus search "
    "related recommended toolbar pagination pager contentinfo complementary".split()
)
#: Words that say where or how something stands, and not what it is.
_LAYOUT = frozenset(
    "area bar block bottom box btn button buttons card cards col column container content footer form full group holder home icon icons inner "
    "item items left link links list main mobile outer page panel post posts primary right row secondary section site slot small sticky stories "
    "thread top unit widget widgets wide wrap wrapper".split()
)
#: Words in a class or id that name the container of the article text.
_TEXTS = frozenset("article articlebody story post entry content maincontent main body-text posttext".split())


@dataclass
class Line:
    text: str
    links: bool  # nothing but links
    marked: str  # what marks it as article text: "article", "main", "container" or ""


@dataclass
class _Element:
    """An open element that matters: one to skip or one that names the container of the text."""

    tag: str
    above: int  # the element to skip that holds it
    skips: bool
    texts: bool
    closed: bool = False


def _named(attributes: str) -> tuple[bool, bool]:
    """Whether a class, id or role names what is no article text, and whether one names its container."""
    other = texts = False
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        for name in (a or b or c).lower().split():
            parts = [p for p in re.split(r"[^a-z]+", name) if p]
            # "related-posts" is furniture, "related-work" and "market-share" may be anything
            other = other or (not _FURNITURE.isdisjoint(parts) and all(p in _FURNITURE or p in _LAYOUT for p in parts))
            texts = texts or not _TEXTS.isdisjoint(parts)
    return other, texts


def lines_of(page: str, names: bool = True) -> list[Line]:
    """The blocks of text of a page, in order; without ``names`` classes and ids are not looked at."""
    elements: list[_Element] = []
    stack: list[tuple[str, int]] = []  # open tags, and the element of each or -1
    opened = dict.fromkeys(_STACKED, 0)
    depth = {"article": 0, "main": 0, "a": 0}
    skip, held = -1, []  # the innermost open element to skip, the open ones that name a container of text
    blocks: list[tuple[list[tuple[str, bool, int]], str, int]] = []  # pieces (text, in a link, element to skip), mark, container
    parts: list[tuple[str, bool, int]] = []

    def flush() -> None:
        nonlocal parts
        if parts:
            blocks.append((parts, "article" if depth["article"] else "main" if depth["main"] else "", held[-1] if held else -1))
            parts = []

    def leave(of: int, explicit: bool) -> None:
        nonlocal skip
        if of >= 0:
            elements[of].closed = explicit
            if elements[of].skips:
                skip = elements[of].above
            if held and held[-1] == of:
                held.pop()

    at = 0
    for m in _TAG.finditer(page):
        if m.start() < at:  # inside a raw element
            continue
        if m.start() > at:
            parts.append((page[at : m.start()], depth["a"] > 0, skip))
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW:
            if not closing:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _BLOCKS:
            flush()
        if tag in _STACKED and not closing and not m[3].endswith("/"):
            other, texts = _named(m[3]) if names and m[3] and tag in _CONTAINERS else (False, False)
            skips, texts = tag in _SKIPPED or other, texts and tag in ("div", "section", "td")
            of = -1
            if skips or texts:
                of = len(elements)
                elements.append(_Element(tag, skip, skips, texts))
                if skips:
                    skip = of
                if texts:
                    held.append(of)
            stack.append((tag, of))
            opened[tag] += 1
        elif tag in _STACKED and closing and opened[tag]:
            while True:  # what is open inside ends here too, but was never closed
                name, of = stack.pop()
                opened[name] -= 1
                leave(of, name == tag)
                if name == tag:
                    break
        if tag in depth and not m[3].endswith("/"):
            depth[tag] = max(0, depth[tag] + (-1 if closing else 1))
    if at < len(page):
        parts.append((page[at:], depth["a"] > 0, skip))
    flush()

    gone: list[bool] = []
    for e in elements:
        gone.append((e.skips and e.closed) or (e.above >= 0 and gone[e.above]))
    out = []
    for own, mark, container in blocks:
        kept = [(html.unescape(t), linked) for t, linked, of in own if of < 0 or not gone[of]]
        text = " ".join("".join(t for t, _ in kept).split())
        if text:
            outside = any(any(map(str.isalnum, t)) for t, linked in kept if not linked)
            links = any(linked and t.strip() for t, linked in kept)
            out.append(Line(text, links and not outside, mark or ("container" if container >= 0 else "")))
    return out


def stretches(weights: list[int], limit: float, sure: Sequence[bool] = (), window: int = WINDOW) -> list[tuple[int, int]]:
    """(surge, dive) line ranges: where sums over ``window`` lines are above 0 throughout, and over ``limit`` somewhere or with a ``sure`` line."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    found, start = [], -1
    for i, s in enumerate([*sums, 0]):
        if s > 0 and start < 0:
            start = i
        elif s <= 0 and start >= 0:
            if max(sums[start:i]) > limit or any(sure[start:i]):
                found.append((start, i))
            start = -1
    # a window reaches ahead: a stretch begins and ends at lines with weight
    out = []
    for a, b in found:
        while not weights[a]:
            a += 1
        while not weights[b - 1]:
            b -= 1
        out.append((a, b))
    return out


def _largest(weights: list[int]) -> int:
    return max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)


def _weights(lines: list[Line]) -> tuple[list[int], list[bool]]:
    """The weight of each line, and whether it stands where the page says its text is, or says nothing."""
    weights = [0 if x.links else len(x.text) for x in lines]
    for mark in ("article", "main", "container"):
        inside = [n if x.marked == mark else 0 for x, n in zip(lines, weights, strict=True)]
        if any(inside):
            outside = sum(weights) - sum(inside)
            if outside <= 2 * sum(inside) or not any(n and x.marked != mark and _is_sentence(x.text) for x, n in zip(lines, weights, strict=True)):
                return inside, [x.marked == mark for x in lines]
    return weights, [True] * len(lines)


def _is_sentence(text: str) -> bool:
    return " " in text and text.rstrip("\"'\u201d\u2019\u00bb)").endswith((".", "!", "?", "\u2026", "\u3002"))


def main_text(page: str | None) -> str:
    for names in (True, False):
        lines = lines_of(page or "", names)
        weights, placed = _weights(lines)
        sure = [n > 0 and _is_sentence(x.text) for x, n in zip(lines, weights, strict=True)]
        if found := stretches(weights, LIMIT_SHARE * _largest(weights), sure):
            linked = [x.links for x in lines]
            kept = []
            for i in range(found[0][0], found[-1][1]):
                menu = linked[i] and (linked[i - 1 : i] == [True] or linked[i + 1 : i + 2] == [True])
                if placed[i] and not menu:
                    kept.append(lines[i].text)
            return "\n".join(kept)
    return ""


def extract_main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
