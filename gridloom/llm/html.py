"""Main text of web pages by the line-block distribution.

Markup is stripped so that every block of a page is a line, boilerplate included.  A line counts its text length, less
the evidence against it: nothing inside scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, by their elements and names, in bare lists of links, and outside the articles of a page that names some
(``article``, ``main``); a quarter where a short text stands in a container itself and not in an article, paragraph,
heading or item.  The counts are summed over sliding windows of ``WINDOW`` lines.  The main text starts where the sums surge over a level and
ends where they dive below it, and from there it reaches on, both ways, over the paragraphs that join it without a gap:
short first and last ones belong to it.  No line is kept that no surge reaches, whatever its element.

Defined cases: a null page, and one without text, give an empty string; unclosed tags end with their parent
block or with the page; text outside any tag counts as a block; very long pages are read whole; repeated
blocks are kept as often as they stand there; sums equal to the level are below it.  The page, ``main`` and
``article`` never count nothing by their names; an article that stands in dropped blocks only is taken out of
them.  An empty table gives an empty result; repeated rows are separate rows; columns other than the three
named ones, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
WINDOW = 3
#: A surge is a window sum above this share of the page's largest one, or above SURE characters.
SURGE, SURE = 0.3, 80
#: Up to this length a text that stands in a container itself counts the WEAK-th part.
BARE, WEAK = 200, 4

_RAW = "script|style|noscript|template|textarea|svg|iframe|object|select"
#: Raw elements that hold the rest of the page if they are not closed; the others are empty then.
_OPEN = frozenset(["script", "style"])
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW.split("|")}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<({_RAW})\b[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>",
    re.S | re.I,
)
#: Elements that start a block of their own.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul head".split()
)
_DROP = frozenset("nav header footer aside form button head menu dialog label fieldset legend input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is prose of its own.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption address summary".split())
#: Elements that a name never drops, and those that an article inside takes its place from.
_KEEP, _WRAP = frozenset("html body main article".split()), frozenset(["form"])
_BAD = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|header|footer|side-?bar|breadcrumbs?|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|share|social|"
    r"related|recommend\w*|comments?|replies|disqus|respond|login|search|pagination|pager|toolbar|widget|skip|masthead|copyright",
    re.I,
)
#: Parts that a compound name may hold besides bad ones; with any other part it names something else.
_NEUTRAL = re.compile(r"site|global|main|top|bottom|left|right|primary|secondary|wrap(?:per)?|container|inner|outer|box|bar|block|area|section|slot|list|links?|items?|buttons?|icons?|media|posts?|articles?|form|text|to|\d*", re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def bad_name(names: str) -> bool:
    """Whether one of the names, as a whole, is that of boilerplate."""
    for name in names.split():
        parts = re.split(r"[_-]+", name)
        bad = [bool(_BAD.fullmatch(part)) for part in parts]
        if _BAD.fullmatch(name) or (any(bad) and all(b or _NEUTRAL.fullmatch(part) for b, part in zip(bad, parts, strict=True))):
            return True
    return False


class Line(NamedTuple):
    """A block of a page: its text, what it counts, the outermost article around it (0: none), whether it is prose."""

    text: str
    count: int
    article: int
    prose: bool


def page_lines(html: str, rescue: bool = False, names: bool = True) -> list[Line]:
    """Every block of a page that holds text; without ``names``, class names say nothing.

    With ``rescue``, an article ends the drop of the blocks around it that their names, or a form, dropped.
    """
    lines: list[Line] = []
    stack: list[tuple[str, bool, int]] = []  # tag, dropped, article
    articles = 0
    text: list[str] = []
    linked: list[int] = [0]
    in_link = 0

    def flush() -> None:
        whole = " ".join(unescape("".join(text)).split())
        if whole and not any(t == "head" for t, _, _ in stack):
            article = next((a for _, _, a in stack if a), 0)
            # A block that is nothing but links is part of a list of links.
            bare = not article and linked[0] >= len("".join("".join(text).split())) > 0
            prose = article > 0 or len(whole) > BARE or any(t in _PROSE for t, _, _ in stack)
            count = 0 if bare or any(d for _, d, _ in stack) else len(whole) if prose else max(1, len(whole) // WEAK)
            lines.append(Line(whole, count, article, prose))
        text.clear()
        linked[0] = 0

    def add(piece: str) -> None:
        text.append(piece)
        if in_link:
            linked[0] += len("".join(piece.split()))

    at = 0
    unclosed: set[str] = set()
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[1]:
            raw = m[1].lower()
            if raw not in _OPEN and (m[0].endswith("/>") or raw in unclosed):
                continue
            if end := _CLOSE[raw].search(html, at):
                at = end.end()
            elif raw in _OPEN:
                at = len(html)
            else:
                unclosed.add(raw)
            continue
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = 0 if m[2] else 1
        if tag in _BLOCK or tag in _DROP:
            flush()
        if tag in _VOID or (m[4] or "").rstrip().endswith("/"):
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            if tag in _BLOCK:
                in_link = 0
        elif tag in _BLOCK or tag in _DROP:
            if tag == "p":  # a paragraph ends the one before it
                while stack and stack[-1][0] == "p":
                    stack.pop()
            called = " ".join(x.strip("\"'") for x in _NAMED.findall(m[4] or "")) if names else ""
            if rescue and tag in ("article", "main"):
                stack[:] = [(t, d and t in _DROP - _WRAP, a) for t, d, a in stack]
            articles += tag in ("article", "main")
            stack.append((tag, tag in _DROP or (tag not in _KEEP and bad_name(called)), articles if tag in ("article", "main") else 0))
    if at < len(html):
        add(html[at:])
    flush()
    return lines


def text_spans(lines: list[Line]) -> list[tuple[int, int]]:
    """(first line, line behind the last) of each stretch of text, in order; they do not overlap."""
    counts = np.array([x.count for x in lines], dtype=np.int64)
    if not counts.any():
        return []
    sums = np.convolve(counts, np.ones(WINDOW, dtype=np.int64))[WINDOW - 1 :]  # of a line and those behind it
    level = min(SURGE * sums.max(), SURE)
    strong = lambda k: counts[k] > 0 and (lines[k].prose or counts[k] * WINDOW > level)

    def reach(k: int, step: int) -> int:
        """The last line, from k on, that joins it: prose of the same article, past what counts nothing inside that."""
        end = k
        while 0 <= k + step < len(lines) and lines[k + step].article == lines[end].article:
            k += step
            if counts[k] > 0 and lines[k].prose:
                end = k
            elif counts[k] > 0 or not lines[k].article:
                break
        return end

    out: list[tuple[int, int]] = []
    i = 0
    while i < len(lines):
        if sums[i] <= level:
            i += 1
            continue
        j = i  # a surge
        while j < len(lines) and sums[j] > level:  # until the dive
            j += 1
        # The first windows reach back over what stands in front of the text.
        held = [k for k in range(i, j) if strong(k)]
        if held:
            first, last = reach(held[0], -1), max(reach(held[-1], 1), held[-1])
            if out and first < out[-1][1]:
                first = out.pop()[0]
            out.append((first, last + 1))
        i = j
    return out


def main_text(html: str | None, names: bool = True) -> str:
    """The lines that count, between each surge of the window sums and the end of the text behind its dive."""
    lines = page_lines(html or "", names=names)
    named = any(x.article and x.count for x in lines)
    if not named and re.search(r"<(?:article|main)\b", html or "", re.I):
        saved = page_lines(html or "", rescue=True, names=names)
        named = any(x.article and x.count for x in saved)
        lines = saved if named else lines
    if named:
        lines = [x if x.article else x._replace(count=0) for x in lines]
    return "\n".join(x.text for i, j in text_spans(lines) for x in lines[i:j] if x.count)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            cols = [batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
