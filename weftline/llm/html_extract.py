"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one a block of text; where a line stands in another container
than the one before it, empty lines stand between them. A line weighs its text length, a
heading several times that, and text that is mostly links nothing or next to nothing. Lengths
are summed over sliding windows of a few lines. Text surges where the sums rise from nothing
and dives where they fall back to nothing, and of the stretches between, the one with the
highest sum is the main one. Others stay if they lie inside its container, or come near its
height: a quarter of it, or a little of it where they stand beside it inside a part of the
page.

Names only change weights. In a page with an article element what lies outside weighs a
64th, so that the highest stretch is one of the article's unless the article has next to no
text, and all of the article's own stretches stay with it. Text under class names that mark
boilerplate weighs an eighth; a stretch that is all of such text stays where it comes near
the main one's height even so, and a marked line inside another stretch stays with it. Menus,
forms, footers and hidden elements weigh nothing, and are never text.

Defined results: null, empty and textless pages have an empty text; unclosed elements end
with their parents; a page that is only boilerplate has an empty text; repeated rows are
alike; character references are decoded and white space within a line becomes one space;
markup of any depth takes time in proportion to its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|select|title)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
MARKED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until-found))|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile(r"[a-z]+")

# fixed lists of element names and of the words that mark boilerplate
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr math mi mn mo mrow msub msup mfrac mtext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form head button dialog menu header".split())
ARTICLE = frozenset("article main".split())
BEFORE_ARTICLE = frozenset("nav header head".split())
WHOLE_PAGE = frozenset("html body".split())
ENDS_LIKE = frozenset("p li dt dd tr td th option".split())
TEXT_BLOCKS = ENDS_LIKE | frozenset("h1 h2 h3 h4 h5 h6 ul ol dl table thead tbody tfoot caption blockquote pre figure figcaption address".split())
BOILERPLATE = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside rail footer foot header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social follow related recommended recommendations teaser widget widgets "
    "comment comments commentlist reply replies respond disqus discussion copyright legal disclaimer pagination pager skip contentinfo complementary".split()
)


def _marked(attributes: str) -> bool:
    """Whether class, id or role name boilerplate."""
    if not attributes:
        return False
    for value in MARKED.findall(attributes):
        for name in value.strip("\"'").lower().split():
            if not BOILERPLATE.isdisjoint(WORD.findall(name)) and "article" not in name and "content" not in name.replace("contentinfo", ""):
                return True
    return False


class Line(NamedTuple):
    text: str
    links: bool
    inside: bool
    marked: bool
    never: bool
    heading: bool
    container: int

    @property
    def boiler(self) -> bool:
        """Whether any name tells against the line."""
        return self.marked or self.never


class _Lines:
    """The lines of a page as they are met, and the elements that are open."""

    def __init__(self):
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = 0
        self.open: list[tuple[str, bool, bool]] = []  # elements, whether names mark them, and whether they are never text
        self.names: Counter = Counter()  # how often each element is open
        self.containers = [0]  # the number of each open element's container, after that of the page
        self.parent = {0: 0}
        self.marked = 0
        self.never = 0
        self.within = 0
        self.heading = False
        self.in_link = False

    def add(self, raw: str) -> None:
        self.parts.append(raw)
        if self.in_link:
            self.linked += len(raw)

    def end_line(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                self.lines.append(Line(text, 2 * self.linked > len(raw), self.within > 0, self.marked > 0, self.never > 0, self.heading, self.containers[-1]))
            self.parts, self.linked = [], 0

    def push(self, name: str, marked: bool, never: bool) -> None:
        self.open.append((name, marked, never))
        self.names[name] += 1
        held = self.containers[-1]
        if name not in TEXT_BLOCKS and name not in INLINE and name not in WHOLE_PAGE:
            held = len(self.parent)
            self.parent[held] = self.containers[-1]
        self.containers.append(held)
        self.marked += marked
        self.never += never
        self.within += name in ARTICLE and not (marked or never)

    def pop(self) -> None:
        name, marked, never = self.open.pop()
        self.names[name] -= 1
        self.containers.pop()
        self.marked -= marked
        self.never -= never
        self.within -= name in ARTICLE and not (marked or never)

    def start(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name in ("br", "hr"):
                self.end_line()
            return
        marked, hidden = _marked(attributes), bool(attributes and HIDDEN.search(attributes))
        if name in INLINE:
            self.in_link = self.in_link or name == "a"
            if marked or hidden:
                self.push(name, marked, hidden)
            return
        self.end_line()
        while self.open and (self.open[-1][0] == "p" or self.open[-1][0] == name in ENDS_LIKE):
            self.pop()
        if name in ARTICLE and not (marked or hidden):
            while any(self.names[n] for n in BEFORE_ARTICLE):
                self.pop()
        self.heading = name == "h1"
        self.push(name, marked, hidden or name in NEVER and not (name == "header" and self.within))

    def end(self, name: str) -> None:
        if name in INLINE:
            if name == "a":
                self.in_link = False
            if self.open and self.open[-1][0] == name:
                self.pop()
            return
        self.end_line()
        self.heading = False
        self.in_link = False
        if self.names[name]:
            while self.open[-1][0] != name:
                self.pop()
            self.pop()


def lines(html: str) -> tuple[list[Line], dict[int, int]]:
    """The blocks of text, and the parent of each container."""
    page, at = _Lines(), 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            page.add(html[at : m.start()])
        at = m.end()
        if name := m.group(3):
            if m.group(2):
                page.end(name.lower())
            else:
                page.start(name.lower(), m.group(4))
    page.add(html[at:])
    page.end_line()
    return page.lines, page.parent


def _menus(found: list[Line], window: int) -> list[bool]:
    """Whether a line is one of at least ``window`` lines in a row that are mostly links."""
    out, run = [], 0
    for k, line in enumerate(found):
        run = run + 1 if line.links else 0
        out.append(run >= window)
        if run == window:
            out[k - window + 1 :] = [True] * window
    return out


def _weight(line: Line, menu: bool, article: bool, heading: int) -> int:
    """What a line adds to the sums; ``article``: whether the page has one."""
    if line.never:
        return 0
    if article and line.inside and line.links:
        return 1  # an article's links hold its stretches together
    if line.links or menu:
        return 0
    weight = len(line.text) * (heading if line.heading else 1)
    return weight // ((8 if line.marked else 1) * (64 if article and not line.inside else 1))


def main_text(html: str, window: int = 3, share: float = 0.25, beside: float = 0.05, heading: int = 8) -> str:
    found, parent = lines(html)
    menu = _menus(found, window)
    article = any(x.inside and not x.never for x in found)
    # the weights of the lines, with empty lines where the container changes; ``number`` says which line a weight is of
    weights, number = [], []
    for k, x in enumerate(found):
        if k and x.container != found[k - 1].container:
            weights += [0] * window
            number += [-1] * window
        weights.append(_weight(x, menu[k], article, heading))
        number.append(k)
    stretches = _stretches(weights, number, window)
    if not stretches:
        return ""
    (top, _), peak = max(stretches, key=lambda x: x[1])
    main, in_article = found[top].container, found[top].inside
    kept = []
    for (a, b), highest in stretches:
        held = found[a : b + 1]
        up = container = found[a].container
        while up and up != main:
            up = parent[up]
        own = up == main != 0 or in_article and found[a].inside
        if all(x.boiler for x in held):
            near = beside if own else 2 * share
        else:
            near = 0.0 if own else beside if parent[main] and parent[container] == parent[main] else share
        if highest >= near * peak:
            kept += [x.text for k, x in enumerate(held, a) if not x.never and (x.inside or not menu[k])]
    return "\n".join(kept)


def _stretches(weights: list[int], number: list[int], window: int) -> list[tuple[tuple[int, int], int]]:
    """(first and last line with a weight, highest sum of a window) between each surge and its dive."""
    out, total, highest, ends = [], 0, 0, None
    for at, weight in enumerate([*weights, *[0] * window]):
        total += weight - (weights[at - window] if at >= window else 0)
        if weight:
            ends = (ends[0] if ends else number[at], number[at])
        highest = max(highest, total)
        if ends and not total:
            out.append((ends, highest))
            highest, ends = 0, None
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
