"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams over a page; every block-level tag ends a line. A line's
ratio is its characters over its tags. The ratios are smoothed with a Gaussian kernel and
those above a threshold (a share of their standard deviation) cluster as content. The smallest
regions of the page that hold all of that content are the article; all their lines are given,
short ones too, with two exceptions: parts that their tag or name says are no text (menus,
notices, forms and the like), and blocks of links, which are those whose lines are mostly in no
cluster and of whose characters half or more are in links.

Names count as whole words of class, id or role on tags that hold blocks: ``ad`` or
``cookie-notice`` names a part, ``ad-hoc``, ``related-work`` or ``section-header`` doesn't.

Defined results: null or empty html, or a page without text, gives the empty text; white space
is what Python's str.split() splits at; rows that repeat are extracted alike; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTHING = 1.0
THRESHOLD = 0.5
#: Characters in links, as a share, from which a block of few content lines is one of links.
LINKED = 0.5

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
REGIONS = {"article", "main", "section", "div", "body"}
#: Tags that hold blocks, and so may be blocks of links or be named as parts.
BLOCKS = {"div", "section", "ul", "ol", "dl", "table"}
NAMED = BLOCKS | {"p", "aside", "details", "figure", "header", "footer"}
DROPPED = set(
    "head title script style noscript template iframe object svg math canvas video audio map nav footer aside form button select option textarea fieldset dialog menu".split()
)
#: Tags that may stand in a head; any other one ends it, as its end tag is optional.
HEAD = set("html head title base basefont bgsound link meta script style noscript noframes template".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag that ends open ones whose end tag is optional: (which, up to what).
ENDS = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figure footer form hr main menu nav ol p pre section table ul header".split() + sorted(HEADINGS), ({"p"}, REGIONS | BLOCKS | {"li", "dd", "td", "th"})),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})),
    "tr": ({"tr"}, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr"}, {"table"})),
    "option": ({"option"}, {"select"}),
}
#: What an end tag of another kind doesn't close.
CELLS = {"td", "th", "table", "caption"}
#: Words that name a part without main text.
PARTS = set(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation
    breadcrumb breadcrumbs comment comments reply replies respond disqus cookie cookies consent gdpr notice
    notices popup modal newsletter subscribe subscription share sharing social related recommended widget toolbar pagination pager
    login signup search copyright disclaimer alert complementary""".split()
)
#: Words that name the head or foot of a page: only their headings may belong to an article.
EDGES = set("masthead header footer contentinfo".split())
#: Words that may stand with one of ``PARTS`` in a name of several words: before it, and after it.
BEFORE = set("site page top bottom left right main global primary secondary mobile user reader post article".split())
AFTER = set(
    "list box block container wrapper wrap section area slot unit bar buttons links form panel inner thread posts articles stories content container top bottom left right footer".split()
)


def _names(given: dict[str, str | None]) -> set[str]:
    return set(f"{given.get('class') or ''} {given.get('id') or ''} {given.get('role') or ''}".lower().split())


def _is_part(name: str) -> bool:
    """One of ``PARTS``, alone, numbered or among words that only say where it stands or that it holds some."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    named = [k for k, w in enumerate(words) if w in PARTS]
    if not named:
        return False
    return all(w in BEFORE for w in words[: named[0]]) and all(w in AFTER or w in PARTS for w in words[named[0] :])


def _is_edge(name: str) -> bool:
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return bool(words) and words[-1] in EDGES and all(w in ("site", "page", "top", "main", "global") for w in words[:-1])


class _Open(NamedTuple):
    tag: str
    region: int
    block: int
    dropped: bool
    edge: bool


class _Line(NamedTuple):
    text: str
    tags: int
    linked: int
    regions: tuple[int, ...]
    blocks: tuple[int, ...]


class _Lines(HTMLParser):
    """Lines of a page: text, tags, characters in links, the regions and blocks around."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.region_tags: list[str] = []
        self.blocks = 0
        self.open: list[_Open] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.dropping = self.edges = self.headings = self.links = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            regions, blocks = (tuple(x for x in of if x >= 0) for of in ([o.region for o in self.open], [o.block for o in self.open]))
            self.lines.append(_Line(text, self.tags, self.linked, regions, blocks))
        if text or self.parts:
            self.tags = self.linked = 0
        self.parts = []

    def _in_head(self) -> bool:
        return bool(self.open) and self.open[-1].tag == "head"

    def _counted(self, o: _Open, n: int) -> None:
        self.dropping += n * o.dropped
        self.edges += n * o.edge
        self.headings += n * (o.tag in HEADINGS)
        self.links += n * (o.tag == "a")

    def _cut(self, k: int) -> None:
        """Closes what is open from place ``k`` on."""
        for o in self.open[k:]:
            self._counted(o, -1)
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" or tag not in HEAD and self._in_head():
            self._close("head")
        if tag not in INLINE:
            self._end_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag in ENDS:
            which, until = ENDS[tag]
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag in which:
                    self._cut(k)
                    break
                if self.open[k].tag in until:
                    break
        self.tags += 1
        if tag in VOID:
            return
        given = dict(attrs)
        dropped = "hidden" in given or (given.get("aria-hidden") or "").lower() == "true" or "display:none" in (given.get("style") or "").replace(" ", "").lower()
        edge = tag == "header"
        if tag in ("html", "body", "main"):
            dropped = False
        elif tag == "article":
            dropped |= bool(PARTS & _names(given))
        else:
            dropped |= tag in DROPPED
            if tag in NAMED:
                names = _names(given)
                dropped |= any(map(_is_part, names))
                edge |= any(map(_is_edge, names))
        if edge and not any(o.tag in ("article", "main") for o in self.open):
            dropped = True
        region = block = -1
        if tag in REGIONS:
            region = len(self.region_tags)
            self.region_tags.append(tag)
        if tag in BLOCKS:
            block = self.blocks
            self.blocks += 1
        self.open.append(_Open(tag, region, block, dropped, edge))
        self._counted(self.open[-1], 1)

    def _close(self, tag: str) -> None:
        """Ends the last open one; an inline one ends alone where blocks have begun in it."""
        over_block = False
        for k in range(len(self.open) - 1, -1, -1):
            o = self.open[k]
            if o.tag == tag:
                if tag in INLINE and over_block:
                    self._counted(o, -1)
                    del self.open[k]
                else:
                    self._cut(k)
                return
            if o.tag in CELLS and tag not in CELLS | {"tr", "thead", "tbody", "tfoot"}:
                return
            over_block |= o.tag not in INLINE

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_line()
        self.tags += 1
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if self._in_head() and data.strip():
            self._close("head")
        if self.dropping or (self.edges and not self.headings):
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._end_line()


def _smoothed(ratio: np.ndarray) -> np.ndarray:
    reach = np.arange(-2, 3)
    kernel = np.exp(-(reach**2) / (2 * SMOOTHING**2))
    # at the ends the kernel's inner part alone counts
    return np.convolve(ratio, kernel, "full")[2 : 2 + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel, "full")[2 : 2 + len(ratio)]


def main_text(html: str | None) -> str:
    """The page's main text, a line for each block."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    if not parser.lines:
        return ""
    content = _content(parser.lines)
    around = [set(line.regions) for line, chosen in zip(parser.lines, content, strict=True) if chosen]
    tags = parser.region_tags
    held = Counter(r for regions in around for r in regions)
    # the articles with content; what they leave out is in main parts or else in the last opened region that holds all
    named = {r for r in held if tags[r] == "article"}
    if not all(named & regions for regions in around):
        left_out = set().union(*(regions for regions in around if not named & regions))
        named |= {r for r in left_out if tags[r] == "main"}
    if not all(named & regions for regions in around):
        named = {max((r for r in held if held[r] == len(around)), default=-1)}
    links = _link_blocks(parser.lines, content)
    return "\n".join(
        line.text for line in parser.lines if (-1 in named or not named.isdisjoint(line.regions)) and links.isdisjoint(line.blocks)
    )


def _content(lines: list[_Line]) -> np.ndarray:
    """Whether a line's smoothed ratio makes it content."""
    smooth = _smoothed(_ratios(lines))
    return smooth >= THRESHOLD * smooth.std()


def _ratios(lines: list[_Line]) -> np.ndarray:
    return np.array([len(line.text) / max(1, line.tags) for line in lines])


def _link_blocks(lines: list[_Line], content: np.ndarray) -> set[int]:
    """Blocks of two lines or more of which fewer than half are content and that are links for the most part."""
    chars, linked, count, chosen_in = Counter(), Counter(), Counter(), Counter()
    for line, chosen in zip(lines, content.tolist(), strict=True):
        for block in line.blocks:
            chars[block] += len(line.text)
            linked[block] += min(line.linked, len(line.text))
            count[block] += 1
            chosen_in[block] += chosen
    return {b for b in count if 2 * chosen_in[b] < count[b] > 1 and linked[b] >= LINKED * chars[b]}


RESULT = "page_id bigint, url string, text string"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_text(html.as_py()) for html in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), found], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(texts, RESULT)
