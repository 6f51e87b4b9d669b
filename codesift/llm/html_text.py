"""Main text of HTML pages by text-to-tag ratios.

A page is fed to the standard library's streaming parser.  Block elements cut
it into lines; each line has its text, its number of tags and its place in the
page.  The ratio of text to tags per line is smoothed by a Gaussian, and lines
above a threshold (a share of the ratios' standard deviation) form clusters.
The deepest region (article, main or other container) that holds all of the
clusters is the content: its lines are returned, short ones too.  Lines that are
mostly links stay only where the smoothed ratio of all of a run of them is that of
a cluster: one among paragraphs is part of the text, a list is a menu, in an
article as well.

Lines inside elements that are never main text (navigation, asides, forms,
scripts, footers, and containers named as adverts, notices, menus, comments
and the like) have no ratio and belong to no region.  A page with an article
or a main element has its content in those only.

Defined cases: a null page is an empty page and has empty text; broken markup
is read as far as the parser makes sense of it, an unclosed menu or page
header ends where an article begins, an unclosed comment goes on to the end;
repeated rows are read each; an empty table gives no rows; further columns do
not matter.  A very long page is one row of one task: the places of open
elements are kept by tag, so any nesting is read in linear time.
"""

from __future__ import annotations

import itertools
import math
import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from codesift.llm.common import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIGMA = 1.0
LAMBDA = 0.5

_BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option
p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Never main text, whatever their names.
_NEVER = frozenset("""aside audio canvas dialog footer form head iframe menu nav noscript object
option script search select style svg template textarea title video""".split())
# No main text by themselves, but words of a paragraph within one.
_CONTROLS = frozenset(["button", "label"])
_CONTENT = frozenset(["article", "main"])
_CONTAINERS = frozenset(["div", "section", "td", "body", "blockquote", "center"])
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
# An opening tag ends these open elements, up to the container given.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select"])),
}
# Blocks that an open paragraph does not contain.
_ENDS_P = _BLOCKS - frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "body", "html", "head", "legend"])
_ROLES = frozenset("""alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search
toolbar""".split())
# Words of class and id attributes that name what is not main text.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?<!has-)(?<!with-)(?<!no-)(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion|tions|s)?|banners?"
    r"|cookies?|consent|gdpr|notices?|notifications?|alerts?|sidebars?|side|menus?|nav|navbar|navigation|breadcrumbs?"
    r"|footer|masthead|topbar|toolbar|comments?|commentlist|replies|reply|responses|discussion|disqus|respond|share|sharing|social"
    r"|related|recommended|recommendations|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|widgets?|pagination|pager"
    r"|skip|disclaimer|tags|byline|teasers?)(?:$|[\s_-]|\d)", re.IGNORECASE)
# Of these, the names that may be of the text inside an article: its own sections
# are called like this too, other blocks are not.
_SECTION_NAMES = re.compile(
    r"(?:^|[\s_-])(?<!has-)(?<!with-)(?<!no-)(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion|tions|s)?"
    r"|cookies?|sidebars?|comments?|commentlist|disqus|share|sharing|newsletter)(?:$|[\s_-]|\d)", re.IGNORECASE)
# A whole class name that marks an article as something beside the main one.
_ASIDE_ARTICLE = re.compile(
    r"(?:user-|reader-)?(?:comment|reply|response)s?(?:-(?:item|body|content|\d+))?|teaser|related|promo|sponsored|ad|advert", re.IGNORECASE)
_HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|page-header|site-header)(?:$|[\s_-])", re.IGNORECASE)
_BLANK = re.compile(r"\s+")


class _Open(NamedTuple):
    tag: str
    skip: bool      # never main text
    muted: bool     # in an article's header, outside its headings
    region: int
    content: bool   # in an article or main element
    link: bool      # in an anchor


class Line(NamedTuple):
    text: str
    tags: int
    region: int
    content: bool
    linked: int     # characters in anchors


class _Lines(HTMLParser):
    """Lines and the tree of their regions; what is skipped leaves a line
    without text, so that smoothing sees the gap."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack = [_Open("", False, False, 0, False, False)]
        self.places: dict[str, list[int]] = {}  # of open elements in the stack, by tag
        self.menus: list[int] = []  # places of open menus and page headers
        self.parents = [-1]  # of each region; the page is region 0
        self.held: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        top = self.stack[-1]
        text = "" if top.skip or top.muted else _BLANK.sub(" ", "".join(self.held)).strip()
        if text or self.tags:
            self.lines.append(Line(text, self.tags, top.region, top.content, self.linked))
        self.held, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        block = tag in _BLOCKS
        if tag in _CONTENT:
            # A menu or page header cannot hold the article: it was not closed.
            if self.menus:
                self.end_line()
                self._cut(self.menus[0])
        if block:
            self.end_line()
            if tag in _ENDS_P:
                self._close("p", _BLOCKS - _HEADINGS)
        if tag in _ENDS:
            ends, until = _ENDS[tag]
            at = self._last(ends)
            if at > self._last(until):
                self._cut(at)
        self.tags += 1
        if tag in _VOID:
            if tag == "br":
                self.held.append(" ")
            return
        top = self.stack[-1]
        names = {k: v or "" for k, v in attrs}
        called = f"{names.get('class', '')} {names.get('id', '')}"
        skip = top.skip or tag in _NEVER or "hidden" in names or names.get("aria-hidden") == "true" \
            or names.get("role", "").lower() in _ROLES
        if tag == "article":
            skip = skip or any(_ASIDE_ARTICLE.fullmatch(c) for c in called.split())
        elif tag == "main":
            skip = False
        elif tag in _CONTROLS:
            skip = skip or not self.places.get("p")
        elif block and tag not in _HEADINGS and tag not in ("body", "html"):
            skip = skip or bool((_SECTION_NAMES if top.content and tag == "section" else _NAMES).search(called))
            skip = skip or not top.content and bool(_HEADER_NAMES.search(called))
        # A page header goes; of an article's header the headings stay.
        skip = skip or tag == "header" and not top.content
        muted = tag not in _HEADINGS and (top.muted or tag == "header" or block and top.content and bool(_HEADER_NAMES.search(called)))
        content = top.content or tag in _CONTENT
        region = top.region
        if not top.content and (tag in _CONTENT or tag in _CONTAINERS):
            self.parents.append(region)
            region = len(self.parents) - 1
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in ("nav", "header") and not content:
            self.menus.append(len(self.stack))
        self.stack.append(_Open(tag, skip, muted, region, content, top.link or tag == "a"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()
        while self.menus and self.menus[-1] >= at:
            self.menus.pop()

    def _last(self, tags) -> int:
        """Place of the innermost open element of ``tags``; 0 when there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def _close(self, tag, until=frozenset()) -> None:
        at = self._last([tag])
        if at and at > self._last(until - {tag}):
            self._cut(at)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in _BLOCKS:
            self.end_line()
        if tag in _VOID:
            return
        self._close(tag)

    def handle_data(self, data):
        top = self.stack[-1]
        if not (top.skip or top.muted):
            self.held.append(data)
            self.linked += len(data) if top.link else 0


def page_lines(html: str) -> tuple[list[Line], list[int]]:
    """Lines of a page, and the parent of each region."""
    parser = _Lines()
    parser.feed(html)
    if parser.rawdata.startswith("<!--"):
        parser.rawdata = ""  # a comment without an end
    parser.close()
    parser.end_line()
    return parser.lines, parser.parents


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over two sigma on both sides; edges are weighted anew."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(kernel[d + reach], ratios[i + d]) for d in range(-reach, reach + 1) if 0 <= i + d < len(ratios)]
        out.append(sum(k * r for k, r in near) / sum(k for k, _ in near))
    return out


def _content_region(weights: dict[int, float], parents: list[int]) -> int:
    """The deepest region that holds the weight of all lines."""
    inside = [weights.get(r, 0.0) for r in range(len(parents))]
    # A region has a higher number than its parent.
    for r in range(len(parents) - 1, 0, -1):
        inside[parents[r]] += inside[r]
    return max(r for r in range(len(parents)) if inside[r] >= inside[0])


def main_text(html: str | None, sigma: float = SIGMA, share: float = LAMBDA) -> str:
    lines, parents = page_lines(html or "")
    if any(x.text and x.content for x in lines):
        lines = [x if x.content else x._replace(text="") for x in lines]
    with_text = [i for i, x in enumerate(lines) if x.text]
    if not with_text:
        return ""
    level = smoothed([len(x.text) / max(1, x.tags) for x in lines], sigma)
    mean = sum(level) / len(level)
    threshold = share * math.sqrt(sum((x - mean) ** 2 for x in level) / len(level))
    core = {i for i in with_text if level[i] >= threshold and not _is_list_of_links(lines[i])} or set(with_text)
    weights: dict[int, float] = {}
    for i in core:
        weights[lines[i].region] = weights.get(lines[i].region, 0.0) + len(lines[i].text)
    content = _content_region(weights, parents)

    within = [r == content for r in range(len(parents))]
    for r in range(content + 1, len(parents)):
        within[r] = within[parents[r]]
    # All of the region counts, short lines too, but for runs of links that are
    # not in a cluster throughout.
    kept = []
    for links, run in itertools.groupby((i for i in with_text if within[lines[i].region]), key=lambda i: _is_list_of_links(lines[i])):
        run = list(run)
        if not links or min(level[i] for i in run) >= threshold:
            kept += [lines[i].text for i in run]
    return "\n\n".join(kept)


def _is_list_of_links(line: Line) -> bool:
    return 2 * line.linked > len(line.text)


def extracted(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` with text and its number of code points."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                schema=schema)

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return pages.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op2_text_to_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
