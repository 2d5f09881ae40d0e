"""The main text of web pages from parser events and text-to-tag ratios.

A page is read once as a stream of parser events.  Each block becomes a line with its
text and the number of tags it took.  The ratio of characters to tags is smoothed
along the page by a Gaussian window, and the lines above a threshold drawn from the
spread of the smoothed ratios are the dense ones.  They show which regions hold the
content: the article elements that have dense lines, or else the stretch of the page
between the first and the last dense line.  All lines of these regions are kept, short
ones too, except what its element marks as menu, advert, form, comment and the like.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelantern.llm.shared import slices

# Width of the Gaussian window in lines, and the part of the spread that a dense line exceeds.
SIGMA = 1.0
THRESHOLD = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody "
    "tfoot thead tr ul".split()
)
# Elements that are never part of the text.
DROPPED = frozenset(
    "applet aside audio button canvas datalist dialog embed footer form head iframe input map menu nav noscript object "
    "option search select svg template textarea title video script style".split()
)
# What an element's class or id says of it, word by word.
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu menubar modal nav navbar "
    "navigation navmenu newsletter notice notification overlay pager pagination paywall popup promo promotion promoted "
    "recommended recommendations related replies respond search share sharing sidebar sidenav signup skip social sponsor "
    "sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
# Which open elements an element ends.
IMPLIED = {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "td": ("td", "th"), "th": ("td", "th"),
    "tr": ("tr", "td", "th"), "option": ("option",),
}
# A class that begins so tells of the page's template or topic, not of the element.
ABOUT = frozenset("category cat has hide is no not page postid single tag tax term topic type with without".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@dataclass
class Line:
    """A block of the page; ``region`` is the article it lies in, if any.

    ``dropped``: an element around it marks it as no content; ``dropped_within``: one
    inside the article does."""

    text: str
    tags: int
    region: int
    dropped: bool
    dropped_within: bool
    links: int
    hard: bool  # dropped by more than class or id
    marks: tuple[int, ...]  # the elements around it whose class or id drops it


@dataclass
class _Open:
    tag: str
    drops: bool
    region: int | None = None
    mark: int = 0


@dataclass
class _State:
    parts: list[str] = field(default_factory=list)
    tags: int = 1
    links: int = 0
    region: int = 0
    within: bool = False
    hard: bool = False
    marks: tuple[int, ...] = ()


class Lines(HTMLParser):
    """Collects the lines of a page from the parser's events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[_Open] = []
        self.current, self.aside = _State(), _State()  # of the block, and of dropped elements in it
        self.regions, self.marks = 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_block()
        if tag == "br":
            self.handle_data(" ")
        self.current.tags += 1
        if tag in VOID:
            return
        if tag in BLOCKS or tag in ("td", "th"):
            self._close_implied(tag)
        if tag in ("td", "th"):
            self.handle_data(" ")
        values = {k: v or "" for k, v in attrs}
        is_article = tag in ("article", "main") or values.get("role") in ("main", "article") or "articleBody" in values.get("itemprop", "")
        region = None
        is_main = tag == "main" or values.get("role") == "main"
        marked = tag not in ("html", "body") and not is_main and self._marked(values)
        if is_article and not marked:
            if not any(o.region is not None for o in self.open):
                self.regions += 1
            region = self.regions
        self.marks += marked
        self.open.append(_Open(tag, region is None and self._drops(tag, values), region, self.marks if marked else 0))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash of a void or block element means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_block()
        self.current.tags += 1
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k].tag == tag), -1)
        # the end of an inline element ends no block that was opened in it
        if at >= 0 and (tag in BLOCKS or tag in DROPPED or not any(o.tag in BLOCKS for o in self.open[at:])):
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        drops = [o.drops or o.mark > 0 for o in self.open]
        state = self.aside if any(drops) else self.current
        if not state.parts:
            at = next((k for k, o in enumerate(self.open) if o.region is not None), len(self.open))
            state.region = self.open[at].region if at < len(self.open) else 0
            state.within = any(drops[at:])
            state.hard = any(o.drops for o in self.open)
            state.marks = tuple(o.mark for o in self.open if o.mark)
        state.parts.append(data)
        if any(o.tag == "a" for o in self.open):
            state.links += len(data)

    def unknown_decl(self, data: str) -> None:
        pass

    def close(self) -> None:
        super().close()
        self._end_block()

    def _close_implied(self, tag: str) -> None:
        """A paragraph ends where a block begins, an item or cell where the next one does."""
        group = IMPLIED.get(tag, ("p",))
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k].tag
            if name in group:
                del self.open[k:]
                return
            if name in BLOCKS:
                return

    @staticmethod
    def _marked(values: dict[str, str]) -> bool:
        """Whether a class or the id is a mark, or begins or ends with one."""
        for name in f"{values.get('class', '')} {values.get('id', '')}".split():
            words = [w.lower() for w in _WORDS.findall(name)]
            if words and words[0] not in ABOUT and (words[0] in MARKS or words[-1] in MARKS):
                return True
        return False

    def _drops(self, tag: str, values: dict[str, str]) -> bool:
        if tag in DROPPED or tag == "header" and not any(o.region is not None for o in self.open):
            return True
        if values.get("role") in ROLES or values.get("aria-hidden") == "true" or "hidden" in values:
            return True
        return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")))

    def _end_block(self) -> None:
        for state in (self.current, self.aside):
            text = " ".join("".join(state.parts).split())
            if text:
                self.lines.append(Line(text, state.tags, state.region, state is self.aside, state.within, state.links, state.hard, state.marks))
        self.current, self.aside = _State(), _State()


def _ended(html: str) -> str:
    """The page without a tag that the page's end cuts off, and with one start at most for a
    comment that never ends; the parser would try either again from each of its parts."""
    last = html.rfind(">") + 1
    cut = re.compile(r"<[a-zA-Z/!?]").search(html, last)
    html = html[:cut.start()] if cut else html
    start = html.find("<!--", html.rfind("-->") + 1)
    return html if start < 0 else html[:start + 4] + html[start + 4:].replace("<!--", "<!-")


def parsed(html: str) -> list[Line]:
    """The lines of a page, dropped ones included."""
    parser = Lines()
    try:
        parser.feed(_ended(html))
        parser.close()
        return parser.lines
    except AssertionError:  # the parser gives up on declarations it does not know
        parser = Lines()
        parser.feed(_ended(html).replace("<![", "&lt;!["))
        parser.close()
        return parser.lines


def dense(lines: list[Line], sigma: float = SIGMA, threshold: float = THRESHOLD) -> np.ndarray:
    """Which lines have a smoothed text-to-tag ratio above the threshold."""
    ratio = np.array([len(line.text) / line.tags for line in lines])
    reach = max(1, int(3 * sigma))
    window = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.convolve(ratio, window)[reach:reach + len(ratio)]
    smooth = padded / np.convolve(np.ones(len(ratio)), window)[reach:reach + len(ratio)]
    return smooth >= threshold * smooth.std()


def _trust_content(lines: list[Line], is_dense: np.ndarray) -> None:
    """On a page without an unmarked article, an element that holds most of the dense text is
    the content, whatever its class says; its lines are not dropped for it."""
    if any(line.region and not line.dropped for line in lines):
        return
    held: dict[int, int] = {}
    total = 0
    for k, line in enumerate(lines):
        if is_dense[k] and not line.hard and 2 * line.links < len(line.text):
            total += len(line.text)
            for mark in line.marks:
                held[mark] = held.get(mark, 0) + len(line.text)
    for line in lines:
        line.dropped = line.hard or any(2 * held.get(mark, 0) <= total for mark in line.marks)


def main_text(html: str, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The blocks of the content regions, joined by empty lines; empty if there are none."""
    lines = parsed(html)
    if not lines:
        return ""
    is_dense = dense(lines, sigma, threshold)
    _trust_content(lines, is_dense)
    within = [k for k, line in enumerate(lines) if line.region and not line.dropped]
    free = [k for k, line in enumerate(lines) if not line.dropped and 2 * line.links < len(line.text)]
    if not within and not any(is_dense[k] for k in free):
        # an element that was left open hides the article
        within = [k for k, line in enumerate(lines) if line.region and not line.dropped_within]
    if within:
        wanted = {lines[k].region for k in within if is_dense[k]} or {lines[k].region for k in within}
        return "\n\n".join(lines[k].text for k in within if lines[k].region in wanted)
    # without an article: from the first to the last dense line, with the headings before them
    core = [k for k in free if is_dense[k]] or free
    if not core:
        return ""
    first, others = core[0], set(free)
    while first - 1 in others:
        first -= 1
    return "\n\n".join(lines[k].text for k in free if first <= k <= core[-1])


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, sigma: float = SIGMA, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    A null or empty html, or a page without content, gives an empty text.  n_chars
    counts code points.  Repeated rows give repeated results; other columns are not
    read.  Nothing is shuffled, and a worker holds one page beside its batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(html or "", sigma, threshold) for html in batch.column(2).to_pylist()]
            counts = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], schema=_SCHEMA)

    columns = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extract(spark.read.parquet(f"{folder}/pages.parquet"))
