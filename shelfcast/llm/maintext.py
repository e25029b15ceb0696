"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page as events. Every block of text is a line with
the number of tags that it cost; lines of menus, forms, adverts and the like, which elements
and their class names tell, are left out. The ratios of text to tags of the others are
smoothed with a Gaussian, and lines that reach the deviation of the smoothed ratios seed the
content. A region is then closed to whole paragraphs within the element that holds the seeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared

# Element and class names as pages use them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset((
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr").split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
SKIPPED = frozenset((
    "script style template noscript iframe object embed svg canvas audio video map head title nav footer aside form button "
    "select option textarea label fieldset menu dialog").split())
# Outside an article a header is the site's, inside one it holds the headline.
OUTSIDE = frozenset({"header"})
ARTICLE = frozenset({"article", "main"})
WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription signup login paywall popup modal overlay sidebar widget widgets "
    "related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation pagination "
    "pager toolbar comment comments commentlist disqus reply replies footer skip copyright adsbygoogle taboola outbrain").split())
# These tell wherever they stand in a class name; the others as its first or last part.
ANYWHERE = frozenset((
    "advert advertisement comment comments cookie cookies consent gdpr newsletter sidebar breadcrumb breadcrumbs sponsored "
    "disqus navbar").split())
OUTSIDE_WORDS = frozenset({"header", "masthead"})
NEGATED = frozenset({"has", "no", "with", "without", "hide"})
ROLES = frozenset("navigation banner complementary contentinfo search alert dialog menu menubar form".split())
# Open elements at most, as in browsers; deeper ones count as part of the last.
DEEPEST = 512
# An element of this name closes open ones of the listed names, as browsers do.
CLOSES = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}),
    "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
}


@dataclass(frozen=True)
class Clustering:
    """``spread`` of the Gaussian in lines, ``threshold`` in deviations of the smoothed ratios,
    ``links``: the share of a line's characters in links from which it is no prose."""

    spread: float = 1.0
    threshold: float = 1.0
    links: float = 0.6


@dataclass
class Line:
    """A block of text: its pieces, tags, characters in links, and the elements around it."""

    path: tuple[int, ...]
    prose: bool
    tags: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether an element is known not to be content; ``inside`` an article."""
    if tag in SKIPPED or tag in OUTSIDE and not inside:
        return True
    if tag in ("html", "body", *ARTICLE) and tag != "article":
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value and value.lower() in ROLES and not (inside and value.lower() == "banner"):
            return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
        if name in ("class", "id") and value:
            for whole in value.lower().replace("_", "-").split():
                parts = whole.split("-")
                if parts[0] in NEGATED:
                    continue
                ends = {parts[0], parts[-1]}
                if ends & WORDS or ANYWHERE.intersection(parts) or not inside and ends & OUTSIDE_WORDS:
                    return True
    return False


class PageLines(HTMLParser):
    """Lines of a page from parser events, boilerplate left out, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.names: dict[int, str] = {0: ""}
        self.open: list[tuple[str, int, bool]] = []
        self.articles, self.links, self.tags = 0, 0, 0
        self.number, self.line = 0, None

    @property
    def out(self) -> bool:
        return bool(self.open) and self.open[-1][2]

    def _end_line(self) -> None:
        if self.line is not None:
            self.line.text = " ".join("".join(self.line.pieces).split())
            if self.line.text:
                self.lines.append(self.line)
            self.line = None

    def _pop(self) -> None:
        tag = self.open.pop()[0]
        self.articles -= tag in ARTICLE
        self.links -= tag == "a"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE:
            self._end_line()
            if any(name == "p" for name, _, _ in self.open[-4:]) and tag not in VOID:
                self._close("p", ARTICLE | {"td", "th", "li", "blockquote", "div", "section"})
            if tag in CLOSES:
                self._close_any(CLOSES[tag])
        elif tag == "br" and self.line is not None:
            self.line.pieces.append(" ")
        if tag in VOID or len(self.open) >= DEEPEST:
            return
        if tag in ARTICLE and not self.articles:
            # An unclosed menu, or a form around the page, doesn't swallow the article.
            around = [k for k, (name, _, _) in enumerate(self.open) if name in ("nav", "form", "header", "ul", "fieldset")]
            if around and self.out and not any(out for _, _, out in self.open[: around[0]]):
                self.open[around[0]:] = [(name, n, False) for name, n, _ in self.open[around[0]:]]
        self.number += 1
        self.names[self.number] = tag
        out = self.out or _boilerplate(tag, attrs, bool(self.articles))
        self.open.append((tag, self.number, out))
        self.articles += tag in ARTICLE
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str, fence: frozenset[str] = frozenset()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in fence:
                return

    def _close_any(self, tags: frozenset[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name in tags:
                while len(self.open) > k:
                    self._pop()
                return
            if name not in INLINE and name != "p":
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self._end_line()
        # A paragraph's end doesn't reach past the block around it.
        self._close(tag, ARTICLE if tag not in ARTICLE | {"body", "html"} else frozenset())

    def handle_data(self, data: str) -> None:
        if self.out:
            return
        if self.line is None:
            if data.isspace():
                return
            names = {name for name, _, _ in self.open[-6:]}
            self.line = Line(tuple(n for name, n, _ in self.open if name not in INLINE | PROSE), bool(names & PROSE), self.tags)
            self.tags = 0
        else:
            self.line.tags, self.tags = self.line.tags + self.tags, 0
        self.line.pieces.append(data)
        if self.links:
            self.line.linked += len(data.strip())


def page_lines(html: str) -> PageLines:
    """The parser after the whole page, fed piece by piece."""
    page = PageLines()
    for at in range(0, len(html), 1 << 16):
        page.feed(html[at: at + (1 << 16)])
    page.close()
    page._end_line()
    return page


def smoothed(ratios: np.ndarray, spread: float) -> np.ndarray:
    """Gaussian mean over the lines around each, with the weights that lie inside the page."""
    reach = max(1, int(np.ceil(3 * spread)))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / spread) ** 2)
    total = np.convolve(ratios, weights)[reach: reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), weights)[reach: reach + len(ratios)]


def main_lines(page: PageLines, how: Clustering = Clustering()) -> list[Line]:
    """The lines of the content regions, in page order."""
    lines = page.lines
    if not lines:
        return []
    ratios = np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    smooth = smoothed(ratios, how.spread)
    seeds = np.flatnonzero((smooth >= how.threshold * smooth.std()) & (ratios > 0))
    if not len(seeds):
        return []
    weight = {}
    for k in seeds:
        for n in lines[k].path:
            weight[n] = weight.get(n, 0) + len(lines[k].text)
    articles = {n for n in weight if page.names[n] in ARTICLE}
    if articles:
        # The articles that hold seeds; what stands inside belongs to them.
        inner = {n for n in articles if page.names[n] == "article"} or articles
        return [x for x in lines if inner.intersection(x.path)]
    most = sum(len(lines[k].text) for k in seeds)
    around = [n for n, w in weight.items() if 2 * w > most]
    # The innermost element with most of the seeds, and in it the lines from the first seed to
    # the last, on both sides extended over prose.
    holder = max(around, default=0)
    held = [k for k, x in enumerate(lines) if not holder or holder in x.path]
    seeds = [k for k in held if k in set(seeds.tolist())]
    first, last = held.index(seeds[0]), held.index(seeds[-1])
    is_prose = [lines[k].prose and lines[k].linked < how.links * len(lines[k].text) for k in held]
    while first > 0 and is_prose[first - 1]:
        first -= 1
    while last + 1 < len(held) and is_prose[last + 1]:
        last += 1
    return [lines[k] for k, prose in zip(held[first: last + 1], is_prose[first: last + 1])
            if prose or lines[k].linked < how.links * len(lines[k].text)]


def main_text(html: str | None, how: Clustering = Clustering()) -> str:
    """Blocks of the article, each with its white space as single spaces, joined by newlines."""
    return "\n".join(x.text for x in main_lines(page_lines(html or ""), how))


def extracted(pages: DataFrame, how: Clustering = Clustering()) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages``.

    A null or empty page, or one without content, has an empty text. Ids and urls are passed
    on as they are, nulls and repeated rows included. A page is parsed within its task, so a
    long one costs its own length.
    """
    @shared.trimmed
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py(), how) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(
        extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null, empty, repeated and truncated pages as ``extracted`` says."""
    return extracted(shared.table(spark, sf_dir, "pages"))
