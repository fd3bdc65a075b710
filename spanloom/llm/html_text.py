"""Main text of web pages.

The standard library's parser streams events; they are gathered to lines, one per block element, each with its text
and the tags seen in it. What a page marks as furniture (menus, headers, footers, side bars, notices, adverts, forms,
scripts, styles, comments of readers) is left out by element, role, class or id. Lines then form regions: what an
article or main element holds, runs of lines between those that no furniture parts, and, in either, runs of lines that
hold LINKS links or more and no other text. Each line's ratio of text outside links to tags is smoothed with a Gaussian
along its region, and regions that reach the threshold, the standard deviation of all the page's ratios, are content;
of none, the best. Article and main elements are a prior only: where the largest of them holds as much text outside
links as all other regions that reach the threshold, those are not content. A region's lines are kept whole, short
ones too. Where all text is links, links count as text.

A class or id does not remove an element that holds a main element or the page's only article, nor one whose furniture
name is in one word with a name of layout ("content-sidebar-wrap") if it holds most of the page's text: the page is read
again with that element kept. So it is where nothing else is left: the article or main element with most text, or the
element with a furniture name as a part of a longer one ("no-comments", "menu-open"), is then kept. A head that does not close ends where the body or a block element opens.

Cases: a null or empty page, or one of markup only, has the empty text. Broken markup is read as far as it goes;
elements that never close end with the page. Repeated rows give equal texts. Null ids and urls are carried. Other
columns are ignored. A page is parsed in its task's memory, batch by batch.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never content.
OUT = frozenset("head title script style noscript template nav aside footer form button select textarea input iframe object svg canvas menu dialog".split())
OUT_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar".split())
OUT_NAMES = frozenset("ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner sidebar comment comments commentlist discussion replies reply respond disqus menu nav navbar navigation navigate breadcrumb breadcrumbs topbar masthead footer foot cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager toolbar widget skip".split())
#: Names of layout; with one of these, a furniture name in the same class or id may be that of a wrapper.
LAYOUT = frozenset("wrap wrapper layout container content page site grid row with has".split())
CONTAINERS = frozenset(("article", "main"))
#: Elements of a head whose content does not end it.
QUIET = frozenset(("noscript", "template", "title"))
#: Elements that an opening block element closes.
LOOSE = frozenset(("p", "li", "dt", "dd", "option"))
SPREAD, REACH = 1.0, 3
#: So many links, and nothing else, make lines a list of links.
LINKS = 3


class Line:
    __slots__ = ("links", "own", "parts", "region", "tags", "title")

    def __init__(self, region: int) -> None:
        self.parts: list[str] = []
        self.own: list[str] = []  # the parts outside links
        self.region, self.tags, self.links, self.title = region, 1, 0, False

    def linked(self) -> bool:
        return self.links > 0 and not self.title and not any(c.isalnum() for x in self.own for c in x)


class Named:
    """An element left out by its class or id: where it starts, and what it holds."""

    __slots__ = ("articles", "layout", "loose", "main", "place", "size")

    def __init__(self, place: tuple[int, int], layout: bool, loose: bool) -> None:
        self.place, self.layout, self.loose = place, layout, loose
        self.articles, self.main, self.size = 0, False, 0


class Page(HTMLParser):
    """Lines of a page without its furniture, from the parser's events."""

    def __init__(self, kept: frozenset[tuple[int, int]] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.kept = kept  # places of elements that their names do not remove
        self.named: list[Named] = []
        self.holder: Named | None = None
        self.articles = 0
        self.quiet = 0
        self.lines: list[Line] = []
        self.out: str | None = None  # the element that is left out, and how many of its name are open in it
        self.depth = 0
        self.inside: list[str] = []  # open article and main elements
        self.regions: list[bool] = [False]  # whether a region is an article's
        self.line = Line(0)
        self.link = False

    def close_line(self) -> None:
        self.link = False
        if self.line.parts:
            self.lines.append(self.line)
        self.line = Line(len(self.regions) - 1)

    def new_region(self, article: bool) -> None:
        self.close_line()
        self.regions.append(article)
        self.line = Line(len(self.regions) - 1)

    def furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in OUT or tag == "header" and not self.inside:
            return True
        if tag in ("html", "body"):
            return False
        if any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value and value.lower() in OUT_ROLES for name, value in attrs):
            return True
        return bool(self.names(attrs)) and self.getpos() not in self.kept

    @staticmethod
    def names(attrs: list[tuple[str, str | None]]) -> list[set[str]]:
        """Classes and ids with a furniture name, each as its parts."""
        words = [set(re.split(r"[^a-z]+", x)) - {""} for name, value in attrs if name in ("class", "id") and value for x in value.lower().split()]
        return [x for x in words if x & OUT_NAMES]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "article":
            named = bool(self.names(attrs))
            self.articles += not named
            if self.holder:
                self.holder.articles += not named
        elif tag == "main" and self.holder:
            self.holder.main = True
        if self.out:
            if self.out == "head":
                self.quiet += tag in QUIET
            if self.out in LOOSE and tag in BLOCKS or self.out == "head" and (tag == "body" or tag in BLOCKS and not self.quiet):
                self.leave()
            else:
                self.depth += tag == self.out
                return
        self.line.tags += 1
        if self.furniture(tag, attrs):
            self.close_line()
            if tag not in VOID:
                self.out, self.depth, self.quiet = tag, 1, 0
                if tag not in OUT and (names := self.names(attrs)) and self.getpos() not in self.kept:
                    self.holder = Named(self.getpos(), all(x & LAYOUT for x in names), tag in CONTAINERS or all(len(x) > 1 for x in names))
                    self.named.append(self.holder)
            return
        if tag in CONTAINERS:
            self.inside.append(tag)
            if len(self.inside) == 1:
                self.new_region(True)
        if tag in BLOCKS:
            self.close_line()
            self.line.title = tag == "h1"
        elif tag == "br":
            self.line.parts.append(" ")
        elif tag == "a":
            self.link = True
            self.line.links += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # HTML knows no self-closing elements but the void ones: <p/> opens a paragraph.
        self.handle_starttag(tag, attrs)

    def leave(self) -> None:
        self.out = self.holder = None
        if not self.inside:
            self.new_region(False)

    def handle_endtag(self, tag: str) -> None:
        if self.out:
            if self.out == "head" and tag in QUIET:
                self.quiet = max(0, self.quiet - 1)
            if tag == self.out:
                self.depth -= 1
                if not self.depth:
                    self.leave()
                return
            if not (self.out in LOOSE and tag in BLOCKS) and tag not in ("body", "html"):
                return
            self.leave()
        self.line.tags += 1
        if tag in BLOCKS:
            self.close_line()
        elif tag == "a":
            self.link = False
        if tag in CONTAINERS and tag in self.inside:
            while self.inside.pop() != tag:
                pass
            if not self.inside:
                self.new_region(False)

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.line.parts.append(data)
            if not self.link:
                self.line.own.append(data)
        elif self.holder and not self.cdata_elem:
            self.holder.size += len(" ".join(data.split()))

    def wrappers(self) -> frozenset[tuple[int, int]]:
        """Places of elements that were left out by name but hold the page's main part."""
        size = sum(len(" ".join(p.split())) for x in self.lines for p in x.parts) + sum(x.size for x in self.named)
        if not any(p.strip() for x in self.lines for p in x.parts):
            loose = [x for x in self.named if x.loose and x.size]
            return frozenset(x.place for x in loose if x.size == max(y.size for y in loose))
        return frozenset(x.place for x in self.named if x.main or x.articles == self.articles == 1 or x.layout and 2 * x.size > size)


def smoothed(ratios: list[float], spread: float = SPREAD, reach: int = REACH) -> list[float]:
    """Gaussian smoothing over neighbouring lines."""
    kernel = [math.exp(-(k * k) / (2 * spread * spread)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(kernel[k + reach], ratios[i + k]) for k in range(-reach, reach + 1) if 0 <= i + k < len(ratios)]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


def read(html: str, kept: frozenset[tuple[int, int]] = frozenset()) -> Page:
    page = Page(kept)
    page.feed(html)
    page.close()
    page.close_line()
    return page


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = read(html)
    while more := page.wrappers():
        page = read(html, page.kept | more)
    lines = [(text, x) for x in page.lines if (text := " ".join("".join(x.parts).split()))]
    if not lines:
        return ""
    sizes = [len(" ".join("".join(x.own).split())) for _, x in lines]
    if not any(sizes):
        sizes = [len(text) for text, _ in lines]
    regions: list[tuple[int, int]] = []  # a line's region, and the number of its list of links there
    for n, (listed, run) in enumerate(groupby((x for _, x in lines), key=lambda x: (x.region, x.linked()))):
        own = list(run)
        regions += [(listed[0], n + 1 if listed[1] and sum(x.links for x in own) >= LINKS else 0)] * len(own)
    ratios = [r for _, own in groupby(range(len(lines)), key=regions.__getitem__) for r in smoothed([sizes[k] / lines[k][1].tags for k in own])]
    mean = sum(ratios) / len(ratios)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)) or max(ratios)
    held: dict[tuple[int, int], int] = {}
    best: dict[tuple[int, int], float] = {}
    for region, n, r in zip(regions, sizes, ratios):
        held[region], best[region] = held.get(region, 0) + n, max(best.get(region, 0.0), r)
    article = max((n for (k, _), n in held.items() if page.regions[k]), default=0)
    if article and article >= sum(n for x, n in held.items() if not page.regions[x[0]] and best[x] >= threshold):
        best = {x: r for x, r in best.items() if page.regions[x[0]]}
    threshold = min(threshold, max(best.values()))
    content = {x for x, r in best.items() if r >= threshold}
    return " ".join(text for (text, _), region in zip(lines, regions) if region in content)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
