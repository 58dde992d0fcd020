"""Main text of web pages from streaming parser events.

The standard library's parser sends start tags, end tags and text; the page is never held
as a tree.  Block-level tags end a line; every line knows its text, the number of tags it
took and the element that holds it.  The text-to-tag ratios of a page's lines are smoothed
with a Gaussian; the lines above a threshold are the content clusters, and they alone
choose the content region: it holds nearly all clustered text, as the page's ``article``
elements together, else its ``main``, where they do, or else as the innermost element that
does.  A page without a cluster has no text.  The region's lines are the result, short ones
too; outside of articles a run of link lines is a menu.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, mark-up and
reader comments are known by their element, role or class and send no lines.  A mark of
layout in a class ends at an ``article`` or ``main`` inside, and a mark is not believed
where its element holds most of the page's text.

A null or empty page gives an empty text.  Unclosed, stray and broken tags are put up with:
what the parser can't read is a comment.  Work grows with the page's length, whatever its
depth.  Character references are decoded; white space inside a line becomes one blank.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup "
    "option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never content.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input label map menu nav noscript object option "
    "script select style svg template textarea title video".split()
)
#: A start tag (key) ends an open element named in the value, up to the nearest of SCOPE.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
} | {t: {"p"} for t in BLOCK - {"li", "dt", "dd", "tr", "td", "th", "option", "body"}}
SCOPE = frozenset("article aside body div dl footer form header html main nav ol section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Marks in class or id, as whole words between blanks, "-" and "_".
MARKS = re.compile(
    r"ads?|adsense|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|breadcrumbs?|"
    r"comments?|replies|reply|respond|disqus|newsletter|subscribe|subscription|signup|login|popup|modal|"
    r"toolbar|pagination|pager|hidden",
    re.I,
)
#: Marks that may also name a place in a layout that holds content.
LAYOUT = re.compile(r"banner|sidebars?|menus?|nav|navbar|navigation|footer|header|masthead|topbar", re.I)
COMMENTS = re.compile(r"comments?|replies|reply|respond|disqus", re.I)
#: Beside these a mark of layout says nothing, and an element whose class is one is marked by whole classes only.
CONTENT = re.compile(r"articles?|body|content|entry|hentry|layout|main|page|post|story|text|wrap|wrapper|container", re.I)
BEFORE = frozenset("has have no not with without".split())
#: Containers that hold content whatever their marks say.
KEPT = frozenset(("html", "body", "article", "main"))
#: Elements that are no region by themselves.
INLINE = frozenset("a b em i p span strong".split())
WHITE = re.compile(r"\s+")


def mark_of(names: str) -> str | None:
    """What a class or id says of its element: ``comments``, ``noise``, ``layout`` or nothing."""
    words = [w for w in names.split() if w]
    content, found = any(map(CONTENT.fullmatch, words)), set()
    for word in words:
        parts = [p for p in re.split("[_-]", word) if p]
        beside = content or any(map(CONTENT.fullmatch, parts))
        for before, part in zip([word, *parts], parts):
            if before in BEFORE and before != word or content and len(parts) > 1:
                continue
            if MARKS.fullmatch(part):
                found.add("comments" if COMMENTS.fullmatch(part) else "noise")
            elif LAYOUT.fullmatch(part) and not beside:
                found.add("layout")
    return next((kind for kind in ("comments", "noise", "layout") if kind in found), None)


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters that stand in links
    holder: int  # number of the innermost open element, 0 outside of all


class LineCollector(HTMLParser):
    """Turns events into lines.  Elements are numbered from 1 as they open; ``above`` holds each one's parent.

    ``kept``: numbers of elements whose marks are not believed.
    """

    def __init__(self, kept: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.kept, self.kinds = kept, {}
        self.left_out: Counter[int] = Counter()  # characters that marks drop, by innermost element
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, int]] = []  # name, number, the marked element that drops its text; -1: dropped for good
        self.standing: Counter[str] = Counter()  # names of open elements
        self.names, self.above = [""], [0]
        self.tags = self.linked = 0
        self.text: list[str] = []
        self.comments_end = True  # a comment that opens may still be closed

    def parse_comment(self, i: int, report: bool = True) -> int:
        """The end of a comment is looked for once: where one isn't closed, none behind it is."""
        if not self.comments_end:
            return -1
        found = super().parse_comment(i, report)
        self.comments_end = found >= 0
        return found

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """What begins like a marked section is a comment up to the next ``>``."""
        end = self.rawdata.find(">", i)
        return len(self.rawdata) if end < 0 else end + 1

    def flush(self) -> None:
        if self.text:
            text = WHITE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append(Line(text, self.tags, self.linked, self.open[-1][1] if self.open else 0))
                self.tags = 0
            self.text, self.linked = [], 0

    def _noise(self, tag: str, number: int, attrs: list) -> int:
        """0, -1 or the new element's number, as in ``open``."""
        if tag in DROPPED:
            return -1
        if tag == "header":
            return 0 if self.standing["article"] else -1
        given = {k: v or "" for k, v in attrs}
        if "hidden" in given or given.get("aria-hidden") == "true" or given.get("role", "").lower() in ROLES:
            return 0 if tag in ("html", "body") else -1
        marks = f"{given.get('class', '')} {given.get('id', '')}"
        if len(marks) == 1 or number in self.kept:
            return 0
        kind = mark_of(marks)
        # reader comments are often articles
        if kind is None or tag in KEPT and not (tag == "article" and kind == "comments"):
            return 0
        self.kinds[number] = kind
        return number

    def _dropping(self) -> int:
        return self.open[-1][2] if self.open else 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        ended = ENDS.get(tag, ())
        if any(self.standing[name] for name in ended):
            for k in range(len(self.open) - 1, -1, -1):
                name = self.open[k][0]
                if name in ended:
                    self._close(k)
                    break
                if name in SCOPE:
                    break
        number, dropping = len(self.names), self._dropping()
        if tag in ("article", "main") and self.kinds.get(dropping) == "layout":
            dropping = 0
        own = self._noise(tag, number, attrs) if dropping >= 0 else 0
        self.names.append(tag)
        self.above.append(self.open[-1][1] if self.open else 0)
        self.standing[tag] += 1
        self.open.append((tag, number, -1 if own < 0 else dropping or own))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # HTML takes no notice of the slash
        if tag in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if not self.standing[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                break
            if self.open[k][0] in ("td", "th", "table") and tag not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot") and tag not in SCOPE:
                break

    def _close(self, k: int) -> None:
        for name, _, _ in self.open[k:]:
            self.standing[name] -= 1
        del self.open[k:]

    def handle_data(self, data: str) -> None:
        by = self._dropping()
        if by > 0:
            self.left_out[self.open[-1][1]] += len(data.strip())
        if not by:
            self.text.append(data)
            if self.standing["a"]:
                self.linked += len(data.strip())


def smoothed_ratios(lines: list[Line], sigma: float = 1.5) -> np.ndarray:
    """Characters for each tag of every line, smoothed over the neighbouring lines."""
    ratios = np.array([len(line.text) / max(1, line.tags) for line in lines], float)
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.convolve(np.pad(ratios, reach), kernel / kernel.sum(), "same")
    return padded[reach : reach + len(ratios)]


def clusters(lines: list[Line]) -> np.ndarray:
    """Which lines belong to a content cluster: those whose smoothed ratio is above the page's threshold."""
    smooth = smoothed_ratios(lines)
    return (smooth > 0) & (smooth >= min(smooth.std(), 0.5 * smooth.mean()))


def content_lines(page: LineCollector, cover: float = 0.9) -> list[str]:
    """The lines of the content region."""
    lines, names, above = page.lines, page.names, page.above
    if not lines:
        return []
    linked = [line.linked > 0.6 * len(line.text) for line in lines]
    inside = clusters(lines)
    weights = [len(line.text) * bool(c and not in_links) for line, c, in_links in zip(lines, inside, linked, strict=True)]
    if not any(weights):  # nothing but links
        weights = [len(line.text) * bool(c) for line, c in zip(lines, inside, strict=True)]
    total = sum(weights)
    if not total:
        return []
    held = [0] * len(names)  # clustered text of every element; a parent's number is smaller than its children's
    for line, weight in zip(lines, weights, strict=True):
        held[line.holder] += weight
    for n in range(len(names) - 1, 0, -1):
        held[above[n]] += held[n]

    def within(chosen: set[int]) -> list[bool]:
        found = [0 in chosen]
        for n in range(1, len(names)):
            found.append(n in chosen or found[above[n]])
        return found

    for kind in ("article", "main"):  # several make up a page together
        part = within({n for n in range(1, len(names)) if names[n] == kind})
        if sum(w for line, w in zip(lines, weights, strict=True) if part[line.holder]) >= cover * total:
            return [line.text for line in lines if part[line.holder]]
    region = max((n for n in range(1, len(names)) if held[n] >= cover * total and names[n] not in INLINE), default=0)
    part = within({region})
    own = [(line.text, w, a) for line, w, a in zip(lines, weights, linked, strict=True) if part[line.holder]]
    links = [False, *(a for _, _, a in own), False]
    return [text for k, (text, w, a) in enumerate(own) if w or not a or not (links[k] or links[k + 2])]  # two in a row: a menu


def collect(html: str, kept: frozenset[int]) -> LineCollector:
    """Lines of a page, given at once.  Behind the last ``>`` no tag or comment can end, so what stands there is text, up to a marked section."""
    page, last = LineCollector(kept), html.rfind(">") + 1
    page.feed(html[:last])
    page.close()
    if not page.cdata_elem:  # a script or style that isn't closed takes the rest
        page.handle_data(unescape(html[last:].partition("<![")[0]))
    page.flush()
    return page


def main_text(html: str | None) -> str:
    """The main text of one page, lines joined by a line feed."""
    if not html:
        return ""
    kept: frozenset[int] = frozenset()
    while True:
        page = collect(html, kept)
        # a marked element with most of the text (nearly all, beside an article) is no notice or side column; comments may be long
        own = sum(len(line.text) for line in page.lines)
        every = own + page.left_out.total()
        found = [False]
        for name, up in zip(page.names[1:], page.above[1:], strict=True):
            found.append(name in ("article", "main") or found[up])
        share = 0.9 if any(found[line.holder] for line in page.lines) else 0.5
        size = [page.left_out[n] for n in range(len(page.names))]
        for n in range(len(size) - 1, 0, -1):
            size[page.above[n]] += size[n]
        large = {n for n, kind in page.kinds.items() if size[n] > share * every and (kind != "comments" or not own)}
        if not large:
            return "\n".join(content_lines(page))
        kept |= large


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``; repeated rows stay, null keys too."""

    @F.pandas_udf("string")
    def extract(html: pd.Series) -> pd.Series:
        return html.map(lambda h: main_text(h if isinstance(h, str) else None)).astype(object)

    return pages.select("page_id", "url", extract(F.col("html").cast("string")).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
