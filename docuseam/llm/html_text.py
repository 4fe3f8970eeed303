"""Main text of web pages: text-to-tag ratio per line, smoothed and clustered.

The page is fed to the standard library's streaming parser in pieces. Block
elements and line breaks start a new line; each line keeps its text, the number
of its tags, the number of its characters inside links, and its container. The
text-to-tag ratios of all lines, weighted down where tags or names speak for
boilerplate, are smoothed with a Gaussian and split in two clusters by a
threshold; the high cluster marks the content.

The marked text chooses the region: the articles, or the main element, that hold
most of it, and what stands around them as content does; else the innermost
container outside which there is nothing but boilerplate, links and scraps. All
lines of the region are returned, so that short paragraphs are not lost, but for
those in boilerplate elements. Names alone decide less: a container that holds
half of the page's text, and a heading or an article, is never boilerplate by
its name, and a name that is only a hint drops those lines that are not marked.
Inside an article or main element a name needs company: see ``_name_in_article``.
A line break ends a block, as the start and end of a block element do.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_name, other_columns

_BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style template noscript head title iframe object svg canvas audio video map select textarea button datalist".split())
_BOILER = frozenset("nav footer aside form menu dialog".split())
_CONTAINERS = frozenset("article main section div body table td form nav footer header aside blockquote ul ol dl menu dialog fieldset details figure".split())
_NAME = r"(?:^|[\s_-])(?:{})(?:$|[\s_-])"
#: Names of boilerplate, and names that are only a hint.
_STRONG = re.compile(_NAME.format(r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|nav\w*|menu\w*|sidebar\w*|footer|masthead|breadcrumbs?|cookies?|consent|popup|newsletter|subscribe\w*|signup|login|share|sharing|social|comments?|commentlist|disqus|respond|replies|pager|pagination|gdpr"), re.I)
_WEAK = re.compile(_NAME.format(r"banner|side|header|notice|notices|modal|overlay|related|recommend\w*|widget\w*|toolbar|skip|copyright|legal|disclaimer|alert"), re.I)
#: Parts of names that say what a container looks like, not what it is about.
_GENERIC = re.compile(r"list|box|wrap|wrapper|section|area|container|items?|block|bar|top|bottom|main|left|right|inner|outer|content|form|links?|icons?|buttons?|btn|readers?|users?|site|page|global|primary|secondary|widgets?|post|article|entry|module|panel|group|row|col|column|slot|unit|banner|header|thread|recent|\d*|[a-z]", re.I)
_COMMENT = re.compile(r"comments?|commentlist|disqus|respond|repl(?:y|ies)|responses?", re.I)
_PARTS = re.compile(r"[-_]|(?<=[a-z])(?=[A-Z])")
_HEADINGS = frozenset("h1 h2 h3".split())
#: In an article, characters of a line of prose without its links, the most of prose that is in links, and the least that is in such lines.
_PROSE, _LINKED, _LONG = 80, 0.25, 0.5
#: Weights of ratios without a sign of boilerplate, with a hint, and in boilerplate.
_WEIGHTS = np.array([1.0, 0.6, 0.1])
#: Lines under so many characters that are neither marked nor headings count as scraps.
_SCRAP = 60
_BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SPACE = re.compile(r"\s+")
_PIECE = 1 << 16


class _Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters inside links
    at: int  # container
    heading: bool


class _Lines(HTMLParser):
    """Collects lines and the tree of containers from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, container, hidden
        self.parents, self.kinds = [-1], [""]
        self.by_tag, self.by_name = [0], [0]  # how much a container's own tag and names speak for boilerplate
        self.named: list[tuple[bool, bool, bool]] = [(False, False, False)]  # see _whole_names
        self.lines: list[_Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def _state(self) -> tuple[int, bool]:
        return self.open[-1][1:] if self.open else (0, False)

    def _end_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append(_Line(text, self.tags, min(self.linked, len(text)), self._state()[0], any(x[0] in _HEADINGS for x in self.open)))
                self.tags = self.linked = 0
            self.parts.clear()

    def _signs(self, tag: str, named: dict) -> tuple[int, int]:
        if tag in ("html", "body", "main", "article"):
            return 0, 0
        names = [named.get(k) or "" for k in ("class", "id")]
        by_name = 2 if any(map(_STRONG.search, names)) else 1 if any(map(_WEAK.search, names)) else 0
        outside = tag == "header" and not any(x[0] == "article" for x in self.open)
        return 2 if tag in _BOILER or outside or (named.get("role") or "").lower() in _BOILER_ROLE else 0, by_name

    @staticmethod
    def _whole_names(named: dict) -> tuple[bool, bool, bool]:
        """Whether a class, and whether an id, says nothing but boilerplate; whether a name says nothing but comments."""

        def whole(name: str, kind) -> bool:
            parts = [x for x in _PARTS.split(name) if x]
            hit = [bool(kind(x)) for x in parts]
            return any(hit) and all(h or _GENERIC.fullmatch(x) for h, x in zip(hit, parts, strict=True))

        classes, ids = ((named.get(k) or "").split() for k in ("class", "id"))
        return any(whole(x, _STRONG.fullmatch) for x in classes), any(whole(x, _STRONG.fullmatch) for x in ids), any(whole(x, _COMMENT.fullmatch) for x in classes + ids)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in _BLOCKS:
            self._end_line()
            for old in _CLOSES.get(tag, ()):
                if self.open and self.open[-1][0] == old:
                    self.open.pop()
                    break
        if tag in _VOID:
            return
        if tag == "a":
            self.links += 1
        at, hidden = self._state()
        named = dict(attrs)
        by_tag, by_name = self._signs(tag, named)
        hidden = hidden or tag in _HIDDEN or "hidden" in named or (named.get("aria-hidden") or "").lower() == "true" or bool(re.search(r"display\s*:\s*none", named.get("style") or "", re.I))
        if tag in _CONTAINERS or by_tag or by_name:
            self.parents.append(at)
            self.kinds.append(tag)
            self.by_tag.append(by_tag)
            self.by_name.append(by_name)
            self.named.append(self._whole_names(named) if by_name else (False, False, False))
            at = len(self.parents) - 1
        self.open.append((tag, at, hidden))

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in _BLOCKS:
            self._end_line()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in _BLOCKS:
            self._end_line()
        if tag == "a":
            self.links = max(0, self.links - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                # an inline end tag does not close blocks around it
                if tag not in _BLOCKS and any(x[0] in _CONTAINERS for x in self.open[i + 1 :]):
                    break
                del self.open[i:]
                break

    def handle_data(self, data):
        if not self._state()[1]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def text_to_tag_ratio(lines) -> np.ndarray:
    return np.array([(len(x.text) - 0.9 * x.linked) / max(1, x.tags) for x in lines], float)


def gaussian_smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    around = np.convolve(np.ones(len(x)), kernel)[r : r + len(x)]
    return np.convolve(x, kernel)[r : r + len(x)] / around


def split_threshold(x: np.ndarray, steps: int = 20) -> float:
    """Threshold between two clusters: halfway between their means, repeated until it stays."""
    cut = float(x.mean())
    for _ in range(steps):
        low, high = x[x <= cut], x[x > cut]
        if not len(low) or not len(high):
            break
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def _sums(page: _Lines, own: np.ndarray) -> np.ndarray:
    """Totals of every container with all inside it; parents come before their children."""
    for i in range(len(own) - 1, 0, -1):
        own[page.parents[i]] += own[i]
    return own


def _by_container(page: _Lines, lines: list[_Line], values) -> np.ndarray:
    return np.bincount([x.at for x in lines], values, minlength=len(page.parents)) if lines else np.zeros(len(page.parents))


def _name_in_article(page: _Lines, marked: np.ndarray) -> np.ndarray:
    """What names say of containers inside an article or main element: 0, 1 (a hint) or 2.

    Comments need a name of nothing else, and their place behind the text or
    two containers named so in them. A class of nothing but boilerplate words
    counts. Any other name counts only where a container is not prose, or,
    for an id of boilerplate words, prose under a heading; prose has few
    links, and half of its characters in long lines. A
    container with the page's first heading is never boilerplate by a hint.
    """
    by_name, n = np.array(page.by_name), len(page.parents)
    inside = np.zeros(n, bool)
    for i in range(1, n):
        inside[i] = inside[page.parents[i]] or page.kinds[page.parents[i]] in ("article", "main")
    open_ = np.flatnonzero(inside & (by_name > 0))
    if not len(open_):
        return by_name
    size, linked = [len(x.text) for x in page.lines], [x.linked for x in page.lines]
    total = _sums(page, _by_container(page, page.lines, size))
    links = _sums(page, _by_container(page, page.lines, linked))
    long = _sums(page, _by_container(page, page.lines, [len(x.text) if len(x.text) - x.linked >= _PROSE else 0 for x in page.lines]))
    titled = _sums(page, _by_container(page, page.lines, [x.heading for x in page.lines]))
    first_title = next((x.at for x in page.lines if x.heading), 0)
    talk = _sums(page, np.array([float(x[2]) for x in page.named]))
    last_line = np.full(n, -1)
    for k, x in enumerate(page.lines):
        at = x.at
        while at > 0 and last_line[at] < k:
            last_line[at] = k
            at = page.parents[at]
    in_article = [inside[x.at] or page.kinds[x.at] in ("article", "main") for x in page.lines]
    tail = max((k for k, x in enumerate(page.lines) if marked[k] and in_article[k] and not _named_comment(page, x.at)), default=-1)
    for i in open_:
        by_class, by_id, comments = page.named[i]
        prose = links[i] < _LINKED * total[i] and long[i] >= _LONG * total[i] > 0
        if comments:
            by_name[i] = 2 if talk[i] > 2 or last_line[i] > tail or not prose else 0
        elif not by_class:
            keep = prose and (titled[i] > 0 or not by_id) or by_name[i] == 1 and _within(page, first_title, i)
            by_name[i] = 0 if keep else by_name[i]
    return by_name


def _named_comment(page: _Lines, at: int) -> bool:
    while at > 0:
        if page.named[at][2] or page.by_tag[at]:
            return True
        at = page.parents[at]
    return False


def _within(page: _Lines, at: int, outer: int) -> bool:
    while at > 0 and at != outer:
        at = page.parents[at]
    return at == outer


def _levels(page: _Lines, by_name: np.ndarray) -> np.ndarray:
    """How much speaks for boilerplate in each container, from itself and all around it: 0, 1 (a hint) or 2."""
    tagged = np.array(page.by_tag)
    for i in range(1, len(tagged)):
        tagged[i] = max(tagged[i], tagged[page.parents[i]])
    size = [0 if tagged[x.at] else len(x.text) for x in page.lines]
    holds = _sums(page, _by_container(page, page.lines, size))
    titled = _sums(page, _by_container(page, page.lines, [x.heading for x in page.lines]) + np.array([k in ("article", "main") for k in page.kinds]))
    spared = (2 * holds >= max(1, holds[0])) & (titled > 0)
    level = np.where(spared, page.by_tag, np.maximum(page.by_tag, by_name))
    for i in range(1, len(level)):
        level[i] = max(level[i], level[page.parents[i]])
    return level


def _region(page: _Lines, level: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Whether each container belongs to the content."""
    n = len(page.parents)
    weight = _sums(page, _by_container(page, page.lines, [len(x.text) if hit and level[x.at] < 2 else 0 for x, hit in zip(page.lines, marked, strict=True)]))
    plain = [level[x.at] == 0 for x in page.lines]
    scrap = [not p or 2 * x.linked > len(x.text) or not hit and not x.heading and len(x.text) < _SCRAP for x, p, hit in zip(page.lines, plain, marked, strict=True)]
    content = _sums(page, _by_container(page, page.lines, [not s for s in scrap]))
    links = _sums(page, _by_container(page, page.lines, [p and 2 * x.linked > len(x.text) for x, p in zip(page.lines, plain, strict=True)]))

    roots: list[int] = []
    for kind in ("article", "main"):
        outer = [i for i in range(1, n) if page.kinds[i] == kind and level[i] < 2 and not _inside(page, page.parents[i], kind)]
        if 2 * sum(weight[i] for i in outer) >= weight[0] > 0:
            roots = outer
            break
    if roots:
        at = roots[0]
        while len(roots) == 1 and page.kinds[page.parents[at]] in ("main", "article", "div", "section"):
            up = page.parents[at]  # what stands around it as content: text or headings, but no lists of links
            if level[up] or content[up] <= content[at] or links[up] > links[at]:
                break
            roots = [at := up]
    else:
        at, kids = 0, [[] for _ in range(n)]
        for i in range(1, n):
            kids[page.parents[i]].append(i)
        while inner := [i for i in kids[at] if content[i] == content[at] > 0]:  # nothing but scraps is left out
            at = inner[0]
        roots = [at]
    inside = np.zeros(n, bool)
    for i in range(n):
        inside[i] = i in roots or i > 0 and inside[page.parents[i]]
    return inside


def _inside(page: _Lines, at: int, kind: str) -> bool:
    while at > 0:
        if page.kinds[at] == kind:
            return True
        at = page.parents[at]
    return False


def _marks(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Lines of the high cluster of smoothed ratios."""
    smooth = gaussian_smooth(ratio, sigma)
    return smooth >= min(split_threshold(smooth), float(smooth.max())) - 1e-9


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Blocks of the main text joined by line feeds; empty for null, empty or textless pages.

    Unclosed elements end where the next of their kind or an outer one ends, and
    cells of a table are blocks of their own.
    """
    if not html:
        return ""
    page = _Lines()
    for i in range(0, len(html), _PIECE):
        page.feed(html[i : i + _PIECE])
    page.close()
    page._end_line()
    if not page.lines:
        return ""
    ratio = text_to_tag_ratio(page.lines)
    level = _levels(page, _name_in_article(page, _marks(ratio, sigma)))
    marked = _marks(ratio * _WEIGHTS[level[[x.at for x in page.lines]]], sigma)
    inside = _region(page, level, marked)
    return "\n".join(x.text for x, hit in zip(page.lines, marked, strict=True) if inside[x.at] and (level[x.at] == 0 or level[x.at] == 1 and hit))


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Replace the html column by ``out``, the main text; all other columns and rows stay.

    An input column named like ``out``, in whatever case, is replaced. Null and
    empty pages give an empty text.
    """
    bounded_batches(pages.sparkSession)
    others = other_columns(pages, html, out)

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(len(others))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(texts, pa.string())], [*others, out])

    schema = pages.select(*others).schema.add(out, "string")
    return pages.select(*others, F.col(html).alias(fresh_name(pages.select(*others), "html"))).mapInArrow(run, schema)


def html_report(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    return extract_main_text(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
