"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams a page as events. Block elements cut it into lines; each line
has the number of its characters, of its characters inside links and of the tags met in it. The
ratio of plain text to tags per line is smoothed with a Gaussian over neighbouring lines, two
clusters are fitted to the smoothed ratios, and the regions (lines of the same container; outside
articles, runs of them) that lie above the threshold between the clusters are the content. Elements
that are never content (menus, forms, scripts ...) are left out while streaming. Being in an article
is a prior: it raises the level of plain text, and decides nothing alone. Containers marked as
furniture by class, id or role are held back, but come in where the text would be in them alone.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0  # of the Gaussian, in lines
PRIOR = 2.0  # the level of plain text in an article counts so many times
LINKED = 0.9  # lines with this share of link characters are links

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never article text.
DROPPED = frozenset("script style noscript template nav footer aside form button select textarea option label fieldset menu iframe object svg canvas audio video map dialog head title".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = frozenset("article main section div body td header table ul ol dl blockquote".split())
#: Elements that are never furniture.
KEPT = frozenset("html body article main".split())
#: Parts of a list or table: in articles they stay in the container of the list or table around them.
INNER = frozenset("ul ol dl table td".split())
#: Words of class, id and role values that mark furniture.
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer masthead comment comments reply replies disqus respond share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar complementary contentinfo".split())
#: Words that may stand beside them in a name and say nothing themselves.
COMPANIONS = frozenset("section sections list lists area box boxes bar slot slots user users site page post posts article articles content contents thread threads wrapper wrap container block blocks panel item items holder unit region zone group inner outer top bottom left right main global sticky fixed mobile desktop js id the of links link buttons button icons icon form title heading header body count".split())
#: What an open element is closed by: a new p, li ... ends an open one.
CLOSED_BY = {
    "p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body", *BLOCKS]),
}
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")  # fooBar is two words


class _Events(HTMLParser):
    """Cuts a page into lines: (text, link characters, tags, container, inside an article, marked containers around it)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int, str]] = []  # tag, never content, marked, number and tag of the container around it
        self.hidden = self.marks = self.links = self.articles = self.containers = self.tags = self.linked = 0
        self.container, self.kind = 0, ""
        self.parts: list[str] = []
        self.lines: list[tuple[str, int, int, int, bool, int]] = []
        self.mains = 0
        self.depth_of_main: int | None = None  # fewest marked containers around an article or main element with text

    def cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.linked, self.tags, self.container, self.articles > 0, self.marks))
            if self.articles or self.mains:
                self.depth_of_main = self.marks if self.depth_of_main is None else min(self.depth_of_main, self.marks)
        self.parts, self.linked, self.tags = [], 0, 0

    def handle_starttag(self, tag, attrs):
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()) and (self.open[-1][0] != "p" or tag != "body"):
            self.shut()
        if tag in ("p", "li", "dd", "dt", "tr", "td", "th") or tag in BLOCKS:
            # a block ends an open p even when inline elements are still open in it
            for at in range(len(self.open) - 1, -1, -1):
                name = self.open[at][0]
                if name == "p":
                    while len(self.open) > at:
                        self.shut()
                    break
                if name in BLOCKS or name in DROPPED:
                    break
            self.cut()
        elif tag in ("br", "hr"):
            self.parts.append("\n")
        if not self.hidden:
            self.tags += 1
        if tag in VOID:
            return
        shown = dict(attrs)
        hidden = tag in DROPPED or (tag == "header" and not self.articles) or (tag not in KEPT and ("hidden" in shown or shown.get("aria-hidden") == "true"))
        marked = not hidden and not self.hidden and self.marked(tag, attrs)
        if marked and tag not in BLOCKS:
            self.cut()
        self.open.append((tag, hidden, marked, self.container, self.kind))
        self.hidden += hidden
        self.marks += marked
        self.mains += tag == "main"
        self.links += tag == "a"
        self.articles += tag == "article"
        if tag in CONTAINERS and not (self.articles and tag in INNER and self.kind in INNER):
            self.containers += 1
            self.container, self.kind = self.containers, tag

    @staticmethod
    def marked(tag, attrs) -> bool:
        """Whether a class, id or role names furniture: a name of words for it and of words that say nothing.

        ad, ad-slot, comments-section and relatedPosts do; has-sidebar, with-comments, ad-free, social-policy
        and search-results have a word that says something else.
        """
        if tag in KEPT:
            return False
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                for name in value.split():
                    words = set(_WORD.findall(_HUMP.sub(" ", name).lower()))
                    if words & FURNITURE and words <= FURNITURE | COMPANIONS:
                        return True
        return False

    def shut(self) -> None:
        tag, hidden, marked, container, kind = self.open[-1]
        if tag in BLOCKS or hidden or marked:
            self.cut()
        self.open.pop()
        self.hidden -= hidden
        self.marks -= marked
        self.mains -= tag == "main"
        self.links -= tag == "a"
        self.articles -= tag == "article"
        self.container, self.kind = container, kind

    def handle_endtag(self, tag):
        if not self.hidden:
            self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                while len(self.open) > at:
                    self.shut()
                return
            if self.open[at][0] in ("article", "body", "td", "table") and tag not in BLOCKS and tag not in DROPPED:
                return  # a stray inline end tag does not close a region

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def lines_of(html: str) -> tuple[list[tuple[str, int, int, int, bool, int]], int | None]:
    """The lines of a page and the fewest marked containers around an article or main element with text."""
    parser = _Events()
    parser.feed(html)
    parser.close()
    parser.cut()
    return parser.lines, parser.depth_of_main


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with weights renormalised at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[reach : reach + len(values)]
    return full / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """Middle between the two clusters of the values (two means in one dimension); the least value if they don't part."""
    low, high = float(values.min()), float(values.max())
    if high <= 4 * max(low, 1.0):  # one cluster
        return low
    for _ in range(50):
        upper = values > (low + high) / 2
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def levels(lines: list, sigma: float) -> tuple[np.ndarray, float]:
    """Smoothed ratio of every line and the threshold."""
    level = smooth(np.array([max(0, len(text) - linked) / max(1, tags) for text, linked, tags, *_ in lines]), sigma)
    return level, threshold(level)


def main_text(html: str, sigma: float = SIGMA) -> str:
    """The content blocks of a page in order, joined by blank lines."""
    lines, depth = lines_of(html)
    if not lines:
        return ""
    if any(x[5] for x in lines):
        if depth is None:  # neither article nor main: as deep as the first text above the threshold
            level, least = levels(lines, sigma)
            depth = min(x[5] for x, y in zip(lines, level, strict=True) if y >= least)
        lines = [x for x in lines if x[5] <= depth]
    level, least = levels(lines, sigma)
    plain = np.array([max(0, len(text) - linked) / len(text) for text, linked, *_ in lines])
    inside = np.array([x[4] for x in lines])
    level = np.where(inside, level * (1 + (PRIOR - 1) * plain), level)
    regions: list[list[int]] = []
    of: dict[int, list[int]] = {}  # region of a container in an article
    for i, x in enumerate(lines):
        last = of.get(x[3]) if x[4] else regions[-1] if regions and lines[regions[-1][-1]][3] == x[3] else None
        if last is not None:
            last.append(i)
        else:
            regions.append([i])
            if x[4]:
                of[x[3]] = regions[-1]
    kept = []
    for r in regions:
        if level[r].max() < least:
            continue
        linked = [lines[i][1] >= LINKED * len(lines[i][0]) for i in r]
        for at, i in enumerate(r):
            # in an article a link of its own (a title, a source) is text, links in a row are a list
            row = linked[at] and (not lines[i][4] or (at > 0 and linked[at - 1]) or (at + 1 < len(r) and linked[at + 1]))
            if len(r) == 1 or not row:
                kept.append(i)
    return "\n\n".join(lines[i][0] for i in sorted(kept))


def extract(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page row.

    A null or empty page, and one without text, gives the empty text. Repeated rows give repeated
    results; other columns are not carried.
    """

    def run(batches):
        for pdf in batches:
            pdf["text"] = [main_text(h, sigma) if isinstance(h, str) else "" for h in pdf["html"]]
            yield pdf[["page_id", "url", "text"]]

    kept = pages.select("page_id", "url", "html")
    schema = f"page_id {kept.schema['page_id'].dataType.simpleString()}, url string, text string"
    return kept.mapInPandas(run, schema).withColumn("n_chars", F.length("text").cast("long"))
