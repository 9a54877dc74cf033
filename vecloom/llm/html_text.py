"""Main text of web pages by the distribution of text over lines.

Markup is stripped, and block elements become lines. A line's text counts, but not
that of links, menus, adverts, forms and the like; those count as blank lines.
The lengths of ``WINDOW`` lines from each line on are added up. A surge is a line
from which that sum passes the threshold; a dive is where it falls to nothing.
The lines between are the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.registry import query
from vecloom.plans.catalog import table

WINDOW = 3
# A run of lines is text if its densest window has this share of the page's densest one, where
# a line inside a marked article weighs so many times its length.
SURGE = 1 / 5
BONUS = 5

# Element names and words in class names, ids and roles.
RAW = "script style noscript template svg math iframe object head title textarea select button canvas audio video".split()
CONTAINERS = set(
    "html body div section article main aside nav header footer form fieldset ul ol dl table thead tbody tfoot tr td th "
    "blockquote figure details dialog menu address center".split()
)
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd pre br hr caption figcaption summary legend option".split())
VOID = set("br hr img input meta link area base col embed source track wbr".split())
BOILERPLATE = set("nav aside footer form menu dialog fieldset".split())
ALWAYS = (
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion nav navbar navigation "
    "menu menus breadcrumb breadcrumbs sidebar widget widgets footer cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup share sharing social related recommend recommended recommendations comment comments "
    "reply replies disqus respond pagination pager skip login search toolbar contentinfo complementary"
)
OUTSIDE_ARTICLES = "header masthead topbar head"
_words = lambda names: re.compile(r"(?:^|[\s_-])(?:%s)(?:$|[\s_-])" % "|".join(names.split()), re.I)
HINT, WEAK_HINT = _words(ALWAYS), _words(OUTSIDE_ARTICLES)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?:[\s=/]|$)|display\s*:\s*none""", re.I)
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)(?:>|(?=<)|\Z)",
    re.S,
)
RAW_END = {name: re.compile(rf"</{name}\b[^>]*+>", re.I) for name in RAW}


def _boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    if name in BOILERPLATE or (name == "header" and not in_article):
        return True
    if not attributes:
        return False
    if HIDDEN.search(attributes):
        return True
    for found in NAMES.findall(attributes):
        value = "".join(found)
        if HINT.search(value) or (not in_article and WEAK_HINT.search(value)):
            return name not in ("html", "body", "article", "main")
    return False


class _Lines:
    def __init__(self) -> None:
        self.text: list[str] = []
        self.weight: list[int] = []
        # Number of the outermost article a line stands in, 0 for none.
        self.article: list[int] = []
        self._parts: list[str] = []
        self._linked = 0

    def add(self, text: str, linked: bool) -> None:
        self._parts.append(text)
        if linked:
            self._linked += len(text.strip())

    def end(self, article: int, listed: bool) -> None:
        if self._parts:
            line = " ".join(html.unescape("".join(self._parts)).split())
            if line:
                mostly_links = self._linked * 3 > 2 * len(line) and (listed or not article)
                self.text.append(line)
                self.weight.append(0 if mostly_links else len(line))
                self.article.append(article)
            self._parts, self._linked = [], 0

    def gap(self) -> None:
        self.text += [""] * WINDOW
        self.weight += [0] * WINDOW
        self.article += [0] * WINDOW


def lines(page: str) -> _Lines:
    out = _Lines()
    stack: list[tuple[str, bool, bool]] = []  # name, boilerplate, article
    at, links, skipped = 0, 0, 0
    articles, met = 0, 0  # how many are around, and the number of the outermost one
    while True:
        tag = MARKUP.search(page, at)
        if not skipped:
            out.add(page[at : tag.start() if tag else len(page)], links > 0)
        if not tag:
            break
        at = tag.end()
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if name in BLOCKS:
            out.end(met if articles else 0, any(x[0] in ("ul", "ol", "dl") for x in stack[-3:]))
        if closing:
            if name == "a":
                links = max(links - 1, 0)
            elif any(x[0] == name for x in stack):
                while True:
                    top, boilerplate, article = stack.pop()
                    skipped -= boilerplate
                    articles -= article
                    if (boilerplate and not skipped) or (article and not articles):
                        out.gap()
                    if top == name:
                        break
        elif name in RAW_END:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
        elif name == "a":
            links = 1
        elif name not in VOID and not attributes.endswith("/"):
            boilerplate = _boilerplate(name, attributes, articles > 0)
            if name in CONTAINERS or (boilerplate and name in ("span", "p", "section")):
                article = name in ("article", "main") and not skipped
                if (boilerplate and not skipped) or (article and not articles):
                    out.end(met if articles else 0, False)
                    out.gap()
                stack.append((name, boilerplate, article))
                skipped += boilerplate
                met += article and not articles
                articles += article
                if name in CONTAINERS:
                    links = 0
    out.end(met if articles else 0, False)
    return out


def main_text(page: str | None) -> str:
    """The article of a page; a null, empty or textless page has none.

    Windows of lines slide over the page. A text surges where their sums leave nothing and
    dives where they fall back to it; boilerplate and the borders of marked articles leave a
    gap, which parts texts, but not the parts of one article. A run counts by its densest window, measured against
    the densest of the page; of runs alike all stay, in the order of the page.
    """
    if not page:
        return ""
    found = lines(page)
    weight, article = np.array(found.weight, np.int64), np.array(found.article, np.int64)
    if not weight.any():
        return ""
    sums = np.convolve(np.where(article > 0, BONUS * weight, weight), np.ones(WINDOW, np.int64))[WINDOW - 1 :]
    live = np.concatenate([[0], sums > 0, [0]])
    surges, dives = np.flatnonzero(np.diff(live) == 1), np.flatnonzero(np.diff(live) == -1)
    peaks, runs = np.zeros(article.max() + 1), []
    for a, b in zip(surges, dives):
        own = np.unique(article[a:b][weight[a:b] > 0])
        peak = float(sums[a:b].max())
        runs.append((a, b, peak, own[own > 0]))
        peaks[own] = np.maximum(peaks[own], peak)
    peaks[0] = 0
    least = SURGE * float(sums.max())
    kept = [i for a, b, peak, own in runs if max(peak, peaks[own].max(initial=0)) >= least for i in range(a, b) if weight[i]]
    return " ".join(found.text[i] for i in kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; repeated rows give repeated results."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame.assign(html=[main_text(page) for page in frame["html"]])

    kinds = dict(pages.dtypes)
    found = pages.select("page_id", "url", "html").mapInPandas(read, f"page_id {kinds['page_id']}, url {kinds['url']}, html string")
    return found.select("page_id", "url", F.col("html").alias("text"), F.length("html").cast("bigint").alias("n_chars"))


@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
