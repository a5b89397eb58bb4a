"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks. A block's features are its word count and link density, those of the block before and
after it, and where it stands (in an article, in a part that is named as boilerplate, heading). A small decision tree, grown
on the labelled TABLE below, says which blocks are main text.

Null pages count as empty and have no text. Tags that never close, stray ends and cut-off references are tolerated. Extra columns pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+)>", re.S)
#: A tag whatever its quotes: for pages that have one whose quotes leave it open to the end.
LOOSE_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S)
UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = frozenset("script style noscript template head title textarea svg iframe object select button canvas".split())
RAW = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog".split())
BOILER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|notice\w*|gdpr|popup|modal|newsletter|subscribe|signup|login|"
    r"nav\w*|menu\w*|breadcrumb\w*|pagination|pager|sidebar|aside|widget\w*|related|recommend\w*|share|sharing|social|header|masthead|footer|"
    r"copyright|comment|comments|comment-list|disqus|replies|search|toolbar|tags|complementary|navigation|contentinfo)(?:$|[\s_-])",
    re.I,
)
MAIN_TAGS = frozenset("article main".split())
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content|body)(?:$|[\s_-])", re.I)
# Elements whose start ends an open one of the second kind, unless one of the third kind stands between; and what may stand in a head.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ()),
}
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
#: words, link density, the same before, the same after, in main part, in boilerplate part, heading: is it main text?
TABLE = (
    ((60, 0.0, 8, 0.0, 70, 0.0, 1, 0, 0), 1), ((70, 0.02, 60, 0.0, 55, 0.0, 1, 0, 0), 1), ((3, 0.0, 60, 0.0, 70, 0.0, 1, 0, 0), 1), ((1, 0.0, 40, 0.0, 0, 0.0, 1, 0, 0), 1),
    ((9, 0.0, 9, 0.0, 60, 0.0, 1, 0, 1), 1), ((4, 0.0, 50, 0.0, 60, 0.0, 1, 0, 1), 1), ((25, 0.3, 50, 0.0, 40, 0.0, 1, 0, 0), 1), ((6, 1.0, 30, 0.0, 30, 0.0, 1, 0, 0), 1),
    ((45, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0), 1), ((30, 0.05, 6, 0.0, 45, 0.0, 0, 0, 0), 1), ((22, 0.0, 60, 0.0, 30, 0.1, 0, 0, 0), 1), ((120, 0.1, 2, 1.0, 90, 0.0, 0, 0, 0), 1),
    ((18, 0.0, 40, 0.0, 35, 0.0, 0, 0, 0), 1), ((8, 0.0, 3, 0.0, 50, 0.0, 0, 0, 1), 1), ((7, 0.0, 45, 0.0, 40, 0.0, 0, 0, 1), 1), ((35, 0.0, 4, 0.0, 3, 0.5, 0, 0, 0), 1),
    ((1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), 0), ((2, 1.0, 1, 1.0, 2, 1.0, 0, 1, 0), 0), ((12, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0), 0), ((40, 0.0, 60, 0.0, 12, 0.0, 0, 1, 0), 0),
    ((9, 0.2, 60, 0.0, 0, 0.0, 0, 1, 0), 0), ((30, 0.0, 50, 0.0, 30, 0.0, 1, 1, 0), 0), ((15, 0.0, 40, 0.0, 20, 0.0, 1, 1, 0), 0), ((6, 0.0, 3, 1.0, 60, 0.0, 0, 1, 1), 0),
    ((60, 0.0, 50, 0.0, 50, 0.0, 1, 1, 0), 0), ((80, 0.0, 9, 0.0, 9, 0.0, 0, 1, 0), 0), ((5, 0.0, 3, 0.0, 30, 0.0, 1, 1, 1), 0), ((3, 0.0, 20, 0.0, 2, 1.0, 1, 1, 0), 0),
    ((2, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0), 0), ((5, 0.8, 60, 0.0, 5, 0.9, 0, 0, 0), 0), ((14, 0.9, 12, 0.9, 15, 0.9, 0, 0, 0), 0), ((28, 0.7, 4, 1.0, 5, 1.0, 0, 0, 0), 0),
    ((3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0), 0), ((5, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0), 0), ((4, 0.0, 1, 1.0, 6, 0.0, 0, 0, 0), 0), ((7, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), 0),
    ((2, 0.0, 2, 0.8, 2, 1.0, 0, 0, 1), 0), ((3, 1.0, 20, 0.0, 2, 1.0, 0, 0, 1), 0), ((6, 0.5, 5, 0.0, 4, 0.6, 0, 0, 0), 0), ((8, 0.1, 30, 0.0, 4, 1.0, 0, 0, 0), 0),
    ((5, 0.0, 30, 0.0, 2, 1.0, 1, 0, 0), 1), ((12, 0.0, 9, 0.0, 3, 0.0, 1, 0, 0), 1), ((33, 0.0, 22, 0.0, 0, 0.0, 1, 0, 0), 1), ((7, 0.0, 8, 0.0, 7, 0.0, 1, 0, 0), 1),
    ((2, 0.0, 5, 0.0, 4, 0.0, 1, 0, 0), 1), ((50, 0.0, 5, 0.0, 9, 0.0, 1, 0, 0), 1), ((40, 0.0, 60, 0.0, 5, 0.5, 1, 0, 0), 1), ((20, 0.0, 20, 0.0, 20, 0.0, 1, 0, 0), 1),
    ((10, 0.5, 10, 0.0, 10, 0.0, 1, 0, 0), 1), ((3, 0.0, 3, 0.0, 3, 0.0, 1, 0, 0), 1), ((90, 0.0, 90, 0.0, 10, 0.0, 1, 0, 0), 1), ((15, 0.0, 1, 1.0, 16, 0.0, 1, 0, 0), 1),
    ((6, 0.0, 6, 0.0, 12, 0.0, 1, 0, 0), 1), ((24, 0.0, 30, 0.0, 11, 0.0, 1, 0, 0), 1), ((8, 0.0, 1, 1.0, 45, 0.0, 0, 1, 0), 0), ((25, 0.0, 1, 1.0, 50, 0.0, 0, 1, 0), 0),
    ((30, 0.0, 40, 0.0, 60, 0.0, 1, 1, 0), 0), ((60, 0.0, 70, 0.0, 65, 0.0, 1, 1, 0), 0), ((50, 0.1, 40, 0.0, 45, 0.0, 0, 1, 0), 0), ((20, 0.0, 10, 0.0, 40, 0.0, 0, 1, 0), 0),
    ((2, 1.0, 2, 1.0, 30, 0.0, 0, 1, 0), 0), ((12, 0.0, 30, 0.0, 33, 0.0, 1, 1, 0), 0), ((45, 0.0, 55, 0.0, 50, 0.0, 0, 1, 0), 0), ((1, 1.0, 5, 0.0, 60, 0.0, 1, 1, 0), 0),
    ((70, 0.0, 5, 0.0, 28, 0.0, 1, 1, 0), 0), ((28, 0.0, 28, 0.0, 28, 0.0, 0, 1, 0), 0), ((10, 0.0, 10, 0.0, 10, 0.0, 1, 1, 0), 0), ((22, 0.0, 22, 0.0, 26, 0.0, 1, 1, 0), 0),
    ((3, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0), 0), ((4, 1.0, 2, 1.0, 80, 0.0, 0, 0, 0), 0), ((8, 1.0, 30, 0.0, 40, 0.0, 0, 0, 0), 0), ((30, 0.9, 60, 0.0, 60, 0.0, 0, 0, 0), 0),
    ((40, 1.0, 3, 0.0, 50, 0.0, 0, 0, 0), 0), ((25, 0.8, 9, 1.0, 9, 1.0, 1, 0, 0), 0), ((5, 1.0, 6, 1.0, 60, 0.0, 1, 0, 0), 0), ((6, 1.0, 5, 1.0, 5, 1.0, 1, 0, 0), 0),
    ((60, 0.0, 3, 1.0, 70, 0.0, 0, 0, 0), 1), ((45, 0.1, 30, 0.9, 20, 0.0, 0, 0, 0), 1), ((6, 1.0, 40, 0.0, 50, 0.0, 1, 0, 0), 1), ((90, 0.0, 40, 1.0, 40, 1.0, 0, 0, 0), 1),
    ((5, 1.0, 50, 0.0, 45, 0.0, 0, 0, 0), 0), ((4, 1.0, 9, 0.0, 60, 0.0, 0, 0, 0), 0), ((50, 0.0, 4, 1.0, 60, 0.0, 0, 0, 0), 1), ((12, 1.0, 0, 0.0, 45, 0.0, 0, 0, 0), 0),
)


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, words in links, in main part, in boilerplate part, heading) of each block, in page order."""
    found: list[tuple[str, int, int, int, int, int]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: name, hides, boilerplate, main
    opened: Counter[str] = Counter()  # their names
    inside = [0, 0, 0]  # how many of them hide, are boilerplate, are main
    parts: list[str] = []
    linked: list[str] = []
    links = heading = 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n = len(html.unescape("".join(linked)).split())
            found.append((text, len(text.split()), n, int(inside[2] > 0), int(inside[1] > 0), int(heading > 0)))
        parts, linked = [], []

    def say(text: str) -> None:
        if text and not inside[0]:
            parts.append(text)
            if links:
                linked.append(text)

    def end(at: int) -> None:
        """Close the open elements from number at on."""
        for name, *marks in stack[at:]:
            opened[name] -= 1
            for i, mark in enumerate(marks):
                inside[i] -= mark
        del stack[at:]

    def last(names: tuple[str, ...], barriers: tuple[str, ...] = ()) -> int | None:
        if not any(opened[n] for n in names):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in barriers:
                return None
        return None

    at, tag = 0, TAG
    while True:
        start = START.search(page, at)
        m = start and tag.match(page, start.start())
        if start and m is None and tag is TAG:  # from here on a tag ends at the next bracket, so that no later one is looked for to the end again
            tag = LOOSE_TAG
            m = tag.match(page, start.start())
        say(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if name not in INLINE:
            flush()
        elif name == "br":
            say(" ")
        if name == "a":
            links = 0 if closing else 1
            linked.append(" ")  # the words of two links are two words
        if re.fullmatch(r"h[1-6]", name):
            heading = 0 if closing else 1
        if closing:
            if (i := last((name,))) is not None:
                end(i)
            continue
        if stack and (stack[-1][0] == "head" and name not in HEAD_TAGS or stack[-1][0] == "p" and name not in INLINE):
            end(len(stack) - 1)
        if name in IMPLIED and (i := last(*IMPLIED[name])) is not None:
            end(i)
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        if name in RAW:
            closed = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = closed.end() if closed else len(page)
            continue
        named = " ".join(next(filter(None, a[1:]), "") for a in ATTRIBUTE.findall(m[3])) if m[3] else ""
        unseen = name in HIDDEN or bool(m[3] and UNSEEN.search(m[3]))
        flows = name in ("p", "li") or name[0] == "h" and name[1:].isdigit()  # of these, one named for the article is its text, such as a "story-header"
        about = bool(named and MAIN_NAMES.search(named))
        boiler = name in BOILER_TAGS or bool(named and name not in ("body", "html", "article", "main") and BOILER_NAMES.search(named) and not (flows and about))
        if name not in INLINE or unseen:
            element = (name, unseen, boiler, name in MAIN_TAGS or about and name not in ("p", "li"))
            stack.append(element)
            opened[name] += 1
            for i, mark in enumerate(element[1:]):
                inside[i] += mark
    flush()
    return found


def features(found: list[tuple[str, int, int, int, int, int]]) -> np.ndarray:
    own = np.array([(n, min(k / n, 1.0)) for _, n, k, *_ in found], np.float64)
    none = np.zeros((1, 2))
    place = np.array([(main, boiler, h) for *_, main, boiler, h in found], np.float64)
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), place])


Tree = tuple


def grow(x: np.ndarray, y: np.ndarray, depth: int = 5) -> Tree:
    """A decision tree by Gini impurity: (label,) or (feature, cut, tree up to cut, tree above)."""
    label = (int(y.mean() >= 0.5),)
    if depth == 0 or len(set(y)) == 1:
        return label
    impurity = lambda part: len(part) * part.mean() * (1 - part.mean()) if len(part) else 0.0
    best = (impurity(y) - 1e-9, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for c in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= c
            best = min(best, (impurity(y[low]) + impurity(y[~low]), (f, float(c))), key=lambda b: b[0])
    if best[1] is None:
        return label
    f, c = best[1]
    low = x[:, f] <= c
    return f, c, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@cache
def tree() -> Tree:
    return grow(np.array([row for row, _ in TABLE], np.float64), np.array([label for _, label in TABLE]))


def classify(node: Tree, x: np.ndarray) -> np.ndarray:
    if len(node) == 1:
        return np.full(len(x), bool(node[0]))
    low = x[:, node[0]] <= node[1]
    return np.where(low, classify(node[2], x), classify(node[3], x))


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b[0] for b, keep in zip(found, classify(tree(), features(found)), strict=True) if keep)


def extract(pages: DataFrame, *, page: str = "html") -> DataFrame:
    """pages, without the markup, and ``text``."""

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda p: main_text(p if isinstance(p, str) else None))

    return pages.withColumn("text", F.pandas_udf(texts, "string")(F.col(page))).drop(page)
