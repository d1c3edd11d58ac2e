"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block's features are its number of words and
link density, those of its neighbours, and where it stands: inside an article, inside
something that is not main text (by tag, role, class or id), or neither. A decision tree,
trained on the small labelled table below, says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 5

#: Labelled blocks: place (1 in an article, -1 in what is not main text, 0 neither), words,
#: link density, words and link density of the block before and of the block after; main text?
LABELLED = [
    (1, 60, 0.00, 8, 0.00, 55, 0.00, 1), (1, 120, 0.02, 60, 0.00, 80, 0.05, 1), (1, 1, 0.00, 60, 0.00, 45, 0.00, 1),
    (1, 8, 0.00, 0, 0.00, 70, 0.00, 1), (1, 4, 0.00, 5, 1.00, 40, 0.00, 1), (1, 3, 0.00, 2, 0.00, 1, 0.00, 1),
    (1, 30, 0.40, 50, 0.00, 60, 0.00, 1), (1, 12, 1.00, 40, 0.00, 70, 0.00, 1), (1, 25, 0.00, 6, 1.00, 4, 1.00, 1),
    (1, 2, 0.00, 1, 1.00, 1, 1.00, 1), (1, 6, 0.50, 20, 0.00, 30, 0.00, 1), (1, 3, 1.00, 35, 0.00, 22, 0.10, 1),
    (1, 200, 0.00, 3, 0.00, 0, 0.00, 1), (1, 9, 0.00, 150, 0.00, 6, 0.00, 1), (1, 5, 1.00, 9, 0.00, 0, 0.00, 1),
    (-1, 1, 1.00, 0, 0.00, 1, 1.00, 0), (-1, 1, 1.00, 1, 1.00, 1, 1.00, 0), (-1, 7, 0.00, 1, 1.00, 9, 0.00, 0),
    (-1, 40, 0.00, 70, 0.00, 3, 1.00, 0), (-1, 12, 0.00, 90, 0.00, 0, 0.00, 0), (-1, 150, 0.00, 200, 0.00, 60, 0.00, 0),
    (-1, 25, 0.10, 30, 0.00, 28, 0.00, 0), (-1, 3, 0.00, 4, 0.00, 2, 0.00, 0), (-1, 60, 0.50, 2, 1.00, 40, 0.00, 0),
    (-1, 9, 0.00, 60, 0.00, 55, 0.00, 0), (-1, 80, 0.00, 5, 0.00, 90, 0.00, 0), (-1, 2, 0.50, 100, 0.00, 0, 0.00, 0),
    (0, 60, 0.00, 8, 0.00, 55, 0.00, 1), (0, 35, 0.05, 40, 0.00, 20, 0.00, 1), (0, 18, 0.00, 60, 0.00, 45, 0.00, 1),
    (0, 6, 0.00, 3, 1.00, 60, 0.00, 1), (0, 5, 0.00, 70, 0.00, 48, 0.00, 1), (0, 90, 0.20, 2, 1.00, 3, 1.00, 1),
    (0, 2, 0.00, 55, 0.00, 62, 0.00, 1), (0, 150, 0.00, 0, 0.00, 4, 1.00, 1), (0, 14, 0.10, 30, 0.00, 28, 0.10, 1),
    (0, 1, 1.00, 0, 0.00, 1, 1.00, 0), (0, 3, 1.00, 2, 1.00, 4, 1.00, 0), (0, 4, 0.00, 2, 1.00, 3, 1.00, 0),
    (0, 12, 0.90, 50, 0.00, 5, 1.00, 0), (0, 8, 0.00, 90, 0.00, 0, 0.00, 0), (0, 20, 0.80, 15, 0.70, 12, 0.90, 0),
    (0, 3, 0.00, 1, 0.00, 2, 0.00, 0), (0, 5, 0.60, 4, 1.00, 60, 0.00, 0), (0, 6, 0.00, 4, 0.50, 5, 1.00, 0),
    (0, 2, 0.00, 3, 0.00, 6, 1.00, 0), (0, 40, 0.70, 30, 0.90, 20, 0.80, 0), (0, 1, 0.00, 0, 0.00, 2, 1.00, 0),
]

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>"
    r"|<[!?][^>]*>|</?[a-zA-Z][^<>]*\Z|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Names of the markup language, and words that class names and ids use.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle mspace semantics".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("head nav header footer aside form button dialog menu fieldset".split())
_ARTICLE = frozenset("article main".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
_ASIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment
    comments commentlist consent cookie cookies copyright disclaimer disqus dropdown footer form gdpr header hidden
    legal login masthead menu meta modal nav navbar navigation newsletter notice notices notification pager
    pagination popup privacy promo promoted promotion recommended related replies reply respond share sharing
    sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget widgets alert
    discussion""".split()
)
_ARTICLE_WORDS = frozenset("article articlebody content entry main maincontent post story".split())
_MODIFIERS = frozenset("has with no without show".split())  # a class has-sidebar is of what stands beside one
_STATES = frozenset("open closed enabled disabled on off visible active".split())  # comments-open is said of a post
_AROUND = frozenset("wrap wrapper container row layout grid columns inner outer area".split())  # content-sidebar-wrap holds both
_SECTIONS = frozenset("div section td table ul ol li dl p span blockquote center details".split())


def _kind(name: str) -> str | None:
    """What a class name or id says of its element. The last word that is known decides, as nouns do:
    post-comments are comments. Names of what stands beside (has-sidebar), of a state (comments-open),
    of what holds several things, or of an aside's content say both."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    known = [w for w in words if w in _ASIDE_WORDS or w in _ARTICLE_WORDS]
    asides = [w for w in known if w in _ASIDE_WORDS]
    if not known:
        return None
    if not asides:
        return "main"
    if not _MODIFIERS.isdisjoint(words[: words.index(asides[0])]) or words[-1] in _STATES or words[-1] in _AROUND:
        return "both"
    return "aside" if known[-1] in _ASIDE_WORDS else "both"


def _place(tag: str, attributes: str) -> int:
    """1: opens an article; -1: opens what is not main text; 0: neither."""
    if tag in _ASIDE:
        return -1
    named = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    if named:
        if named.get("role", "").lower() in _ASIDE_ROLES or named.get("aria-hidden", "").lower() == "true":
            return -1
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", ""), re.IGNORECASE):
            return -1
    if attributes and re.search(r"(?:^|\s)hidden(?=[\s=/]|$)", attributes):
        return -1
    if named and (tag in _SECTIONS or tag in _ARTICLE):
        said = _CAMEL.sub("-", f"{named.get('class', '')} {named.get('id', '')}").lower()
        main = tag == "main" or named.get("role", "").lower() in ("main", "article")
        kinds = {_kind(name) for name in said.split()}
        if "aside" in kinds:  # names of both kinds beside each other decide nothing
            return 0 if main or "main" in kinds else -1
        if main or "main" in kinds:
            return 0 if "both" in kinds and tag not in _ARTICLE else 1
    return 1 if tag in _ARTICLE else 0


class Block:
    __slots__ = ("parts", "linked", "place")

    def __init__(self, place: int):
        self.parts, self.linked, self.place = [], [], place


def blocks(page: str | None) -> list[tuple[str, int, float, int]]:
    """(text, words, link density, place) of every block that has text, in page order."""
    open_: list[tuple[str, int]] = []  # tags that are open, and the place inside of them
    made, now, links = [], Block(0), 0
    for m in _TOKEN.finditer(page or ""):
        raw, tag = m[0], m[3]
        if m[1] or tag is None and len(raw) > 1 and raw[0] == "<":
            continue
        if tag is None:
            now.parts.append(raw)
            if links:
                now.linked.append(raw)
            continue
        tag, closing = tag.lower(), bool(m[2])
        if tag == "br":
            now.parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        place = 0 if closing or tag in _VOID else _place(tag, m[4])
        if tag in _INLINE and not place and not any(t == tag and p != (open_[i - 1][1] if i else 0) for i, (t, p) in enumerate(open_)):
            continue
        if now.parts:
            made.append(now)
        if tag == "body" and not closing:
            open_ = [x for x in open_ if x[0] not in ("head", "title")]
        if closing:
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
            if at is not None:
                del open_[at:]
        elif tag not in _VOID:
            if open_ and tag not in _INLINE and (open_[-1][0] == "p" or open_[-1][0] == tag == "li"):
                del open_[-1]  # its end tag may be left out
            if place or tag in _SECTIONS - {"p", "li"} or tag in _ARTICLE:
                # What is not main text holds for all inside; but a form (-2) may be around the whole page.
                outer = open_[-1][1] if open_ else 0
                inside = -2 if tag == "form" and outer >= 0 else place or outer
                open_.append((tag, -1 if outer == -1 else inside))
        if tag not in _INLINE:
            links = 0
        now = Block(max(open_[-1][1], -1) if open_ else 0)
    if now.parts:
        made.append(now)
    found = []
    for b in made:
        text = " ".join(html.unescape("".join(b.parts)).split())
        if text:
            n = len(text.split(" "))
            linked = len(html.unescape(" ".join(b.linked)).split()) if b.linked else 0
            found.append((text, n, min(1.0, linked / n), b.place))
    return found


def features(found: list[tuple[str, int, float, int]]) -> np.ndarray:
    """[block, 7], in the order of the labelled table."""
    n = np.array([b[1] for b in found], float)
    density = np.array([b[2] for b in found], float)
    before = lambda x: np.concatenate(([0.0], x[:-1]))
    after = lambda x: np.concatenate((x[1:], [0.0]))
    place = np.array([b[3] for b in found], float)
    return np.stack([place, n, density, before(n), before(density), after(n), after(density)], axis=1)


def train_tree(rows: list[tuple] = LABELLED, depth: int = MAX_DEPTH) -> tuple:
    """A tree of (feature, threshold, below or equal, above), with shares of main text as leaves.

    Splits take the least Gini impurity; of equal ones the first feature and lowest threshold.
    """
    table = np.array(rows, float)
    x, y = table[:, :-1], table[:, -1]

    def impurity(part: np.ndarray) -> float:
        share = part.mean()
        return 2 * share * (1 - share) * len(part)

    def grow(x: np.ndarray, y: np.ndarray, left: int) -> tuple | float:
        if left == 0 or y.min() == y.max():
            return float(y.mean())
        best = (impurity(y), None, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                below = x[:, f] <= cut
                loss = impurity(y[below]) + impurity(y[~below])
                if loss < best[0] - 1e-12:
                    best = (loss, f, float(cut))
        _, f, cut = best
        if f is None:
            return float(y.mean())
        below = x[:, f] <= cut
        return (f, cut, grow(x[below], y[below], left - 1), grow(x[~below], y[~below], left - 1))

    return grow(x, y, depth)


def classify(x: np.ndarray, tree: tuple | float) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, classify(x, low), classify(x, high))


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = classify(features(found), tree)
    return " ".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", name: str = "text", tree: tuple | None = None) -> DataFrame:
    """``pages`` with the main text of each whole page in a new column ``name``.

    A null or empty page has an empty text, and so has one without main text. Markup that does
    not end is taken to end with the page. Pages may be of any length; a table without rows stays
    one. Repeated rows and other columns (but ``name``) pass as they are.
    """
    grown = train_tree() if tree is None else tree

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, grown) for p in batch], dtype="object")

    return pages.withColumn(name, text(F.coalesce(F.col(html_col), F.lit(""))))
