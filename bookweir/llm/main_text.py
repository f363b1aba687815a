"""Main text of web pages: flat text blocks classified by a decision tree over them and their neighbours.

A page becomes a flat list of text blocks, each with its number of words and its link
density (share of words inside links), what its neighbours have of both, and whether it
stands inside elements that by tag, class, id or role hold navigation and the like, or the
article. A decision tree, grown from the labelled table below, says which blocks are text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookweir.llm.work import map_texts

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "article", "heading")

# The labelled table, one block a row: the features in order, then 1 for main text.
# Inside boilerplate elements nothing is text; inside the article everything is but links next to
# other links; elsewhere long blocks of few links are, and short ones between such blocks.
LABELLED = [
    # menus, sidebars, footers, forms, adverts, notices and comments, told by their elements
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0),
    (2, 1.0, 1, 1.0, 2, 1.0, 1, 0, 0, 0),
    (1, 1.0, 2, 1.0, 9, 0.0, 1, 0, 0, 0),
    (7, 0.0, 1, 1.0, 11, 0.0, 1, 0, 0, 0),
    (9, 0.0, 1, 1.0, 60, 0.0, 1, 0, 0, 0),
    (12, 0.0, 80, 0.0, 0, 0.0, 1, 0, 0, 0),
    (25, 0.2, 60, 0.0, 4, 1.0, 1, 0, 0, 0),
    (40, 0.0, 90, 0.0, 30, 0.0, 1, 0, 0, 0),
    (120, 0.0, 40, 0.0, 25, 0.0, 1, 0, 0, 0),
    (3, 0.0, 50, 0.0, 35, 0.0, 1, 0, 1, 0),
    (5, 0.0, 12, 0.0, 40, 0.0, 1, 1, 1, 0),
    (35, 0.0, 70, 0.0, 50, 0.0, 1, 1, 0, 0),
    (60, 0.1, 100, 0.0, 0, 0.0, 1, 1, 0, 0),
    (8, 0.0, 65, 0.0, 45, 0.0, 1, 1, 0, 0),
    (2, 0.0, 8, 0.0, 55, 0.0, 1, 1, 0, 0),
    (4, 1.0, 40, 0.0, 4, 1.0, 1, 1, 0, 0),
    # the article, told by its element
    (9, 0.0, 7, 0.0, 45, 0.0, 0, 1, 1, 1),
    (4, 0.0, 60, 0.0, 75, 0.0, 0, 1, 1, 1),
    (1, 0.0, 9, 0.0, 50, 0.0, 0, 1, 0, 1),
    (2, 0.0, 40, 0.0, 1, 0.0, 0, 1, 0, 1),
    (6, 0.0, 1, 1.0, 30, 0.0, 0, 1, 0, 1),
    (15, 0.0, 30, 0.0, 12, 0.0, 0, 1, 0, 1),
    (45, 0.0, 10, 0.0, 60, 0.0, 0, 1, 0, 1),
    (80, 0.1, 45, 0.0, 20, 0.2, 0, 1, 0, 1),
    (150, 0.0, 80, 0.1, 9, 1.0, 0, 1, 0, 1),
    (400, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
    (30, 0.4, 50, 0.0, 45, 0.0, 0, 1, 0, 1),
    (12, 0.5, 60, 0.1, 50, 0.0, 0, 1, 0, 1),
    (22, 0.0, 50, 0.0, 5, 0.2, 0, 1, 0, 1),
    (70, 0.0, 35, 0.0, 6, 0.0, 0, 1, 0, 1),
    (1, 0.0, 25, 0.0, 4, 0.0, 0, 1, 0, 1),
    (9, 0.0, 3, 0.0, 2, 0.0, 0, 1, 0, 1),
    (38, 0.0, 2, 0.0, 3, 0.0, 0, 1, 0, 1),
    (3, 0.0, 5, 0.0, 1, 1.0, 0, 1, 0, 1),
    (13, 0.1, 4, 0.0, 0, 0.0, 0, 1, 0, 1),
    (110, 0.0, 6, 0.0, 0, 0.0, 0, 1, 0, 1),
    (6, 0.0, 7, 1.0, 5, 1.0, 0, 1, 0, 1),
    (12, 1.0, 40, 0.0, 50, 0.0, 0, 1, 0, 1),
    (4, 1.0, 60, 0.0, 30, 0.1, 0, 1, 0, 1),
    (25, 1.0, 5, 0.0, 0, 0.0, 0, 1, 0, 1),
    (3, 1.0, 0, 0.0, 45, 0.0, 0, 1, 0, 1),
    (6, 1.0, 0, 0.0, 70, 0.0, 0, 1, 1, 1),
    (9, 0.9, 3, 0.0, 4, 0.2, 0, 1, 0, 1),
    (2, 1.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
    # in the article also at its ends, and next to links
    (5, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 1),
    (9, 0.3, 55, 0.0, 0, 0.0, 0, 1, 0, 1),
    (12, 0.0, 4, 0.0, 0, 0.0, 0, 1, 0, 1),
    (15, 0.0, 58, 0.0, 0, 0.0, 0, 1, 0, 1),
    (17, 0.1, 17, 0.0, 0, 0.0, 0, 1, 0, 1),
    (1, 0.0, 9, 0.0, 0, 0.0, 0, 1, 0, 1),
    (7, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
    (25, 0.0, 0, 0.0, 60, 0.0, 0, 1, 0, 1),
    (3, 0.0, 0, 0.0, 8, 0.0, 0, 1, 0, 1),
    (7, 0.0, 0, 0.0, 5, 1.0, 0, 1, 0, 1),
    (6, 0.0, 30, 0.0, 1, 1.0, 0, 1, 0, 1),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 1, 0, 1),
    (12, 0.0, 1, 1.0, 11, 0.0, 0, 1, 0, 1),
    (6, 0.0, 1, 1.0, 40, 0.0, 0, 1, 0, 1),
    (9, 0.1, 1, 1.0, 0, 0.0, 0, 1, 0, 1),
    (3, 0.0, 4, 1.0, 2, 1.0, 0, 1, 1, 1),
    (2, 0.0, 40, 0.0, 3, 1.0, 0, 1, 1, 1),
    (5, 0.5, 6, 0.5, 4, 1.0, 0, 1, 0, 1),
    (50, 0.0, 1, 1.0, 2, 1.0, 0, 1, 0, 1),
    (3, 1.0, 40, 0.0, 3, 1.0, 0, 1, 0, 0),
    (5, 1.0, 3, 1.0, 4, 1.0, 0, 1, 0, 0),
    (2, 1.0, 5, 1.0, 0, 0.0, 0, 1, 0, 0),
    (8, 0.9, 60, 0.0, 6, 1.0, 0, 1, 0, 0),
    # pages without such elements: long blocks, and whatever stands between blocks without links
    (60, 0.0, 40, 0.0, 55, 0.0, 0, 0, 0, 1),
    (35, 0.0, 8, 0.0, 50, 0.0, 0, 0, 0, 1),
    (90, 0.1, 50, 0.0, 5, 1.0, 0, 0, 0, 1),
    (25, 0.0, 70, 0.0, 30, 0.0, 0, 0, 0, 1),
    (12, 0.0, 45, 0.0, 65, 0.0, 0, 0, 0, 1),
    (5, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0, 1),
    (2, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 1),
    (1, 0.0, 8, 0.0, 60, 0.0, 0, 0, 0, 1),
    (8, 0.0, 9, 0.0, 7, 0.0, 0, 0, 0, 1),
    (10, 0.0, 17, 0.0, 8, 0.0, 0, 0, 0, 1),
    (4, 0.1, 50, 0.0, 6, 0.0, 0, 0, 0, 1),
    (6, 0.0, 5, 0.0, 14, 0.0, 0, 0, 0, 1),
    (14, 0.1, 7, 0.0, 8, 0.0, 0, 0, 0, 1),
    (13, 0.0, 55, 0.0, 4, 0.0, 0, 0, 0, 1),
    (9, 0.0, 9, 0.0, 4, 0.0, 0, 0, 0, 1),
    (8, 0.0, 20, 0.0, 2, 0.0, 0, 0, 0, 1),
    (16, 0.0, 2, 0.0, 1, 0.0, 0, 0, 0, 1),
    (1, 0.0, 60, 0.0, 1, 0.0, 0, 0, 0, 1),
    (20, 0.1, 60, 0.0, 45, 0.0, 0, 0, 0, 1),
    (30, 0.0, 12, 0.0, 0, 0.0, 0, 0, 0, 1),
    (200, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (45, 0.0, 3, 1.0, 7, 0.0, 0, 0, 0, 1),
    (28, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0, 1),
    (80, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 1),
    (40, 0.2, 1, 1.0, 0, 0.0, 0, 0, 0, 1),
    # headings, unless only links follow
    (6, 0.0, 55, 0.0, 60, 0.0, 0, 0, 1, 1),
    (8, 0.0, 2, 1.0, 45, 0.0, 0, 0, 1, 1),
    (4, 0.0, 0, 0.0, 6, 0.0, 0, 0, 1, 1),
    (9, 0.0, 12, 0.0, 9, 0.0, 0, 0, 1, 1),
    (11, 0.0, 1, 1.0, 23, 0.0, 0, 0, 1, 1),
    (3, 0.0, 8, 0.0, 3, 0.0, 0, 0, 1, 1),
    (4, 0.0, 12, 0.0, 1, 0.0, 0, 0, 1, 1),
    (3, 0.0, 4, 1.0, 2, 1.0, 0, 0, 1, 0),
    (2, 0.0, 40, 0.0, 3, 1.0, 0, 0, 1, 0),
    # links and what is mostly links
    (2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0),
    (3, 1.0, 50, 0.0, 2, 1.0, 0, 0, 0, 0),
    (10, 0.8, 4, 1.0, 6, 0.9, 0, 0, 0, 0),
    (25, 0.7, 8, 1.0, 12, 0.8, 0, 0, 0, 0),
    (5, 0.5, 6, 0.5, 4, 1.0, 0, 0, 0, 0),
    (9, 1.0, 70, 0.0, 60, 0.0, 0, 0, 0, 0),
    (9, 0.7, 12, 0.0, 0, 0.0, 0, 0, 0, 0),
    # short blocks next to links: an advert below the menu, a label between links
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0),
    (8, 0.0, 3, 1.0, 6, 1.0, 0, 0, 0, 0),
    (12, 0.0, 1, 1.0, 11, 0.0, 0, 0, 0, 0),
    (15, 0.0, 2, 1.0, 9, 0.0, 0, 0, 0, 0),
    (6, 0.0, 1, 1.0, 40, 0.0, 0, 0, 0, 0),
    (9, 0.1, 1, 1.0, 0, 0.0, 0, 0, 0, 0),
    (6, 0.0, 30, 0.0, 1, 1.0, 0, 0, 0, 0),
    (7, 0.0, 0, 0.0, 5, 1.0, 0, 0, 0, 0),
    # short last blocks: whose page it is
    (5, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0),
    (9, 0.3, 55, 0.0, 0, 0.0, 0, 0, 0, 0),
    (12, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 0),
    (15, 0.0, 58, 0.0, 0, 0.0, 0, 0, 0, 0),
    (17, 0.1, 17, 0.0, 0, 0.0, 0, 0, 0, 0),
]

# Elements that start and end a block of text.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section"
    " select summary table tbody td tfoot th thead tr ul button".split()
)
# Blocks that hold no others: the next block ends them.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 dt caption legend summary option".split())
_VOID = frozenset("hr".split())
# What these hold isn't text of the page.
_RAW = frozenset("script style title textarea noscript template iframe svg math object audio video canvas xmp noframes".split())
_BOILER_TAGS = frozenset("nav footer aside form menu select button dialog fieldset".split())
_BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline captcha comment"
    " comments consent cookie cookies copyright disclaimer discussion disqus footer form gdpr hidden login masthead menu"
    " modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted"
    " promotion recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe"
    " subscription tags teaser toc toolbar tracking warning widget alert".split()
)
_COMMENT_NAMES = frozenset("comment comments disqus discussion replies reply".split())
_ARTICLE_NAMES = frozenset("article post story entry".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+>|[^>]*+>)",
    re.DOTALL,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")
# A name that begins so says something about what it names but isn't it: with-sidebar, no-comments.
_ABOUT = frozenset("with without has have no not non is hide hides hidden show shows toggle open above below before after".split())
_NO_MORE: dict[str, re.Pattern] = {}


def _end_of(tag: str) -> re.Pattern:
    if tag not in _NO_MORE:
        _NO_MORE[tag] = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE)
    return _NO_MORE[tag]


def _names(token: str) -> set[str]:
    """What a class, id or role names: itself, or its first or last part (`sidebar-left`, `site-footer`)."""
    parts = _PARTS.findall(token)
    if not parts or len(parts) > 1 and parts[0] in _ABOUT:
        return set()
    return {parts[0], parts[-1]}


def _kind(tag: str, attributes: str, boiler: int, article: bool) -> tuple[int, bool]:
    """Whether text inside an element is boilerplate (2: whatever is inside) or of the article, given its surroundings."""
    names: set[str] = set()
    hidden = False
    if attributes and tag not in ("body", "html"):
        for name, value in _NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                for token in value.split():
                    names.update(_names(token))
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                hidden = True
            elif name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
    if hidden or names & _COMMENT_NAMES:
        return 2, article
    if tag in _BOILER_TAGS or tag == "header" and not article:
        return max(boiler, 1 if tag == "header" else 2), article
    if tag in ("article", "main") or "main" in names or names & _ARTICLE_NAMES and not names & _BOILER_NAMES:
        return (boiler if boiler == 2 else 0), True
    if names & _BOILER_NAMES or "header" in names and not article:
        return max(boiler, 1), article
    return boiler, article


@dataclass
class _Blocks:
    texts: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)


def blocks(page: str) -> tuple[list[str], list[tuple]]:
    """Texts of a page's blocks and, for each, words, link density, boiler, article and heading."""
    out = _Blocks()
    stack: list[tuple[str, int, bool]] = []
    boiler, article, tag_now = 0, False, ""
    parts: list[str] = []
    linked: list[str] = []
    in_link = False
    opened: dict[str, int] = {}
    at, size, last = 0, len(page), page.rfind(">") + 1  # behind the last one no tag can end

    def close(k: int) -> None:
        for name, *_ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    def flush() -> None:
        if parts:
            text = html.unescape("".join(parts)) if any("&" in x for x in parts) else "".join(parts)
            words = text.split()
            if words:
                of_links = len(html.unescape(" ".join(linked)).split()) if linked else 0
                out.texts.append(" ".join(words))
                out.rows.append((len(words), min(1.0, of_links / len(words)), int(boiler > 0), int(article), int(tag_now in _HEADINGS)))
            parts.clear()
            linked.clear()

    while at < size:
        found = _MARKUP.search(page, at, last)
        stop = found.start() if found else size
        if stop > at:
            parts.append(page[at:stop])
            if in_link:
                linked.append(parts[-1])
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                parts.append(found[0][9:].removesuffix("]]>"))
            continue
        tag, closing = tag.lower(), bool(found[1])
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in _RAW:
            if not closing and not found[3].endswith("/>"):
                end = _end_of(tag).search(page, at)
                at = end.end() if end else size
        elif tag in _BLOCKS:
            flush()
            in_link = False
            if closing:
                if opened.get(tag):
                    close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            else:
                if stack and stack[-1][0] in _LEAVES:
                    close(len(stack) - 1)
                if tag in ("li", "td", "th", "tr", "dd"):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in ("ul", "ol", "menu", "table", "dl"):
                            break
                        if stack[k][0] == tag:
                            close(k)
                            break
                if tag not in _VOID:
                    around = stack[-1][1:] if stack else (0, False)
                    stack.append((tag, *_kind(tag, found[3][:-1], *around)))
                    opened[tag] = opened.get(tag, 0) + 1
            tag_now, boiler, article = stack[-1] if stack else ("", 0, False)
    flush()
    return out.texts, out.rows


def features(rows: list[tuple]) -> np.ndarray:
    """The features of a page's blocks, in the order of FEATURES."""
    own = np.array(rows, float).reshape(-1, 5)
    before, after = np.zeros((len(own), 2)), np.zeros((len(own), 2))
    before[1:], after[:-1] = own[:-1, :2], own[1:, :2]
    # What stands outside the article, or outside the menu, is no neighbour of what is inside.
    apart = (own[1:, 2:4] != own[:-1, 2:4]).any(axis=1)
    before[1:][apart] = after[:-1][apart] = 0
    return np.hstack([own[:, :2], before, after, own[:, 2:]])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by the Gini measure: a label, or (feature, threshold, below, above)."""
    if depth == 0 or len(set(y)) <= 1:
        return int(2 * y.sum() > len(y))
    best = None
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for cut in (values[1:] + values[:-1]) / 2:
            below = x[:, k] <= cut
            loss = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[below], y[~below]))
            if best is None or loss < best[0] - 1e-12:
                best = (loss, k, cut, below)
    if best is None:
        return int(2 * y.sum() > len(y))
    _, k, cut, below = best
    return k, cut, grow(x[below], y[below], depth - 1), grow(x[~below], y[~below], depth - 1)


def trained(labelled: list[tuple] | None = None):
    table = np.array(LABELLED if labelled is None else labelled, float)
    return grow(table[:, :-1], table[:, -1])


def classify(tree, x: np.ndarray) -> np.ndarray:
    """Which rows the tree takes for main text."""
    if isinstance(tree, int):
        return np.full(len(x), bool(tree))
    k, cut, below, above = tree
    low = x[:, k] <= cut
    out = np.zeros(len(x), bool)
    out[low], out[~low] = classify(below, x[low]), classify(above, x[~low])
    return out


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, labelled: list[tuple] | None = None) -> DataFrame:
    """Each row (struct `row` of the columns in `keep`, all by default) and `out`: text and n_chars.

    Character references are decoded, white space inside a block is one space, blocks are
    joined by a line break. Null html, empty html and pages without text give an empty text;
    unclosed elements end where their surroundings do; repeated rows give the same text; an
    empty table gives an empty result.
    """
    tree = trained(labelled)

    def work(column: pa.Array) -> list:
        parsed = [blocks(page or "") for page in column.to_pylist()]
        sizes = [len(rows) for _, rows in parsed]
        x = [features(rows) for _, rows in parsed if rows]
        chosen = classify(tree, np.vstack(x)) if x else np.zeros(0, bool)
        texts, at = [], 0
        for (lines, _), n in zip(parsed, sizes):
            texts.append("\n".join([line for line, good in zip(lines, chosen[at : at + n]) if good]))
            at += n
        return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]

    return map_texts(pages, html_col, "text string, n_chars long", work, keep)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    found = extract(pages, html_col, keep=[id_col, url_col])
    return found.select(F.col("row")[id_col].alias(id_col), F.col("row")[url_col].alias(url_col), "out.*")
