"""Operator 1, main text of web pages.

A page is cut into flat text blocks at block-level tags. Each block gets numbers about itself and
its neighbours: words and link density of the block before, itself and the block after, and what its
open elements say about its place. A decision tree that is trained on a small labelled
table (``html_labels``) tells content from boilerplate. The tree is fitted in the driver in
well under a second and travels with the tasks.

Pages are independent rows: no shuffle. Character references are decoded, runs of white space
in a block become one space, blocks of content are joined in page order by one line break.

Defined results: a null or empty page has the empty text; so has a page without content blocks.
A tag, comment or quoted value that never closes reaches to the end of the page, as in
browsers, and so does a script. A quote in a tag opens a value only right after ``=``; other quotes
are plain characters. Only raw-text elements (script, style, textarea, title and the like) hide
their content as text; svg, math, media and forms are skipped up to their end tag, and end at once
when they close themselves (``<svg/>``). Repeated rows get equal results, null ids and urls are kept; an empty
table gives an empty result. Only the id, url and page columns are read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from srclens.llm.common import bounded_batches, table
from srclens.llm.html_labels import LABELLED

# Inside a tag a quote opens a value only right after "=" (as browsers read it); any other quote is a
# plain character, and a "/" just before ">" closes the element at once.
_ATTRS = r"""(?:=\s*+(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?|/(?!>)|[^>=/])*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes)\b" + _ATTRS + r"(?:/?>|\Z).*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<skip>svg|math|object|select|canvas|video|audio)\b" + _ATTRS + r"(?:/>|>.*?(?:</(?P=skip)\s*+>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>" + _ATTRS + r")/?(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
_CONTAINER = _BLOCK - frozenset("p hr li dd dt tr td th tbody thead tfoot h1 h2 h3 h4 h5 h6 html body".split())
_MAIN = frozenset("article main".split())
_ASIDE = frozenset("nav aside footer form menu dialog search fieldset".split())
_ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|masthead|menu|modal|nav(?:bar|igation)?|"
    r"newsletter|notices?|pagination|popup|promo(?:s|tion)?|related|repl(?:y|ies)|respond|share|sharing|side(?:bar)?|social|sponsor(?:ed|s)?|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|entry|main|post|story)(?:$|[\s_-])", re.I)
_MARKS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*)display\s*:\s*none)", re.I)
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_main", "in_aside", "heading")


def _place(name: str, attrs: str) -> tuple[int, int]:
    """What an element says about its content: main text, something beside it."""
    main, aside = name in _MAIN, name in _ASIDE
    if attrs:
        for m in _MARKS.finditer(attrs):
            value = m.group(2) or m.group(3) or m.group(4) or ""
            if m.group(1).lower() == "role":
                main, aside = main or value in ("main", "article"), aside or value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert")
            else:
                aside = aside or bool(_ASIDE_NAMES.search(value))
                main = main or bool(_MAIN_NAMES.search(value))
        aside = aside or bool(_HIDDEN.search(attrs))
    return int(main and not aside), int(aside)


def blocks(page: str | None) -> tuple[list[str], list[int], list[tuple[int, int, int, int, int]]]:
    """Texts of the flat blocks, where each begins in the page, and
    ``words, linked words, in main, beside it, heading`` of each."""
    page = page or ""
    texts: list[str] = []
    starts: list[int] = []
    numbers: list[tuple[int, int, int, int, int]] = []
    piece: list[str] = []
    stack: list[tuple[str, int, int]] = []
    main = aside = heading = linked = begin = 0
    in_link = False

    def flush() -> None:
        nonlocal linked, piece
        text = " ".join(html.unescape("".join(piece)).split())
        if text:
            n = text.count(" ") + 1
            texts.append(text)
            starts.append(begin)
            numbers.append((n, min(linked, n), int(main > 0), int(aside > 0), heading))
        piece, linked = [], 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            data = page[at : m.start()]
            if not piece:
                begin = at
            piece.append(data)
            if in_link:
                linked += len(data.split())
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        closing = bool(m.group("close"))
        if name == "a":
            in_link = not closing
        elif name == "br":
            piece.append(" ")
        elif name in _BLOCK:
            flush()
            in_link = False
            if name[0] == "h" and name[1:].isdigit():
                heading = int(not closing)
            else:
                heading = 0
            if name == "header" and not closing:  # a header of the page, not that of an article
                marks = (0, int(main == 0))
            elif not closing:
                marks = _place(name, m.group("attrs"))
            if closing:
                if name in _CONTAINER and any(x[0] == name for x in stack):
                    while True:
                        gone, a, b = stack.pop()
                        main, aside = main - a, aside - b
                        if gone == name:
                            break
            elif name in _CONTAINER:
                stack.append((name, *marks))
                main, aside = main + marks[0], aside + marks[1]
    if at < len(page):
        if not piece:
            begin = at
        piece.append(page[at:])
        if in_link:
            linked += len(page[at:].split())
    flush()
    return texts, starts, numbers


def features(numbers: list[tuple[int, int, int, int, int]]) -> np.ndarray:
    """One row of ``FEATURES`` for each block."""
    raw = np.array(numbers, dtype=np.float64).reshape(-1, 5)
    words, density = raw[:, 0], raw[:, 1] / np.maximum(raw[:, 0], 1)
    shift = lambda x: (np.concatenate([[0.0], x[:-1]]), np.concatenate([x[1:], [0.0]])) if len(x) else (x, x)
    (w0, w2), (d0, d2) = shift(words), shift(density)
    return np.column_stack([words, density, w0, d0, w2, d2, raw[:, 2], raw[:, 3], raw[:, 4]])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> tuple:
    """A decision tree by Gini impurity: ``(share,)`` or ``(feature, limit, left, right)``."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return (share,)
    best: tuple = (2 * share * (1 - share) * len(y) - 1e-9, None, None)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for limit in (values[:-1] + values[1:]) / 2:
            left = x[:, j] <= limit
            n = int(left.sum())
            if least <= n <= len(y) - least:
                p, q = y[left].mean(), y[~left].mean()
                cost = 2 * p * (1 - p) * n + 2 * q * (1 - q) * (len(y) - n)
                if cost < best[0] - 1e-12:
                    best = (cost, j, limit)
    if best[1] is None:
        return (share,)
    left = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


def walk(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Share of content at the leaf of each row."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    out, left = np.empty(len(x)), x[:, tree[0]] <= tree[1]
    out[left], out[~left] = walk(tree[2], x[left]), walk(tree[3], x[~left])
    return out


def train(labelled: list[tuple[str, str, int]] = LABELLED) -> tuple:
    """Fit the tree on rows ``page, fragment of html, label``; fragments of a page stand in order."""
    pages: dict[str, list[tuple[str, int]]] = {}
    for page, fragment, label in labelled:
        pages.setdefault(page, []).append((fragment, label))
    xs, ys = [], []
    for fragments in pages.values():
        ends = np.cumsum([len(f) for f, _ in fragments])
        _, starts, numbers = blocks("".join(f for f, _ in fragments))
        xs.append(features(numbers))
        ys.append([fragments[int(np.searchsorted(ends, s, side="right"))][1] for s in starts])
    return grow(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_text(page: str | None, tree: tuple) -> str:
    texts, _, numbers = blocks(page)
    if not texts:
        return ""
    keep = walk(tree, features(numbers)) >= 0.5
    return "\n".join(t for t, k in zip(texts, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: tuple | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    bounded_batches(pages.sparkSession)
    tree = tree or train()

    @pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, tree) for p in column])

    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(F.col(html_col)).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
