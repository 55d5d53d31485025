"""Main text of web pages by the distribution of text over lines.

Markup is stripped, and what lies between two tags that open or close a block is one line; where markup holds no text the line
is empty. Menus, headers, footers, asides, forms, adverts, notices, comments and the like, known by element, role, class or
id, are empty lines too. On a page with an article, lines outside it are empty as well; on a page without one, link letters do
not count. Text lengths are summed over sliding windows of ``WINDOW`` lines. A surge point is a window whose sum reaches the
threshold; from there text is kept back to the last empty window and on to the next one, the dive point. Inside an article any text
is a surge; elsewhere a stretch must reach ``SURGE`` letters or, on a page of little text, half of the largest sum.

Character references are decoded, white space inside a block becomes one space, and blocks are joined by a line feed. ``br`` is
white space. A page is worked on by itself, so a table of pages is one pass without a shuffle.

Edge cases. A null or empty page, and one without text, has the empty text. Markup cut off at the end of a page is no text,
and an element left open ends with the page or with its container. A very long page costs time and memory linear in its length. Ids and
urls may be null or repeated; every row has its result. Other columns pass through; one named ``text``, ``n_chars``, ``n_blocks`` or ``n_stretches``
is replaced.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .segment import slices

WINDOW = 3
SURGE = 86

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split())
_SPACES = frozenset("br td th".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
_LEFT_OUT = frozenset("aside button canvas dialog footer form head menu nav object select svg".split()) | _RAW
_IMPLIED_END = frozenset("dd dt li option p td th tr".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
    "promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar "
    "widget widgets".split())
_NOT = frozenset("has no with without is can".split())
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _named_so(value: str) -> bool:
    """Whether a class or id is, begins with or ends with a word of boilerplate."""
    for name in value.split():
        parts = [p for p in re.split(r"[^a-z]+", _CAMEL.sub("-", name).lower()) if p]
        if parts and parts[0] not in _NOT and (parts[0] in _WORDS or parts[-1] in _WORDS):
            return True
    return False


def _left_out(name: str, attributes: str, in_article: bool, by_name: bool) -> bool:
    if name in _LEFT_OUT or (name == "header" and not in_article):
        return True
    if name in ("html", "body", "main") or not (by_name or in_article) or not attributes.strip():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and _named_so(value):
            return True
        if (key == "role" and value.lower() in _ROLES) or key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def page_lines(page: str, by_name: bool = True) -> tuple[list[str], list[int], list[bool]]:
    """Lines of a page between block tags, the letters of each that are links, and whether it lies in an article.

    Without ``by_name``, roles, classes and ids count inside articles only.
    """
    texts, links, inside = [], [], []
    held: list[str] = []
    linked = articles = link = 0
    skipping, depth = "", 0

    def flush():
        nonlocal linked
        text = " ".join("".join(held).split())
        texts.append(text)
        links.append(min(linked, len(text)))
        inside.append(articles > 0)
        held.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        upto = m.start() if m else size
        if upto > at and not skipping:
            text = html.unescape(page[at:upto])
            held.append(text)
            if link:
                linked += len("".join(text.split()))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closes = m[1] == "/"
        if skipping:
            if name == skipping:
                depth += -1 if closes else 1
            ended = depth == 0 or (closes and name in ("article", "body", "html"))
            ended |= skipping in _IMPLIED_END and name in _BLOCKS and (closes or name == skipping or skipping == "p")
            if not ended:
                continue
            closed = name == skipping and closes
            skipping, depth = "", 0
            if closed:
                continue
        if not closes and _left_out(name, m[3], articles > 0, by_name):
            flush()
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            elif name not in _VOID and not m[3].endswith("/"):
                skipping, depth = name, 1
            continue
        if name in _BLOCKS:
            flush()
            if name == "article":
                articles = max(0, articles - 1) if closes else articles + 1
        elif name in _SPACES:
            held.append(" ")
        elif name == "a":
            link = 0 if closes else 1
    flush()
    return texts, links, inside


def stretches(sizes: np.ndarray, surge: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Line ranges between a surge point and its dive point: windows above 0 around one that reaches ``surge``."""
    if not len(sizes):
        return []
    total = np.concatenate([np.zeros(window, np.int64), np.cumsum(sizes), np.full(window - 1, sizes.sum())])
    sums = total[window:] - total[:-window]  # window i ends at line i
    some = np.concatenate([[False], sums > 0, [False]])
    edges = np.flatnonzero(some[1:] != some[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if sums[a:b].max() >= surge]


def main_text(page: str | None) -> tuple[str, int, int]:
    """Main text of a page, its blocks and the stretches they lie in."""
    texts, links, inside = page_lines(page or "")
    if not any(inside) and "<article" in (page or "").lower():  # the article lies in an element that is named like boilerplate
        texts, links, inside = page_lines(page, by_name=False)
    sizes = np.array([len(t) for t in texts])
    if any(inside):
        sizes, surge = sizes * np.array(inside), 1
    else:
        own = sizes - np.array(links)
        largest = max((int(own[k : k + WINDOW].sum()) for k in range(len(own))), default=0)
        sizes, surge = own, max(1, min(SURGE, largest / 2))
    found = stretches(sizes, surge)
    kept = [texts[k] for a, b in found for k in range(a, min(b, len(texts))) if sizes[k]]
    return "\n".join(kept), len(kept), len(found)


def _extract(batches):
    for batch in batches:
        pages = batch.column(0)
        for low, high in slices(pages):
            found = [main_text(p) for p in pages.slice(low, high - low).to_pylist()]
            part = batch.slice(low, high - low)
            new = [pa.array([f[0] for f in found]), pa.array([len(f[0]) for f in found]), pa.array([f[1] for f in found]), pa.array([f[2] for f in found])]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *new], [*part.schema.names[1:], "text", "n_chars", "n_blocks", "n_stretches"])


def extract_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """The rows without ``column``, with ``text``, ``n_chars`` (code points), ``n_blocks`` and ``n_stretches``."""
    found = ["text", "n_chars", "n_blocks", "n_stretches"]
    other = [c for c in pages.columns if c != column and c not in found]
    new = [T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in found[1:]]]
    rows = pages.select(F.col(column).cast("string").alias(column), *other)
    return rows.mapInArrow(_extract, T.StructType([*rows.select(*other).schema.fields, *new]))
