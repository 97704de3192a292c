"""Main-text extraction by tag-path ratios.

A page becomes its text nodes in page order, each with the path of block elements (tag and class) from the root.  Per
path the text outside links and the punctuation are summed over its nodes and divided by their number.  Text
counts by what its path is: less where it stands bare in a container, next to nothing below a landmark (navigation, footer, comments).  Both ratios are
smoothed over the sequence of nodes by a Gaussian; a path's fused ratio is the geometric mean of its own and its nodes' smoothed
ratios, times the logarithm of its whole text.

The path of the greatest fused ratio is the page's measure, and the smallest element that holds its nodes the article.
A path is content where its fused ratio reaches a share of that measure: a small one for paragraphs, headings, list items and cells
within the article, a large one for bare text in it and for everything outside or below a landmark.  The text is that of all nodes of
content paths.  Only scripts, styles, forms and what is declared hidden are left out beforehand.

Null or empty html: empty text, as for a page without any text outside links.  Texts of any length are read whole;
repeated pages give repeated rows, an empty table none; columns besides html_col and keep are ignored, and keep may name
columns called like those that come out only if they aren't `text` or `n_chars`.
"""

from __future__ import annotations

import html as H
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: elements whose text is never shown, that have no end tag, that don't break a line
_SILENT = ("script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "textarea", "select", "button", "form", "canvas", "audio", "video")
_RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "xmp")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split())
#: fixed values: what an open element of the left is closed by
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("ul ol dl table article section main body div td th aside nav".split())
#: fixed values: elements that hold prose, and marks of what isn't the article
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th caption figcaption blockquote pre".split())
_LANDMARKS = frozenset("nav aside footer menu dialog header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset("ad ads advert advertisement nav navbar menu breadcrumb breadcrumbs sidebar footer cookie cookies consent newsletter share related comment comments commentlist comment-list disqus_thread respond pagination".split())
_ATTRS = r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*){_ATTRS}(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PUNCT = re.compile(r"[.,;:!?…。、，；：！？¿¡\"'()«»„“”’]")
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}

#: what text counts for: bare in a container, below a landmark
BARE, LANDMARK = 0.1, 0.05
#: shares of the page's measure from which a path is content
WITHIN, LOOSE, OUTSIDE = 0.001, 0.35, 0.5


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)} if attrs else {}


def _hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()


def _landmark(tag: str, a: dict[str, str], in_article: bool) -> bool:
    """in_article: where a header is the article's own."""
    if tag in _LANDMARKS and not (in_article and tag == "header") or a.get("role", "").lower() in _ROLES:
        return True
    return not _NAMES.isdisjoint([*a.get("class", "").lower().split(), a.get("id", "").lower()])


class Page:
    """Text nodes of a page: texts (with white space as it is), the characters of each that are in links, the open element
    of each, and the element tree."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path = [-1], ["#root"], [0]
        self.off, self.aside, self.article = [False], [False], [False]
        self.texts: list[list[str]] = []
        self.linked: list[int] = []
        self.owner: list[int] = []
        paths: dict[tuple, int] = {}
        stack, at, end, node, link = [0], 0, len(source), None, 0
        while at < end:
            m = _TOKEN.search(source, at)
            text = source[at : m.start() if m else end]
            if text:
                if node is None:
                    node = []
                    self.texts.append(node)
                    self.owner.append(stack[-1])
                    self.linked.append(0)
                node.append(text)
                if link:
                    self.linked[-1] += len(text)
            if not m:
                break
            at = m.end()
            closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag in _VOID:
                if tag == "br" and node is not None:
                    node.append(" ")
                elif tag not in ("wbr", "img", "input"):
                    node = None
                continue
            if not closing and tag in _SILENT:
                if attrs.rstrip().endswith("/") and tag not in _RAW:
                    continue
                stop = _END_RAW[tag].search(source, at) if tag in _RAW else re.compile(rf"</{tag}\s*>" + ("|<body|<article|<main|<p[ >]" if tag == "head" else ""), re.I).search(source, at)
                if stop:
                    at = stop.start()
                    if source[at : at + 2] == "</":
                        at = (source.find(">", at) + 1) or end
                else:
                    at = end if tag in _RAW else at
                continue
            a = {} if closing else _attributes(attrs)
            if tag == "a":
                link = 0 if closing else len(stack)
            if tag in _INLINE:
                if closing and any(self.tag[x] == "~" + tag for x in stack[-4:]) or not closing and _hidden(a):
                    tag = "~" + tag  # a hidden inline element stands in the tree
                else:
                    continue
            node = None
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                    if tag == "p" and self.tag[stack[k]] in _SCOPE:
                        break
                link = link if link <= len(stack) else 0
                continue
            shut = _CLOSES.get(tag)
            if shut or tag in _ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[k]]
                    if shut and t in shut or t == "p" and tag in _ENDS_P:
                        del stack[k:]
                        break
                    if t in _SCOPE:
                        break
                link = link if link <= len(stack) else 0
            if attrs and attrs.rstrip().endswith("/") and tag not in ("p", "div", "li"):
                continue
            up = stack[-1]
            mark = tag not in ("html", "body") and _landmark(tag, a, self.article[up])
            key = (self.path[up], tag, a.get("class", "").lower(), mark)
            stack.append(len(self.tag))
            self.parent.append(up)
            self.tag.append(tag)
            self.off.append(self.off[up] or _hidden(a))
            self.aside.append(self.aside[up] or mark)
            self.article.append(self.article[up] or tag in ("article", "main"))
            self.path.append(paths.setdefault(key, len(paths) + 1))


def ratios(length: np.ndarray, punct: np.ndarray, path: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """The fused and smoothed ratio of each node's path; length: what the text counts for."""
    _, p = np.unique(path, return_inverse=True)
    count, whole = np.bincount(p), np.bincount(p, length)
    by_len, by_punct = whole / count, np.bincount(p, punct) / count
    x = np.arange(-3, 4)
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()
    smooth = lambda v: np.convolve(np.pad(v, 3, mode="edge"), g, mode="valid")
    own = np.sqrt(by_len * (1 + by_punct))
    around = np.bincount(p, np.sqrt(smooth(by_len[p]) * (1 + smooth(by_punct[p])))) / count
    return (np.sqrt(own * around) * np.log(2 + whole / 100))[p]


def extract(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    texts = [" ".join(H.unescape("".join(t)).split()) for t in page.texts]
    held = [i for i, t in enumerate(texts) if t and not page.off[page.owner[i]]]
    if not held:
        return ""
    owner = [page.owner[i] for i in held]
    prose = np.array([page.tag[k] in _PROSE for k in owner])
    aside = np.array([page.aside[k] for k in owner])
    path = np.array([page.path[k] for k in owner])
    counts = np.where(prose, 1, BARE) * np.where(aside, LANDMARK, 1) * np.where([page.article[k] for k in owner], 2, 1)
    length = np.array([max(0, len(texts[i]) - page.linked[i]) for i in held], float) * counts
    if not length.any():
        return ""
    punct = np.array([len(_PUNCT.findall(texts[i])) for i in held], float)
    fused = ratios(length, punct, path)
    best = int(fused.argmax())
    # the smallest element that holds all nodes of the best path
    root = None
    for i in np.flatnonzero(path == path[best]):
        k = page.parent[owner[i]] if prose[i] and page.parent[owner[i]] >= 0 else owner[i]
        while root is not None and root != k:
            if root > k:
                root = page.parent[root]
            else:
                k = page.parent[k]
        root = k
    inside = [False] * len(page.tag)
    inside[root] = True
    for k in range(root + 1, len(page.tag)):
        inside[k] = inside[page.parent[k]]
    near = np.array([inside[k] for k in owner]) & (~aside | aside[best])
    need = np.where(near, np.where(prose, WITHIN, LOOSE), OUTSIDE)
    return " ".join(texts[i] for i, ok in zip(held, fused >= need * fused[best], strict=True) if ok)


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep's columns, text and n_chars of every page."""
    kept = pages.select(*keep, F.col(html_col).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                own = batch.slice(a, 500)
                out = [extract(x) for x in own.column(own.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=[*keep, "text", "n_chars"])

    return kept.mapInArrow(run, schema)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
