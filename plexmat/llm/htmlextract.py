"""Main-text extraction with a tree-structured graphical model over the DOM.

A page becomes a tree of block elements whose leaves are text runs. Every node has a binary label (content or not), a unary
potential from its own features (tag, class and id words, length, links, punctuation) and a pairwise potential with its
parent; one upward and one downward sum-product pass gives every node's content marginal. Unary weights
(maximum likelihood through the same marginals) and pairwise potentials (smoothed label counts) are trained from ``LABELLED_PAGES``,
pages whose content is marked by ``data-content`` attributes; more such pages can be given.

Leaves with a marginal above one half are the main text: character references decoded, white space (``<br>`` included) turned into
one space, trimmed, and joined by an empty line in page order.

Edge cases: a null or empty page, or one without text, gives '' and 0; broken markup is read as far as it goes (open ``<p>`` and
``<li>`` end at the next block, unknown end tags are skipped, an unclosed script, style, comment or tag runs to the end, of any other raw element
without an end only the tag is skipped); ``data-content`` has no meaning outside training pages; a page takes time linear in its length; repeated rows
and null ids are returned as they are; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Raw elements whose content is never text of the page, and elements without content.
RAW = "script|style|noscript|template|iframe|svg|math|textarea|select|title|object|canvas|audio|video"
#: Raw elements that may end in their own tag, those that may stand in themselves, and those that run to the end of the page if nothing ends them.
SELF_CLOSED, NESTED, ENDLESS = frozenset(["svg", "math"]), frozenset(["svg", "math", "template", "object"]), frozenset(["script", "style"])
VOID = frozenset("br hr img input meta link wbr area base col embed source track param".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th caption nav header footer aside "
    "form fieldset figure figcaption blockquote pre address details summary hgroup menu center dialog head button label".split())  # fmt: skip
CLOSES_P = BLOCK - {"button", "label", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "body", "html", "head"}
#: Where a comment, a declaration or a tag begins, and the rest of a tag whose quotes are closed.
START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
RAW_NAMES = frozenset(RAW.split("|"))
RAW_START = {n: re.compile(rf"</{n}\s*>|<{n}(?=[\s/>])", re.I) for n in RAW_NAMES}
ATTRIBUTE = re.compile(r"\b(class|id|role|data-content|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")

#: Word classes of class, id and role attributes.
KEYWORDS: dict[str, frozenset[str]] = {
    "content": frozenset("article content post entry story main body text prose single page detail hentry articlebody maincontent".split()),
    "menu": frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc sitemap skip toolbar topbar".split()),
    "header": frozenset("header masthead banner logo branding hero site title".split()),
    "footer": frozenset("footer foot copyright legal colophon bottom contentinfo credits imprint".split()),
    "sidebar": frozenset("sidebar aside rail widget widgets related recommended recommendations popular trending tags complementary teaser more".split()),
    "notice": frozenset("cookie cookies consent gdpr notice alert warning popup modal overlay dialog newsletter subscribe signup subscription paywall privacy message toast".split()),
    "advert": frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense adbox adslot banner commercial affiliate".split()),
    "form": frozenset("form search login register contact input field searchbox searchform captcha".split()),
    "comment": frozenset("comment comments discussion disqus reply replies respond reader feedback thread reviews review commentlist".split()),
    "share": frozenset("share sharing social follow facebook twitter print buttons".split()),
}
TAGS: dict[str, frozenset[str]] = {
    "article": frozenset(["article", "main"]), "nav": frozenset(["nav", "menu"]), "header": frozenset(["header", "hgroup"]),
    "footer": frozenset(["footer", "address"]), "aside": frozenset(["aside"]), "form": frozenset(["form", "fieldset", "button", "label", "dialog"]),
    "prose": frozenset(["p", "blockquote", "pre", "figcaption"]), "heading": frozenset(["h1", "h2", "h3", "h4", "h5", "h6"]),
    "list": frozenset(["ul", "ol", "li", "dl", "dt", "dd"]), "table": frozenset("table tbody thead tfoot tr td th caption".split()),
    "box": frozenset(["div", "section", "center", "details", "summary", "figure"]),
}
NAMES = [f"tag:{t}" for t in TAGS] + [f"word:{k}" for k in KEYWORDS] + ["leaf", "long", "links", "punctuation", "copyright", "top", "hidden", "bias"]
AT = {n: i for i, n in enumerate(NAMES)}
TAG_AT = {t: AT[f"tag:{k}"] for k, ts in TAGS.items() for t in ts}
WORD_AT: dict[str, list[int]] = {}
for _k, _ws in KEYWORDS.items():
    for _w in _ws:
        WORD_AT.setdefault(_w, []).append(AT[f"word:{_k}"])


class Node:
    __slots__ = ("tag", "parent", "words", "label", "hidden", "text", "linked", "size", "order", "parts", "depth")

    def __init__(self, tag: str, parent: int, depth: int):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.words: list[int] = []
        self.label: int | None = None
        self.hidden = False
        self.text, self.linked, self.size = "", 0, 0
        self.parts: list[tuple[str, bool]] = []


class TagEnds:
    """Where tags end: at the first ``>`` outside quotes. Once a tag's quotes stay open to the end of the page, tags end at their first ``>``.

    No part of a page is read again and again, whatever its tags look like.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def after(self, at: int) -> int:
        """The place after the ``>`` of the tag whose name ends at ``at``; -1 if there is none."""
        if at > self.last:
            return -1
        if self.quotes:
            m = QUOTED.match(self.page, at)
            if m:
                return m.end()
            self.quotes = False
        return self.page.index(">", at) + 1


class RawEnds:
    """Where the raw elements of a page end; each kind of tag is looked for once."""

    def __init__(self, page: str):
        self.page = page
        self.paired: dict[str, dict[int, int]] = {}
        self.ends: dict[str, list[tuple[int, int]]] = {}

    def pairs(self, name: str) -> dict[int, int]:
        """Start of each element that may stand in itself -> end of its own end tag."""
        tags, begun, at, out = TagEnds(self.page), [], 0, {}
        while m := RAW_START[name].search(self.page, at):
            at = m.end()
            if m[0][1] == "/":
                if begun:
                    out[begun.pop()] = at
                continue
            end = tags.after(at)
            if end < 0:
                break
            at = end
            if name not in SELF_CLOSED or self.page[end - 2] != "/":
                begun.append(m.start())
        return out

    def after(self, name: str, start: int, end: int) -> int:
        """The end of the raw element whose start tag reaches from ``start`` to ``end``."""
        if name in SELF_CLOSED and self.page[end - 2] == "/":
            return end
        if name in NESTED:
            if name not in self.paired:
                self.paired[name] = self.pairs(name)
            return self.paired[name].get(start, end)
        if name not in self.ends:
            self.ends[name] = [tag.span() for tag in re.finditer(rf"</{name}\s*>", self.page, re.I)]
        k = bisect_left(self.ends[name], (end, 0))
        if k < len(self.ends[name]):
            return self.ends[name][k][1]
        return len(self.page) if name in ENDLESS else end


class Open:
    """The open elements, with the places of each tag, so that the nearest of some tags is known at once."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack = nodes, [0]
        self.places: dict[str, list[int]] = {}

    def nearest(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, i: int) -> None:
        self.places.setdefault(self.nodes[i].tag, []).append(len(self.stack))
        self.stack.append(i)

    def cut(self, k: int) -> None:
        """Close everything from place k on."""
        while len(self.stack) > k:
            self.places[self.nodes[self.stack.pop()].tag].pop()


#: Elements inside which an open paragraph further out isn't closed, and what a list item or a cell closes and stops at.
HOLDS_P = ("div", "section", "article", "td", "li", "body")
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}


def parse(page: str, labelled: bool = True) -> list[Node]:
    """Nodes in page order, parents first; text runs are leaves with the tag ''. Marks count in labelled pages only."""
    nodes = [Node("", -1, 0)]
    nodes[0].tag = "html"
    opened, links, run = Open(nodes), 0, []

    def flush() -> None:
        if not run:
            return
        raw = "".join(t for t, _ in run)
        if raw.strip():
            text = " ".join((html_lib.unescape(raw) if "&" in raw else raw).split())
            if text:
                leaf = Node("", opened.stack[-1], len(opened.stack))
                leaf.text, leaf.size = text, len(text)
                leaf.linked = min(len(text), sum(len(t.strip()) for t, linked in run if linked))
                nodes.append(leaf)
        run.clear()

    at, tags, raw_ends = 0, TagEnds(page), RawEnds(page)
    while m := START.search(page, at):
        if m.start() > at:
            run.append((page[at : m.start()], links > 0))
        name = m[2]
        if name is None:
            closing = page.find("-->" if m[0] == "<!--" else ">", m.end())
            at = len(page) if closing < 0 else closing + (3 if m[0] == "<!--" else 1)
            continue
        name, end = name.lower(), tags.after(m.end())
        if end < 0:  # a tag that never ends
            at = len(page)
            break
        attributes = page[m.end() : end - 1]
        at = raw_ends.after(name, m.start(), end) if name in RAW_NAMES and not m[1] else end
        if name not in BLOCK:
            if name == "br":
                run.append((" ", False))
            elif name == "hr":
                flush()
            elif name == "a":
                links = max(0, links - 1) if m[1] else links + 1
            continue
        flush()
        if m[1]:
            k = opened.nearest((name,))
            if k > 0:
                opened.cut(k)
            continue
        links = 0 if name in CLOSES_P and name != "li" else links
        if name in CLOSES_P:
            k = opened.nearest(("p",))
            if k > opened.nearest(HOLDS_P):
                opened.cut(k)
        if name in CLOSES:
            alike, stop = CLOSES[name]
            k = opened.nearest(alike)
            if k > opened.nearest(stop):
                opened.cut(k)
        node = Node(name, opened.stack[-1], len(opened.stack))
        if attributes:
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), (a or b or c).lower()
                if key == "data-content":
                    if labelled:
                        node.label = int(value == "1")
                elif key in ("class", "id", "role"):
                    for w in WORD.findall(value):
                        node.words += WORD_AT.get(w, ())
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                    node.hidden = True
        nodes.append(node)
        opened.push(len(nodes) - 1)
    if at < len(page):
        run.append((page[at:], links > 0))
    flush()
    for n in reversed(nodes):
        if n.parent >= 0:
            nodes[n.parent].size += n.size
            nodes[n.parent].linked += n.linked
    return nodes


def active(n: Node, total: int) -> list[tuple[int, float]]:
    """The node's non-zero features."""
    out = [(AT["bias"], 1.0)]
    if not n.tag:
        out.append((AT["leaf"], 1.0))
        end = n.text[-1]
        if end in ".!?:;\"'»”…":
            out.append((AT["punctuation"], 1.0))
        if "©" in n.text or "all rights reserved" in n.text.lower():
            out.append((AT["copyright"], 1.0))
    elif n.tag in TAG_AT:
        out.append((TAG_AT[n.tag], 1.0))
    for w in set(n.words):
        out.append((w, 1.0))
    if n.hidden:
        out.append((AT["hidden"], 1.0))
    out.append((AT["long"], min(1.0, math.log1p(n.size) / 7)))
    if n.size:
        out.append((AT["links"], n.linked / n.size))
    if n.depth <= 2 and n.tag in ("html", "body") and total:
        out.append((AT["top"], 1.0))
    return out


class TreeModel:
    """Unary weights and pairwise potentials; ``marginals`` runs sum-product on a tree."""

    def __init__(self, weights: np.ndarray, pair: dict[bool, list[list[float]]]):
        self.weights, self.pair = weights.tolist(), pair

    def marginals(self, nodes: list[Node]) -> list[float]:
        total, w = nodes[0].size, self.weights
        n = len(nodes)
        unary = [sum(w[i] * v for i, v in active(x, total)) for x in nodes]
        # log messages as the ratio content : other
        up, inside = [0.0] * n, list(unary)
        for i in range(n - 1, 0, -1):
            (a00, a01), (a10, a11) = self.pair[not nodes[i].tag]  # a[parent][child]
            s = math.exp(min(inside[i], 500.0))
            up[i] = math.log((a10 + a11 * s) / (a00 + a01 * s))
            inside[nodes[i].parent] += up[i]
        belief = list(inside)
        for i in range(1, n):
            (a00, a01), (a10, a11) = self.pair[not nodes[i].tag]
            cavity = belief[nodes[i].parent] - up[i]
            s = math.exp(max(-500.0, min(cavity, 500.0)))
            belief[i] = inside[i] + math.log((a01 + a11 * s) / (a00 + a10 * s))
        return [1 / (1 + math.exp(-max(-500.0, min(b, 500.0)))) for b in belief]


def labels(nodes: list[Node]) -> list[int]:
    """Labels of a marked page: leaves inherit the nearest mark, an element is content if most of its text is."""
    own: list[int] = []
    for x in nodes:
        own.append(x.label if x.label is not None else (own[x.parent] if x.parent >= 0 else 0))
    good = [x.size if not x.tag and own[i] else 0 for i, x in enumerate(nodes)]
    for i in range(len(nodes) - 1, 0, -1):
        good[nodes[i].parent] += good[i]
    return [own[i] if not x.tag or not x.size else int(2 * good[i] > x.size) for i, x in enumerate(nodes)]


def train(pages: list[str], rounds: int = 200, penalty: float = 0.02) -> TreeModel:
    """Fit the model on pages whose content is marked."""
    parsed = [(nodes, labels(nodes)) for nodes in map(parse, pages)]
    pair = {}
    for leaf in (False, True):
        c = np.full((2, 2), 0.5)
        for nodes, y in parsed:
            for i, x in enumerate(nodes[1:], 1):
                if (not x.tag) == leaf:
                    c[y[x.parent], y[i]] += 1
        joint = c / c.sum()
        pair[leaf] = (joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True)).tolist()  # association only
    features = []
    for nodes, _ in parsed:
        f = np.zeros((len(nodes), len(NAMES)))
        for i, x in enumerate(nodes):
            for k, v in active(x, nodes[0].size):
                f[i, k] = v
        features.append(f)
    # maximum likelihood of the labels: the gradient is labels minus sum-product marginals (Adam steps)
    w, mean, square = (np.zeros(len(NAMES)) for _ in range(3))
    for t in range(1, rounds + 1):
        model = TreeModel(w, pair)
        gradient = -penalty * w
        for (nodes, y), f in zip(parsed, features, strict=True):
            gradient += f.T @ (np.array(y, float) - np.array(model.marginals(nodes)))
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w = w + 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return TreeModel(w, pair)


def main_text(page: str | None, model: TreeModel) -> str:
    if not page:
        return ""
    nodes = parse(page, labelled=False)
    marginal = model.marginals(nodes)
    return "\n\n".join(x.text for x, p in zip(nodes, marginal, strict=True) if not x.tag and p > 0.5)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", extra_pages: list[str] = ()) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    from plexmat.llm.labelledpages import LABELLED_PAGES

    model = train([*LABELLED_PAGES, *extra_pages])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, model) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
