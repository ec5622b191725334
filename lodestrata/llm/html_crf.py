"""HTML extraction by a tree-structured graphical model.

A page's markup is read into a tree of nodes (elements; inline ones without a name of their own join their block). Each node has a
hidden label, content or not. Its features give a unary potential, each edge a potential for parent's and child's labels that
depends on the child's kind. Sum-product messages go up from the leaves and down from the root, and give exact marginals; texts of
nodes with a marginal of at least one half are the article. The weights maximise the likelihood of labelled pages (made by the
seeded templates of labelled_pages.py), with gradients from the same messages. A batch's trees are worked together, level by level.

Text: character references are decoded, white space in a block becomes one blank, the ends are trimmed, blocks are joined in page
order by one blank; inline tags join what they separate.

Cases: null or empty markup gives empty text, as does a page without text; markup that breaks off, is never closed, or is wrongly
nested, is read as far as it goes, in linear time; a tag that the page breaks off is no text; the model labels the text of math, object, noscript and svg like any other; text outside all elements belongs to the root; a null page_id or url stays null; pages that
repeat are each reported; very long pages are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import with_results
from lodestrata.llm.labelled_pages import is_content, pages

#: Labelled pages to train on.
TRAINED_ON = 700
#: A tag: a quote counts behind "=" if there is another of its kind; no part is read twice, so a page is read in linear time.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>")
#: The same without quotes, for a page with a tag that quotes keep open to its end.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of HTML: elements without an end, whose text is not shown (RAW ones hold no tags, and reach to the page's end where
#: theirs is missing), that flow within a line, and that a sibling ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())
HIDDEN = RAW | frozenset("template head desc metadata annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var object noscript tspan math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HOLDS_P = (ENDS_P - {"p"}) | frozenset("td th li dd body".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Kinds of elements, and of parts of class, id and role names, that are features.
TAGS = {
    "article": "article", "main": "main", "section": "section", "div": "div", "p": "p", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl menu", "item": "li dt dd", "table": "table thead tbody tr td th caption",
    "nav": "nav", "header": "header hgroup", "footer": "footer", "aside": "aside", "form": "form button input select option label fieldset legend output datalist", "figure": "figure figcaption picture", "quote": "blockquote pre", "page": "html body", "link": "a",
}
NAMES = {
    "content": "article content post entry story main body text prose", "menu": "nav navbar menu breadcrumb breadcrumbs navigation toc pagination pager topnav", "header": "header masthead topbar logo branding site", "footer": "footer copyright legal bottom colophon",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner adslot", "notice": "notice cookie cookies consent alert gdpr popup modal newsletter subscribe privacy overlay dialog alertdialog banner", "comment": "comment comments commentlist reply replies respond response responses discussion disqus",
    "side": "sidebar side widget rail aside complementary", "related": "related recommended recommendations popular trending share social sharing tags", "form": "form search login signup contact",
}
#: Words that stand around articles in short texts.
CUE = re.compile(r"&copy;|©|\b(?:copyright|rights reserved|terms of|privacy|impressum|mentions légales|rechte vorbehalten|droits réservés|derechos reservados|datenschutz|advertisement|sponsored|anzeige|werbung|publicité|publicidad|cookies?|newsletter|subscribe|sign (?:up|in)|log ?in|related|read more|most popular|share this|follow us|recommended|comments?|reply|kommentare?|commentaires?|comentarios?)\b", re.I)
CUE_WITHIN = 240
TAG_OF = {t: k for k, (_, ts) in enumerate(TAGS.items()) for t in ts.split()}
NAME_OF: dict[str, list[int]] = {}
for _k, _words in enumerate(NAMES.values()):
    for _w in _words.split():
        NAME_OF.setdefault(_w, []).append(_k)
N_TAGS, N_NAMES = len(TAGS), len(NAMES)
#: Own tag and names; the same of all nodes above (nearest to furthest alike); then measures.
MEASURES = ("own_length", "own_links", "all_length", "all_links", "stops", "paragraphs", "share", "place", "depth", "elsewhere", "empty", "own_cues", "all_cues")
WIDTH = 2 * (N_TAGS + N_NAMES) + len(MEASURES) + 1
KINDS = 4


class Tree:
    """Nodes of one page: parent, tag and names of each; texts as (node, text, whether a block begins before it, whether in a link)."""

    __slots__ = ("parent", "tag", "names", "texts")

    def __init__(self, markup: str):
        self.parent, self.tag, self.names, self.texts = [-1], [""], [()], []
        stack: list[tuple[str, int]] = [("", 0)]  # element, its node
        where: dict[str, list[int]] = {}  # of each open element its places in the stack, so that no search goes through it
        in_link, fresh, pos, end = 0, True, 0, len(markup)
        last, tag_at, unended = markup.rfind(">"), TAG.match, set()
        texts = self.texts

        def close(at: int) -> None:
            nonlocal in_link
            while len(stack) > at:
                name, _ = stack.pop()
                where[name].pop()
                in_link -= name == "a"

        def nearest(names) -> int:
            return max((where[n][-1] for n in names if where.get(n)), default=0)

        while pos < end:
            at = markup.find("<", pos)
            if at != pos:
                texts.append((stack[-1][1], markup[pos:at] if at >= 0 else markup[pos:], fresh, in_link > 0))
                fresh = False
                if at < 0:
                    break
            c = markup[at + 1 : at + 3]
            if c[:1] in ("!", "?") or (c[:1] == "/" and not c[1:2].isalpha()):
                comment = markup.startswith("<!--", at)
                pos = markup.find("-->" if comment else ">", at + 2)
                pos = end if pos < 0 else pos + (3 if comment else 1)
                continue
            if not (c[:1].isascii() and c[:1].isalpha()) and not (c[:1] == "/" and c[1:2].isascii()):
                texts.append((stack[-1][1], "<", fresh, in_link > 0))
                fresh, pos = False, at + 1
                continue
            if at > last:  # a tag that the page breaks off is no text
                break
            m = tag_at(markup, at)
            if m is None:
                tag_at = PLAIN_TAG.match
                m = tag_at(markup, at)
            pos = m.end()
            name = m[2].lower()
            if m[1]:
                if where.get(name):
                    k = where[name][-1]
                    fresh = fresh or any(s[0] not in INLINE for s in stack[k:])
                    close(k)
                continue
            if name in HIDDEN:
                if name == "head":
                    pos = self.skip_head(markup, pos, unended)
                elif not m[3].endswith("/"):
                    found = None if name in unended else re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+>?", re.I).search(markup, pos)
                    if found is None:
                        unended.add(name)
                    pos = found.end() if found else end if name in RAW else pos
                continue
            if name in VOID:
                fresh = fresh or name in ("br", "hr")
                continue
            if name in ENDS_P or name in ENDED_BY:
                ended, holds = ({"p"} if name in ENDS_P else set()) | ENDED_BY.get(name, set()), HOLDS.get(name, HOLDS_P)
                while (k := nearest(ended)) and k > nearest(holds):
                    close(k)
                    if name not in ENDED_BY:
                        break
            block = name not in INLINE
            fresh = fresh or block or name in ("mtr", "mtd")
            in_link += name == "a"
            attributes = m[3]
            named: tuple[int, ...] = ()
            if attributes and ("=" in attributes):
                parts = {p.lower() for a in ATTRIBUTE.finditer(attributes) for p in NAME_PART.findall(a[1] or a[2] or a[3] or "")}
                named = tuple(sorted({k for p in parts for k in NAME_OF.get(p, ())}))
            node = stack[-1][1]
            if block or named:
                self.parent.append(node)
                self.tag.append(name)
                self.names.append(named)
                node = len(self.parent) - 1
            where.setdefault(name, []).append(len(stack))
            stack.append((name, node))

    @staticmethod
    def skip_head(markup: str, pos: int, unended: set[str]) -> int:
        """Past the head: to its end, or to the body where it has none."""
        m = None if "head" in unended else re.compile(r"</head\s*+>|(?=<body[\s>])", re.I).search(markup, pos)
        if m is None:
            unended.add("head")
        return m.end() if m else pos


def tree_features(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, parent, depth and kind (for the edge to the parent) of each node."""
    n = len(tree.parent)
    own, linked, stops, seen_before = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    cues, at, first = np.zeros(n), 0.0, np.full(n, -1.0)
    for node, text, _, link in tree.texts:
        k = len(text) if len(text) < 40 else len(text.strip())
        if k < 40:
            k = len(text.strip())
        if not k:
            continue
        own[node] += k
        stops[node] += text.count(".") + text.count(",")
        if link:
            linked[node] += k
        if k < CUE_WITHIN and CUE.search(text):
            cues[node] += 1
        if first[node] < 0:
            first[node] = at
        at += k
    total, all_linked, all_cues, paragraphs = own.copy(), linked.copy(), cues.copy(), np.zeros(n)
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        total[p] += total[k]
        all_linked[p] += all_linked[k]
        all_cues[p] += all_cues[k]
        paragraphs[p] += tree.tag[k] == "p"
        if first[k] >= 0 and (first[p] < 0 or first[k] < first[p]):
            first[p] = first[k]
    x = np.zeros((n, WIDTH))
    depth, kind = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    above = N_TAGS + N_NAMES
    has_article = any(t in ("article", "main") for t in tree.tag)
    for k in range(n):
        p, t = tree.parent[k], TAG_OF.get(tree.tag[k], -1)
        if t >= 0:
            x[k, t] = 1
        for j in tree.names[k]:
            x[k, N_TAGS + j] = 1
        if p >= 0:
            depth[k] = depth[p] + 1
            x[k, above : 2 * above] = np.maximum(x[p, :above], x[p, above : 2 * above])
        kind[k] = 0 if tree.tag[k] in ("p", "li", "td", "th", "blockquote", "pre", "dd", "dt") else 1 if t == 5 else 2 if tree.names[k] or t in (0, 1, 9, 10, 11, 12, 13) else 3
    whole = max(total[0], 1.0)
    m = 2 * above
    x[:, m] = np.minimum(np.log1p(own) / 6, 1.5)
    x[:, m + 1] = linked / np.maximum(own, 1)
    x[:, m + 2] = np.minimum(np.log1p(total) / 8, 1.5)
    x[:, m + 3] = all_linked / np.maximum(total, 1)
    x[:, m + 4] = np.minimum(stops / np.maximum(own, 20) * 20, 2)
    x[:, m + 5] = np.minimum(paragraphs, 5) / 5
    x[:, m + 6] = total / whole
    x[:, m + 7] = np.maximum(first, 0) / whole
    x[:, m + 8] = np.minimum(depth, 10) / 10
    inside = (x[:, :2].max(axis=1) + x[:, above : above + 2].max(axis=1)) > 0
    x[:, m + 9] = has_article & ~inside
    x[:, m + 10] = own == 0
    if not inside.any():  # an article that tags or names mark may hold such words; only bare pages need them
        x[:, m + 11] = np.minimum(cues, 1)
        x[:, m + 12] = np.minimum(all_cues * 200 / np.maximum(total, 100), 1.5)
    x[:, -1] = 1
    return x, np.asarray(tree.parent), depth, kind


def stacked(trees: list[Tree]):
    """The features of many trees as one forest."""
    parts = [tree_features(t) for t in trees]
    base = np.concatenate([[0], np.cumsum([len(p[1]) for p in parts])])
    parent = np.concatenate([np.where(p[1] >= 0, p[1] + b, -1) for p, b in zip(parts, base[:-1], strict=True)])
    return np.vstack([p[0] for p in parts]), parent, np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]), base


def messages(unary: np.ndarray, edge: np.ndarray, parent: np.ndarray, depth: np.ndarray, kind: np.ndarray):
    """Sum-product over a forest: node marginals of label 1, and of each node's edge the marginals (parent's label, its own)."""
    n = len(parent)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    local = np.zeros((n, 2))
    local[:, 1] = unary
    up = np.zeros((n, 2))
    for level in levels[:0:-1]:  # leaves first; local gathers what comes from below
        t = edge[kind[level]] + local[level][:, None, :]
        up[level] = np.logaddexp(t[:, :, 0], t[:, :, 1])
        np.add.at(local, parent[level], up[level])
    belief, pair = local.copy(), np.zeros((n, 2, 2))
    for level in levels[1:]:
        cavity = belief[parent[level]] - up[level]
        t = cavity[:, :, None] + edge[kind[level]]
        belief[level] = local[level] + np.logaddexp(t[:, 0], t[:, 1])
        joint = t + local[level][:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        pair[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair


@dataclass
class Model:
    weights: np.ndarray
    edge: np.ndarray

    def marginals(self, trees: list[Tree]) -> list[np.ndarray]:
        x, parent, depth, kind, base = stacked(trees)
        p, _ = messages(x @ self.weights, self.edge, parent, depth, kind)
        return [p[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]


def node_labels(tree: Tree) -> np.ndarray:
    """Labels of a generated page's nodes: content if their own text is, or, without text, if most below them is."""
    y = np.full(len(tree.parent), -1)
    mass = np.zeros((len(tree.parent), 2))
    for node, text, _, _ in tree.texts:
        if text.strip():
            mass[node, int(is_content(text))] += len(text)
    own = mass.sum(axis=1) > 0
    y[own] = mass[own, 1] > mass[own, 0]
    for k in range(len(y) - 1, 0, -1):
        mass[tree.parent[k]] += mass[k]
    y[~own] = mass[~own, 1] > 0.8 * mass[~own].sum(axis=1)
    return y


def fit(markups: list[str], steps: int = 250, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """Adam on the mean log likelihood of the labelled trees."""
    trees = [Tree(m) for m in markups]
    x, parent, depth, kind, _ = stacked(trees)
    y = np.concatenate([node_labels(t) for t in trees])
    child = np.flatnonzero(parent >= 0)
    n = len(y)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (kind[child], y[parent[child]], y[child]), 1)
    w, e = np.zeros(x.shape[1]), np.zeros((KINDS, 2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(e), np.zeros_like(e)]
    for t in range(1, steps + 1):
        p, pair = messages(x @ w, e, parent, depth, kind)
        expected = np.zeros_like(e)
        np.add.at(expected, kind[child], pair[child])
        for at, (value, g) in enumerate(((w, (x.T @ (p - y)) / n + ridge * w), (e, (expected - seen) / n + ridge * e))):
            a, b = moments[2 * at], moments[2 * at + 1]
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            value -= rate * (1 - 0.8 * t / steps) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-9)
    return Model(w, e)


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(pages(TRAINED_ON))


def assembled(tree: Tree, keep: np.ndarray) -> str:
    out, began = [], False
    for node, text, fresh, _ in tree.texts:
        began = began or fresh
        if keep[node]:
            if began:
                out.append(" ")
            out.append(text if "&" not in text else html.unescape(text))
            began = False
    return " ".join("".join(out).split())


def extract_texts(markups: list[str | None], model: Model) -> list[str]:
    full = [k for k, m in enumerate(markups) if m]
    out = [""] * len(markups)
    if full:
        trees = [Tree(markups[k]) for k in full]
        for k, tree, p in zip(full, trees, model.marginals(trees), strict=True):
            out[k] = assembled(tree, p >= 0.5)
    return out


def extract(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    model = model or default_model()

    def run(markups: list[str | None]) -> dict[str, pa.Array]:
        texts = extract_texts(markups, model)
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    pages_in = rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    return with_results(pages_in, "html", "text string, n_chars long", lambda: run)
