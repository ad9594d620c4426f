"""HTML extraction with a tree-structured graphical model.

A page is parsed into a tree of elements and blocks of text. Every node has a hidden label, content (1) or not (0). A
node's features (kind of element, each word of its class, id and role, depth; of a block its length, link share, last
character and the element it is in) give it a potential; parent and child are joined by a potential that depends on whether the child is a
sectioning or named element or lies right under the body. Sum-product messages, leaves to root and back, give each node's
marginal, exactly; blocks whose marginal is over one half are the page's main text.

All weights are trained from labelled pages: by default pages made here from a grammar of layouts (``labelled``), whose
labels are known by construction; ``train`` takes any labelled pages. The model itself knows no words: what a class or id
says is learned, and one that was never seen says nothing. Node weights are those of a logistic regression; potentials
of pairs are counted. As the tree repeats what a node's own features say, node potentials are raised to the power that
labels most blocks of a quarter of the pages, which the weights weren't fitted on, rightly.

Scripts, styles, comments, the head and form controls have no text. A block ends at block-level tags; ``br`` counts as
white space. Character references are decoded, runs of white space become one space, blocks are joined by one newline.

Defined results: null and empty html give the empty text and n_chars 0; html without any tag is one block of content;
unclosed and stray tags are closed as browsers do, in outline; repeated page_ids give a row each. Extra columns are
kept out.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import fit_sparse_logistic
from .shared import lean, plain_texts, table

#: Fixed values of the language: elements without an end tag, with raw text, within a line, and without page text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object canvas audio video".split())
CONTROLS = frozenset("select option button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset(["p"])
#: An open element that a new one of the same group closes.
CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th"}
SECTIONS = frozenset("article main nav header footer aside form section body menu dialog".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*)(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
POWERS = (0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)
BREAK = re.compile(r"</?(?:p|div|h[1-6]|ul|ol|li|dl|table|article|section|main|nav|header|footer|aside|form|blockquote|body|html)[\s/>]")
LABEL = re.compile(r"data-main\s*=\s*[\"']?([01])")


@dataclass
class Node:
    tag: str  # "" for a block of text
    parent: int
    words: tuple[str, ...] = ()  # of class, id and role
    hidden: bool = False
    depth: int = 0
    text: list[str] = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    label: int | None = None


def parse(page: str) -> list[Node]:
    """Nodes, parents before children, blocks in page order. Node 0 is the root."""
    nodes = [Node("#", -1)]
    stack = [0]
    block = -1  # the block that text goes to
    anchors = 0
    at = 0
    low = page.lower() if len(page.lower()) == len(page) else page  # places must stay
    ahead: dict[str, int] = {}

    def following(what: str) -> int:
        """Place of the next ``what`` (an end tag's beginning, or a break) from here on; the page's end if there is none.
        What was found is kept until it lies behind, so that a page is searched once for each."""
        if ahead.get(what, -1) < at:
            if what:
                k = low.find(f"</{what}", at)
                ahead[what] = k if k >= 0 else len(page)
            else:
                m = BREAK.search(low, at)
                ahead[what] = m.start() if m else len(page)
        return ahead[what]

    def put(text: str) -> None:
        nonlocal block
        if block < 0:
            if not text.strip():
                return
            nodes.append(Node("", stack[-1], depth=len(stack)))
            block = len(nodes) - 1
        nodes[block].text.append(text)
        if anchors:
            nodes[block].linked += len(text)

    def close(where: int) -> None:
        del stack[where:]

    for m in TAG.finditer(page):
        if m.start() < at:
            continue  # inside raw text
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                anchors = max(0, anchors - 1)
            if name in INLINE or name in RAW or name in CONTROLS:
                continue
            block = -1
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == name:
                    close(k)
                    break
            continue
        attributes = m[3]
        if name in RAW:
            end = following(name) if not attributes.endswith("/") else at
            if end < len(page) and end > at - 1 and not attributes.endswith("/"):
                at = end
            elif name in ("script", "style", "textarea", "title") and not attributes.endswith("/"):
                at = len(page)
            if block >= 0:
                nodes[block].text.append(" ")
            continue
        if name in CONTROLS:
            # up to its end or, where that is missing, to the next tag
            end = following(name)
            if end < following(""):
                at = end
            else:
                end = page.find("<", at)
                at = end if end >= 0 else len(page)
            if block >= 0:
                nodes[block].text.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                anchors += 1
            if name in ("br", "img", "wbr") and block >= 0:
                nodes[block].text.append(" " if name == "br" else "")
            continue
        block, anchors = -1, 0
        if name in VOID:
            continue
        if nodes[stack[-1]].tag in CLOSED_BY_BLOCK:
            close(len(stack) - 1)
        ends = CLOSES.get(name)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag in ends.split():
                    close(k)
                    break
                if nodes[stack[k]].tag in ("ul", "ol", "dl", "table"):
                    break
        words: tuple[str, ...] = ()
        if attributes:
            words = tuple(dict.fromkeys(w for v in NAMES.findall(attributes) for w in re.split(r"[\s_\-]+", "".join(v).lower()) if w))[:8]
        nodes.append(Node(name, stack[-1], words, bool(attributes and HIDDEN.search(attributes)), len(stack)))
        label = LABEL.search(attributes) if attributes else None
        if label:
            nodes[-1].label = int(label[1])
        stack.append(len(nodes) - 1)
    if at < len(page):
        put(page[at:])
    for n in nodes:
        if not n.tag:
            n.chars = sum(map(len, n.text))
    return nodes


def block_text(node: Node) -> str:
    return " ".join(entities.unescape("".join(node.text)).split())


def describe(nodes: list[Node]) -> list[list[str]]:
    """Features of each node."""
    out = []
    for n in nodes:
        if n.tag:
            found = ["element", f"tag {n.tag}", f"element depth {min(n.depth, 6)}", *(f"word {w}" for w in n.words)]
            out.append([*found, "hidden"] if n.hidden else found)
        else:
            share = n.linked / n.chars if n.chars else 0
            last = next((t.rstrip()[-1] for t in reversed(n.text) if t.strip()), " ")
            ends = "stop" if last in ".!?。…\"”»" else "word" if last.isalnum() else "other"
            out.append(["block", f"in {nodes[n.parent].tag}", f"length {min(8, int(math.log2(1 + n.chars)))}", f"links {0 if share == 0 else 1 if share < 0.5 else 2}", f"ends {ends}"])
    return out


def joint(child: Node, parent: Node) -> str:
    """What the potential between a child and its parent depends on."""
    if not child.tag:
        return "block"
    if child.tag in SECTIONS or child.words:
        return "section"
    return "top" if parent.tag in ("#", "html", "body") else "part"


class TreeModel:
    """Logarithms of the potentials."""

    def __init__(self, nodes: dict[str, tuple[float, float]], edges: dict[str, tuple[tuple[float, float], tuple[float, float]]], power: float = 1.0) -> None:
        self.nodes = {f: (v[0] * power, v[1] * power) for f, v in nodes.items()}
        self.edges = edges

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's probability of being content, by sum-product up and down the tree."""
        n = len(nodes)
        own0, own1 = [1.0] * n, [1.0] * n
        for i, features in enumerate(describe(nodes)):
            a = b = 0.0
            for f in features:
                x = self.nodes.get(f)
                if x:
                    a += x[0]
                    b += x[1]
            top = max(a, b)
            own0[i], own1[i] = math.exp(a - top), math.exp(b - top)
        # up: a node's belief so far is its own potential times its children's messages
        up0, up1, msg = own0[:], own1[:], [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            (e00, e01), (e10, e11) = self.edges.get(joint(nodes[i], nodes[nodes[i].parent]), ((1.0, 1.0), (1.0, 1.0)))
            m0, m1 = e00 * up0[i] + e01 * up1[i], e10 * up0[i] + e11 * up1[i]
            s = m0 + m1
            m0, m1 = m0 / s, m1 / s
            msg[i] = (m0, m1)
            p = nodes[i].parent
            x, y = up0[p] * m0, up1[p] * m1
            s = max(x, y)
            up0[p], up1[p] = x / s, y / s
        # down: a parent's belief without the child's own message, through the edge
        all0, all1 = up0[:], up1[:]
        for i in range(1, n):
            p = nodes[i].parent
            x, y = all0[p] / max(msg[i][0], 1e-300), all1[p] / max(msg[i][1], 1e-300)
            (e00, e01), (e10, e11) = self.edges.get(joint(nodes[i], nodes[nodes[i].parent]), ((1.0, 1.0), (1.0, 1.0)))
            d0, d1 = up0[i] * (x * e00 + y * e10), up1[i] * (x * e01 + y * e11)
            s = d0 + d1
            all0[i], all1[i] = d0 / s, d1 / s
        return [b / (a + b) for a, b in zip(all0, all1, strict=True)]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        sure = self.marginals(nodes) if any(n.tag for n in nodes[1:]) else [1.0] * len(nodes)
        blocks = [block_text(n) for n, s in zip(nodes, sure, strict=True) if not n.tag and s > 0.5]
        return "\n".join(b for b in blocks if b)


def train(pages: list[str]) -> TreeModel:
    """From pages whose elements carry data-main="1" or "0"; an element without it, and a block, has its parent's
    label, the root 0."""
    edges: dict[str, list[list[float]]] = defaultdict(lambda: [[1.0, 1.0], [1.0, 1.0]])
    trees = [label_all(parse(page)) for page in pages]
    judged = trees[::4]
    number: dict[str, int] = {}
    indices, counts, labels = [], [], []
    for k, nodes in enumerate(trees):
        if k % 4 == 0 and len(trees) > 3:
            continue
        for i, (n, names) in enumerate(zip(nodes, describe(nodes), strict=True)):
            if i:
                edges[joint(n, nodes[n.parent])][nodes[n.parent].label][n.label] += 1
            indices += [number.setdefault(f, len(number)) for f in names]
            counts.append(len(names)), labels.append(n.label)
    w, bias = fit_sparse_logistic(np.concatenate([[0], np.cumsum(counts)]), np.array(indices, np.int64), np.ones(len(indices)), np.array(labels, float), len(number), 1e-6, 800)
    w[[number[f] for f in ("element", "block") if f in number]] += bias
    node = {f: (0.0, float(w[i])) for f, i in number.items()}
    edge = {k: tuple(tuple(c / sum(row) for c in row) for row in rows) for k, rows in edges.items()}
    models = [TreeModel(node, edge, power) for power in POWERS]
    return max(models, key=lambda m: sum(right_blocks(m, nodes) for nodes in judged))


def label_all(nodes: list[Node]) -> list[Node]:
    """Nodes without a label of their own get their parent's, the root 0."""
    for i, n in enumerate(nodes):
        if n.label is None:
            n.label = nodes[n.parent].label if i else 0
    return nodes


def right_blocks(model: TreeModel, nodes: list[Node]) -> int:
    return sum((s > 0.5) == bool(n.label) for n, s in zip(nodes, model.marginals(nodes), strict=True) if not n.tag)


# --- labelled pages ------------------------------------------------------------------------------------------------

#: Names of parts as pages have them in classes and ids, from which the grammar draws.
HINTS = {
    "ad": "ad ads advert advertisement adsense banner sponsor sponsored promo promoted promotion",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip topbar",
    "foot": "footer foot copyright legal colophon",
    "head": "header head masthead logo branding",
    "side": "sidebar side aside widget related recommended trending popular teaser",
    "note": "cookie cookies consent notice alert popup modal overlay gdpr newsletter subscribe signup login paywall",
    "talk": "comment comments reply replies respond discussion disqus reactions",
    "share": "share sharing social tags meta byline toolbar",
    "text": "article content post entry story main text body prose page-content",
}


def labelled(count: int = 1200, seed: int = 3) -> list[str]:
    """Pages of many layouts whose parts' labels are known: an article within any of the usual containers, or none, among
    menus, headers, footers, sidebars, notices, adverts, forms and readers' comments."""
    r = random.Random(seed)
    letters = "etaoinshrdlu"

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(r.randint(a, b))).capitalize() + "."

    def name(*kinds: str) -> str:
        kind = r.choice(kinds)
        word = r.choice(HINTS[kind].split())
        return f' {r.choice(["class", "id"])}="{r.choice(["", "site-", "c1 "])}{word}{r.choice(["", "-box", " wide"])}"'

    def links(a: int, b: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(r.randint(a, b))) + "</ul>"

    def loose(piece: str) -> str:
        """A piece whose own elements carry the label."""
        return re.sub(r"<(p|h1|h2|blockquote|ul|pre|table|div)(?=[ >])", r'<\1 data-main="1"', piece)

    def small() -> str:
        return r.choice([lambda: f"<p>{words(2, 30)}</p>", lambda: words(2, 25), lambda: links(2, 6)])()

    def boiler() -> str:
        return r.choice(
            [
                lambda: f'<nav data-main="0"{r.choice(["", name("nav")])}>{links(3, 9)}</nav>',
                lambda: f'<div data-main="0"{name("ad", "note", "side", "nav", "share", "talk", "foot", "head")}>{small()}</div>',
                lambda: f'<aside data-main="0"{r.choice(["", name("side", "ad")])}><h3>{words(1, 4)}</h3>{small()}</aside>',
                lambda: f'<header data-main="0"><h1>{words(1, 4)}</h1>{r.choice(["", links(2, 6)])}</header>',
                lambda: f'<form data-main="0">{words(1, 8)}<input name="q"><button>{words(1, 1)}</button></form>',
                lambda: f'<section data-main="0"{name("talk", "side", "note")}><h2>{words(1, 3)}</h2>{"".join(f"<div><p>{words(3, 60)}</p></div>" for _ in range(r.randint(1, 5)))}</section>',
                lambda: f'<div data-main="0" {r.choice(["hidden", "style=display:none"])}>{small()}</div>',
                lambda: f'<div data-main="0"{r.choice(["", " class=c7", " id=x12"])}>{links(3, 9)}</div>',
                lambda: f'<ol data-main="0"{name("talk")}>{"".join(f"<li>{words(3, 60)}</li>" for _ in range(r.randint(1, 4)))}</ol>',
            ]
        )()

    def piece() -> str:
        return r.choice(
            [
                *[lambda: f"<p>{words(4, 120)}</p>"] * 6,
                lambda: f"<p><b>{words(4, 60)}<br><p>{words(3, 40)}</p>",
                lambda: f"<p>{words(3, 40)} <a href='/y'>{words(1, 4)}</a> {words(2, 30)}</p>",
                lambda: f"<h2>{words(1, 6)}</h2>",
                lambda: f"<blockquote><p>{words(5, 40)}</p></blockquote>",
                lambda: "<ul>" + "".join(f"<li>{words(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
                lambda: f"<pre>{words(3, 20)}</pre>",
                lambda: f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>",
                lambda: f"<div>{words(5, 60)}</div>",
                lambda: f"<p>{words(1, 4)}</p>",
            ]
        )()

    pages = []
    for _ in range(count):
        inside = f"<h1>{words(1, 12)}</h1>" * (r.random() < 0.8) + "".join(piece() if r.random() > 0.06 else boiler() for _ in range(r.choice([0, 1, r.randint(1, 14), r.randint(1, 14)])))
        container = r.choice([*["article"] * 5, "main", "div", "section", *["plain", "body", "loose"] * 2])
        if container == "loose":  # no container at all, with or without the other parts and the page's own elements
            own = loose("".join(piece() for _ in range(r.randint(1, 8))))
            around = r.random() < 0.6
            own = "".join(boiler() for _ in range(r.randint(0, 2) * around)) + own + (f'<footer data-main="0">&copy; {words(1, 5)}</footer>' if around else "")
            pages.append(own if r.random() < 0.5 else f"<html><head><title>{words(1, 6)}</title></head><body>{own}</body></html>")
            continue
        hint = name("text") if container in ("div", "section") or container != "plain" and r.random() < 0.3 else ""
        tag = "div" if container == "plain" else container
        body = inside if container == "body" else f'<{tag} data-main="1"{hint}>{inside}</{tag}>'
        if r.random() < 0.3:
            body = f"<div{r.choice(['', ' class=container', ' id=wrap'])}>{boiler() * (r.random() < 0.5)}{body}{boiler() * (r.random() < 0.5)}</div>"
        foot = f'<footer data-main="0">&copy; {words(1, 5)} &middot; {words(2, 30)}</footer>' if r.random() < 0.85 else ""
        before = "".join(boiler() for _ in range(r.randint(0, 3)))
        after = "".join(boiler() for _ in range(r.randint(0, 2)))
        main = ' data-main="1"' * (container == "body")
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title></head><body{main}>{before}{body}{after}{foot}</body></html>")
    return pages


_default: list[TreeModel] = []


def default_model() -> TreeModel:
    if not _default:
        _default.append(train(labelled()))
    return _default[0]


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                texts = [model.extract(t.as_py()) for t in plain_texts(batch.column(2).slice(a, 500))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 500), batch.column(1).slice(a, 500), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
