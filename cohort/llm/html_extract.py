"""Main text of pages by a tree-structured graphical model.

The nodes are a page's block elements and text segments, each content or not.
Node potentials come from the element's name and the words of its class, id and
role, and from a segment's length, link share and punctuation; parent-child
potentials (one table for elements, one for segments) connect the DOM. One
upward and one downward sweep of sum-product messages give every node's exact
content marginal, level by level for all pages of a chunk at once; segments
with at least one half are the text.

Training pages: ``sample_pages`` pages that say themselves where their article
is (an article or main element; lowest hash first), each as it is and in
``variants`` rebuilt forms in which the names are replaced by plain or classed
divs and menus, notices, adverts, forms, sidebars and reader comments are added
from the lists below, so that all segments' labels are known. The tree's
log-likelihood is maximised by Adagrad on the driver; the model is a table of
a few hundred weights.

Pages are handled where they lie, no shuffle. Defined results: null, empty or
text-free pages give the empty text; repeated rows give the same text; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import chunks, map_arrow
from cohort.llm.dom import Tree, parse

_WORD = re.compile(r"[a-z]+")
_NAMED = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_LABEL = re.compile(r"""x-content="([01])\"""")

# Names that pages give to their parts, for the rebuilt forms.
CONTENT_NAMES = ("content", "post", "entry", "story", "article body", "main text", "post content",
                 "page main", "entry content", "")
OTHER_NAMES = {
    "nav": ("nav", "menu", "navbar", "navigation", "breadcrumb", "topbar", "links", "pagination"),
    "header": ("header", "masthead", "site header", "banner", "branding", "logo"),
    "footer": ("footer", "site footer", "copyright", "bottom", "colophon", "legal"),
    "aside": ("sidebar", "aside", "widget", "related", "recommended", "trending", "popular"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion"),
    "notice": ("notice", "cookie", "consent", "gdpr", "alert", "popup", "modal", "warning",
               "newsletter", "subscribe", "banner notice"),
    "form": ("form", "search", "login", "signup", "contact", "subscribe form"),
    "comments": ("comments", "comment list", "comment", "reply", "respond", "discussion", "disqus",
                 "disqus thread", "comment section", "responses", "user comments"),
    "share": ("share", "social", "sharing", "follow", "tags", "meta"),
}


@dataclass(frozen=True)
class Params:
    sample_pages: int = 150
    variants: int = 3
    steps: int = 80
    rate: float = 0.3
    ridge: float = 1e-4
    cache_names: int = 50_000


# -- features -----------------------------------------------------------------

def element_features(tag: str, attrs: str) -> list[str]:
    out = [f"tag:{tag}"]
    if attrs:
        words = {w for m in _NAMED.finditer(attrs) for w in _WORD.findall(m.group(1).lower())}
        out += [f"name:{w}" for w in sorted(words)[:24]]
    return out


def segment_features(text: str, link: int) -> list[str]:
    n = len(text)
    out = [f"len:{min(10, n.bit_length())}", f"link:{min(4, 5 * link // max(1, n))}",
           f"dots:{min(4, sum(map(text.count, '.!?')))}",
           f"end:{text[-1] in '.!?:;…”\"'}"]
    if "©" in text or text[:9].lower() == "copyright":
        out.append("mark:©")
    elif "|" in text:
        out.append("mark:|")
    return out


# -- sum-product --------------------------------------------------------------

def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Forest:
    """Trees side by side: parents, levels and the kind of each edge."""

    def __init__(self, trees: list[Tree]):
        sizes = np.array([len(t.parent) for t in trees], np.int64)
        base = np.cumsum(sizes) - sizes
        self.parent = np.concatenate([np.asarray(t.parent, np.int64) + b
                                      for t, b in zip(trees, base)])
        depth = np.concatenate([np.asarray(t.depth, np.int64) for t in trees])
        self.segment = np.concatenate([np.fromiter((not x for x in t.tag), bool, len(t.tag))
                                       for t in trees])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.nonzero(np.diff(depth[order]))[0] + 1)
        self.base = base

    def infer(self, unary: np.ndarray, edge: np.ndarray):
        """Beliefs (log, n x 2), what each child told its parent, and the
        children's own side; ``edge`` is kinds x 2 x 2 by (parent, child)."""
        own, told = unary.copy(), np.zeros_like(unary)
        kind = self.segment.astype(np.int64)
        for level in self.levels[:0:-1]:
            m = _lse(own[level][:, None, :] + edge[kind[level]], 2)
            told[level] = m
            np.add.at(own, self.parent[level], m)
        belief = own.copy()
        for level in self.levels[1:]:
            rest = belief[self.parent[level]] - told[level]
            belief[level] = own[level] + _lse(rest[:, :, None] + edge[kind[level]], 1)
        return belief, told, own

    def log_z(self, belief: np.ndarray) -> float:
        return float(_lse(belief[self.levels[0]], 1).sum())


def soft(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray         # log-odds of content per feature
    edge: np.ndarray            # 2, 2, 2


class Reader:
    """Pages to marginals with one model; names are looked up once."""

    def __init__(self, model: Model, p: Params):
        self.model, self.p = model, p
        self.names: dict[tuple[str, str], list[int]] = {}

    def numbers(self, t: Tree) -> list[list[int]]:
        get, out = self.model.index.get, []
        for tag, attrs, text, link in zip(t.tag, t.attrs, t.text, t.link):
            if tag:
                key = tag, attrs
                got = self.names.get(key)
                if got is None:
                    if len(self.names) >= self.p.cache_names:
                        self.names.clear()
                    got = [i for i in map(get, element_features(tag, attrs)) if i is not None]
                    self.names[key] = got
            else:
                got = [i for i in map(get, segment_features(text, link)) if i is not None]
            out.append(got)
        return out

    def marginals(self, trees: list[Tree]) -> tuple[Forest, np.ndarray]:
        forest = Forest(trees)
        feats = [f for t in trees for f in self.numbers(t)]
        sizes = np.fromiter(map(len, feats), np.int64, len(feats))
        flat = np.fromiter((i for f in feats for i in f), np.int64, int(sizes.sum()))
        node = np.repeat(np.arange(len(feats)), sizes)
        unary = np.zeros((len(feats), 2))
        unary[:, 1] = np.bincount(node, self.model.weights[flat], minlength=len(feats))
        return forest, soft(forest.infer(unary, self.model.edge)[0])[:, 1]

    def texts(self, pages: list[str]) -> list[str]:
        trees = [parse(x) for x in pages]
        forest, prob = self.marginals(trees)
        out = []
        for t, b in zip(trees, forest.base.tolist()):
            keep = prob[b:b + len(t.tag)] >= 0.5
            out.append("\n\n".join(x for x, g, k in zip(t.text, t.tag, keep) if not g and k))
        return out


# -- training -----------------------------------------------------------------

SELF_LABELLED = ("article", "main")
NEVER = ("nav", "aside", "footer", "form", "header", "button", "select", "menu")


def labels_of(t: Tree) -> np.ndarray:
    """Labels of a tree: by the nearest x-content mark, or else by the page's
    own article and main elements. An element is content if most characters
    below it are."""
    n = len(t.tag)
    inside = np.zeros(n, bool)
    for i in range(1, n):
        up = bool(inside[t.parent[i]])
        mark = _LABEL.search(t.attrs[i]) if t.attrs[i] else None
        if mark:
            up = mark.group(1) == "1"
        elif t.tag[i] in SELF_LABELLED:
            up = True
        elif t.tag[i] in NEVER:
            up = False
        inside[i] = up
    size = np.array([len(x) for x in t.text], float)
    good = size * inside
    for i in range(n - 1, 0, -1):
        size[t.parent[i]] += size[i]
        good[t.parent[i]] += good[i]
    return np.where([not g for g in t.tag], inside, 2 * good > size).astype(np.int64)


def _wrap(rng: random.Random, kind: str, inner: str, tags: tuple[str, ...]) -> str:
    tag = rng.choice(tags)
    name = rng.choice(OTHER_NAMES[kind])
    named = "" if tag in ("nav", "aside", "footer", "form", "header") and rng.random() < .4 else \
        f' {rng.choice(["class", "id", "class"])}="{name.replace(" ", rng.choice(["-", " ", "_"]))}"'
    return f'<{tag}{named} x-content="0">{inner}</{tag}>'


def linked(text: str, rng: random.Random) -> str:
    """Now and then some words of a content text, or all, inside a link."""
    words, r = text.split(), rng.random()
    if r < .1:
        return f'<a href="/x">{text}</a>'
    if r < .25 and len(words) > 3:
        a = rng.randrange(len(words) - 1)
        b = min(len(words), a + rng.randrange(1, 6))
        return " ".join([*words[:a], f'<a href="/x">{" ".join(words[a:b])}</a>', *words[b:]])
    return text


def rebuilt(t: Tree, y: np.ndarray, pool: list[str], rng: random.Random) -> str:
    """A page of other markup around the content of a labelled page."""
    def some(n):
        return [_html.escape(x) for x in rng.sample(pool, min(n, len(pool)))]

    def short(n):
        return [" ".join(x.split()[:rng.randrange(1, 5)]) for x in some(n)]

    def items(n, link=True):
        return "<ul>" + "".join(f'<li><a href="/x">{x}</a></li>' if link else f"<li>{x}</li>"
                                for x in short(n)) + "</ul>"

    def paras(n):
        return "".join(f"<p>{x[:rng.choice([40, 90, 400])]}</p>" for x in some(n))
    body = []
    for i, text in enumerate(t.text):
        if text and y[i]:
            tag = t.tag[t.parent[i]]
            tag = tag if tag in ("h1", "h2", "h3", "p", "li", "blockquote", "pre", "td") else "p"
            body.append(f"<{tag}>{linked(_html.escape(text), rng)}</{tag}>")
    for kind in ("list", "table", "quote", "heading", "figure", "links", "sources", "word", "formula"):
        if rng.random() < .35:          # articles hold more than paragraphs
            few = [x[:rng.choice([25, 60, 120])] for x in some(rng.randrange(2, 6))]
            body.insert(rng.randrange(len(body) + 1), {
                "list": "<ul>" + "".join(f"<li>{x}</li>" for x in few) + "</ul>",
                "table": "<table>" + "".join(f"<tr><td>{x[:20]}</td><td>{len(x)}</td></tr>"
                                             for x in few) + "</table>",
                "quote": f"<blockquote><p>{few[0]}</p></blockquote>",
                "heading": f"<h2>{' '.join(few[0].split()[:4])}</h2>",
                "figure": f"<figure><img src='x'><figcaption>{few[0]}</figcaption></figure>",
                "links": "".join(f'<p><a href="/x">{" ".join(x.split()[:k])}</a></p>'
                                 for x, k in zip(few, (2, 99, 4))),
                "sources": "<ul>" + "".join(f'<li><a href="/x">{" ".join(x.split()[:4])}</a></li>'
                                            for x in few) + "</ul>",
                "word": f"<p>{few[0].split()[0]}</p>",
                "formula": f"<p>{few[0]} <math><mi>x</mi><mo>=</mo><mn>{len(few)}</mn></math></p>",
            }[kind])
    inner = "".join(body)
    if rng.random() < .3:
        cut = rng.randrange(len(body) + 1)
        inner = "".join([*body[:cut], _wrap(rng, "ad", paras(1), ("div", "aside", "section")),
                         *body[cut:]])
    name = rng.choice(CONTENT_NAMES)
    tag = rng.choice(("article", "main", "div", "div", "section"))
    if tag == "div" and not name and rng.random() < .6:
        name = "content"
    content = f'<{tag}{f""" class="{name}" """ if name else ""} x-content="1">{inner}</{tag}>'
    before = [
        _wrap(rng, "header", f"<h2>{''.join(short(1))}</h2>{items(3)}", ("header", "div")),
        _wrap(rng, "nav", items(rng.randrange(2, 9)), ("nav", "div", "ul")),
        _wrap(rng, "notice", paras(1), ("div", "section", "dialog")),
        _wrap(rng, "ad", paras(1), ("div", "aside")),
        _wrap(rng, "form", f"<label>{''.join(short(1))}</label><input><button>Go</button>", ("form", "div")),
    ]
    after = [
        _wrap(rng, "comments", "<h3>Comments</h3>" + "".join(
            f'<div class="{rng.choice(OTHER_NAMES["comments"])}" x-content="0">{paras(1)}</div>'
            for _ in range(rng.randrange(1, 4))), ("section", "div", "ol")),
        _wrap(rng, "aside", f"<h3>{''.join(short(1))}</h3>{items(4)}{paras(1)}", ("aside", "div")),
        _wrap(rng, "share", items(3), ("div", "ul")),
        _wrap(rng, "footer", f"&copy; {''.join(some(1))[:80]}", ("footer", "div")),
        _wrap(rng, "form", f"<p>{''.join(short(1))}</p><input><button>Send</button>", ("form",)),
    ]
    parts = [x for x in before if rng.random() < .55] + [content] + \
        [x for x in after if rng.random() < .55]
    if rng.random() < .2:       # an unnamed last line
        parts.append(f"<hr><small>{rng.choice(['Copyright', '&copy;'])} {rng.randrange(1995, 2025)} "
                     f"{''.join(short(1))}</small>")
    if rng.random() < .3:
        parts = [f'<div class="{rng.choice(["wrapper", "container", "row", "page", "site"])}">',
                 *parts, "</div>"]
    return f"<html><head><title>x</title></head><body>{''.join(parts)}</body></html>"


#: Content for rebuilt pages where no page of the corpus labels itself.
PLAIN_PAGE = "<article><h1>A title of some words</h1>" + "".join(
    f"<p>{'Plain sentences follow one another, with commas, and come to an end. ' * k}</p>"
    for k in (1, 3, 2, 5)) + "</article>"


def fit(pages: list[str], p: Params = Params()) -> Model:
    rng = random.Random(17)
    own = [t for t in map(parse, pages or [PLAIN_PAGE]) if any(t.text)]
    own = own or [parse(PLAIN_PAGE)]
    marks = [labels_of(t) for t in own]
    pool = sorted({x for t, y in zip(own, marks) for x, k in zip(t.text, y) if x and k}) or \
        [parse(PLAIN_PAGE).text[2]]
    trees, gold = list(own) if pages else [], list(marks) if pages else []
    for t, y in zip(own, marks):
        for _ in range(p.variants if pages else 40):
            made = parse(rebuilt(t, y, pool, rng))
            trees.append(made), gold.append(labels_of(made))
    names = [element_features(g, a) if g else segment_features(x, k)
             for t in trees for g, a, x, k in zip(t.tag, t.attrs, t.text, t.link)]
    index: dict[str, int] = {}
    feats = [[index.setdefault(f, len(index)) for f in fs] for fs in names]
    sizes = np.array([len(f) for f in feats])
    flat = np.array([i for f in feats for i in f])
    node = np.repeat(np.arange(len(feats)), sizes)
    y, forest = np.concatenate(gold), Forest(trees)
    child = np.nonzero(forest.parent >= 0)[0]
    child = np.setdiff1d(child, forest.levels[0])
    kind = forest.segment.astype(np.int64)
    w, edge = np.zeros(len(index)), np.zeros((2, 2, 2))
    seen_w, seen_e = np.full(len(w), 1e-6), np.full(edge.shape, 1e-6)
    count = len(trees)
    for _ in range(p.steps):
        unary = np.zeros((len(y), 2))
        unary[:, 1] = np.bincount(node, w[flat], minlength=len(y))
        g_node, pairs = gradients(forest, unary, edge, y, child, kind)
        g_w = np.bincount(flat, g_node[node], minlength=len(w)) / count + p.ridge * w
        g_e = pairs / count + p.ridge * edge
        seen_w += g_w * g_w
        seen_e += g_e * g_e
        w -= p.rate * g_w / np.sqrt(seen_w)
        edge -= p.rate * g_e / np.sqrt(seen_e)
    return Model(index, w, edge)


def gradients(forest: Forest, unary, edge, y, child, kind):
    """Expected minus observed: content per node, and (kind, parent, child)."""
    belief, told, own = forest.infer(unary, edge)
    g_node = soft(belief)[:, 1] - y
    pair = ((belief[forest.parent[child]] - told[child])[:, :, None] + edge[kind[child]]
            + own[child][:, None, :]).reshape(-1, 4)
    pair = soft(pair).reshape(-1, 2, 2)
    pairs = np.zeros((2, 2, 2))
    np.add.at(pairs, kind[child], pair)
    np.add.at(pairs, (kind[child], y[forest.parent[child]], y[child]), -1.0)
    return g_node, pairs


def train(pages: DataFrame, p: Params = Params()) -> Model:
    source = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    n = source.count()
    share = min(1.0, 2.0 * p.sample_pages / max(n, 1))
    rank = F.xxhash64(F.col("page_id").cast("string"))
    rows = (source.select(rank.alias("rank"), "html")
            .where(F.col("rank") <= min(2 ** 63 - 1, int(-2 ** 63 + share * 2 ** 64)))
            .limit(4 * p.sample_pages).collect())
    rows = sorted(rows, key=lambda r: (r["rank"], r["html"]))[:p.sample_pages]
    return fit([r["html"] for r in rows], p)


def extract(pages: DataFrame, p: Params = Params(), model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars per page."""
    model = train(pages, p) if model is None else model
    readers: list[Reader] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not readers:
            readers.append(Reader(model, p))
        for c in chunks(batch, "html"):
            texts = readers[0].texts([x or "" for x in c.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [c.column(0), c.column(1), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")
