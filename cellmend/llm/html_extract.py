"""Main text of web pages by a tree-structured graphical model.

Each element of the page's tree is a binary variable, main text or not; running text that stands in a container beside blocks is an element of
its own, so no text is without one. A variable's potential comes from its tag, the words of its class, id and role and of those it is in, the amount
of text and links below it and its share of the page's; the potential of an edge from the kind of the child. Sum-product passes
messages from the leaves up and from the root down and gives each element's exact marginal; text stays whose element's marginal is over
one half. The weights maximise the exact likelihood of labelled pages (labelled_pages.py) and are fitted on the driver in a
second or so; they are small and of fixed size.

Text: character references decoded, white space inside a block made one space, blocks joined in page order by one space. Pages are
read whole, in one narrow pass; nothing is shuffled.

Defined results: null or empty html, or a page without main text, gives an empty text; null url or id is carried; rows that repeat are
extracted like others; an id that is no integer is an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.llm import common, labelled_pages
from cellmend.llm.html_tree import INLINE, TEXT, Tree, parse

_NAMED = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_LABEL = re.compile(r'\by="([01])"')
_PIECE = re.compile(r"[A-Za-z]+")
RIDGE, ROUNDS, FEW = 1e-4, 400, 4
#: Elements whose text is never read; their variables are held at "not main text".
_NEVER = frozenset("script style template iframe noembed noframes title textarea select button head".split())
#: Tags that say something of all that is in them.
_SPEAKING = frozenset("article main aside nav header footer form table ul ol blockquote figure head noscript script style select dialog".split())
#: Kinds of an edge, by its child.
SECTIONS = frozenset("article main section div body html td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def kind(tag: str) -> int:
    return 5 if tag == TEXT else 0 if tag in INLINE else 1 if tag in SECTIONS else 2 if tag in HEADINGS else 3 if tag in ("p", "li", "ul", "ol", "blockquote", "pre", "dl", "dt", "dd", "tr", "table", "tbody", "figure", "figcaption") else 4


KINDS = 6


@dataclass
class Forest:
    """Many trees at once: elements in order of their tree, parents before children."""

    parent: np.ndarray
    edge: np.ndarray
    depth: np.ndarray
    feature: np.ndarray  # flat feature numbers
    owner: np.ndarray  # and the element that has each
    never: np.ndarray  # elements that are held


class Model:
    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.weight = np.zeros(0)
        self.edge = np.zeros((KINDS, 2, 2))
        self.learning = False
        self.cache: dict[tuple[str, str], list[int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def _id(self, name: str) -> int:
        if self.learning:
            return self.number.setdefault(name, len(self.number))
        return self.number.get(name, -1)

    def _static(self, tag: str, attrs: str) -> tuple[list[int], frozenset[int]]:
        """Numbers of the features that follow from the opening tag: of the element, and of all elements in it."""
        key = (tag, attrs)
        if key not in self.cache:
            if len(self.cache) > 20_000:
                self.cache.clear()
            names = {f"tag {tag}"}
            for m in _NAMED.finditer(attrs):
                for w in _PIECE.findall(m[1] or m[2] or m[3] or ""):
                    w = w.lower()
                    names |= {f"name {w}", f"name {w.rstrip('s')}", f"stem {w[:4]}"}
            inside = names if len(names) > 1 or tag in _SPEAKING else ()
            mine, below = ([k for k in map(self._id, x) if k >= 0] for x in (sorted(names), [f"in {x}" for x in sorted(inside)]))
            self.cache[key] = mine, frozenset(below)
        return self.cache[key]

    def forest(self, trees: list[Tree]) -> Forest:
        parent, edge, depth, feature, owner, never, base = [], [], [], [], [], [], 0
        for t in trees:
            n = len(t.tags)
            size, linked, stops = [0] * n, [0] * n, [0] * n
            for k, text in t.parts:
                if k >= 0 and (m := len(text.strip())):
                    size[k] += m
                    stops[k] += text.count(".") + text.count("!") + text.count("?")
            d, in_link = [0] * n, [False] * n
            for k in range(1, n):
                p = t.parents[k]
                d[k] = d[p] + 1
                in_link[k] = in_link[p] or t.tags[k] == "a"
                if in_link[k]:
                    linked[k] = size[k]
            own = size[:]
            for k in range(n - 1, 0, -1):
                p = t.parents[k]
                size[p] += size[k]
                linked[p] += linked[k]
                stops[p] += stops[k]
            most = max(1, size[0] - linked[0])
            within: list[frozenset[int]] = []  # of what an element is in, by its number
            for k, tag in enumerate(t.tags):
                mine, below = self._static(tag, "" if tag in ("a", "img", "meta", "link") else t.attrs[k])
                above = within[t.parents[k]] if k else frozenset()
                within.append(above | below)
                f = [*mine, *above, self._id("bias"), self._id(f"share {(16 * (size[k] - linked[k]) // most).bit_length()}"),
                     self._id(f"size {size[k].bit_length()}"), self._id(f"links {4 * linked[k] // size[k] if size[k] else -1}"),
                     self._id(f"own {(text := min(own[k].bit_length(), 8) // 2)}"), self._id(f"{tag} own {text}"), self._id(f"stops {min(stops[k], 3)}"),
                     self._id(f"{tag} under {t.tags[t.parents[k]] if k else ''}")]
                f = [x for x in f if x >= 0]
                feature += f
                owner += [base + k] * len(f)
                edge.append(kind(tag))
            parent += [base + p if p >= 0 else -1 for p in t.parents]
            depth += d
            never += [base + k for k, tag in enumerate(t.tags) if tag in _NEVER]
            base += n
        return Forest(*(np.array(x, dtype=np.int64) for x in (parent, edge, depth, feature, owner, never)))

    def messages(self, f: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of main text: of each element and what is below it; of its parent without it; and in all."""
        n = len(f.parent)
        up = np.bincount(f.owner, self.weight[f.feature], minlength=n)
        up[f.never] = -500.0
        e = self.edge[f.edge]
        e00, e01, e10, e11 = e[:, 0, 0], e[:, 0, 1], e[:, 1, 0], e[:, 1, 1]
        order = np.argsort(f.depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(f.depth[order])) + 1) if n else []
        sent = np.zeros(n)
        for v in reversed(levels[1:]):
            sent[v] = np.logaddexp(e10[v], e11[v] + up[v]) - np.logaddexp(e00[v], e01[v] + up[v])
            np.add.at(up, f.parent[v], sent[v])
        full, cavity = up.copy(), np.zeros(n)
        for v in levels[1:]:
            cavity[v] = full[f.parent[v]] - sent[v]
            full[v] = up[v] + np.logaddexp(e01[v], e11[v] + cavity[v]) - np.logaddexp(e00[v], e10[v] + cavity[v])
        return up, cavity, full

    def texts(self, pages: list[str]) -> list[str]:
        trees = [parse(p) for p in pages]
        if not trees:
            return []
        full = self.messages(self.forest(trees))[2]
        out, base = [], 0
        for t in trees:
            main = (full[base : base + len(t.tags)] > 0).tolist()
            base += len(t.tags)
            out.append(" ".join("".join(" " if k < 0 else text for k, text in t.parts if k < 0 or main[k]).split()))
        return out


def _labels(t: Tree) -> list[bool]:
    """An element has the label that it or the nearest element above it is given; one without text of its own is main text if
    all the text below it is, and is none if none of it is."""
    n = len(t.tags)
    y = [not any(map(_LABEL.search, t.attrs))]  # a page without a label is main text
    for k in range(1, n):
        m = _LABEL.search(t.attrs[k])
        y.append(m[1] == "1" if m else y[t.parents[k]])
        t.attrs[k] = _LABEL.sub("", t.attrs[k])
    own, good, bad = [False] * n, [False] * n, [False] * n
    for k, text in t.parts:
        if k >= 0 and not text.isspace():
            own[k] = True
            (good if y[k] else bad)[k] = True
    for k in range(n - 1, -1, -1):
        if not own[k] and good[k] != bad[k]:
            y[k] = good[k]
        if k:
            good[t.parents[k]] |= good[k]
            bad[t.parents[k]] |= bad[k]
    return y


def fit(pages: list[str], rounds: int = ROUNDS) -> Model:
    """Exact maximum likelihood (with a ridge) by adaptive gradient steps over all labelled pages."""
    trees = [parse(p) for p in pages]
    y = np.array([v for t in trees for v in _labels(t)], dtype=bool)
    m = Model()
    m.learning = True
    f = m.forest(trees)
    m.learning = False
    m.cache = {}
    # what a few pages alone have says nothing of others
    page = np.repeat(np.arange(len(trees)), [len(t.tags) for t in trees])[f.owner]
    pages_with = np.bincount(np.unique(f.feature * len(trees) + page) // len(trees), minlength=len(m.number))
    m.number = {name: i for i, name in enumerate(x for x, k in m.number.items() if pages_with[k] >= FEW)}
    f = m.forest(trees)
    m.weight = np.zeros(len(m.number))
    inner = np.flatnonzero(f.parent >= 0)
    kinds, before, here = f.edge[inner], y[f.parent[inner]], y[inner]
    seen = np.zeros_like(m.edge)
    np.add.at(seen, (kinds, before.astype(int), here.astype(int)), 1)
    sq_w, sq_e = np.full(len(m.weight), 1e-6), np.full(m.edge.shape, 1e-6)
    for _ in range(rounds):
        up, cavity, full = m.messages(f)
        p = 1 / (1 + np.exp(-np.clip(full, -500, 500)))
        g = np.bincount(f.feature, (p - y)[f.owner], minlength=len(m.weight)) / len(trees) + RIDGE * m.weight
        e, u, c = m.edge[kinds], up[inner], cavity[inner]
        z = np.stack([e[:, 0, 0], e[:, 0, 1] + u, e[:, 1, 0] + c, e[:, 1, 1] + c + u])
        z = np.exp(z - z.max(axis=0))
        z /= z.sum(axis=0)
        ge = -seen
        for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            np.add.at(ge[:, a, b], kinds, z[k])
        ge = ge / len(trees) + RIDGE * m.edge
        sq_w += g * g
        sq_e += ge * ge
        m.weight -= 0.3 * g / np.sqrt(sq_w)
        m.edge -= 0.3 * ge / np.sqrt(sq_e)
    return m


@functools.cache
def default_model() -> Model:
    return fit(labelled_pages.pages())


def _extract(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for b in common.steps(whole, text_at=2, limit=1 << 20):
                texts = m.texts(b.column(2).to_pylist())
                yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    spark = df.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model or default_model())
    pages = df.select(common.column(id_col).cast("long").alias("page_id"), common.column(url_col).alias("url"), F.coalesce(common.column(html_col), F.lit("")).alias("html"))
    return pages.mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long")
