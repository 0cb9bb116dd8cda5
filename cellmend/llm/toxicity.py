"""Toxicity by a linear-chain conditional random field over words.

Labels are per document, so words are labelled first: in a toxic training document, words are toxic that have a form or a
beginning which toxic documents share and clean ones hardly show. The two-state chain is then trained on these labelled
words by its exact gradient (forward-backward), with hashed features of a word's form, beginnings and end, so unseen
forms of a known stem are tagged too. A document's score is a logistic function of its marginals' peak and expected
number of toxic words; offsets are the runs of words with marginal one half or more.

Learning takes a bounded sample of labelled documents (parameters below) that are not held out; scoring takes every word of every
document, in one narrow pass: nothing is shuffled, and only the weights, of a fixed size, are broadcast.

Defined results: null, empty and wordless texts get the score of a document without toxic words; without any toxic or any clean
label every score is the smoothed share of toxic labels; labels that are null or repeat count once, toxic if one of them is; of repeated
documents the greatest text is learnt from; rows that repeat or have null ids, of any type, are scored like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.llm import common

#: Toxic documents that are learnt from (and twice as many clean ones), and the longest of them in characters.
SAMPLE, SAMPLE_CHARS = 1200, 20_000
BITS, EPOCHS, THRESHOLD = 18, 6, 0.7
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_CACHE = 200_000


def words(text: str) -> list[bytes]:
    return text.encode().translate(common.WORDS).split()


def forms(word: bytes) -> list[str]:
    """What a word is known by: itself, its beginnings of 4 to 6 characters."""
    w = word.decode(errors="replace")
    return ["=" + w] + ["^" + w[:k] for k in (4, 5, 6) if len(w) > k]


def features(word: bytes) -> list[int]:
    w = word.decode(errors="replace")
    names = [*forms(word), "$" + w[-3:], f"#{min(len(w), 12)}", "bias"]
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in names]


@dataclass
class Model:
    weight: np.ndarray
    #: Scores of the moves clean-toxic, toxic-clean and toxic-toxic; clean-clean has 0.
    move: np.ndarray
    #: Bias, peak and count of the document's score.
    score: np.ndarray
    known: dict[bytes, float] = field(default_factory=dict)

    def emissions(self, w: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        weight = self.weight.item
        for x in {*w}.difference(known):
            known[x] = sum(map(weight, features(x)))
        return np.array([known[x] for x in w], dtype=np.float64)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}


def _relax(value: np.ndarray, base: np.ndarray, step: Callable[[np.ndarray, np.ndarray], np.ndarray], nodes: np.ndarray, towards: int, stop: np.ndarray) -> None:
    """value[t] = step(base[t], value[t - towards]) from one end of each chain to the other. All places are computed at once and
    again wherever the place before has changed, until nothing has: the chain forgets within a few words."""
    while len(nodes):
        new = step(base[nodes], value[nodes - towards])
        moved = np.abs(new - value[nodes]) > 1e-12
        value[nodes] = new
        nodes = nodes[moved & ~stop[nodes]] + towards


def forward_backward(e: np.ndarray, starts: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of toxic in the forward message and in s = emission + backward message, at each word."""
    n = len(e)
    first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    lo, hi = starts[:-1][np.diff(starts) > 0], starts[1:][np.diff(starts) > 0]
    first[lo], last[hi - 1] = True, True
    t01, t10, t11 = move
    r = e + t01
    r[first] = e[first]
    _relax(r, e, lambda a, x: a + np.logaddexp(t01, x + t11) - np.logaddexp(0, x + t10), np.flatnonzero(~first), 1, last)
    s = e + t10
    s[last] = e[last]
    _relax(s, e, lambda a, x: a + np.logaddexp(t10, x + t11) - np.logaddexp(0, x + t01), np.flatnonzero(~last), -1, first)
    return r, s


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _lexicon(docs: list[set[str]], toxic: np.ndarray) -> set[str]:
    """Forms that toxic documents share and clean ones hardly show, more than chance gives.

    Of all forms that k documents have, a share^k of them would be in toxic documents alone by chance, where share is the toxic
    documents' part of all forms. A form is taken where so many would be at most a twentieth of those that are there; then, for toxic
    documents that none of these explains, the forms that explain most of them, where they would be at most a third.
    """
    bad, good = Counter(), Counter()
    for d, y in zip(docs, toxic, strict=True):
        (bad if y else good).update(d)
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    share = bad.total() / max(1, bad.total() + good.total())
    pure = {f for f, k in bad.items() if good[f] * n_bad <= 0.02 * k * n_good}
    have, alone = Counter(k + good[f] for f, k in bad.items()), Counter(bad[f] + good[f] for f in pure)
    have.update(k for f, k in good.items() if f not in bad)
    chance = {k: have[k] * share**k / n for k, n in alone.items()}
    likely = lambda f, most: chance[bad[f] + good[f]] <= most
    chosen = {f for f in pure if bad[f] >= 2 and likely(f, 0.05)}
    usable = {f for f in pure if bad[f] >= 2 and likely(f, 0.3)}
    left = [d for d, y in zip(docs, toxic, strict=True) if y and not d & chosen]
    while left:
        count = Counter(f for d in left for f in d if f in usable)
        best = max(count, key=lambda f: (count[f], bad[f], len(f), f), default=None)
        if best is None or count[best] < 2:
            break
        chosen.add(best)
        left = [d for d in left if best not in d]
    return chosen


def _one_of_each(docs: list[list[bytes]]) -> list[int]:
    """Numbers of documents without near copies of earlier ones: copies would make their rare words look shared. Two are near
    copies if a quarter of their bottom-16 sketches of three-word shingles agree."""
    owners: dict[int, list[int]] = {}
    out = []
    for k, d in enumerate(docs):
        sketch = sorted({zlib.crc32(b" ".join(d[i : i + 3])) for i in range(max(1, len(d) - 2))})[:16]
        seen = Counter(o for h in sketch for o in owners.get(h, ()))
        if not seen or 4 * max(seen.values()) < len(sketch):
            out.append(k)
            for h in sketch:
                owners.setdefault(h, []).append(k)
    return out


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Train on whole texts with labels 0 or 1."""
    y = np.array(labels, dtype=bool)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(np.zeros(1 << BITS), np.zeros(3), np.array([np.log(share / (1 - share)), 0, 0]))
    docs = [words(t) for t in texts]
    if not y.any() or y.all():
        return model
    keep = _one_of_each(docs)
    docs, y = [docs[k] for k in keep], y[keep]
    if not y.any() or y.all():
        return model
    known = {w: forms(w) for d in docs for w in d}
    lexicon = _lexicon([{f for w in d for f in known[w]} for d in docs], y)
    bad = {w for w, f in known.items() if not lexicon.isdisjoint(f)}
    number = {w: k for k, w in enumerate(known)}
    # a beginning that one or two toxic words have says nothing about other words
    stems = Counter(f for w in bad for f in known[w] if f[0] == "^")
    lone = {zlib.crc32(f.encode()) & ((1 << BITS) - 1) for f, k in stems.items() if k < 3}
    table = [[f for f in features(w) if f not in lone] for w in known]
    width = max(map(len, table), default=1)
    rows = np.full((len(table), width), -1)
    for k, f in enumerate(table):
        rows[k, : len(f)] = f
    weight = np.zeros((1 << BITS) + 1)  # the last is for places without a feature
    squares, move_squares, move = np.full(len(weight), 1e-6), np.full(3, 1e-6), np.zeros(3)
    rng = np.random.default_rng(seed)
    ids = [np.array([number[w] for w in d], dtype=np.int64) for d in docs]
    tags = [np.array([t and w in bad for w in d], dtype=bool) for d, t in zip(docs, y, strict=True)]
    used = [k for k in range(len(ids)) if len(ids[k])]
    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            w = np.concatenate([ids[k] for k in some])
            t = np.concatenate([tags[k] for k in some])
            starts = np.concatenate(([0], np.cumsum([len(ids[k]) for k in some])))
            kinds, at = np.unique(w, return_inverse=True)
            e = weight[rows[kinds]].sum(axis=1)[at]
            r, s = forward_backward(e, starts, move)
            p = _sigmoid(r + s - e)
            by_kind = np.bincount(at, p - t, minlength=len(kinds)) / len(some)
            g = np.bincount(rows[kinds].ravel() % len(weight), np.repeat(by_kind, width), minlength=len(weight)) + 1e-5 * weight
            g[-1] = 0
            inner = np.setdiff1d(np.arange(1, len(e)), starts)
            z = np.stack([np.zeros(len(inner)), move[0] + s[inner], r[inner - 1] + move[1], r[inner - 1] + move[2] + s[inner]])
            z = np.exp(z - z.max(axis=0))
            z /= z.sum(axis=0)
            before, here = t[inner - 1], t[inner]
            gm = np.array([(z[1] - (~before & here)).sum(), (z[2] - (before & ~here)).sum(), (z[3] - (before & here)).sum()]) / len(some) + 1e-3 * move
            squares += g * g
            move_squares += gm * gm
            weight -= 0.5 * g / np.sqrt(squares)
            move -= 0.2 * gm / np.sqrt(move_squares)
    model.weight, model.move = weight[:-1], move
    x = np.array([summary(model, d)[0] for d in docs])
    model.score = _logistic(np.column_stack((np.ones(len(x)), x)), y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-2] * (x.shape[1] - 1)) * len(x) ** 0.5
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def summary(model: Model, w: list[bytes]) -> tuple[tuple[float, float], np.ndarray]:
    """Of one document: (peak log-odds, log expected toxic words), and each word's marginal."""
    peaks, p = _summaries(model, [w])
    return (float(peaks[0, 0]), float(peaks[0, 1])), p


def _summaries(model: Model, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    e = model.emissions([w for d in docs for w in d])
    r, s = forward_backward(e, starts, model.move)
    odds = r + s - e
    p = _sigmoid(odds)
    out = np.tile([-12.0, np.log(1e-5)], (len(docs), 1))
    full = np.diff(starts) > 0
    if len(odds):
        at = starts[:-1][full]
        out[full, 0] = np.clip(np.maximum.reduceat(odds, at), -12, 12)
        out[full, 1] = np.log(np.add.reduceat(p, at) + 1e-5)
    return out, p


def _scores(model, inside: str | None) -> Callable:
    """inside: the field of the row that holds the text, where it is not a column of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for b in common.steps(whole, inside=inside):
                texts = common.texts_of(b, inside)
                docs = [words(t) for t in texts]
                x, p = _summaries(m, docs)
                score = _sigmoid(m.score[0] + x @ m.score[1:])
                ends = np.cumsum([len(d) for d in docs])
                spans = [[] if x[k, 0] < 0 else runs(texts[k], p[ends[k] - len(docs[k]) : ends[k]]) for k in range(len(texts))]
                yield pa.record_batch([b.column(0), pa.array(score), pa.array(spans, pa.list_(pa.int32()))], ["row", "score", "spans"])

    return run


def runs(text: str, p: np.ndarray) -> list[int]:
    """Code point offsets, half-open and flat, of runs of words with marginal one half or more."""
    places = [m.span() for m in WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (p >= 0.5).view(np.int8), [0]))))
    return [x for a, z in pairwise(edge.tolist()) if p[a] >= 0.5 for x in (places[a][0], places[z - 1][1])]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most `sample` toxic and twice as many clean documents, none of them held out, of at most sample_chars characters."""
    known = labels.select(common.column(id_col).cast("long").alias("doc_id"), common.column(label_col).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~common.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts, y = common.labelled_texts(docs, known, {1: sample, 0: 2 * sample}, id_col, text_col, sample_chars)
    return fit(texts, y)


def toxicity(df: DataFrame, labels: DataFrame | None, row: Column | None = None, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, **more) -> DataFrame:
    """Per row of df: row (the given column, else a struct of all columns), score (0 to 1) and spans (flat code point offsets of toxic runs)."""
    spark = df.sparkSession
    common.ship(spark)
    model = spark.sparkContext.broadcast(model or learn(df, labels, id_col, text_col, **more))
    docs = common.rows_with_text(df, row, text_col)
    return docs.mapInArrow(_scores(model, text_col if row is None else None), f"row {dict(docs.dtypes)['row']}, score double, spans array<int>")
