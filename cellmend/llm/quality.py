"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w x): all grades share the hashed-text weights w, the thresholds are in order. A text's x is
the mean over its tokens of two hashed features, the lower-cased token and its shape, with features of the whole text (how
often tokens repeat, how long the text is). The result is the expected grade, and the probability of at least the grade asked for.

Learning takes a bounded sample of rated documents (parameters below) that are not held out; scoring takes every token of every
document in one narrow pass. Nothing is shuffled; the weights are of a fixed size and broadcast.

Defined results: null and empty texts are scored by their length alone; with ratings of one grade only every text has that grade; with
none to learn from (no labels, none outside the held-out fold, none of a document that is there) every text has the tail probability 1/2;
ratings that are null are skipped, of repeated ones the largest counts, and of repeated documents the greatest text is learnt from; rows
that repeat or have null ids are scored like others; an id that is no integer is an error; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.llm import common

#: Rated documents of each grade that are learnt from, and the longest of them in characters.
SAMPLE, SAMPLE_CHARS = 1200, 20_000
BITS, EPOCHS, KEEP = 18, 8, 0.5
_CACHE = 200_000
_RUN = re.compile(r"(.)\1+", re.DOTALL)


def shape(token: str) -> str:
    """Letters by case, digits, other signs as they are; runs of one as two."""
    return _RUN.sub(r"\1\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token))[:12]


def token_features(token: str) -> list[int]:
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in ("w " + token.lower(), "s " + shape(token))]


def text_features(tokens: list[str], text: str) -> list[int]:
    n = len(tokens)
    size = min(n.bit_length(), 12)
    distinct = 10 * len({*tokens}) // n if n else -1
    lines = text.split("\n")
    same = 10 * len({*lines}) // len(lines)
    names = ("t bias", f"t size {size}", f"t distinct {distinct}", f"t size {size} distinct {distinct}", f"t lines {same}")
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in names]


@dataclass
class Model:
    weight: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def linear(self, texts: list[str]) -> np.ndarray:
        known, weight = self.known, self.weight.item
        docs = [t.split() for t in texts]
        if len(known) > _CACHE:
            known.clear()
        for x in set().union(*docs).difference(known) if docs else ():
            known[x] = sum(map(weight, token_features(x)))
        get = known.__getitem__
        return np.array([sum(map(get, d)) / max(1, len(d)) + sum(map(weight, text_features(d, t))) for d, t in zip(docs, texts, strict=True)])

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """P of each grade, a row for each text."""
        below = _sigmoid(self.thresholds[None, :] - z[:, None])
        below = np.column_stack((np.zeros(len(z)), below, np.ones(len(z))))
        return np.diff(below, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(texts: list[str], ratings: list[int], epochs: int = EPOCHS, seed: int = 3) -> Model:
    grades, y = np.unique(np.array(ratings, dtype=np.int64), return_inverse=True)
    share = np.cumsum(np.bincount(y, minlength=len(grades)) + 1)[:-1] / (len(y) + len(grades))
    model = Model(np.zeros(1 << BITS), np.log(share / (1 - share)), grades)
    if len(grades) < 2:
        return model
    at, value = [], []
    known: dict[str, list[int]] = {}
    for t in texts:
        tokens = t.split()
        f, whole = [], text_features(tokens, t)
        for x in tokens:
            if x not in known:
                known[x] = token_features(x)
            f += known[x]
        k, n = np.unique(np.array(f + whole, dtype=np.int64), return_counts=True)
        v = n / max(1, len(tokens))
        v[np.isin(k, whole)] = 1.0
        at.append(k)
        value.append(v)
    w, th = model.weight, model.thresholds.copy()
    sq, sq_th = np.full(len(w), 1e-6), np.full(len(th), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 64)):
            row = np.repeat(np.arange(len(some)), [len(at[k]) for k in some])
            k, v, c = np.concatenate([at[i] for i in some]), np.concatenate([value[i] for i in some]), y[some]
            g, g_th = gradient(w, th, row, k, v, c)
            g += 1e-5 * w
            sq += g * g
            sq_th += g_th * g_th
            w -= 0.5 * g / np.sqrt(sq)
            th = np.maximum.accumulate(th - 0.1 * g_th / np.sqrt(sq_th))
    model.thresholds = th
    return model


def gradient(w: np.ndarray, th: np.ndarray, row: np.ndarray, k: np.ndarray, v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log-likelihood of grades c by weights and thresholds; text row[i] has feature k[i] with value v[i]."""
    z = np.bincount(row, w[k] * v, minlength=len(c))
    ends = np.concatenate(([-np.inf], th, [np.inf]))
    up, low = _sigmoid(ends[c + 1] - z), _sigmoid(ends[c] - z)
    p = np.maximum(up - low, 1e-12)
    d_up, d_low = up * (1 - up) / p, low * (1 - low) / p  # of log p by the upper and the lower threshold
    g = np.bincount(k, ((d_up - d_low)[row]) * v, minlength=len(w)) / len(c)
    g_th = np.zeros(len(th) + 2)
    np.add.at(g_th, c + 1, -d_up)
    np.add.at(g_th, c, d_low)
    return g, g_th[1:-1] / len(c)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most `sample` documents of each grade, none of them held out, of at most sample_chars characters. Grades are few: up to 100."""
    known = labels.select(common.column(id_col).cast("long").alias("doc_id"), common.column(grade_col).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~common.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    grades = sorted(r.y for r in known.select("y").distinct().limit(101).collect())
    if len(grades) > 100:
        raise ValueError("over 100 grades: this is no ordinal rating")
    texts, ratings = common.labelled_texts(docs, known, dict.fromkeys(grades, sample), id_col, text_col, sample_chars)
    return fit(texts, ratings)


def _scores(model, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for b in common.steps(whole):
                p = m.probabilities(m.linear(b.column(1).to_pylist()))
                yield pa.record_batch([b.column(0), pa.array(p @ m.grades), pa.array(p @ (m.grades >= least)), pa.array(m.grades[p.argmax(axis=1)], pa.int32())], ["doc_id", "expected_grade", "tail_probability", "predicted"])

    return run


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1, keep: float = KEEP, model: Model | None = None, **more) -> DataFrame:
    """Per document: doc_id, held_out, expected_grade, tail_probability (of grade `least` or more), predicted (likeliest grade), kept."""
    spark = df.sparkSession
    common.ship(spark)
    model = model or learn(df, labels, id_col, text_col, **more)
    if not len(model.grades):
        model = Model(np.zeros(1 << BITS), np.zeros(1), np.array([least - 1, least]))
    scored = common.texts(df, id_col, text_col).mapInArrow(_scores(spark.sparkContext.broadcast(model), least), "doc_id long, expected_grade double, tail_probability double, predicted int")
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", "predicted", (F.col("tail_probability") >= keep).alias("kept"))
