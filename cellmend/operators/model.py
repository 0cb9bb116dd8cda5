"""Tied-weight softmax over each cell's candidates: encode, score, fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmend import schema
from cellmend.sources.tables import checkpointed, dense_number

_CELL = ["tid", "attr"]
_STATE = ["tid", "attr", "candidate_val"]


def encode_variables(cells: DataFrame) -> DataFrame:
    """(tid, attr, var_idx, is_query): cells numbered in order of tid and attribute; noisy cells are queries, the others evidence."""
    return dense_number(cells.select("tid", "attr", F.col("is_noisy").alias("is_query")), _CELL, "var_idx").select("tid", "attr", "var_idx", "is_query")


def encode_domains(domains: DataFrame) -> DataFrame:
    """(tid, attr, candidate_val, domain_idx): rank of each distinct candidate in its cell."""
    rank = F.row_number().over(Window.partitionBy(*_CELL).orderBy("candidate_val")) - 1
    return domains.select(*_STATE).distinct().withColumn("domain_idx", rank)


def encode_features(features: DataFrame) -> DataFrame:
    """(feature, feature_idx) in order of name."""
    return dense_number(features.select("feature").distinct(), ["feature"], "feature_idx")


def encode_states(features: DataFrame, domains: DataFrame, cells: DataFrame) -> DataFrame:
    """(var_idx, domain_idx, feature_idx): the design, a row for each feature that a candidate has. Features of cells or candidates
    that are not there have none: encoding_skips() counts them."""
    of_cell = encode_domains(domains).join(encode_variables(cells).select("tid", "attr", "var_idx"), _CELL)
    rows = features.join(of_cell, _STATE).join(encode_features(features), "feature")
    return rows.select("var_idx", "domain_idx", "feature_idx")


def encoding_skips(features: DataFrame, domains: DataFrame, cells: DataFrame, known: DataFrame) -> DataFrame:
    """One row: n_rows of features and those that the design leaves out, each for its first reason: n_unknown_cells,
    n_unknown_candidates, and n_unknown_features, whose name is not among known (feature)."""
    mark = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    rows = features.join(mark(cells, _CELL, "c"), _CELL, "left").join(mark(domains, _STATE, "d"), _STATE, "left").join(mark(known, ["feature"], "f"), "feature", "left")
    cell, state, name = (F.col(x).isNotNull() for x in "cdf")
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(~cell).alias("n_unknown_cells"), F.count_if(cell & ~state).alias("n_unknown_candidates"), F.count_if(cell & state & ~name).alias("n_unknown_features"))


def labels(domains: DataFrame, cells: DataFrame) -> DataFrame:
    """(tid, attr, y): the domain index of a cell's own value, -1 where it is missing or no candidate."""
    own = encode_domains(domains).select("tid", "attr", F.col("candidate_val").alias("val"), "domain_idx")
    return cells.select("tid", "attr", "val").join(own, ["tid", "attr", "val"], "left").select("tid", "attr", F.coalesce("domain_idx", F.lit(-1)).alias("y"))


def split(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence and query cells."""
    return cells.where(~F.col("is_noisy")), cells.where("is_noisy")


def unknown_features(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(n_rows): features that no weight exists for; they score nothing."""
    return features.join(weights, "feature", "left_anti").agg(F.count("*").alias("n_rows"))


def scores(features: DataFrame, domains: DataFrame, weights: DataFrame) -> DataFrame:
    """(tid, attr, candidate_val, score): the sum of the weights of a candidate's features; zero without any."""
    summed = features.join(weights, "feature").groupBy(*_STATE).agg(F.sum("weight").alias("score"))
    return domains.select(*_STATE).join(summed, _STATE, "left").select(*_STATE, F.coalesce("score", F.lit(0.0)).alias("score"))


def softmax(scored: DataFrame) -> DataFrame:
    """(tid, attr, candidate_val, prob). A window holds one cell's candidates."""
    cell = Window.partitionBy(*_CELL)
    e = F.exp(F.col("score") - F.max("score").over(cell))
    return scored.withColumn("__e", e).select(*_STATE, (F.col("__e") / F.sum("__e").over(cell)).alias("prob"))


def predict(features: DataFrame, domains: DataFrame, weights: DataFrame, noisy: DataFrame) -> DataFrame:
    """Marginals of the noisy cells' candidates. A noisy cell without a domain has none."""
    mine = noisy.select(*_CELL).distinct()
    return softmax(scores(features.join(mine, _CELL, "left_semi"), domains.join(mine, _CELL, "left_semi"), weights))


@dataclass(frozen=True)
class Training:
    epochs: int = 10
    learning_rate: float = 0.001
    weight_decay: float = 1e-6
    optimizer: str = "adam"  # or "sgd", with momentum 0.9
    batch_size: int = 64
    seed: int = 0
    prior_weight: float = schema.PRIOR_WEIGHT
    #: Feature rows up to which the driver holds the mini-batches; above, it streams the same ones from the shared folder.
    local_rows: int = 2_000_000


def training_rows(features: DataFrame, domains: DataFrame, cells: DataFrame) -> DataFrame:
    """(tid, attr, candidate_val, feature, y): the features of evidence cells whose own value is a candidate; y marks that candidate."""
    evidence = cells.where(~F.col("is_noisy") & F.col("val").isNotNull()).select("tid", "attr", "val")
    states = domains.select(*_STATE).join(evidence, _CELL).withColumn("y", (F.col("candidate_val") == F.col("val")).cast("int"))
    known = states.where("y = 1").select(*_CELL)
    return states.join(known, _CELL, "left_semi").drop("val").join(features, _STATE, "left")


def gradient(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(feature, gradient) of the summed cross-entropy: what the model expects less what is observed."""
    joined = rows.join(weights, "feature", "left")
    state = joined.groupBy(*_STATE).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("score"), F.max("y").alias("y"))
    residual = softmax(state.select(*_STATE, "score")).join(state.select(*_STATE, "y"), _STATE).select(*_STATE, (F.col("prob") - F.col("y")).alias("residual"))
    return rows.where("feature is not null").join(residual, _STATE).groupBy("feature").agg(F.sum("residual").alias("gradient"))


def initial_weights(rows: DataFrame, t: Training = Training()) -> DataFrame:
    """(feature, weight): uniform by name within one over the root of the number of features; the prior's is fixed."""
    names = rows.where("feature is not null").select("feature").distinct()
    n = max(1, names.count())
    unit = F.pmod(F.xxhash64(F.col("feature"), F.lit(t.seed)), F.lit(1 << 30)) / float(1 << 30)  # the same everywhere
    start = (2 * unit - 1) / float(np.sqrt(n))
    return names.select("feature", F.when(F.col("feature") == schema.PRIOR_FEATURE, t.prior_weight).otherwise(start).alias("weight"))


def _numbered(rows: DataFrame, t: Training, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(feature, number, weight) at the start, and one row a cell: the number of its states, and for each state its y, its number of
    features and their numbers. A row holds one cell's candidates."""
    first = initial_weights(rows, t)
    if start is not None:  # features that it lacks begin as without it
        given = start.select("feature", F.col("weight").alias("__given"))
        first = first.join(given, "feature", "left").select("feature", F.when(F.col("feature") == schema.PRIOR_FEATURE, t.prior_weight).otherwise(F.coalesce("__given", "weight")).alias("weight"))
    start = checkpointed(dense_number(first, ["feature"], "number"), "weights")
    states = rows.join(start.select("feature", "number"), "feature", "left").groupBy(*_STATE).agg(F.max("y").alias("y"), F.sort_array(F.collect_list("number")).alias("f"))
    cells = states.groupBy(*_CELL).agg(F.sort_array(F.collect_list(F.struct("candidate_val", "y", "f"))).alias("s"))
    flat = cells.select(*_CELL, F.size("s").alias("n"), F.col("s.y").alias("y"), F.transform("s", lambda x: F.size(x["f"])).alias("width"), F.flatten("s.f").alias("f"))
    return start, checkpointed(flat, "training")


def _turn(t: Training, epoch: int) -> Column:
    """Cells take their turn in an epoch by this hash, then by tid and attribute."""
    return F.xxhash64(*_CELL, F.lit(t.seed), F.lit(epoch))


_PARTS = ["n", "y", "width", "f"]


#: Batches of cells of an epoch, in their order.
Epochs = Callable[[int], Iterator[list]]


def _held(cells: DataFrame, t: Training) -> Epochs:
    """Batches of cells that the driver holds."""
    data = cells.orderBy(*_CELL).select(*_PARTS, *[_turn(t, e).alias(f"turn{e}") for e in range(t.epochs)]).collect()

    def batches(e: int) -> Iterator[list]:
        order = np.argsort(np.array([r[len(_PARTS) + e] for r in data], dtype=np.int64), kind="stable")
        for a in range(0, len(order), t.batch_size):
            yield [data[k] for k in order[a : a + t.batch_size]]

    return batches


def _streamed(cells: DataFrame, t: Training) -> Epochs:
    """The same batches in the same order, sorted by Spark in each epoch and read one partition at a time."""

    def batches(e: int) -> Iterator[list]:
        batch = []
        for r in cells.orderBy(_turn(t, e), *_CELL).select(*_PARTS).toLocalIterator():
            batch.append(r)
            if len(batch) == t.batch_size:
                yield batch
                batch = []
        if batch:
            yield batch

    return batches


@dataclass(frozen=True)
class Epoch:
    """What one epoch came to: the mean loss of its usable batches, batches skipped as their loss was no number, and the share of
    training cells whose likeliest candidate is their own value after it."""

    epoch: int
    loss: float
    n_skipped: int
    accuracy: float | None


class _Batch:
    """A batch's cells as flat arrays."""

    def __init__(self, rows: list):
        flat = lambda part: np.fromiter(chain.from_iterable(r[part] for r in rows), dtype=np.int64)
        self.n = np.fromiter((r[0] for r in rows), dtype=np.int64, count=len(rows))
        self.y, width, self.f = flat(1), flat(2), flat(3)
        self.cell, self.state = np.repeat(np.arange(len(self.n)), self.n), np.repeat(np.arange(len(self.y)), width)

    def probabilities(self, w: np.ndarray) -> np.ndarray:
        z = np.bincount(self.state, w[self.f], minlength=len(self.y))
        e = np.exp(z - np.maximum.reduceat(z, np.cumsum(self.n) - self.n)[self.cell])
        return e / np.bincount(self.cell, e)[self.cell]

    def right(self, w: np.ndarray) -> int:
        """Cells whose likeliest candidate, of equals the first, is their own value."""
        p = self.probabilities(w)
        first = np.lexsort((np.arange(len(p)), -p, self.cell))[np.cumsum(self.n) - self.n]
        return int(self.y[first].sum())


def _optimise(start: DataFrame, epochs: Epochs, t: Training, history: list[Epoch] | None = None) -> DataFrame:
    """(feature, weight) after a step on each batch. The driver holds three numbers a feature, names stay in the table. history, where
    given, gets an Epoch for each, at the price of another look at all cells. A batch whose loss is no finite number makes no step."""
    w = start.orderBy("number").select("weight").toPandas()["weight"].to_numpy(dtype=np.float64, copy=True)
    prior = start.where(F.col("feature") == schema.PRIOR_FEATURE).select("number").first()
    m, v, k = np.zeros(len(w)), np.zeros(len(w)), 0
    for epoch in range(t.epochs):
        losses, skipped = [], 0
        for rows in epochs(epoch):
            b = _Batch(rows)
            with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                p = b.probabilities(w)
                loss = -np.log(p[b.y == 1]).sum() / len(b.n)
            if not np.isfinite(loss):
                skipped += 1
                continue
            losses.append(float(loss))
            k += 1
            residual = (p - b.y) / len(b.n)
            g = np.bincount(b.f, residual[b.state], minlength=len(w)) + t.weight_decay * w
            if t.optimizer == "sgd":
                m = 0.9 * m + g
                w = w - t.learning_rate * m
            else:
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w - t.learning_rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            if prior is not None:
                w[prior.number] = t.prior_weight
        if history is not None:
            n = right = 0
            for rows in epochs(epoch):
                n, right = n + len(rows), right + _Batch(rows).right(w)
            history.append(Epoch(epoch, float(np.mean(losses)) if losses else 0.0, skipped, right / n if n else None))
    spark = start.sparkSession
    trained = spark.createDataFrame(pd.DataFrame({"number": np.arange(len(w)), "weight": w}), "number long, weight double")
    return checkpointed(start.select("feature", "number").join(trained, "number").select("feature", "weight"), "weights")


def fit_distributed(rows: DataFrame, t: Training, start: DataFrame | None = None, history: list[Epoch] | None = None) -> DataFrame:
    """(feature, weight) by the mini-batches of fit_local(), streamed from the shared folder: the driver holds one partition of cells."""
    first, cells = _numbered(rows, t, start)
    return _optimise(first, _streamed(cells, t), t, history)


def fit_local(rows: DataFrame, t: Training, start: DataFrame | None = None, history: list[Epoch] | None = None) -> DataFrame:
    """(feature, weight) by mini-batches of cells in hashed order; the driver holds all of at most local_rows feature rows."""
    first, cells = _numbered(rows, t, start)
    return _optimise(first, _held(cells, t), t, history)


def fit(features: DataFrame, domains: DataFrame, cells: DataFrame, t: Training = Training(), start: DataFrame | None = None, history: list[Epoch] | None = None) -> DataFrame:
    """(feature, weight). The prior's weight is fixed; cells with a missing value, or whose value is no candidate, teach nothing. start
    (feature, weight) goes on from weights that are there; history, a list, gets an Epoch for each."""
    rows = checkpointed(training_rows(features, domains, cells), "training")
    if rows.limit(t.local_rows + 1).count() > t.local_rows:
        return fit_distributed(rows, t, start, history)
    return fit_local(rows, t, start, history)


def accuracy(features: DataFrame, domains: DataFrame, cells: DataFrame, weights: DataFrame) -> DataFrame:
    """(n, accuracy): share of trainable evidence cells whose likeliest candidate is their own value."""
    from cellmend.operators.repair import argmax

    rows = training_rows(features, domains, cells)
    mine = rows.select(*_CELL).distinct()
    best = argmax(softmax(scores(features, domains.join(mine, _CELL, "left_semi"), weights)))
    right = best.join(cells.select("tid", "attr", "val"), _CELL).select((F.col("predicted_val") == F.col("val")).cast("int").alias("right"))
    return right.agg(F.count("*").alias("n"), F.avg("right").alias("accuracy"))


def active_difference(features: DataFrame, tid: int, attr: str, candidate: str, other: str) -> DataFrame:
    """(feature, side): features of one candidate that the other lacks, and the reverse."""
    of = lambda c: features.where((F.col("tid") == tid) & (F.col("attr") == attr) & (F.col("candidate_val") == c)).select("feature")
    a, b = of(candidate), of(other)
    return a.subtract(b).withColumn("side", F.lit("target")).union(b.subtract(a).withColumn("side", F.lit("other")))


def inspect_sample(features: DataFrame, domains: DataFrame, cells: DataFrame, k: int = 0) -> DataFrame:
    """(tid, attr, target_val, other_val, side, feature): of the k-th training cell in order of tid and attribute, counted from 0, the features
    that its own value alone has (side `target`), or alone its first other candidate (`other`). Without another candidate other_val is
    null and all are the target's. No rows if there are not so many training cells."""
    evidence = cells.where(~F.col("is_noisy") & F.col("val").isNotNull()).select("tid", "attr", F.col("val").alias("target_val"))
    trained = evidence.join(domains.select("tid", "attr", F.col("candidate_val").alias("target_val")).distinct(), ["tid", "attr", "target_val"], "left_semi")
    sample = trained.orderBy(*_CELL).offset(k).limit(1)
    others = domains.join(F.broadcast(sample), _CELL).where(F.col("candidate_val") != F.col("target_val")).groupBy(*_CELL).agg(F.min("candidate_val").alias("other_val"))  # a row
    sample = sample.join(others, _CELL, "left")
    mine = features.join(F.broadcast(sample), _CELL)
    per = mine.groupBy(*_CELL, "target_val", "other_val", "feature").agg(F.max(F.col("candidate_val") == F.col("target_val")).alias("t"), F.max(F.col("candidate_val").eqNullSafe(F.col("other_val"))).alias("o"))
    return per.where(F.col("t") != F.col("o")).select(*_CELL, "target_val", "other_val", F.when(F.col("t"), "target").otherwise("other").alias("side"), "feature")


__all__ = ["Epoch", "Training", "accuracy", "active_difference", "encode_domains", "encode_features", "encode_states", "encode_variables", "encoding_skips", "fit", "gradient", "initial_weights", "inspect_sample", "labels", "predict", "scores", "softmax", "split", "training_rows"]
