"""Value and pair statistics, entropies, and correlations of attributes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend import schema
from cellmend.functions.layout import apart
from cellmend.functions.text import or_placeholder
from cellmend.operators.cells import attributes, quoted


def single_stats(cells: DataFrame) -> DataFrame:
    """(attr, val, n, first_tid), missing values counted as the placeholder."""
    return cells.groupBy("attr", or_placeholder(F.col("val")).alias("val")).agg(F.count("*").alias("n"), F.min("tid").alias("first_tid"))


def value_counts(cells: DataFrame) -> DataFrame:
    """(attr, val, n) of values that are present."""
    return cells.where("val is not null").groupBy("attr", "val", apart("attr", "val")).agg(F.count("*").alias("n")).drop("__apart")


def pair_counts(wide: DataFrame, attrs: list[str] | None = None) -> DataFrame:
    """(a1, v1, a2, v2, n, first_tid) for a1 < a2, missing values as the placeholder. Pairs are made inside each row, so the only
    shuffle carries counts that are summed before it."""
    attrs = attrs or attributes(wide)
    pairs = [F.struct(F.lit(a).alias("a1"), or_placeholder(quoted(a)).alias("v1"), F.lit(b).alias("a2"), or_placeholder(quoted(b)).alias("v2")) for a, b in combinations(sorted(attrs), 2)]
    if not pairs:
        return wide.select(F.lit("").alias("a1"), F.lit("").alias("v1"), F.lit("").alias("a2"), F.lit("").alias("v2"), F.lit(0).cast("long").alias("n"), F.col("tid").alias("first_tid")).limit(0)
    rows = wide.select("tid", F.explode(F.array(*pairs)).alias("p")).select("tid", "p.*")
    return rows.groupBy("a1", "v1", "a2", "v2").agg(F.count("*").alias("n"), F.min("tid").alias("first_tid"))


def both_directions(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select("a2", "v2", "a1", "v1", "n", "first_tid"))


def pair_stats(pairs: DataFrame) -> DataFrame:
    """(a1, v1, a2, v2, n, first_tid) in both directions, both values present."""
    present = (F.col("v1") != schema.PLACEHOLDER) & (F.col("v2") != schema.PLACEHOLDER)
    return both_directions(pairs.where(present))


def _entropy(by: list[str]):
    """log2 of the total less the mean of log2 n: one aggregate, without a second pass for the total."""

    def of(counts: DataFrame) -> DataFrame:
        n = F.col("n").cast("double")
        return counts.groupBy(*by).agg((F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("h"))

    return of


def attr_entropy(singles: DataFrame) -> DataFrame:
    """(attr, h) in bits."""
    return _entropy(["attr"])(singles)


def joint_entropy(pairs: DataFrame) -> DataFrame:
    """(a1, a2, h) in bits, for a1 < a2."""
    return _entropy(["a1", "a2"])(pairs)


def correlations(singles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(attr_x, attr_y, corr): 1 - H(x|y) / H(x); one for a constant x and on the diagonal. As many rows as pairs of attributes."""
    h = attr_entropy(singles)
    joint = joint_entropy(pairs)
    both = joint.select(F.col("a1").alias("attr_x"), F.col("a2").alias("attr_y"), F.col("h").alias("h_xy")).union(joint.select("a2", "a1", "h"))
    # entropies have a row for each attribute, which a table's width bounds
    x = F.broadcast(h.select(F.col("attr").alias("attr_x"), F.col("h").alias("h_x")))
    y = F.broadcast(h.select(F.col("attr").alias("attr_y"), F.col("h").alias("h_y")))
    rest = F.greatest(F.col("h_xy") - F.col("h_y"), F.lit(0.0))
    rest = F.when(rest < 1e-9, 0.0).otherwise(rest)
    corr = F.when(F.abs("h_x") < 1e-12, 1.0).otherwise(1 - F.try_divide(rest, F.col("h_x")))
    out = both.join(x, "attr_x").join(y, "attr_y").select("attr_x", "attr_y", corr.alias("corr"))
    return out.union(h.select(F.col("attr"), F.col("attr"), F.lit(1.0)))


def correlated(corr: DataFrame, threshold: float = schema.CORRELATION_THRESHOLD) -> DataFrame:
    """(attr_x, attr_y) of different attributes with a correlation of the threshold or more."""
    return corr.where((F.col("attr_x") != F.col("attr_y")) & (F.col("corr") >= threshold)).select("attr_x", "attr_y")
