"""Detectors of noisy cells. Each gives (tid, attr, detection_method); merge() keeps one row a cell."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmend import schema
from cellmend.functions.layout import apart
from cellmend.functions.text import to_number
from cellmend.operators.cells import quoted, to_cells
from cellmend.operators.constraints import Constraint


class Detector(Protocol):
    def detect(self, wide: DataFrame) -> DataFrame:
        """Noisy cells of a wide table."""


def fd_support(wide: DataFrame, key: str, target: str) -> DataFrame:
    """(k, v, n): how often a target value occurs with a key value, both present."""
    pairs = wide.select(quoted(key).alias("k"), quoted(target).alias("v")).where("k is not null and v is not null")
    return pairs.groupBy("k", "v", apart("k", "v")).agg(F.count("*").alias("n")).drop("__apart")


def pair_violations(wide: DataFrame, c: Constraint) -> DataFrame:
    """(tid1, tid2) of tuples that together violate c, each pair once, before support. As many rows as there are violations."""
    if not c.equal:
        return wide.select("tid", F.col("tid").alias("tid2")).limit(0).toDF("tid1", "tid2")
    side = wide.select("tid", *[quoted(a) for a in c.attributes])
    joined = side.alias("l").join(side.alias("r"), c.condition("l", "r") & (F.col("l.tid") < F.col("r.tid")))
    return joined.select(F.col("l.tid").alias("tid1"), F.col("r.tid").alias("tid2"))


def violations(wide: DataFrame, c: Constraint, min_support: int = schema.MIN_SUPPORT) -> DataFrame:
    """(constraint_id, tid1, tid2); a pair that violates a dependency stays if the value on either side has support. As many rows as there are
    pairs, which grow with the square of a block: violation_classes() says the same in as many rows as there are values."""
    if c.fd is None:
        return pair_violations(wide, c).select(F.lit(c.id).alias("constraint_id"), "tid1", "tid2")
    key, target = c.fd
    # support comes with the rows, so no pair looks it up
    rows = wide.select("tid", quoted(key).alias("k"), quoted(target).alias("v")).where("k is not null and v is not null").join(fd_support(wide, key, target), ["k", "v"])
    joined = rows.alias("l").join(rows.alias("r"), (F.col("l.k") == F.col("r.k")) & (F.col("l.v") != F.col("r.v")) & (F.col("l.tid") < F.col("r.tid")))
    kept = joined.where((F.col("l.n") >= min_support) | (F.col("r.n") >= min_support))
    return kept.select(F.lit(c.id).alias("constraint_id"), F.col("l.tid").alias("tid1"), F.col("r.tid").alias("tid2"))


def violation_table(found: DataFrame) -> DataFrame:
    """In the stored form: (constraint_id, tids)."""
    return found.select("constraint_id", F.array(F.col("tid1").cast("long"), F.col("tid2").cast("long")).alias("tids"))


def _classes(wide: DataFrame, c: Constraint) -> DataFrame:
    """(key, value, n): tuples by their values of the equal and of the unequal attributes, all of them present."""
    keys, targets = sorted({p.left for p in c.equal}), sorted({p.left for p in c.unequal})
    array = lambda names: F.array(*[quoted(a).cast("string") for a in names]).cast("array<string>")
    rows = wide.dropna(subset=[*keys, *targets]).select(array(keys).alias("key"), array(targets).alias("value"))
    return rows.groupBy("key", "value").agg(F.count("*").alias("n"))


def violation_classes(wide: DataFrame, c: Constraint, min_support: int = schema.MIN_SUPPORT) -> DataFrame:
    """(constraint_id, key, value, n, n_links): tuples that are the same to a constraint with the same attributes on both sides, and with
    how many tuples each of them violates it, after support. All tuples of a class are linked to all of each other class of
    their key (with two unequal attributes or more: to those that differ in all), so no pair need be written.

    One row for each value of a key, from counts alone. With two unequal attributes or more the classes of a key meet each other.
    """
    empty = wide.select(F.lit(c.id).alias("constraint_id"), F.array().cast("array<string>").alias("key"), F.array().cast("array<string>").alias("value"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_links"))
    if not c.equal:
        return empty.limit(0)
    if not c.symmetric:
        raise ValueError(f"constraint {c.id} compares different attributes: its violations are pairs")
    counts = _classes(wide, c)
    if not c.unequal:  # sharing a key is the violation
        linked = counts.withColumn("n_links", F.col("n") - 1)
    elif c.block_form is not None:
        well = F.col("n") >= (min_support if c.fd else 0)
        blocks = counts.groupBy("key", apart("key")).agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(well, F.col("n"))), F.lit(0)).alias("supported")).drop("__apart")
        linked = counts.join(blocks, "key").withColumn("n_links", F.when(well, F.col("all") - F.col("n")).otherwise(F.col("supported")))
    else:
        differ = reduce(and_, [F.col("l.value")[k] != F.col("r.value")[k] for k in range(len({p.left for p in c.unequal}))])
        met = counts.alias("l").join(counts.alias("r"), (F.col("l.key") == F.col("r.key")) & differ)
        linked = met.groupBy(F.col("l.key").alias("key"), F.col("l.value").alias("value")).agg(F.first("l.n").alias("n"), F.sum("r.n").alias("n_links"))
    return linked.where("n_links > 0").select(F.lit(c.id).alias("constraint_id"), "key", "value", "n", "n_links")


def violation_counts(wide: DataFrame, c: Constraint) -> DataFrame:
    """(constraint_id, n_pairs): how many pairs violate c before support, from counts per block and value where these decide it."""
    if not c.equal or not c.symmetric:
        return pair_violations(wide, c).agg(F.lit(c.id).alias("constraint_id"), F.count("*").alias("n_pairs"))
    return _n_pairs(violation_classes(wide, c, 0)).select(F.lit(c.id).alias("constraint_id"), "n_pairs")


def _n_pairs(classes: DataFrame) -> DataFrame:
    n = F.sum(F.col("n").cast("decimal(38,0)") * F.col("n_links"))
    return classes.agg(F.coalesce(n / 2, F.lit(0)).cast("long").alias("n_pairs"))


def violation_summary(wide: DataFrame, c: Constraint, min_support: int = schema.MIN_SUPPORT) -> DataFrame:
    """(constraint_id, n_potential, n_ignored, n_stored): violating pairs, those without support on either side, and those that stay."""
    before = violation_counts(wide, c).select("constraint_id", F.col("n_pairs").alias("n_potential"))
    after = _n_pairs(violation_classes(wide, c, min_support)) if c.fd else before.select(F.col("n_potential").alias("n_pairs"))
    return before.join(after).select("constraint_id", "n_potential", (F.col("n_potential") - F.col("n_pairs")).alias("n_ignored"), F.col("n_pairs").alias("n_stored"))  # a row each


def fd_noisy(wide: DataFrame, key: str, target: str, min_support: int = schema.MIN_SUPPORT) -> DataFrame:
    """(tid, attr) of target cells that conflict with a supported value of their key.

    A cell with value v is noisy if some other value of its key has support: that follows from counts per (key, value) alone, so no
    pair of tuples is ever made, and the cost is linear however large a block is.
    """
    counts = fd_support(wide, key, target)
    well = (F.col("n") >= min_support).cast("int")
    per_key = counts.groupBy("k", apart("k")).agg(F.sum(well).alias("supported")).drop("__apart")
    bad = counts.join(per_key, "k").where(F.col("supported") - well >= 1).select("k", "v")
    rows = wide.select("tid", quoted(key).alias("k"), quoted(target).alias("v"))
    return rows.join(bad, ["k", "v"], "left_semi").select("tid", F.lit(target).alias("attr"))


def general_noisy(wide: DataFrame, c: Constraint) -> DataFrame:
    """(tid, attr) for a constraint that is no dependency: all its attributes, in both tuples of each violation."""
    if not c.equal:
        return wide.select("tid", F.lit("").alias("attr")).limit(0)
    side = wide.select("tid", *[quoted(a) for a in c.attributes])
    if c.block_form is not None:
        # a tuple takes part in a violation if its block holds two different targets
        keys, target = c.block_form
        present = side.dropna(subset=[*keys, target])
        mixed = present.groupBy(*[quoted(k) for k in keys], apart(*keys)).agg(F.min(quoted(target)).alias("__low"), F.max(quoted(target)).alias("__high")).where(F.col("__low") != F.col("__high"))
        tids = present.join(mixed.drop("__apart"), keys, "left_semi").select("tid")
    elif c.symmetric:
        # distinct rows of the attributes meet, not tuples; each finds its tuples again
        present = side.dropna(subset=c.attributes)
        rows = present.select(*[quoted(a) for a in c.attributes]).distinct()
        bad = rows.alias("l").join(rows.alias("r"), c.condition("l", "r"), "left_semi")
        bad = bad.select("*", apart(*c.attributes)).distinct().drop("__apart")
        tids = present.join(bad, c.attributes, "left_semi").select("tid")
    else:
        first = side.alias("l").join(side.alias("r"), c.condition("l", "r") & (F.col("l.tid") < F.col("r.tid")), "left_semi").select("tid")
        second = side.alias("r").join(side.alias("l"), c.condition("l", "r") & (F.col("l.tid") < F.col("r.tid")), "left_semi").select("tid")
        tids = first.union(second).distinct()
    return tids.select("tid", F.explode(F.array(*[F.lit(a) for a in c.attributes])).alias("attr"))


class DenialConstraintDetector:
    """Noisy cells by denial constraints; their detection_method is null."""

    def __init__(self, constraints: Sequence[Constraint], min_support: int = schema.MIN_SUPPORT):
        self.constraints, self.min_support = list(constraints), min_support

    def find_violations(self, wide: DataFrame, all_pairs: bool = True) -> DataFrame:
        """Pairs of tuples; without all_pairs only those of constraints that have no classes."""
        chosen = [c for c in self.constraints if all_pairs or not c.symmetric]
        parts = [violations(wide, c, self.min_support) for c in chosen]
        none = wide.select(F.lit(0).alias("constraint_id"), F.col("tid").alias("tid1"), F.col("tid").alias("tid2")).limit(0)
        return reduce(DataFrame.unionByName, parts, none)

    def find_classes(self, wide: DataFrame) -> DataFrame:
        """violation_classes() of all constraints with the same attributes on both sides."""
        parts = [violation_classes(wide, c, self.min_support) for c in self.constraints if c.symmetric]
        return reduce(DataFrame.unionByName, parts) if parts else wide.sparkSession.createDataFrame([], schema.VIOLATION_CLASSES)

    def detect(self, wide: DataFrame) -> DataFrame:
        parts = [fd_noisy(wide, *c.fd, self.min_support) if c.fd else general_noisy(wide, c) for c in self.constraints]
        return reduce(DataFrame.unionByName, parts).distinct().withColumn("detection_method", F.lit(None).cast("string"))


class OutlierDetector:
    """Noisy cells whose number is further from its attribute's mean than `threshold` standard deviations."""

    def __init__(self, attributes: Sequence[str] | None = None, method: str = "zscore", threshold: float = schema.Z_THRESHOLD):
        if method != "zscore":
            raise ValueError(f"unknown method {method!r}")
        self.attributes, self.threshold = list(attributes or schema.OUTLIER_ATTRIBUTES), threshold

    def scores(self, wide: DataFrame) -> DataFrame:
        """(tid, attr, number, z) of all numeric cells of attributes with two numbers or more and some spread."""
        mine = [a for a in self.attributes if a in wide.columns]
        if not mine:
            return wide.select("tid", F.lit("").alias("attr"), F.lit(0.0).alias("number"), F.lit(0.0).alias("z")).limit(0)
        numbers = to_cells(wide.select("tid", *[quoted(a).cast("string").alias(a) for a in mine]), mine).select("tid", "attr", to_number(F.col("val")).alias("number"))
        numbers = numbers.where(F.col("number").isNotNull() & ~F.isnan("number"))
        stats = numbers.groupBy("attr").agg(F.avg("number").alias("mean"), F.stddev_pop("number").alias("spread"), F.count("*").alias("n"))
        z = F.abs(F.try_divide(F.col("number") - F.col("mean"), F.nullif("spread", F.lit(0.0))))
        return numbers.join(F.broadcast(stats.where("n >= 2")), "attr").select("tid", "attr", "number", z.alias("z"))  # one row for each named attribute

    def detect(self, wide: DataFrame) -> DataFrame:
        found = self.scores(wide).where(~F.isnan("z") & (F.col("z") > self.threshold))
        return found.select("tid", "attr", F.lit(schema.OUTLIER_METHOD).alias("detection_method"))


def merge(*results: DataFrame) -> DataFrame:
    """One row a cell: that of the first detector which found it."""
    ranked = reduce(DataFrame.unionByName, [r.select("tid", "attr", "detection_method", F.lit(k).alias("__rank")) for k, r in enumerate(results)])
    first = Window.partitionBy("tid", "attr").orderBy("__rank", F.col("detection_method").asc_nulls_first())
    return ranked.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("tid", "attr", "detection_method")


def run_detectors(wide: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    return merge(*[d.detect(wide) for d in detectors])


__all__ = ["DenialConstraintDetector", "Detector", "OutlierDetector", "merge", "run_detectors", "violation_classes", "violations"]
