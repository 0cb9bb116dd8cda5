"""Binary features of (cell, candidate) pairs, by name. Four families; a weight is shared by all cells that have the feature."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend import schema
from cellmend.functions.layout import apart
from cellmend.functions.text import log_bin
from cellmend.operators import stats
from cellmend.operators.cells import attributes, quoted, to_cells, with_placeholder
from cellmend.operators.constraints import Constraint

_KEYS = ["tid", "attr", "candidate_val"]


def cooccurrence(domains: DataFrame, cells: DataFrame) -> DataFrame:
    """The candidate beside each other value of its tuple. Names are plain text, so two values can give one name (value `c=d` of b, value
    `d` of `b=c`): it counts once. The rows of a candidate are together after the join, so this moves nothing."""
    other = cells.where("val is not null").select("tid", F.col("attr").alias("other"), "val")
    name = F.concat(F.lit(schema.COOC_PREFIX), "attr", F.lit("="), "candidate_val", F.lit("_"), "other", F.lit("="), "val")
    return domains.join(other, "tid").where(F.col("attr") != F.col("other")).select(*_KEYS, name.alias("feature")).distinct()


def minimality(domains: DataFrame, cells: DataFrame) -> DataFrame:
    """The candidate is the cell's own value."""
    own = cells.select("tid", "attr", F.col("val").alias("candidate_val"))
    return domains.join(own, _KEYS, "left_semi").select(*_KEYS, F.lit(schema.PRIOR_FEATURE).alias("feature"))


def log_frequency(domains: DataFrame, cells: DataFrame) -> DataFrame:
    """Power of ten of how often the candidate occurs in its attribute."""
    counts = stats.value_counts(cells).select("attr", F.col("val").alias("candidate_val"), "n")
    bin_ = log_bin(F.coalesce("n", F.lit(0)))
    name = F.concat(F.lit(schema.FREQ_PREFIX), "attr", F.lit("_BIN="), bin_.cast("string"))
    return domains.join(counts, ["attr", "candidate_val"], "left").select(*_KEYS, name.alias("feature"))


def _hypothetical(domains: DataFrame, wide: DataFrame, names: list[str]) -> DataFrame:
    """Each candidate's tuple with the candidate put in (h_*), and the original values (o_*). wide has the placeholder for null."""
    side = wide.select("tid", *[quoted(a).alias(f"o_{a}") for a in names])
    put = [F.when(F.col("attr") == a, F.col("candidate_val")).otherwise(quoted(f"o_{a}")).alias(f"h_{a}") for a in names]
    return domains.where(F.col("attr").isin(*names)).join(side, "tid").select(*_KEYS, *[quoted(f"o_{a}") for a in names], *put)


def dc_violation(domains: DataFrame, wide: DataFrame, c: Constraint) -> DataFrame:
    """The tuple with the candidate put in violates c with some other tuple. Missing values are values here, but never keys.

    With one unequal attribute counts decide: the block of the new key holds a tuple with another target, besides the tuple itself if
    it stands in that block. No pair of tuples is made. Other constraints take a left-semi join with the distinct rows of c's attributes
    and what tells whether such a row is some other tuple's: how many have it, and the first.
    """
    if not c.equal:
        return domains.select(*_KEYS, F.lit("").alias("feature")).limit(0)
    filled = with_placeholder(wide.select("tid", *[quoted(a) for a in c.attributes]))
    h = _hypothetical(domains, filled, c.attributes)
    name = F.concat(F.lit(f"{schema.DC_PREFIX}{c.id}_ON_"), "attr").alias("feature")
    if c.block_form is not None:
        keys, target = c.block_form
        for a in keys:
            h = h.where(quoted(f"h_{a}") != schema.PLACEHOLDER)
        present = reduce(and_, [quoted(a) != schema.PLACEHOLDER for a in keys])
        on, whole = [f"h_{a}" for a in keys], [*(f"h_{a}" for a in keys), f"h_{target}"]
        n = filled.where(present).select(*[quoted(a).alias(f"h_{a}") for a in [*keys, target]])
        n = n.groupBy(*map(quoted, whole), apart(*whole)).agg(F.count("*").alias("same")).drop("__apart")
        block = n.groupBy(*map(quoted, on), apart(*on)).agg(F.sum("same").alias("all")).drop("__apart")
        found = h.join(block, [f"h_{a}" for a in keys]).join(n, [*[f"h_{a}" for a in keys], f"h_{target}"], "left")
        at_home = reduce(and_, [quoted(f"h_{a}") == quoted(f"o_{a}") for a in keys])
        own = F.when(at_home & (quoted(f"o_{target}") != quoted(f"h_{target}")), 1).otherwise(0)
        return found.where(F.col("all") - F.coalesce("same", F.lit(0)) - own > 0).select(*_KEYS, name)
    other = filled.groupBy(*[quoted(a).alias(f"p_{a}") for a in c.attributes]).agg(F.count("*").alias("__n"), F.min("tid").alias("__first"))
    condition = (F.col("__n") > 1) | (F.col("__first") != F.col("tid"))
    for p in c.predicates:
        condition &= p.holds(quoted(f"h_{p.left}"), quoted(f"p_{p.right}"))
        if p.op == "EQ":
            condition &= quoted(f"h_{p.left}") != schema.PLACEHOLDER
    return h.join(other, condition, "left_semi").select(*_KEYS, name)


def dc_counts(domains: DataFrame, wide: DataFrame, c: Constraint) -> DataFrame:
    """(constraint_id, n_candidates, n_skipped, n_found): candidates of the constraint's attributes, those that cannot be checked as a key is
    missing or the constraint has none, and those that violate it."""
    mine = domains.where(F.col("attr").isin(*c.attributes))
    if not c.equal:
        n = mine.agg(F.count("*").alias("n_candidates"))
        return n.select(F.lit(c.id).alias("constraint_id"), "n_candidates", F.col("n_candidates").alias("n_skipped"), F.lit(0).cast("long").alias("n_found"))
    h = _hypothetical(domains, with_placeholder(wide.select("tid", *[quoted(a) for a in c.attributes])), c.attributes)
    whole = reduce(and_, [quoted(f"h_{p.left}") != schema.PLACEHOLDER for p in c.equal])
    n = h.agg(F.count("*").alias("n_candidates"), F.count_if(~whole).alias("n_skipped"))
    return n.join(dc_violation(domains, wide, c).agg(F.count("*").alias("n_found"))).select(F.lit(c.id).alias("constraint_id"), "n_candidates", "n_skipped", "n_found")  # a row each


def compile_all(wide: DataFrame, domains: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """(tid, attr, candidate_val, feature). The families' names differ and each gives a name once, so their union needs no shuffle."""
    cells = to_cells(wide, attributes(wide))
    parts = [cooccurrence(domains, cells), minimality(domains, cells), log_frequency(domains, cells)]
    parts += [dc_violation(domains, wide, c) for c in constraints]
    return reduce(DataFrame.unionByName, parts)


def counts(features: DataFrame) -> DataFrame:
    """(family, n_rows, n_names)."""
    return features.groupBy(family(F.col("feature")).alias("family")).agg(F.count("*").alias("n_rows"), F.countDistinct("feature").alias("n_names"))


def family(feature: Column) -> Column:
    return (
        F.when(feature == schema.PRIOR_FEATURE, "prior").when(feature.startswith(schema.DC_PREFIX), "dc").when(feature.startswith(schema.COOC_PREFIX), "cooc")
        .when(feature.startswith(schema.FREQ_PREFIX), "logfreq").otherwise("other")
    )
