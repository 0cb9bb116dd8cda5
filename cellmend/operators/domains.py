"""Candidate values of each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmend import schema
from cellmend.functions.layout import apart
from cellmend.operators import stats
from cellmend.operators.cells import to_cells
from cellmend.sources.tables import checkpointed


def candidates(pairs: DataFrame, singles: DataFrame, threshold: float = schema.COOCCURRENCE_THRESHOLD, top: int = schema.TOP_CANDIDATES) -> DataFrame:
    """(target, cond, cond_val, candidate_val, n, p): the likeliest values of target beside a value of cond, at most `top`, ties in the
    order of first occurrence. Made once for each value of cond, not for each cell."""
    given = singles.select(F.col("attr").alias("cond"), F.col("val").alias("cond_val"), F.col("n").alias("all"))
    p = stats.pair_stats(pairs).select(F.col("a1").alias("cond"), F.col("v1").alias("cond_val"), F.col("a2").alias("target"), F.col("v2").alias("candidate_val"), "n", "first_tid")
    p = p.join(given, ["cond", "cond_val"]).withColumn("p", F.col("n") / F.col("all")).where(F.col("p") >= threshold)
    best = Window.partitionBy("target", "cond", "cond_val").orderBy(F.desc("n"), "first_tid")
    return p.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= top).select("target", "cond", "cond_val", "candidate_val", "n", "p")


def from_context(cells: DataFrame, cands: DataFrame, related: DataFrame) -> DataFrame:
    """(tid, attr, candidate_val) that the other cells of a tuple propose."""
    usable = cands.join(F.broadcast(related.select(F.col("attr_x").alias("target"), F.col("attr_y").alias("cond"))), ["target", "cond"])  # pairs of attributes
    # all candidates of a context value in one row (at most `top` for each attribute): the join then carries each cell once
    listed = usable.groupBy("cond", "cond_val", apart("cond", "cond_val")).agg(F.collect_set(F.struct("target", "candidate_val")).alias("found")).drop("__apart")
    context = cells.where("val is not null").select("tid", F.col("attr").alias("cond"), F.col("val").alias("cond_val"))
    return context.join(listed, ["cond", "cond_val"]).select("tid", F.explode("found").alias("f")).select("tid", F.col("f.target").alias("attr"), F.col("f.candidate_val").alias("candidate_val"))


def fallback(cells: DataFrame, domains: DataFrame, noisy: DataFrame, singles: DataFrame, least: int = schema.MIN_DOMAIN_SIZE) -> DataFrame:
    """(tid, attr, candidate_val) for noisy cells with fewer than `least` candidates: their attribute's most frequent values, ties in the order of
    first occurrence, until there are enough."""
    sizes = domains.groupBy("tid", "attr").agg(F.collect_set("candidate_val").alias("has"))
    short = noisy.select("tid", "attr").distinct().join(cells.select("tid", "attr"), ["tid", "attr"]).join(sizes, ["tid", "attr"], "left")
    short = short.withColumn("has", F.coalesce("has", F.array().cast("array<string>"))).where(F.size("has") < least)
    rank = Window.partitionBy("attr").orderBy(F.desc("n"), "first_tid", "val")
    frequent = singles.where(F.col("val") != schema.PLACEHOLDER).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= 2 * least)
    frequent = frequent.groupBy("attr").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "val"))), lambda x: x.val).alias("often"))  # 2 * least values an attribute
    more = F.slice(F.array_except("often", "has"), F.lit(1), F.lit(least) - F.size("has"))
    return short.join(F.broadcast(frequent), "attr").select("tid", "attr", F.explode(more).alias("candidate_val"))


def generate(wide: DataFrame, noisy: DataFrame, correlation_threshold: float = schema.CORRELATION_THRESHOLD, cooccurrence_threshold: float = schema.COOCCURRENCE_THRESHOLD,
             top: int = schema.TOP_CANDIDATES, least: int = schema.MIN_DOMAIN_SIZE, cap: int | None = None) -> DataFrame:
    """(tid, attr, candidate_val) for all cells, noisy or not: the value itself, what the tuple's other values propose, and the fallback.
    cap keeps the first candidates in order of value; there is none unless it is asked for."""
    cells = to_cells(wide)
    # each is read twice or more, and is small beside the scans and joins that make it
    pairs, singles = checkpointed(stats.pair_counts(wide), "pairs"), checkpointed(stats.single_stats(cells), "singles")
    related = stats.correlated(stats.correlations(singles, pairs), correlation_threshold)
    cands = candidates(pairs, singles, cooccurrence_threshold, top)
    own = cells.where(F.col("val").isNotNull() & (F.col("val") != schema.PLACEHOLDER)).select("tid", "attr", F.col("val").alias("candidate_val"))
    domains = checkpointed(own.union(from_context(cells, cands, related)).distinct(), "proposed")
    domains = domains.union(fallback(cells, domains, noisy, singles, least)).where(F.col("candidate_val") != schema.PLACEHOLDER)
    if cap is not None:
        domains = domains.withColumn("__r", F.row_number().over(Window.partitionBy("tid", "attr").orderBy("candidate_val"))).where(F.col("__r") <= cap).drop("__r")
    return domains


def sizes(domains: DataFrame) -> DataFrame:
    """(tid, attr, size)."""
    return domains.groupBy("tid", "attr").agg(F.countDistinct("candidate_val").alias("size"))


def max_size(domains: DataFrame) -> DataFrame:
    return sizes(domains).agg(F.max("size").alias("max_size"))
