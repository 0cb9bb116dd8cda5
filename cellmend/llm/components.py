"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.llm import common


def _min_neighbour(both: DataFrame) -> DataFrame:
    return both.groupBy("u", common.apart("u")).agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that each node of edges reaches. Node ids are longs, of any sign.

    Large-star links every larger neighbour of a node to the least one it sees, small-star the smaller ones; both
    keep the components, and stars at the least node are their only fixed point, reached in O(log^2 n) rounds. A node
    of high degree never meets its neighbours in one task: minima combine before the shuffle, and they
    come back through a join that AQE splits. Each round is written to the shared folder, the one before is deleted.
    """
    e = common.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_min_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = common.save(large, "large-star")
        low = large.groupBy("u", common.apart("u")).agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        small = common.save(small, "small-star")
        changed = small.count() != e.count() or small.exceptAll(e).limit(1).count()
        for old in (e, large):
            common.drop_saved(old)
        e = small
        if not changed:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
