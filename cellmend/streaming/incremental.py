"""Incremental detection over a stream of tuples. An extension: the method itself works on a whole table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellmend.operators import detect
from cellmend.operators.cells import quoted
from cellmend.operators.constraints import Constraint
from cellmend.sources.tables import RunDirectory, checkpointed


def _blocks(table: DataFrame, some: DataFrame, c: Constraint) -> DataFrame:
    """Tuples of table that stand in a block with one of some, on either side of c."""
    left, right = [p.left for p in c.equal], [p.right for p in c.equal]
    values = lambda side: some.select(*[quoted(a).alias(f"__b{k}") for k, a in enumerate(side)])
    touched = values(left).union(values(right)).distinct()
    parts = []
    for side in [left] if left == right else [left, right]:
        condition = reduce(and_, [quoted(a) == touched[f"__b{k}"] for k, a in enumerate(side)])
        parts.append(table.join(touched, condition, "left_semi"))
    return reduce(DataFrame.union, parts).dropDuplicates(["tid"]) if len(parts) > 1 else parts[0]


def detect_batches(stream: DataFrame, run: RunDirectory, known: Callable[[], DataFrame], constraints: Sequence[Constraint], checkpoint: str, more: Sequence[detect.Detector] = ()) -> StreamingQuery:
    """For each micro-batch of wide tuples, the noisy cells of the tuples known so far that share a key with it are replaced.

    known() gives all tuples so far, the batch included, as a wide table. A tuple's cells can only change if it shares a key with the batch
    under some constraint. Those tuples' cells are made anew under every constraint, each over the complete blocks of the tuples: a
    semi-join on its own keys. Detectors in `more` look at the whole table, as their statistics do, and their cells are all replaced. A
    batch that is delivered twice gives the same table twice. A batch reads the keys of all that is known (semi-joins that the batch's keys
    filter) and rewrites the table of noisy cells: cheap beside detection over everything where blocks are small, not free. A write
    that fails leaves the table as it was.
    """

    def one(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        table = known()
        keyed = [c for c in constraints if c.equal]
        old, results = run.read("noisy_cells"), []
        if keyed:
            changed = checkpointed(reduce(DataFrame.union, [_blocks(table, batch, c).select("tid") for c in keyed]).distinct(), "changed")
            tuples = table.join(changed, "tid", "left_semi")
            fresh = reduce(DataFrame.unionByName, [detect.DenialConstraintDetector([c]).detect(_blocks(table, tuples, c)) for c in keyed])
            kept = old.where(F.col("detection_method").isNull()).join(changed, "tid", "left_anti")
            results.append(kept.unionByName(fresh.join(changed, "tid", "left_semi").distinct()))
        elif not more:
            return
        else:
            results.append(old.where(F.col("detection_method").isNull()))
        results += [d.detect(table) for d in more]
        run.write("noisy_cells", checkpointed(detect.merge(*results), "noisy"))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).outputMode("append").start()
