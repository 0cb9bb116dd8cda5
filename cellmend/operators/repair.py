"""From marginals to repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def argmax(marginals: DataFrame) -> DataFrame:
    """(tid, attr, predicted_val, prob): the likeliest candidate of each cell, of equals the first by value."""
    best = Window.partitionBy("tid", "attr").orderBy(F.desc("prob"), "candidate_val")
    return marginals.withColumn("__r", F.row_number().over(best)).where("__r = 1").select("tid", "attr", F.col("candidate_val").alias("predicted_val"), "prob")


def marginal_maps(marginals: DataFrame) -> DataFrame:
    """(tid, attr, marginals): each cell's candidates and probabilities as a map."""
    return marginals.groupBy("tid", "attr").agg(F.map_from_entries(F.collect_list(F.struct("candidate_val", "prob"))).alias("marginals"))


def repairs(marginals: DataFrame) -> DataFrame:
    """(tid, attr, repaired_val, confidence)."""
    return argmax(marginals).select("tid", "attr", F.col("predicted_val").alias("repaired_val"), F.col("prob").cast("float").alias("confidence"))


def apply_repairs(cells: DataFrame, fixed: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """Cells with the repaired values put in."""
    use = fixed.where(F.col("confidence") >= least_confidence).select("tid", "attr", "repaired_val")
    return cells.join(use, ["tid", "attr"], "left").select("tid", "attr", F.coalesce("repaired_val", "val").alias("val"), "is_noisy")
