"""Repairs against ground truth, and reports on weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.functions.text import or_placeholder
from cellmend.operators.features import family


def judged(cells: DataFrame, truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(tid, attr, original, truth, predicted, is_noisy, is_error, outcome). outcome is tp, fp, fn or null; missing values are compared as
    the placeholder. A noisy clean cell that is predicted right counts nowhere; a wrong repair of an error is both fp and fn, here fp."""
    original = cells.select("tid", "attr", or_placeholder(F.col("val")).alias("original"), "is_noisy")
    rows = original.join(truth.select("tid", "attr", F.col("correct_val").alias("truth")), ["tid", "attr"], "left").join(predictions.select("tid", "attr", F.col("predicted_val").alias("predicted")), ["tid", "attr"], "left")
    error = F.coalesce(F.col("original") != F.col("truth"), F.lit(False))
    usable = F.col("is_noisy") & F.col("truth").isNotNull() & F.col("predicted").isNotNull()
    right = F.col("predicted") == F.col("truth")
    outcome = F.when(usable & right & error, "tp").when(usable & ~right, "fp").when(F.col("is_noisy") & error & F.col("predicted").isNull(), "fn")
    return rows.select("tid", "attr", "original", "truth", "predicted", "is_noisy", error.alias("is_error"), outcome.alias("outcome"))


def confusion(rows: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, n_errors, noisy_errors, n_predicted."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    noisy_error = F.col("is_noisy") & F.col("is_error")
    return rows.agg(
        n(F.col("outcome") == "tp").alias("tp"), n(F.col("outcome") == "fp").alias("fp"), n(noisy_error & ~F.col("outcome").eqNullSafe(F.lit("tp"))).alias("fn"),
        n(F.col("is_error")).alias("n_errors"), n(noisy_error).alias("noisy_errors"), n(F.col("is_noisy") & F.col("truth").isNotNull() & F.col("predicted").isNotNull()).alias("n_predicted"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def metrics(counts: DataFrame) -> DataFrame:
    """One row: precision, recall_noisy (of errors that a detector found), f1_noisy, recall_all (of all errors)."""
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("noisy_errors"))
    out = counts.select(p.alias("precision"), r.alias("recall_noisy"), _ratio(F.col("tp"), F.col("n_errors")).alias("recall_all"))
    return out.select("precision", "recall_noisy", _ratio(2 * F.col("precision") * F.col("recall_noisy"), F.col("precision") + F.col("recall_noisy")).alias("f1_noisy"), "recall_all")


def examples(rows: DataFrame, tp: int = 5, fp: int = 10, fn: int = 10) -> DataFrame:
    """(kind, tid, attr, original, truth, predicted): the first of each kind in order of cell. A wrong repair of an error is an example of both."""
    missed = rows.where(F.col("is_noisy") & F.col("is_error") & ~F.col("outcome").eqNullSafe(F.lit("tp")))
    kinds = [("tp", rows.where("outcome = 'tp'"), tp), ("fp", rows.where("outcome = 'fp'"), fp), ("fn", missed, fn)]
    parts = [df.orderBy("tid", "attr").limit(n).select(F.lit(k).alias("kind"), "tid", "attr", "original", "truth", "predicted") for k, df, n in kinds]
    return parts[0].union(parts[1]).union(parts[2])


def weight_report(weights: DataFrame) -> DataFrame:
    """(family, n, mean, std, low, high, mean_abs) with the population's standard deviation."""
    w = F.col("weight")
    return weights.groupBy(family(F.col("feature")).alias("family")).agg(
        F.count("*").alias("n"), F.avg(w).alias("mean"), F.stddev_pop(w).alias("std"), F.min(w).alias("low"), F.max(w).alias("high"), F.avg(F.abs(w)).alias("mean_abs")
    )
