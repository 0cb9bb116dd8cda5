"""Between wide tables (tid and one column for each attribute) and cells (tid, attr, val, is_noisy)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.functions.text import or_placeholder


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def attributes(wide: DataFrame) -> list[str]:
    return sorted(c for c in wide.columns if c != "tid")


def to_cells(wide: DataFrame, attrs: list[str] | None = None) -> DataFrame:
    """One row a cell, null values kept; narrow."""
    attrs = attrs or attributes(wide)
    return wide.unpivot(["tid"], [quoted(a) for a in attrs], "attr", "val").select(F.col("tid").cast("long"), "attr", F.col("val").cast("string"), F.lit(False).alias("is_noisy"))


def to_wide(cells: DataFrame, attrs: list[str]) -> DataFrame:
    """One row a tuple; the attributes are given, so no extra pass looks for them."""
    return cells.groupBy("tid").pivot("attr", attrs).agg(F.first("val"))


def to_tuples(cells: DataFrame) -> DataFrame:
    """(tid, values): each tuple as a map of attribute to value."""
    return cells.groupBy("tid").agg(F.map_from_entries(F.collect_list(F.struct("attr", "val"))).alias("values"))


def with_placeholder(wide: DataFrame) -> DataFrame:
    return wide.select("tid", *[or_placeholder(quoted(a)).alias(a) for a in attributes(wide)])


def mark_noisy(cells: DataFrame, noisy: DataFrame) -> DataFrame:
    """is_noisy set anew from the noisy cells."""
    flags = noisy.select("tid", "attr", F.lit(True).alias("flag")).distinct()
    return cells.drop("is_noisy").join(flags, ["tid", "attr"], "left").select("tid", "attr", "val", F.coalesce("flag", F.lit(False)).alias("is_noisy"))
