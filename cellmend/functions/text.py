"""Column functions on cell values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellmend.schema import NULL_TEXTS, PLACEHOLDER

#: What counts as a number; guards try_cast, which takes more ('1d') than a number parser should.
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?)\s*$"


def strip(c: Column) -> Column:
    """Without white space of any alphabet at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalise_null(c: Column) -> Column:
    """Stripped, and null where the text means a missing value."""
    s = strip(c)
    return F.when(s.isin(*NULL_TEXTS), None).otherwise(s)


def or_placeholder(c: Column) -> Column:
    return F.coalesce(c, F.lit(PLACEHOLDER))


def to_number(c: Column) -> Column:
    """The number that a text is, else null."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def log_bin(count: Column) -> Column:
    """0..5 by powers of ten of count + 1, in integers."""
    out = F.lit(0)
    for k in range(1, 6):
        out = F.when(count + 1 >= 10**k, k).otherwise(out)
    return out
