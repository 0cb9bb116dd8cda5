"""Hints on how Spark lays out a plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def apart(*keys: str) -> Column:
    """A second grouping key that follows from the first ones. A later join on those alone then reads the aggregate through an exchange
    of its own, and AQE can split the other side's hot keys: it cannot where an aggregate stands between join and exchange."""
    return F.hash(*[F.col("`" + k.replace("`", "``") + "`") for k in keys]).alias("__apart")
