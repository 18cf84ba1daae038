"""Join helpers: null-safe keys and broadcast of config tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, cols) -> DataFrame:
    """The columns under new ids, so that ``df`` can be joined with a table it was derived from."""
    return df.select(*[F.col(c).alias(c) for c in cols])


def null_safe_on(left: DataFrame, right: DataFrame, cols) -> Column:
    """Equality on every key column where NULL equals NULL (``<=>``)."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def small_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast for frames whose size is bounded by construction (config tables:
    methods, budgets, labels, thresholds).  Tables derived from data get no hint: Spark
    broadcasts them by their size in bytes, at plan time or (AQE) at run time."""
    return F.broadcast(df)
