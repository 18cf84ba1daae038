"""All rows of one table against all rows of another, block by block on the executors.

Both sides are cut into blocks of about ``left_rows`` / ``right_rows`` rows by a hash of the key; every left block
meets every right block in one grouped task, which sees two bounded NumPy blocks.  Nothing passes the driver and no
block grows with the input; the number of blocks comes from scalar subqueries, so building the plan runs no job.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def _cuts(df: DataFrame, rows: int) -> Column:
    return df.select(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(rows)), F.lit(1)).cast("int")).scalar()


def meet(left: DataFrame, right: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
         left_rows: int = BLOCK_ROWS, right_rows: int = BLOCK_ROWS, key: str = "row_id", by: tuple = ()) -> DataFrame:
    """``fn(left block, right block)`` for every pair of blocks (with equal ``by`` columns, which both sides have).
    Blocks are pandas frames with all columns of their side; either may be empty."""
    n_left, n_right = _cuts(left, left_rows), _cuts(right, right_rows)
    # new column ids on one side: both may come from the same table
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    cut = lambda n: F.pmod(F.xxhash64(key), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = left.withColumn("_a", cut(n_left)).withColumn("_b", all_of(n_right))
    b = right.withColumn("_b", cut(n_right)).withColumn("_a", all_of(n_left))
    return a.groupBy(*by, "_a", "_b").cogroup(b.groupBy(*by, "_a", "_b")).applyInPandas(
        lambda x, y: fn(x, y), schema)
