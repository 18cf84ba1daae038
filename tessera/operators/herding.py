"""RDSS selection (I12): representative-and-diverse greedy pick (alpha-MMD kernel herding).

Gaussian kernel k(x, y) = exp(-gamma |x - y|^2); the bandwidth is not visible in the
reference snapshot, so ``gamma`` is an explicit parameter (default 1 / dims).

mu(x) = mean kernel of x to the pool is exact: blocks of the pool (``block`` rows, by default as
large as memory and parallelism allow) meet in one task per pair, so memory stays bounded
and no pair rows are produced; the work is quadratic in the pool, as in the method.

Greedy round t (t rows already picked) takes the unpicked row with the least
  pen(x) / (t + 1) - alpha * mu(x),   pen(x) = sum of k(x, s) over picked s,
(the x-dependent part of the alpha-MMD of the grown set; ties by row_id).  One Spark
job per round updates ``pen`` with the last pick and finds the next; lineage is cut
with a reliable checkpoint every ``checkpoint_every`` rounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.tiles import BLOCK_ROWS, meet
from tessera.session import cut_lineage


MAX_BLOCK = 1 << 15  # rows of a block: each row is sent to as many tasks as there are blocks
CELLS = 1 << 22  # kernel values held at once


def _kernel(x: np.ndarray, m: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * V.pairwise(x, m, "euclidean") ** 2)


def _block_rows(rows: int, tasks: int) -> int:
    """Rows of a block: as few blocks as give every task a pair of them, so that no row travels more than it must, and no
    block over MAX_BLOCK."""
    cuts = max(math.ceil(rows / MAX_BLOCK), min(math.ceil(rows / BLOCK_ROWS), math.ceil(math.sqrt(tasks))))
    return max(1, math.ceil(rows / cuts))


def kernel_means(pool: DataFrame, gamma: float, block: int | None = None) -> DataFrame:
    """(row_id, features, mu): exact mean kernel to the whole pool.  Blocks of the pool meet blocks of the pool on the
    executors, and partial sums are added up; one job, nothing passes the driver."""
    def sums(x: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(m):
            return pd.DataFrame({"row_id": [], "ksum": []})
        own, other = V.stack(x["features"]), V.stack(m["features"])
        step = max(1, CELLS // len(other))
        return pd.DataFrame({"row_id": x["row_id"], "ksum": np.concatenate([_kernel(own[lo:lo + step], other, gamma).sum(1) for lo in range(0, len(own), step)])})

    rows = pool.select("row_id", "features")
    block = block or _block_rows(rows.count(), pool.sparkSession.sparkContext.defaultParallelism)
    total = meet(rows, rows, sums, "row_id long, ksum double", block, block).groupBy("row_id").agg(F.sum("ksum").alias("ksum"))
    n = pool.select(F.count(F.lit(1))).scalar()
    return rows.join(total, "row_id").select("row_id", "features", (F.col("ksum") / n).alias("mu"))


def rdss(pool: DataFrame, n: int, alpha: float | None = None, gamma: float | None = None,
         block: int | None = None, checkpoint_every: int = 8) -> list[int]:
    """Ids of the n rows picked by alpha-MMD herding (in pick order).  n <= 0 is an error;
    n >= N returns the whole pool."""
    if n <= 0:
        raise ValueError("RDSS needs a positive budget")
    total = pool.count()
    if n >= total:
        return [r[0] for r in pool.select("row_id").orderBy("row_id").collect()]
    dims = len(pool.select("features").first()[0])
    gamma = gamma if gamma is not None else 1.0 / dims
    alpha = alpha if alpha is not None else 1.0 - 1.0 / math.sqrt(total)
    sc = pool.sparkSession.sparkContext
    state = kernel_means(pool, gamma, block).withColumn("pen", F.lit(0.0)).withColumn("picked", F.lit(False))
    state = cut_lineage(state)
    picks: list[int] = []
    last_vec = None
    for t in range(n):
        if last_vec is not None:
            b = sc.broadcast((picks[-1], np.asarray(last_vec, dtype=np.float64)[None, :]))

            def upd(it, b=b):
                pid, v = b.value
                for pdf in it:
                    if len(pdf):
                        x = V.stack(pdf["features"])
                        yield pdf.assign(pen=pdf["pen"].to_numpy() + _kernel(x, v, gamma)[:, 0],
                                         picked=pdf["picked"].to_numpy() | (pdf["row_id"].to_numpy() == pid))
            prev = state
            state = state.mapInPandas(upd, "row_id long, features array<float>, mu double, pen double, picked boolean")
            # reliable checkpoint every few rounds, cached in between (no recompute of pending updates)
            state = cut_lineage(state) if t % checkpoint_every == 0 else state.persist()
            state.count()  # the new state is filled from the cached old one before that goes
            prev.unpersist()
        score = F.col("pen") / F.lit(float(t + 1)) - F.lit(alpha) * F.col("mu")
        best = (state.filter(~F.col("picked"))
                .agg(F.min_by(F.struct("row_id", "features"), F.struct(score, F.col("row_id"))).alias("b")).first()["b"])
        picks.append(best["row_id"])
        last_vec = best["features"]
    state.unpersist()
    return picks
