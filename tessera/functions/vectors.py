"""Vector kernels used inside Arrow batches (mapInPandas) and their Spark-side wrappers."""

from __future__ import annotations

import numpy as np
import pandas as pd

# Largest medoid / candidate block broadcast at once (rows x dims of float64).
MAX_BROADCAST_VALUES = 50_000_000
# Largest context that a user scorer is given whole.
MAX_CONTEXT_ROWS = 100_000


def stack(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.concatenate(col.to_numpy()).astype(np.float64).reshape(len(col), -1)


def normalise(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return x / n


def pairwise(x: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    """Distances between rows of x (n x d) and m (k x d).  Cosine expects normalised rows."""
    if metric == "cosine":
        return np.clip(1.0 - x @ m.T, 0.0, 2.0)
    sq = (x * x).sum(1)[:, None] - 2.0 * (x @ m.T) + (m * m).sum(1)[None, :]
    return np.sqrt(np.maximum(sq, 0.0))


def check_broadcast(rows: int, dims: int):
    if rows * max(dims, 1) > MAX_BROADCAST_VALUES:
        raise ValueError(f"refusing to broadcast {rows} x {dims} values (> {MAX_BROADCAST_VALUES})")
