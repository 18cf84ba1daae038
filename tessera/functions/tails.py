"""Distribution tails for the statistics operators (no SciPy on the image).

Scalar NumPy/math functions plus pandas UDF wrappers so the p-values are
computed next to the data in Arrow batches.

* normal: ``erfc`` from ``math``
* chi-square: regularised upper incomplete gamma (series / continued fraction)
* studentized range with infinite degrees of freedom:
  P(R <= q) = k * integral phi(z) * (Phi(z + q) - Phi(z))^(k-1) dz
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SQRT2 = math.sqrt(2.0)


def normal_two_sided_p(z: float) -> float:
    if z is None or (isinstance(z, float) and math.isnan(z)):
        return float("nan")
    return math.erfc(abs(z) / SQRT2)


@lru_cache(maxsize=256)
def _signed_rank_counts(n: int) -> np.ndarray:
    """How many of the 2^n sign choices of the ranks 1..n give each sum of positive ranks (exact below 2^53)."""
    c = np.zeros(n * (n + 1) // 2 + 1)
    c[0] = 1.0
    for r in range(1, n + 1):
        c[r:] = c[r:] + c[:len(c) - r]
    return c


def signed_rank_p(n: int, statistic: float) -> float:
    """Exact two-sided p of the smaller rank sum of n untied, non-zero differences."""
    c = _signed_rank_counts(n)
    return float(min(1.0, 2.0 * c[:int(round(statistic)) + 1].sum() / c.sum()))


@lru_cache(maxsize=256)
def _rank_sum_counts(n0: int, n1: int) -> np.ndarray:
    """How many of the choices of n0 among n0 + n1 ranks give each value of U (0..n0 n1)."""
    ways = [np.zeros(n0 * n1 + 1) for _ in range(n0 + 1)]
    ways[0][0] = 1.0
    for rank in range(n0 + n1):  # the k-th chosen of rank r (from 0) stands above r - k unchosen ones
        for k in range(min(rank, n0 - 1), -1, -1):
            above = rank - k
            if above <= n1:
                ways[k + 1][above:] += ways[k][:len(ways[k]) - above] if above else ways[k]
    return ways[n0]


def mann_whitney_p(n0: int, n1: int, u: float) -> float:
    """Exact two-sided p of U without ties."""
    small, large = min(n0, n1), max(n0, n1)
    c = _rank_sum_counts(small, large)
    top = int(round(max(u, n0 * n1 - u)))
    return float(min(1.0, 2.0 * c[top:].sum() / c.sum()))


def _gammq(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x < 0 or a <= 0:
        return float("nan")
    if x == 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1.0:  # series for P
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    # Lentz continued fraction for Q
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def chi2_sf(x: float, dof: float) -> float:
    if x is None or dof is None or math.isnan(x) or dof <= 0:
        return float("nan")
    return _gammq(dof / 2.0, x / 2.0)


_Z = np.linspace(-9.0, 9.0, 4001)
_PHI = np.exp(-0.5 * _Z ** 2) / math.sqrt(2 * math.pi)
_ERF = np.vectorize(math.erf)


def _Phi(x):
    return 0.5 * (1.0 + _ERF(np.asarray(x) / SQRT2))


_PHI_Z = _Phi(_Z)


def studentized_range_cdf(q: float, k: int) -> float:
    """P(range of k iid N(0,1) <= q) (df = infinity), trapezoid on a fine grid."""
    if q <= 0:
        return 0.0
    inner = np.clip(_Phi(_Z + q) - _PHI_Z, 0.0, 1.0) ** (k - 1)
    return float(min(1.0, k * np.trapezoid(_PHI * inner, _Z)))


def studentized_range_ppf(p: float, k: int) -> float:
    lo, hi = 0.0, 20.0
    for _ in range(80):
        mid = 0.5 * (lo + hi)
        if studentized_range_cdf(mid, k) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def nemenyi_cd(n_methods: int, n_datasets: int, alpha: float = 0.05) -> float:
    """H3: critical distance q(alpha, k, inf)/sqrt(2) * sqrt(k(k+1)/(6N))."""
    if n_methods < 2 or n_datasets < 1:
        return float("nan")
    q = studentized_range_ppf(1.0 - alpha, n_methods) / SQRT2
    return q * math.sqrt(n_methods * (n_methods + 1) / (6.0 * n_datasets))


# ---------------------------------------------------------------- pandas UDFs (Arrow batches)
@F.pandas_udf(T.DoubleType())
def signed_rank_p_udf(n: pd.Series, statistic: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(int(a), float(b)) for a, b in zip(n, statistic)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def mann_whitney_p_udf(n0: pd.Series, n1: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney_p(int(a), int(b), float(c)) for a, b, c in zip(n0, n1, u)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_p_udf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: float("nan") if v is None or pd.isna(v) else normal_two_sided_p(float(v)))


@F.pandas_udf(T.DoubleType())
def chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([float("nan") if pd.isna(a) or pd.isna(b) else chi2_sf(float(a), float(b))
                      for a, b in zip(x, dof)])


@F.pandas_udf(T.DoubleType())
def range_sf_udf(q: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([float("nan") if pd.isna(a) or pd.isna(b) else 1.0 - studentized_range_cdf(float(a), int(b))
                      for a, b in zip(q, k)])
