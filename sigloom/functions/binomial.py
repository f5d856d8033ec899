"""Exact binomial tails without a statistics library, on whole columns at once.

A tail is a regularised incomplete beta function, whose continued fraction needs a number of steps that
doesn't grow with the count itself, only with the square root of the number of trials.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_TINY = 1e-300


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    nonzero = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    c, d = np.ones_like(x), 1 / nonzero(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 200 + 10 * int(math.sqrt((a + b).max(initial=1.0)))):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 / nonzero(1 + step * d)
            c = nonzero(1 + step / c)
            out = out * c * d
        if np.abs(c * d - 1).max(initial=0) < 1e-15:
            break
    return out


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) for a, b > 0 and x in [0, 1]."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner)) if x.size else x
    left = inner < (a + 1) / (a + b + 2)
    # The fraction is quick on the side of the mean where the tail is small.
    p, q, y = np.where(left, a, b), np.where(left, b, a), np.where(left, inner, 1 - inner)
    tail = front * _fraction(p, q, y) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.clip(np.where(left, tail, 1 - tail), 0, 1)))


def lower_tail(k: object, n: object, p: object) -> np.ndarray:
    """P(X <= k) for n trials of probability p."""
    k, n, p = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, n, p)))
    inside = (k >= 0) & (k < n)
    share = beta_share(np.where(inside, n - k, 1.0), np.where(inside, k + 1, 1.0), 1 - p)
    return np.where(k < 0, 0.0, np.where(k >= n, 1.0, share))


def _solve(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """x with I_x(a, b) = share: Newton steps from the mean, halving where a step leaves the bracket."""
    low, high, x = np.zeros_like(a), np.ones_like(a), a / (a + b)
    norm = _lgamma(a + b) - _lgamma(a) - _lgamma(b) if a.size else a
    for _ in range(100):
        off = beta_share(a, b, x) - share
        low, high = np.where(off < 0, x, low), np.where(off > 0, x, high)
        with np.errstate(all="ignore"):
            step = off / np.exp(norm + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
        to = x - step
        to = np.where(np.isfinite(to) & (to > low) & (to < high), to, (low + high) / 2)
        if not (np.abs(to - x) > 1e-15 * x).any():
            break
        x = to
    return x


def clopper_pearson(k: object, n: object, confidence: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Exact equal-tailed interval for a proportion; n is at least 1."""
    k, n = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, n)))
    if (n <= 0).any():
        raise ValueError("no trials")
    tail = (1 - confidence) / 2
    low = np.where(k == 0, 0.0, _solve(np.maximum(k, 1), n - k + 1, tail))
    high = np.where(k == n, 1.0, _solve(k + 1, np.maximum(n - k, 1), 1 - tail))
    return low, high


def two_sided(losses: object, gains: object) -> np.ndarray:
    """Exact test that losses and gains are equally likely; 1 without any."""
    a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (losses, gains)))
    p = np.minimum(1.0, 2 * lower_tail(np.minimum(a, b), a + b, 0.5))
    return np.where(a + b == 0, 1.0, np.maximum(p, math.ulp(0.0)))


@pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """95 % interval of k of n; null where n is 0."""
    low, high = clopper_pearson(k.to_numpy(float), np.maximum(n.to_numpy(float), 1))
    some = n.to_numpy() > 0
    return pd.DataFrame({"low": np.where(some, low, np.nan), "high": np.where(some, high, np.nan)}).astype(object).where(lambda t: t.notna(), None)


@pandas_udf(T.DoubleType())
def paired_p(losses: pd.Series, gains: pd.Series) -> pd.Series:
    return pd.Series(two_sided(losses.to_numpy(), gains.to_numpy()))
