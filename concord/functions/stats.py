"""Tail probabilities of Student's t, without a statistics library."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def incomplete_beta(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Regularised, for 0 <= x <= 1."""
    x = np.clip(np.asarray(x, dtype=float), 0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        low = front * _fraction(np.full_like(x, a), b, x) / a
        high = 1 - front * _fraction(np.full_like(x, b), a, 1 - x) / b
    out = np.where(x < (a + 1) / (a + b + 2), low, high)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def correlation_p(r: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Two-sided p of correlations over n individuals: I_v/(v+t^2)(v/2, 1/2), v = n - 2,
    which keeps its precision in the tail. NaN for fewer than three individuals; 0 at |r| = 1."""
    r = np.asarray(r, dtype=float)
    if np.ndim(n):
        n = np.asarray(n)
        out = np.full(r.shape, np.nan)
        for k in np.unique(n):
            out[n == k] = correlation_p(r[n == k], int(k))
        return out
    v = n - 2
    if v < 1:
        return np.full(r.shape, np.nan)
    gap = np.maximum(0.0, 1 - r * r)  # v / (v + t^2) = 1 - r^2
    return np.where(np.isnan(r), np.nan, incomplete_beta(gap, v / 2, 0.5))


@F.pandas_udf(DoubleType())
def _p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(correlation_p(r.to_numpy(dtype=float), n.to_numpy()))


def p_value(r: Column, n: Column | int) -> Column:
    """Column form of :func:`correlation_p`, in Arrow batches."""
    return _p(r, F.lit(n) if isinstance(n, int) else n)
