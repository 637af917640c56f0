"""Distribution functions in NumPy."""

from __future__ import annotations

from math import lgamma

import numpy as np


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    a, b, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    front = np.exp(np.vectorize(lambda p, q: lgamma(p + q) - lgamma(p) - lgamma(q), otypes=[float])(a, b) + a * np.log(np.maximum(y, tiny)) + b * np.log(np.maximum(1 - y, tiny))) / a
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    num, den = np.ones_like(y), 1 / keep(1 - (a + b) * y / (a + 1))
    value = den.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))):
            den, num = 1 / keep(1 + step * den), keep(1 + step / num)
            value = value * den * num
    out = np.where(y <= 0, 0.0, front * value)
    return np.where(swap, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p value of Student's t; nan for nan."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    fine = ~np.isnan(t) & (df > 0)
    out[fine] = incomplete_beta(df[fine] / 2, np.full(fine.sum(), 0.5), df[fine] / (df[fine] + t[fine] ** 2))
    return out
