"""F, t and binomial tails from the regularised incomplete beta function, in numpy alone."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a, b, x) -> np.ndarray:
    """I_x(a, b) by its continued fraction (modified Lentz), elementwise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    out[x <= 0], out[x >= 1] = 0.0, 1.0
    inside = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    if not inside.any():
        return out
    p, q, z = a[inside], b[inside], x[inside]
    swap = z > (p + 1) / (p + q + 2)
    p, q, z = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - z, z)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for k in range(1, 400):
        for top in (k * (q - k) * z / ((p + 2 * k - 1) * (p + 2 * k)), -(p + k) * (p + q + k) * z / ((p + 2 * k) * (p + 2 * k + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            total = total * d * c
        if np.max(np.abs(d * c - 1)) < 1e-15:
            break
    out[inside] = np.where(swap, 1 - front * total, front * total)
    return out


def f_cdf(x, d1, d2) -> np.ndarray:
    x = np.asarray(x, float)
    return beta_inc(np.asarray(d1) / 2, np.asarray(d2) / 2, d1 * x / (d1 * x + d2))


def critical_f(p: float, d1: float, d2: float) -> float:
    """The value that an F variable exceeds with probability p."""
    low, high = 0.0, 1.0
    while f_cdf(high, d1, d2) < 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f_cdf(mid, d1, d2) < 1 - p else (low, mid)
    return (low + high) / 2


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def sign_test(less: int, n: int) -> float:
    """Two-sided exact binomial p of ``less`` successes in n at probability one half."""
    k = min(less, n - less)
    tail = sum(math.comb(n, i) for i in range(k + 1))
    return min(1.0, 2 * tail / 2**n)
