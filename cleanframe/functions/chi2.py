"""Chi-square quantile as one driver scalar, by bisection on the regularised lower gamma series."""

from __future__ import annotations

import math


def chi2_cdf(x: float, k: int) -> float:
    if x <= 0:
        return 0.0
    a, half = k / 2.0, x / 2.0
    term = math.exp(a * math.log(half) - half - math.lgamma(a + 1.0))
    total, n = term, 1
    while term > total * 1e-17:
        term *= half / (a + n)
        total += term
        n += 1
    return min(total, 1.0)


def chi2_quantile(p: float, k: int) -> float:
    if not 0.0 < p < 1.0:
        raise ValueError("confidence must lie between 0 and 1")
    lo, hi = 0.0, float(k)
    while chi2_cdf(hi, k) < p:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2.0
