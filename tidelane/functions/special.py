"""Special functions as built-in column arithmetic, and their Python counterparts for the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational approximation of the normal quantile (absolute error below 1.2e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(coefficients, x):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile; null outside (0, 1)."""
    low = 0.02425
    tail = lambda q: _poly(_C, q) / (_poly(_D, q) * q + 1)
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    middle = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    return F.when((p <= 0) | (p >= 1), None).when(p < low, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - low, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(middle)


def chi2_quantile(p: Column, k: int) -> Column:
    """The chi-square quantile by the Wilson-Hilferty cube, good to about 1 % for k >= 3."""
    c = 2.0 / (9 * k)
    z = 1 - c + normal_quantile(p) * math.sqrt(c)
    return k * z * z * z


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = math.exp(a * math.log(h) - h - math.lgamma(a + 1))
    n = 1
    while term > 1e-16 * total and n < 10_000:
        term *= h / (a + n)
        total += term
        n += 1
    return min(total, 1.0)


def chi2_tail(x: np.ndarray, k: int) -> np.ndarray:
    """The upper tail of the chi-square distribution with k degrees of freedom, by its finite sum."""
    h = np.maximum(np.asarray(x, dtype=float), 0.0) / 2
    if k % 2:
        total = np.array([math.erfc(math.sqrt(v)) for v in h.ravel()]).reshape(h.shape)
        term, first = np.exp(-h) * np.sqrt(h) / math.gamma(1.5), 1.5
    else:
        total, term, first = np.zeros_like(h), np.exp(-h), 1.0
    for i in range(k // 2):
        total = total + term
        term = term * h / (first + i)
    return np.clip(total, 0.0, 1.0)


def chi2_inverse(p: float, k: int) -> float:
    """The chi-square quantile, by halving."""
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return (low + high) / 2


def poisson_quantile(p: float, mean: float) -> int:
    """The least k with P(X <= k) >= p."""
    k, term = 0, math.exp(-mean)
    total = term
    while total < p and k < 10_000_000:
        k += 1
        term *= mean / k
        total += term
    return k
