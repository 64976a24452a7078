"""Cumulative distributions by continued fractions and series, for the driver's small statistics."""

from __future__ import annotations

import math


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    value = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or 1e-300)
            c = (1 + k / c) or 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return 1 - tail if t > 0 else tail


def f_cdf(f: float, d1: float, d2: float) -> float:
    return 0.0 if f <= 0 else beta_cdf(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2)


def gamma_cdf(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / ((k * d + b) or 1e-300)
        c = (b + k / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_cdf(x: float, df: float) -> float:
    return gamma_cdf(df / 2, x / 2)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def t_quantile(p: float, df: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2
