"""Student's t distribution, for which Spark has no function."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1.0 / (1.0 + even * d or tiny), 1.0 + even / c or tiny
        value *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1.0 / (1.0 + odd * d or tiny), 1.0 + odd / c or tiny
        value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, for x in [0, 1]."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_upper(t: float, df: float) -> float:
    """Probability of a value above ``t``."""
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_quantile(p: float, df: float) -> float:
    """The value below which a share of ``p`` lies, by bisection."""
    low, high = -1.0, 1.0
    while t_upper(high, df) > 1 - p:
        high *= 2
    while t_upper(low, df) < 1 - p:
        low *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_upper(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2
