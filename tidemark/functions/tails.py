"""Tail probabilities for the handful of test statistics a fitted model reports.

Series and continued fraction of the incomplete gamma and beta functions (Abramowitz and
Stegun, chapters 6 and 26). They run on single numbers: one per coefficient or term.
"""

from __future__ import annotations

import math


def _gamma_lower(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    # upper tail by continued fraction, evaluated backwards from a depth that grows with a
    tail = 0.0
    for k in range(400 + int(12 * math.sqrt(a)), 0, -1):
        tail = k * (k - a) / (x + 2 * k + 1 - a - tail)
    return 1.0 - front / (x + 1 - a - tail)


def _beta_regular(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_regular(b, a, 1 - x)
    front = math.exp(
        a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    )
    tail = 1.0
    for m in range(300 + int(12 * math.sqrt(a + b)), 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        tail = 1 + odd / (1 + even / tail)
    return front / (a * tail)


def chi2_upper(x: float, df: float) -> float:
    if x <= 0:
        return 1.0
    a, y = df / 2, x / 2
    return max(0.0, 1.0 - _gamma_lower(a, y)) if y < a + 1 else _gamma_upper(a, y)


def _gamma_upper(a: float, x: float) -> float:
    """Upper incomplete gamma function as a continued fraction, from its end; for x above a."""
    tail = 0.0
    for m in range(200, 0, -1):
        tail = m * (m - a) / (x + 2 * m + 1 - a - tail)
    return math.exp(a * math.log(x) - x - math.lgamma(a)) / (x + 1 - a - tail)


def f_upper(x: float, df1: float, df2: float) -> float:
    return 1.0 if x <= 0 else _beta_regular(df2 / 2, df1 / 2, df2 / (df2 + df1 * x))


def t_two_sided(t: float, df: float) -> float:
    return _beta_regular(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_quantile(prob: float, df: float) -> float:
    """Value that a t variable stays below with probability ``prob`` >= 0.5, by bisection."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < prob:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - t_two_sided(mid, df) / 2 < prob:
            low = mid
        else:
            high = mid
    return (low + high) / 2
