"""Distribution functions on ``math`` alone: normal, t, chi-square, F and beta."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

_NORMAL = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p) if 0 < p < 1 else math.copysign(math.inf, p - 0.5)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a))
    return 1 - gamma_q(a, x)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, accurate in the far tail."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        return 1 - gamma_p(a, x)
    tiny = 1e-300  # Lentz's continued fraction
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * math.exp(a * math.log(x) - x - math.lgamma(a))


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (tiny if abs(d) < tiny else d)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (tiny if abs(d) < tiny else d)
            c = 1 + num / c
            c = tiny if abs(c) < tiny else c
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h / a


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def t_sf(t: float, df: float) -> float:
    if math.isinf(df):
        return norm_cdf(-t)
    half = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def f_sf(x: float, d1: float, d2: float) -> float:
    if x <= 0:
        return 1.0
    return chi2_sf(x * d1, d1) if math.isinf(d2) else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def solve(f: Callable[[float], float], low: float, high: float, steps: int = 200) -> float:
    """The root of an increasing function by bisection."""
    for _ in range(steps):
        mid = (low + high) / 2
        if f(mid) < 0:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def t_ppf(p: float, df: float) -> float:
    if math.isinf(df):
        return norm_ppf(p)
    return solve(lambda t: (1 - t_sf(t, df)) - p, -1e4, 1e4)


def chi2_ppf(p: float, df: float) -> float:
    return solve(lambda x: gamma_p(df / 2, x / 2) - p, 0.0, 100 * df + 1000)


def beta_ppf(p: float, a: float, b: float) -> float:
    return solve(lambda x: beta_i(a, b, x) - p, 0.0, 1.0)
