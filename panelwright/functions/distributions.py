"""Distribution functions for result rows (a handful of statistics at a time)."""

from __future__ import annotations

import math
from statistics import NormalDist

_N = NormalDist()


def pnorm(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def qnorm(p: float) -> float:
    return _N.inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def beta_tails(a: float, b: float, x: float) -> tuple[float, float]:
    """Regularised incomplete beta function and its complement, each without cancellation."""
    if x <= 0.0:
        return 0.0, 1.0
    if x >= 1.0:
        return 1.0, 0.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        low = math.exp(log_front) * _beta_fraction(a, b, x) / a
        return low, 1.0 - low
    high = math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b
    return 1.0 - high, high


def betainc(a: float, b: float, x: float) -> float:
    return beta_tails(a, b, x)[0]


def gamma_tails(a: float, x: float) -> tuple[float, float]:
    """Regularised lower and upper incomplete gamma functions, each without cancellation."""
    if x <= 0.0:
        return 0.0, 1.0
    log_front = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        low = total * math.exp(log_front)
        return low, 1.0 - low
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    high = math.exp(log_front) * h
    return 1.0 - high, high


def gammainc(a: float, x: float) -> float:
    return gamma_tails(a, x)[0]


def pt(t: float, df: float) -> float:
    if math.isinf(df):
        return pnorm(t)
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + t * t))
    return 1.0 - tail if t > 0 else tail


def qt(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    lo, hi = -1.0, 1.0
    while pt(lo, df) > p:
        lo *= 2.0
    while pt(hi, df) < p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if pt(mid, df) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def pchisq(x: float, df: float) -> float:
    return gammainc(df / 2.0, x / 2.0)


def pf(x: float, df1: float, df2: float) -> float:
    return 0.0 if x <= 0 else betainc(df1 / 2.0, df2 / 2.0, df1 * x / (df1 * x + df2))


def pchisq_upper(x: float, df: float) -> float:
    return gamma_tails(df / 2.0, x / 2.0)[1]


def pf_upper(x: float, df1: float, df2: float) -> float:
    if x <= 0:
        return 1.0
    if math.isinf(df2):
        return pchisq_upper(df1 * x, df1)
    return beta_tails(df2 / 2.0, df1 / 2.0, df2 / (df1 * x + df2))[0]


def two_sided_normal(z: float) -> float:
    return 2.0 * pnorm(-abs(z))


def two_sided_t(t: float, df: float) -> float:
    return 2.0 * pt(-abs(t), df)
