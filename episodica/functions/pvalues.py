"""Tail probabilities for small result tables.

Spark has no chi-square, t or normal distribution function, so these short
scalar helpers are applied, through Arrow, to result rows only: one row per
test, never one per observation.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) for integer degrees of freedom: the regularised upper incomplete gamma function.

    By its series below the mode and by its continued fraction above, with the common factor in
    logarithms, so any number of degrees of freedom is possible.
    """
    if x is None or df is None or math.isnan(x) or df < 1:
        return math.nan
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    # log of z^a e^-z / Gamma(a); around a large mode the terms nearly cancel, so Stirling's series is taken relative to a
    if a > 100:
        off = (z - a) / a
        deviance = a * (math.log1p(off) - off) if abs(off) < 0.5 else a * math.log(z / a) - (z - a)
        front = deviance + 0.5 * math.log(a / (2 * math.pi)) - 1 / (12 * a) + 1 / (360 * a**3)
    else:
        front = a * math.log(z) - z - math.lgamma(a)
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - total * math.exp(front))
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    out, k = d, 0
    while True:
        k += 1
        num = -k * (k - a)
        b += 2
        d = num * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + num / c
        c = c if abs(c) > tiny else tiny
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            return min(1.0, out * math.exp(front))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0)) if z is not None and not math.isnan(z) else math.nan


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 1000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def _log_gamma_ratio(a: float, b: float) -> float:
    """log(Gamma(a + b) / Gamma(a)); for large a by the difference of Stirling's series, which does not cancel."""
    if a < 100:
        return math.lgamma(a + b) - math.lgamma(a)
    s = a + b
    series = (1 / s - 1 / a) / 12 - (1 / s**3 - 1 / a**3) / 360
    return (a - 0.5) * math.log1p(b / a) + b * math.log(s) - b + series


def incomplete_beta(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta function at x; ``y`` is 1 - x where the caller knows it more exactly."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    log_x = math.log1p(-y) if y < 0.5 else math.log(x)
    log_y = math.log1p(-x) if x < 0.5 else math.log(y)
    ratio = _log_gamma_ratio(a, b) - math.lgamma(b) if a >= b else _log_gamma_ratio(b, a) - math.lgamma(a)
    front = math.exp(ratio + a * log_x + b * log_y)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


def t_two_sided(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or df <= 0:
        return math.nan
    square = t * t
    return incomplete_beta(df / 2.0, 0.5, df / (df + square), square / (df + square))


def _tail_column(fn, *inputs: Column) -> Column:
    @F.pandas_udf("double")
    def tails(*parts: pd.Series) -> pd.Series:
        rows = zip(*parts)
        out = [None if any(pd.isna(x) for x in row) else fn(*map(float, row)) for row in rows]
        return pd.Series(out, dtype="float64")

    return F.nanvl(tails(*inputs), F.lit(None).cast("double"))


def chi2_p(stat: Column, df: Column) -> Column:
    return _tail_column(lambda x, k: chi2_tail(x, int(k)), stat, df)


def normal_p(z: Column) -> Column:
    return _tail_column(normal_two_sided, z)


def t_p(stat: Column, df: Column) -> Column:
    return _tail_column(t_two_sided, stat, df)
