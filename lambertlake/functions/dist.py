"""Student, Fisher and chi-square distributions from incomplete beta and gamma functions."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fraction(step: Callable[[int], tuple[float, float]], first: float) -> float:
    """A continued fraction first + a1/(b1 + a2/(b2 + ...)) by the modified Lentz rule."""
    tiny = 1e-300
    value = first or tiny
    c, d = value, 0.0
    for i in range(1, 2000):
        a, b = step(i)
        d = 1 / (b + a * d or tiny)
        c = b + a / c or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)

    def step(i: int) -> tuple[float, float]:
        m = i // 2
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / a / _fraction(step, 1.0)


def gamma_cdf(x: float, a: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return front * total
    return 1 - front / _fraction(lambda i: (-i * (i - a), x + 2 * i + 1 - a), x + 1 - a)


def _solve(cdf: Callable[[float], float], p: float, lo: float, hi: float) -> float:
    for _ in range(400):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def t_cdf(t: float, dof: float) -> float:
    tail = beta_cdf(dof / (dof + t * t), dof / 2, 0.5) / 2
    return 1 - tail if t > 0 else tail


@lru_cache(maxsize=4096)
def t_ppf(p: float, dof: float) -> float:
    if p < 0.5:
        return -t_ppf(1 - p, dof)
    hi = 1.0
    while t_cdf(hi, dof) < p and hi < 1e300:
        hi *= 2
    return _solve(lambda t: t_cdf(t, dof), p, 0.0, hi)


def f_cdf(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2) if f > 0 else 0.0


@lru_cache(maxsize=4096)
def f_ppf(p: float, d1: float, d2: float) -> float:
    x = _solve(lambda v: beta_cdf(v, d1 / 2, d2 / 2), p, 0.0, 1.0)
    return d2 * x / (d1 * (1 - x)) if x < 1 else math.inf


def chi2_cdf(x: float, dof: float) -> float:
    return gamma_cdf(x / 2, dof / 2)


@lru_cache(maxsize=4096)
def chi2_ppf(p: float, dof: float) -> float:
    hi = dof + 10.0
    while chi2_cdf(hi, dof) < p:
        hi *= 2
    return _solve(lambda v: chi2_cdf(v, dof), p, 0.0, hi)


def _column(function: Callable[..., float]) -> Callable[..., Column]:
    """The function over double columns; null where an argument is null or out of its domain."""

    @F.pandas_udf(T.DoubleType())
    def run(*args: pd.Series) -> pd.Series:
        def one(*v):
            try:
                return None if any(pd.isna(a) for a in v) else function(*v)
            except (ValueError, ZeroDivisionError, OverflowError):
                return None

        return pd.Series([one(*v) for v in zip(*args)], dtype="float64")

    return lambda *columns: run(*(c.cast("double") if isinstance(c, Column) else F.lit(float(c)) for c in columns))


t_quantile, t_probability = _column(t_ppf), _column(t_cdf)
f_quantile, f_probability = _column(f_ppf), _column(f_cdf)
chi2_quantile, chi2_probability = _column(chi2_ppf), _column(chi2_cdf)
