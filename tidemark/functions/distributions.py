"""Tails of the usual distributions, for vectorised use in pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def normal_two_tailed(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return _gamma_q(df / 2, x / 2)


def poisson_tail(k: float, mean: float) -> float:
    """Probability of ``k`` or more."""
    return 1.0 if k <= 0 else 1 - _gamma_q(k, mean)


def beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularised(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_regularised(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_tailed(t: float, df: float) -> float:
    return beta_regularised(df / 2, 0.5, df / (df + t * t))


def udf_of(f):
    """A pandas UDF of a scalar function; null in, null out."""

    def run(*columns: pd.Series) -> pd.Series:
        values = (np.nan if any(pd.isna(v) for v in row) else f(*map(float, row)) for row in zip(*columns))
        return pd.Series(list(values), dtype=float)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return F.pandas_udf({1: one, 2: two, 3: three}[f.__code__.co_argcount], "double")
