"""Tail probabilities of Student's t distribution, without a statistics package."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    value = 1.0
    for k in range(400):
        m = k // 2
        if k == 0:
            num = 1.0
        elif k % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + num * d) or tiny)
        c = (1.0 + num / c) or tiny
        value *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (value - 1.0)


def t_tail(t: float, df: float) -> float:
    """P(T < t) for Student's t with ``df`` degrees of freedom."""
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t < 0 else 1.0 - half


@F.pandas_udf(DoubleType())
def t_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(a, b) for a, b in zip(t, df)])
