"""Student-t quantile (U3) as an Arrow function over degrees of freedom.

Only the few distinct sample sizes of a batch are solved; Spark spreads the groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def _beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def upper_tail(t: float, df: float) -> float:
    """P(T > t) for t >= 0."""
    return 0.5 * _beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile for 0 < p < 1; NaN without a degree of freedom."""
    if not df >= 1:
        return math.nan
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    tail = 1.0 - p
    lo, hi = 0.0, 1.0
    while upper_tail(hi, df) > tail:
        lo, hi = hi, hi * 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if mid == lo or mid == hi:
            break
        if upper_tail(mid, df) > tail:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def t_quantile_column(p: float, df: Column) -> Column:
    """Quantile at ``p`` per row; NULL where there is no degree of freedom."""

    @F.pandas_udf("double")
    def quantile(values: pd.Series) -> pd.Series:
        known = {v: t_quantile(p, float(v)) for v in values.dropna().unique()}
        return values.map(known).astype("float64").replace({np.nan: None})

    return F.when(df >= 1, quantile(df.cast("double")))
