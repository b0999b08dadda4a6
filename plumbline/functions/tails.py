"""Tail areas Spark has no function for.  Used on one row per estimate, never on data rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_quantile(df: float, confidence: float = 0.95) -> float:
    """Two-sided Student-t multiplier, e.g. 2.7764 for 4 degrees of freedom."""
    tail = 1.0 - confidence
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = 0.5 * (low + high)
        if _incomplete_beta(df / 2, 0.5, df / (df + mid * mid)) > tail:
            low = mid
        else:
            high = mid
        if high - low < 1e-14 * max(1.0, high):
            break
    return 0.5 * (low + high)


def t_multiplier(n, confidence: float = 0.95):
    """Column: multiplier for ``n`` units; null below two units."""

    @F.pandas_udf("double")
    def multiplier(units: pd.Series) -> pd.Series:
        known = {int(u): t_quantile(int(u) - 1, confidence) for u in units.dropna().unique() if u >= 2}
        return units.map(lambda u: known.get(int(u)) if pd.notna(u) else None).astype("float64")

    return multiplier(n)


def normal_two_sided(z):
    """Column: two-sided normal tail area of ``z``."""

    @F.pandas_udf("double")
    def area(values: pd.Series) -> pd.Series:
        return values.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if pd.notna(v) else np.nan)

    return F.nanvl(area(z), F.lit(None).cast("double"))
