"""Normal and Student-t distributions, for columns (Arrow batches) and for numbers."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_N = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


@F.pandas_udf(DoubleType())
def normal_cdf_col(x: pd.Series) -> pd.Series:
    return x.map(normal_cdf, na_action="ignore").astype("float64")


@F.pandas_udf(DoubleType())
def normal_ppf_col(p: pd.Series) -> pd.Series:
    """Quantiles of the standard normal; 0 and 1 are brought just inside."""
    q = p.clip(1e-16, 1 - 1e-16)
    return q.map(normal_ppf, na_action="ignore").astype("float64")


@F.pandas_udf(DoubleType())
def t_sf_col(t: pd.Series, df: pd.Series) -> pd.Series:
    out = [t_sf(a, b) if np.isfinite(a) and b > 0 else np.nan for a, b in zip(t, df)]
    return pd.Series(out, dtype="float64")
