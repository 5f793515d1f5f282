"""Tail probabilities for small result tables (one row per tested feature).

The statistics themselves are aggregated by Spark; these helpers only turn a
finished statistic into a p-value.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kolmogorov(d: Column, n_a: Column, n_b: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of a two-sample KS statistic, as a plain column."""
    n_a, n_b = n_a.cast("double"), n_b.cast("double")
    t2 = d * d * n_a * n_b / (n_a + n_b)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * t2),
    )
    # The alternating series converges too slowly below this point, where p is 1 to 1e-9.
    return F.when(t2 < 0.04, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def _gamma_upper(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_inc(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + up * d) or tiny)
        c = (1 + up / c) or tiny
        h *= d * c
        down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + down * d) or tiny)
        c = (1 + down / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def chi2_tail(x: float, dof: float) -> float:
    return 1.0 if dof <= 0 else _gamma_upper(dof / 2, x / 2)


def student_two_sided(t: float, dof: float) -> float:
    if dof <= 0:
        return 1.0
    return _beta_inc(dof / 2, 0.5, dof / (dof + t * t)) if math.isfinite(t) else 0.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _both(x, y, fn) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) or pd.isna(b) else fn(float(a), float(b)) for a, b in zip(x, y)], dtype="float64"
    )


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _both(x, dof, chi2_tail)


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _both(t, dof, student_two_sided)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else normal_two_sided(float(v)) for v in z], dtype="float64")
