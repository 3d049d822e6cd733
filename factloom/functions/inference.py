"""Student's t and what is tested with it: scalars for the few values of a ledger, and columns for any number of series."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + up * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + up / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """The chance of a t at least that far from 0; 1 where the test says nothing."""
    if t is None or df is None or not math.isfinite(t) or df <= 0:
        return 1.0
    return beta_share(df / 2, 0.5, df / (df + t * t))


def t_critical(df: float) -> float:
    """The 97.5 % point of t by two terms of the Cornish-Fisher expansion (too small for few degrees of freedom)."""
    z = 1.959963985
    if df <= 0:
        return z
    return z + (z + z**3) / df / 4 + (3 * z + 16 * z**3 + 5 * z**5) / df**2 / 96


def correlation_p(r: float, n: int) -> float:
    if n < 3:
        return 1.0
    r = max(-0.999999, min(0.999999, r))
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


# ---- for many values at once ----------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for positive x: Stirling's series, eight steps up."""
    steps = x[..., None] + np.arange(8)
    z = x + 8
    tail = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + tail - np.log(steps).sum(axis=-1)


def _fractions(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """_beta_fraction() for arrays: what has converged takes part no longer."""
    tiny = 1e-300
    near = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    d = 1.0 / near(1.0 - (a + b) * x / (a + 1))
    c, out = np.ones_like(x), d.copy()
    left = np.arange(len(x))
    for m in range(1, 500):
        p, q, y = a[left], b[left], x[left]
        for up in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d[left] = 1.0 / near(1.0 + up * d[left])
            c[left] = near(1.0 + up / c[left])
            out[left] *= d[left] * c[left]
        left = left[np.abs(d[left] * c[left] - 1.0) >= 1e-14]
        if not len(left):
            break
    return out


def beta_shares(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """beta_share() for arrays."""
    out = np.where(x >= 1, 1.0, 0.0)
    some = np.flatnonzero((x > 0) & (x < 1))
    a, b, x = a[some], b[some], x[some]
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    p, q, y = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)
    share = front * _fractions(p, q, y) / p
    out[some] = np.where(low, share, 1 - share)
    return out


def t_two_sided_all(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """t_two_sided() for arrays, with nan where there is no value."""
    out = np.ones(len(t))
    some = np.flatnonzero(np.isfinite(t) & (df > 0))
    t, df = t[some], df[some]
    out[some] = beta_shares(df / 2, np.full(len(t), 0.5), df / (df + t * t))
    return out


def two_sided(t: Column, df: Column) -> Column:
    """t_two_sided() for columns, a batch of rows at a time."""

    @F.arrow_udf("double")
    def share(t: pa.Array, df: pa.Array) -> pa.Array:
        t, df = (np.asarray(x.to_numpy(zero_copy_only=False), float) for x in (t, df))
        return pa.array(t_two_sided_all(t, df))

    return share(t.cast("double"), df.cast("double"))


def critical(df: Column) -> Column:
    """t_critical() for columns."""
    z = 1.959963985
    more = F.lit(z) + F.lit(z + z**3) / df / 4 + F.lit(3 * z + 16 * z**3 + 5 * z**5) / (df * df) / 96
    return F.when(df > 0, more).otherwise(F.lit(z))


def correlation_two_sided(r: Column, n: Column) -> Column:
    """correlation_p() for columns."""
    r = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r))
    return F.when(n < 3, 1.0).otherwise(two_sided(r * F.sqrt(F.greatest(n - 2, F.lit(0)) / (1 - r * r)), n - 2))
