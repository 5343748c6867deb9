"""Tail probabilities and quantiles that Spark SQL has no function for.

Columns in, column out.  They are evaluated on aggregated rows (one per feature
and contrast), in Arrow batches of numpy arrays, never on raw measurements.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 400):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            out = out * delta
        if np.all(np.abs(delta - 1.0) < 1e-15):
            break
    return out


def beta_regularised(a, b, x) -> np.ndarray:
    a, b, x = (np.atleast_1d(np.asarray(v, dtype=float)) for v in np.broadcast_arrays(a, b, x))
    x = np.clip(x, 0.0, 1.0)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(
        _lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner)
    )
    swap = inner > (a + 1.0) / (a + b + 2.0)
    direct = front * _beta_fraction(a, b, np.where(swap, 0.0, inner)) / a
    mirrored = 1.0 - front * _beta_fraction(b, a, np.where(swap, 1.0 - inner, 0.0)) / b
    out = np.where(swap, mirrored, direct)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def gamma_upper(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma function."""
    a, x = (np.atleast_1d(np.asarray(v, dtype=float)) for v in np.broadcast_arrays(a, x))
    out = np.ones_like(x)
    for i in range(x.size):
        out.flat[i] = _gamma_upper_one(float(a.flat[i]), float(x.flat[i]))
    return out


def _gamma_upper_one(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * front
    b, c = x + 1 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1.0 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _quiet(fn, *columns: pd.Series) -> pd.Series:
    """Apply ``fn`` to the rows where every argument is a number."""
    frame = pd.concat(columns, axis=1).astype(float)
    known = frame.notna().all(axis=1).to_numpy()
    out = np.full(len(frame), np.nan)
    if known.any():
        with np.errstate(all="ignore"):
            out[known] = fn(*(frame.iloc[known, i].to_numpy() for i in range(frame.shape[1])))
    result = pd.Series(out)
    return result.where(result.notna(), None).astype("Float64")


@F.pandas_udf(DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    return _quiet(lambda v: _erfc(np.abs(v) / math.sqrt(2.0)), z)


@F.pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _quiet(lambda v, n: beta_regularised(n / 2.0, 0.5, n / (n + v * v)), t, df)


@F.pandas_udf(DoubleType())
def _f_upper(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _quiet(lambda v, a, b: beta_regularised(b / 2.0, a / 2.0, b / (b + a * v)), f, df1, df2)


@F.pandas_udf(DoubleType())
def _chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    return _quiet(lambda v, n: gamma_upper(n / 2.0, v / 2.0), x, df)


@F.pandas_udf(DoubleType())
def _t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    def solve(prob, n):
        tail = 2.0 * np.minimum(prob, 1.0 - prob)
        low, high = np.zeros_like(prob), np.full_like(prob, 1e8)
        for _ in range(120):
            middle = (low + high) / 2.0
            over = beta_regularised(n / 2.0, 0.5, n / (n + middle * middle)) > tail
            low, high = np.where(over, middle, low), np.where(over, high, middle)
        return np.where(prob >= 0.5, 1.0, -1.0) * (low + high) / 2.0

    return _quiet(solve, p, df)


def normal_two_sided(z: Column) -> Column:
    return _normal_two_sided(z.cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    return _t_two_sided(t.cast("double"), df.cast("double"))


def f_upper(f: Column, df1: Column, df2: Column) -> Column:
    return _f_upper(f.cast("double"), df1.cast("double"), df2.cast("double"))


def chi2_upper(x: Column, df: Column) -> Column:
    return _chi2_upper(x.cast("double"), df.cast("double"))


def t_quantile(p: Column, df: Column) -> Column:
    return _t_quantile(p.cast("double"), df.cast("double"))
