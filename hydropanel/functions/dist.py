"""Tail probabilities of Student's t and Fisher's F.

The one thing Spark has no built-in for.  The functions see one value per fitted
model, never one per data row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b), element-wise, by continued fraction."""
    a, b, x = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)  # the fraction converges fast on this side only
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c = np.ones_like(z)
        d = 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
        h = d.copy()
        for m in range(1, 400):
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            for step in (even, odd):
                d = 1 + step * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + step / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0.0) < 1e-15:
                break
        out = np.where(z <= 0, 0.0, front * h)
    return np.clip(np.where(flip, 1 - out, out), 0.0, 1.0)


def t_tail(t, df):
    """Two-sided p-value; NaN where df < 1."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = ~np.isnan(t) & (df >= 1)
    safe_t, safe_df = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    return np.where(ok, betainc(safe_df / 2, 0.5, safe_df / (safe_df + safe_t**2)), np.nan)


def f_tail(f, df1, df2):
    """Upper-tail p-value; NaN where a degree of freedom is below one."""
    f, df1, df2 = (np.asarray(v, float) for v in (f, df1, df2))
    ok = ~np.isnan(f) & (df1 >= 1) & (df2 >= 1)
    f, df1, df2 = np.where(ok, f, 0.0), np.where(ok, df1, 1.0), np.where(ok, df2, 1.0)
    return np.where(ok, betainc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)), np.nan)


def _nullable(values) -> pd.Series:
    out = pd.Series(np.asarray(values, float).astype(object))
    return out.where(pd.notna(out), None)


@pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_tail(t.astype(float), df.astype(float)))


@pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _nullable(f_tail(f.astype(float), df1.astype(float), df2.astype(float)))
