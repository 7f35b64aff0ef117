"""Statistics shared by the estimators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta, by the Lentz form of its continued fraction."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    flip = x > (a + 1) / (a + b + 2)
    xx, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q)
                       + p * np.log(xx) + q * np.log1p(-xx)) / p
        tiny = 1e-300
        c = np.ones_like(xx)
        d = 1 - (p + q) * xx / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        frac = d.copy()
        for m in range(1, 400):
            for num in (m * (q - m) * xx / ((p + 2 * m - 1) * (p + 2 * m)),
                        -(p + m) * (p + q + m) * xx / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = c * d
                frac = frac * step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        val = np.where(xx <= 0, 0.0, front * frac)
    return np.where(flip, 1 - val, val)


@F.pandas_udf(T.DoubleType())
def student_t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic; NULL where either is missing."""
    tv, dv = t.to_numpy(float), dof.to_numpy(float)
    ok = np.isfinite(tv) & np.isfinite(dv) & (dv > 0)
    out = pd.Series([None] * len(t), dtype="float64")
    if ok.any():
        out[ok] = betainc(dv[ok] / (dv[ok] + tv[ok] ** 2), dv[ok] / 2, np.full(ok.sum(), 0.5))
    return out
