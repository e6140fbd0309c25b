"""The incomplete gamma function, which Spark has no builtin for, as Arrow functions over NumPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from hydroframe.functions.expr import LANCZOS


def np_lgamma(x: np.ndarray) -> np.ndarray:
    y = x - 1.0
    total = np.full_like(y, LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (y + k)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * np.log(t) - t + np.log(total)


def np_gammainc(a: np.ndarray, x: np.ndarray, upper: bool = False) -> np.ndarray:
    """Regularised lower (or upper) incomplete gamma function; NaN for a <= 0 or a missing argument.

    Below a + 1 the power series, above it the continued fraction, evaluated forward with rescaling-free Lentz steps.
    """
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    lower = np.full(a.shape, np.nan)
    top = np.full(a.shape, np.nan)
    good = np.isfinite(a) & (a > 0) & ~np.isnan(x)
    at_zero, at_end = good & (x <= 0), good & np.isposinf(x)
    lower[at_zero], top[at_zero], lower[at_end], top[at_end] = 0.0, 1.0, 1.0, 0.0
    open_ = good & (x > 0) & np.isfinite(x)
    for low_side in (True, False):
        pick = np.flatnonzero(open_ & ((x < a + 1) == low_side))
        if not pick.size:
            continue
        aa, xx = a[pick], x[pick]
        front = np.exp(aa * np.log(xx) - xx - np_lgamma(aa))
        if low_side:
            term = 1.0 / aa
            total, n = term.copy(), aa.copy()
            for _ in range(100_000):
                n += 1.0
                term = term * xx / n
                total += term
                if (term <= total * 1e-16).all():
                    break
            lower[pick] = np.clip(front * total, 0.0, 1.0)
            top[pick] = 1.0 - lower[pick]
        else:
            tiny = 1e-300
            b = xx + 1.0 - aa
            c, d = np.full_like(b, 1.0 / tiny), 1.0 / np.where(b == 0, tiny, b)
            h = d.copy()
            for i in range(1, 100_000):
                step = i * (aa - i)
                b = b + 2.0
                d = step * d + b
                d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
                c = b + step / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h *= c * d
                if (np.abs(c * d - 1.0) < 1e-15).all():
                    break
            top[pick] = np.clip(front * h, 0.0, 1.0)
            lower[pick] = 1.0 - top[pick]
    return top if upper else lower


def np_norm_cdf(z: np.ndarray) -> np.ndarray:
    half = 0.5 * np_gammainc(np.full(np.shape(z), 0.5), np.asarray(z) ** 2 / 2, upper=True)
    return np.where(np.asarray(z) < 0, half, 1.0 - half)


def np_pearson3_cdf(x: np.ndarray, loc: np.ndarray, scale: np.ndarray, skew: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        z = np.where(scale > 0, (x - loc) / scale, np.nan)
        flat = np.abs(skew) < 1e-5
        shape = np.where(flat, np.nan, 4.0 / np.square(skew))
        y = shape + 2.0 * z / skew
        out = np_gammainc(shape, np.maximum(y, 0.0))
        out = np.where(skew > 0, out, 1.0 - out)
        out = np.where(flat, np_norm_cdf(np.where(flat, z, np.nan)), out)
        return np.where(np.isnan(z), np.nan, out)


@F.pandas_udf(DoubleType())
def gamma_cdf(x: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
    """CDF of the gamma distribution with shape alpha and scale beta; null where it has none."""
    with np.errstate(all="ignore"):
        out = np_gammainc(alpha.to_numpy(float), x.to_numpy(float) / beta.to_numpy(float))
    return pd.Series(out).where(~np.isnan(out), None)


@F.pandas_udf(DoubleType())
def pearson3_cdf(x: pd.Series, loc: pd.Series, scale: pd.Series, skew: pd.Series) -> pd.Series:
    out = np_pearson3_cdf(*(s.to_numpy(float) for s in (x, loc, scale, skew)))
    return pd.Series(out).where(~np.isnan(out), None)
