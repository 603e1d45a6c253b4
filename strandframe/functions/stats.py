"""Tail probabilities as Arrow functions over numpy, applied to one row per test after aggregation."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .dna import col

# Functions of this module travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of gamma for positive x: Stirling's series after shifting the argument to 8 and above."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    inv = 1.0 / y
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated from its end."""
    tail = np.ones_like(x)
    for m in range(300, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = 1 + even / (1 + odd / tail)
    first = -(a + b) * x / (a + 1)
    return 1 / (1 + first / tail)


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    a, b, x = np.broadcast_arrays(a, b, x)
    inside = (x > 0) & (x < 1)
    xs = np.where(inside, x, 0.5)
    swap = xs > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - xs, xs)
    front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y))
    part = front * beta_fraction(p, q, y) / p
    value = np.where(swap, 1 - part, part)
    return np.where(inside, value, np.where(x >= 1, 1.0, 0.0))


def _normal(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(v) / math.sqrt(2)) for v in z.to_numpy(float)]).where(z.notna().to_numpy(), None)


def _student(t: pd.Series, df: pd.Series) -> pd.Series:
    t2 = t.to_numpy(float) ** 2
    n = df.to_numpy(float)
    return pd.Series(incomplete_beta(n / 2, 0.5, n / (n + t2))).where((t.notna() & df.notna()).to_numpy(), None)


def _fisher_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    x = f.to_numpy(float)
    a, b = d1.to_numpy(float), d2.to_numpy(float)
    return pd.Series(incomplete_beta(b / 2, a / 2, b / (b + a * x))).where((f.notna() & d2.notna()).to_numpy(), None)


def _log_choose(n, k):
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def _hypergeometric(k: np.ndarray, hits: float, drawn: float, total: float) -> np.ndarray:
    return np.exp(_log_choose(hits, k) + _log_choose(total - hits, drawn - k) - _log_choose(total, drawn))


def _per_table(fn, *columns) -> pd.Series:
    """``fn`` once per distinct table of a batch; tables with a missing cell give NULL."""
    known: dict[tuple, float | None] = {}
    out = []
    for key in zip(*columns):
        if key not in known:
            known[key] = None if any(v != v for v in key) else fn(*key)
        out.append(known[key])
    return pd.Series(out, dtype=float)


def _over_one(a: float, h: float, d: float, n: float) -> float:
    low = max(0.0, h + d - n)
    if a <= low:
        return 1.0
    return min(1.0, float(_hypergeometric(np.arange(a, min(h, d) + 1), h, d, n).sum()))


def _two_sided(w: float, x: float, y: float, z: float) -> float:
    hits, drawn, total = w + y, w + x, w + x + y + z
    ks = np.arange(max(0, hits + drawn - total), min(hits, drawn) + 1, dtype=float)
    pr = _hypergeometric(ks, hits, drawn, total)
    here = float(_hypergeometric(np.array([w]), hits, drawn, total)[0])
    return min(1.0, float(pr[pr <= here * (1 + 1e-7)].sum()))


def _over(k: pd.Series, hits: pd.Series, drawn: pd.Series, total: pd.Series) -> pd.Series:
    return _per_table(_over_one, k, hits, drawn, total)


def _fisher_two(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _per_table(_two_sided, a, b, c, d)


def _double(c) -> Column:
    return col(c).cast("double")


def _arrow(fn, *columns) -> Column:
    return F.pandas_udf(fn, DoubleType())(*[_double(c) for c in columns])


def normal_p(z) -> Column:
    """Two-sided normal p-value."""
    return _arrow(_normal, z)


def chi2_p(x) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return _arrow(_normal, F.sqrt(_double(x)))


def student_p(t, df) -> Column:
    """Two-sided Student t p-value."""
    return _arrow(_student, t, df)


def f_p(f, d1, d2) -> Column:
    """Upper tail of the F distribution."""
    return _arrow(_fisher_f, f, d1, d2)


def hypergeometric_p(k, hits, drawn, total) -> Column:
    """P(X >= k) when ``drawn`` of ``total`` are taken and ``hits`` of them carry the mark."""
    return _arrow(_over, k, hits, drawn, total)


def fisher_exact_p(a, b, c, d) -> Column:
    """Two-sided exact p of the 2x2 table [[a, b], [c, d]]."""
    return _arrow(_fisher_two, a, b, c, d)


# Coefficients of Acklam's rational approximation of the normal quantile.
_CENTRE_TOP = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_CENTRE_LOW = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_TAIL_TOP = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_TAIL_LOW = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _polynomial(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p) -> Column:
    """Inverse of the normal distribution function, relative error below 1.2e-9."""
    p = col(p)
    q = p - 0.5
    centre = q * _polynomial(_CENTRE_TOP, q * q) / _polynomial(_CENTRE_LOW, q * q)

    def tail(x: Column) -> Column:
        y = F.sqrt(-2 * F.log(x))
        return _polynomial(_TAIL_TOP, y) / _polynomial(_TAIL_LOW, y)

    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(centre)
