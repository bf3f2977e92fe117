"""Distribution functions on numpy arrays, and as Arrow UDFs meant for tables that are already aggregated."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def lgamma(x) -> np.ndarray:
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 600):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out *= d * c
        if np.all(np.abs(d * c - 1) < 1e-16):
            break
    return out


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0, 1)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    with np.errstate(all="ignore"):
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
        low = inner < (a + 1) / (a + b + 2)
        out = np.where(
            low,
            front * _beta_fraction(np.where(low, a, 1.0), np.where(low, b, 1.0), np.where(low, inner, 0.1)) / a,
            1 - front * _beta_fraction(np.where(low, 1.0, b), np.where(low, 1.0, a), np.where(low, 0.1, 1 - inner)) / b,
        )
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t, df) -> np.ndarray:
    """Two-sided p-value of Student's t; infinite df is the normal distribution."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    finite_df = np.where(np.isfinite(df) & (df > 0), df, 1.0)
    p = beta_inc(finite_df / 2, 0.5, finite_df / (finite_df + t * t))
    out = np.where(np.isinf(df), norm_two_sided(t), p)
    return np.where(np.isnan(t) | np.isnan(df) | (df <= 0), np.nan, out)


def t_sf(t, df) -> np.ndarray:
    half = t_two_sided(t, df) / 2
    return np.where(np.asarray(t, float) >= 0, half, 1 - half)


def norm_two_sided(z) -> np.ndarray:
    return np.asarray(_erfc(np.abs(np.asarray(z, float)) / math.sqrt(2)), float)


def norm_cdf(z) -> np.ndarray:
    return np.asarray(_erfc(-np.asarray(z, float) / math.sqrt(2)), float) / 2


def f_sf(f, d1, d2) -> np.ndarray:
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, d1, d2)))
    f, endless = np.maximum(f, 0), np.isinf(d2)
    known = np.where(endless, 1.0, d2)
    return np.where(endless, chi2_sf(f * d1, d1), beta_inc(known / 2, d1 / 2, known / (known + d1 * f)))


def gamma_sf(a, x) -> np.ndarray:
    """Upper regularised incomplete gamma function: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    safe = np.maximum(x, 1e-300)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(safe) - safe - lgamma(a))
        term = total = 1 / a
        for k in range(1, 1000):
            term = term * safe / (a + k)
            total = total + term
            if np.all((term < 1e-17 * total) | (safe >= a + 1)):
                break
        b, c = safe + 1 - a, np.full_like(safe, 1e300)
        d = 1 / np.where(np.abs(b) < 1e-300, 1e-300, b)
        h = d.copy()
        for k in range(1, 1000):
            an = -k * (k - a)
            b = b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            h = h * d * c
            if np.all((np.abs(d * c - 1) < 1e-16) | (safe < a + 1)):
                break
    return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h))


def chi2_sf(x, df) -> np.ndarray:
    return gamma_sf(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def bisect(f, lo: np.ndarray, hi: np.ndarray, steps: int = 200) -> np.ndarray:
    """The place where the increasing function f crosses zero."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        up = f(mid) < 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def t_quantile(p, df) -> np.ndarray:
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    return bisect(lambda x: (1 - t_sf(x, df)) - p, np.full(p.shape, -1e4), np.full(p.shape, 1e4), 120)


def hypergeom_sf(k: int, hits: int, size: int, total: int) -> float:
    """P(X >= k): k or more of a set of `size` among `hits` drawn from `total`."""

    def log_choose(n, r):
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    top = min(hits, size)
    low = max(k, hits + size - total, 0)
    if low > top:
        return 0.0
    return min(1.0, sum(math.exp(log_choose(size, i) + log_choose(total - size, hits - i) - log_choose(total, hits)) for i in range(low, top + 1)))


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i * (1 / 30 - i * 5 / 66))))


def trigamma_inverse(y: float) -> float:
    """x with trigamma(x) = y, by bisection over log x (trigamma falls)."""
    if y <= 0 or not math.isfinite(y):
        return math.inf
    lo, hi = -20.0, 20.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if trigamma(math.exp(mid)) > y else (lo, mid)
    return math.exp((lo + hi) / 2)


def _norm_pdf(z: np.ndarray) -> np.ndarray:
    return np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _range_cdf(w: np.ndarray, groups: int, nodes: int = 128) -> np.ndarray:
    """P(range of `groups` standard normals <= w)."""
    x, weight = np.polynomial.legendre.leggauss(nodes)
    z = 8 * x
    upper = norm_cdf(z)
    inner = np.maximum(upper[None, :] - norm_cdf(z[None, :] - w[:, None]), 0) ** (groups - 1)
    return np.clip(groups * 8 * (weight * _norm_pdf(z) * inner).sum(1), 0, 1)


def _over_scale(df: float, f, nodes: int = 48) -> float:
    """Mean of f(s) over s = sqrt(chi2 / df)."""
    if df >= 1e8 or math.isinf(df):
        return float(f(np.ones(1))[0])
    x, weight = np.polynomial.legendre.leggauss(nodes)
    top = max(4.0, 1 + 6 / math.sqrt(df))
    s = (x + 1) * top / 2
    log_pdf = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    density = np.exp(log_pdf)
    return float((weight * density * f(s)).sum() * top / 2 / max((weight * density).sum() * top / 2, 1e-300))


def ptukey(q: float, groups: int, df: float) -> float:
    """Distribution function of the studentised range."""
    return 0.0 if q <= 0 else min(1.0, _over_scale(df, lambda s: _range_cdf(q * s, groups)))


def pdunnett(q: float, others: int, df: float, rho: float | np.ndarray = 0.5) -> float:
    """P(max |T_i| <= q) for comparisons with one control.

    rho: their common correlation; or for each other group n_i / (n_i + n_control), where two comparisons are
    correlated by the root of the product of theirs (groups of different size).
    """
    if q <= 0:
        return 0.0
    x, weight = np.polynomial.legendre.leggauss(64)
    z, share = 8 * x, np.broadcast_to(np.asarray(rho, float), (others,))

    def inside(s: np.ndarray) -> np.ndarray:
        every = np.ones((len(s), len(z)))
        for r, n in zip(*np.unique(share, return_counts=True), strict=True):
            up = (q * s[:, None] + math.sqrt(r) * z[None, :]) / math.sqrt(1 - r)
            low = (-q * s[:, None] + math.sqrt(r) * z[None, :]) / math.sqrt(1 - r)
            every *= np.maximum(norm_cdf(up) - norm_cdf(low), 0) ** n
        return 8 * (weight * _norm_pdf(z) * every).sum(1)

    return min(1.0, _over_scale(df, inside))


def quantile_of(cdf, p: float, hi: float = 30.0) -> float:
    """The place where an increasing distribution function reaches p."""
    lo = 0.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _nullable(a: np.ndarray) -> pd.Series:
    s = pd.Series(a, dtype="float64")
    return s.where(np.isfinite(s), None)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return _nullable(norm_two_sided(z.to_numpy(float)))


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return _nullable(norm_cdf(z.to_numpy(float)))


@F.pandas_udf(DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    """The upper tail."""
    return _nullable(0.5 * np.array([math.erfc(x / math.sqrt(2)) for x in z.to_numpy(float)]))


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """The value below which a share p lies; null outside (0, 1)."""
    return _nullable(np.array([NormalDist().inv_cdf(x) if 0 < x < 1 else np.nan for x in p.to_numpy(float)]))


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(chi2_sf(x.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _nullable(f_sf(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_quantile(p.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def hypergeom_pvalue(k: pd.Series, hits: pd.Series, size: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series([hypergeom_sf(*map(int, x)) for x in zip(k, hits, size, total, strict=True)], dtype="float64")
