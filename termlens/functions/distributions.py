"""Tail probabilities and quantiles for t, F and the studentized range (numpy + math only).

These run inside Arrow-batched pandas UDFs over *aggregated* rows (one row per
statistic / group / group pair), never per data row.

* ``betainc`` -- regularised incomplete beta I_x(a, b) by Lentz's continued
  fraction, using the symmetry I_x(a,b) = 1 - I_{1-x}(b,a) for fast convergence.
* t and F tails are I_x of suitable arguments; the t quantile is found by
  bisection + Newton on the CDF.
* Studentized range: P(Q <= q) = integral over s of the range CDF of k normals
  at q*s, weighted by the density of s = sqrt(chi2_df / df); both integrals by
  vectorised Gauss-Legendre quadrature.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# --------------------------------------------------------------------------- #
# incomplete beta
# --------------------------------------------------------------------------- #
def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            return h
    raise ArithmeticError(f"the incomplete beta fraction does not converge for a={a}, b={b}, x={x}")


def _stirling(x: float) -> float:
    """lgamma(x) less its leading terms (x - 1/2) log x - x + log(2 pi) / 2."""
    return (1.0 / 12.0 - (1.0 / 360.0 - 1.0 / (1260.0 * x * x)) / (x * x)) / x


def _log_beta(a: float, b: float) -> float:
    """log B(a, b) without cancellation when one argument is large."""
    a, b = max(a, b), min(a, b)
    if a < 100.0:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    # lgamma(a + b) - lgamma(a) from Stirling's series, term by term
    rise = (a - 0.5) * math.log1p(b / a) + b * (math.log(a) + math.log1p(b / a)) - b + _stirling(a + b) - _stirling(a)
    return math.lgamma(b) - rise if b < 100.0 else (
        (b - 0.5) * math.log(b) - b + 0.5 * math.log(2.0 * math.pi) + _stirling(b) - rise
    )


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta I_x(a, b) for a, b > 0, 0 <= x <= 1.

    ``y`` is 1 - x; a caller that knows the smaller of the two exactly passes both."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    log_y = math.log(y) if y < 0.5 else math.log1p(-x)
    front = math.exp(a * log_x + b * log_y - _log_beta(a, b))
    # the fraction in x loses digits where a is large and x close to 1: there the one in y,
    # which needs about a * y steps, is kept in use while the tail is not tiny
    near_one = a > 1e4 and b < 100.0 and a * y < 50.0
    if x < (a + 1.0) / (a + b + 2.0) and not near_one:
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, y) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t) for Student's t with ``df`` degrees of freedom."""
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))
    return tail if t >= 0 else 1.0 - tail


def t_cdf(t: float, df: float) -> float:
    return 1.0 - t_sf(t, df)


def t_pdf(t: float, df: float) -> float:
    lc = -_log_beta(df / 2.0, 0.5) - 0.5 * math.log(df)
    return math.exp(lc - (df + 1) / 2 * math.log1p(t * t / df))


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t (bisection bracket, then Newton polish)."""
    if not 0.0 < p < 1.0:
        return math.nan if not p in (0.0, 1.0) else (-math.inf if p == 0.0 else math.inf)
    if p < 0.5:
        return -t_ppf(1.0 - p, df)
    lo, hi = 0.0, 1.0
    while t_cdf(hi, df) < p:
        lo, hi = hi, hi * 2.0
        if hi > 1e12:
            break
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, df) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-12 * max(1.0, hi):
            break
    t = 0.5 * (lo + hi)
    for _ in range(3):
        f = t_pdf(t, df)
        if f <= 0:
            break
        t -= (t_cdf(t, df) - p) / f
    return t


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for the F distribution with (d1, d2) degrees of freedom."""
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson r from n pairs (t test with n-2 df)."""
    if n <= 2:
        return 1.0
    r = max(-1.0, min(1.0, r))
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2
    return betainc(df / 2.0, 0.5, (1.0 - r) * (1.0 + r), r * r)


# --------------------------------------------------------------------------- #
# studentized range
# --------------------------------------------------------------------------- #
_GL = np.polynomial.legendre.leggauss(128)


def _phi(z):
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


_STEP = 1e-3
_KNOTS = np.arange(-9000, 9002) * _STEP
_AT_KNOTS = np.array([0.5 * math.erfc(-z / math.sqrt(2.0)) for z in _KNOTS])


def _Phi(z):
    """Normal distribution function by cubic Hermite steps between knots (error below 1e-13)."""
    z = np.clip(z, -9.0, 9.0)
    i = np.minimum(((z + 9.0) / _STEP).astype(np.int64), len(_KNOTS) - 2)
    t = (z - _KNOTS[i]) / _STEP
    slope0, slope1 = _phi(_KNOTS[i]) * _STEP, _phi(_KNOTS[i + 1]) * _STEP
    rise = _AT_KNOTS[i + 1] - _AT_KNOTS[i]
    return _AT_KNOTS[i] + t * (slope0 + t * (3 * rise - 2 * slope0 - slope1 + t * (slope0 + slope1 - 2 * rise)))


def _nodes(lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    x, wt = _GL
    return 0.5 * (hi - lo) * x + 0.5 * (hi + lo), 0.5 * (hi - lo) * wt


_Z, _ZW = _nodes(-9.0, 9.0)
_PHI_Z, _CDF_Z = _phi(_Z), _Phi(_Z)


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k iid N(0,1) <= w), vectorised over w."""
    inner = np.clip(_CDF_Z[None, :] - _Phi(_Z[None, :] - w[:, None]), 0.0, 1.0)
    return np.clip(k * np.sum((_ZW * _PHI_Z)[None, :] * inner ** (k - 1), axis=1), 0.0, 1.0)


def ptukey(q: float, k: int, df: float) -> float:
    """P(Q <= q) for the studentized range with k groups and df error degrees of freedom.

    Integrated over s = sqrt(chi2_df / df), whose density is smooth also at df = 1; it is taken
    relative to its value at 1 and normalised by the quadrature itself, which holds at any df.
    """
    if q <= 0:
        return 0.0
    if math.isinf(df):
        return float(_range_cdf(np.array([q]), k)[0])
    spread = math.sqrt(0.5 / df)
    lo, hi = max(0.0, 1.0 - 10.0 * spread), 1.0 + 10.0 * spread
    knee = min(max(lo, 8.0 / q), hi)  # beyond it the range probability is flat
    s, weight = (np.concatenate(z) for z in zip(_nodes(lo, knee), _nodes(knee, hi)))
    d = s - 1.0
    dens = weight * np.exp((df - 1.0) * np.log1p(d) - df * (d + 0.5 * d * d))
    return float(np.clip(np.sum(dens * _range_cdf(q * s, k)) / np.sum(dens), 0.0, 1.0))


def qtukey(p: float, k: int, df: float) -> float:
    """Quantile of the studentized range (bisection on :func:`ptukey`)."""
    lo, hi = 0.0, 10.0
    while ptukey(hi, k, df) < p:
        hi *= 2.0
        if hi > 1e4:
            break
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        if ptukey(mid, k, df) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


RANGE_KNOTS = 1024
RANGE_SCALE = 4.0  # knots are even in u = q / (q + RANGE_SCALE)


def tukey_table(k: int, df: float) -> tuple[np.ndarray, np.ndarray]:
    """P(Q <= q) and its slopes (for a step of one knot) at even knots of u, for one k and df."""
    u = np.arange(RANGE_KNOTS + 1) / RANGE_KNOTS
    q = RANGE_SCALE * u[:-1] / (1.0 - u[:-1])
    p = np.ones(RANGE_KNOTS + 1)
    for i, x in enumerate(q):
        p[i] = ptukey(float(x), k, df)
        if p[i] >= 1.0 - 1e-15:
            break
    p = np.maximum.accumulate(p)
    rise = np.diff(p)
    slope = np.empty_like(p)
    slope[0], slope[-1] = 0.0, rise[-1]
    slope[1:-1] = (p[2:] - p[:-2]) / 2
    slope[2:-2] = (8 * (p[3:-1] - p[1:-3]) - (p[4:] - p[:-4])) / 12
    # no more than three times the lower neighbouring rise keeps every step monotone
    least = np.minimum(np.append(rise, rise[-1]), np.insert(rise, 0, rise[0]))
    return p, np.clip(slope, 0.0, 3 * least)


def tukey_sf_column(q: Column, k: int, df: float) -> Column:
    """1 - P(Q <= q) by cubic steps between the knots of :func:`tukey_table`, as a column expression."""
    p, slope = (F.lit([float(x) for x in v]) for v in tukey_table(k, df))
    place = q / (q + RANGE_SCALE) * RANGE_KNOTS
    i = F.least(F.floor(place), F.lit(RANGE_KNOTS - 1)).cast("int")
    t = place - i
    p0, p1, s0, s1 = F.get(p, i), F.get(p, i + 1), F.get(slope, i), F.get(slope, i + 1)
    rise = p1 - p0
    cdf = p0 + t * (s0 + t * (rise * 3 - s0 * 2 - s1 + t * (s0 + s1 - rise * 2)))
    return F.when(q == float("inf"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - cdf)))


# --------------------------------------------------------------------------- #
# Arrow UDFs (applied to aggregated rows only)
# --------------------------------------------------------------------------- #
def _map2(fn, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([fn(x, y) if pd.notna(x) and pd.notna(y) else None for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_ppf_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _map2(lambda x, d: t_ppf(float(x), float(d)) if d > 0 else None, p, df)


@F.pandas_udf(T.DoubleType())
def pearson_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return _map2(lambda x, m: pearson_p(float(x), int(m)), r, n)


@F.pandas_udf(T.DoubleType())
def f_sf_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    out = []
    for x, a, b in zip(f, d1, d2):
        out.append(f_sf(float(x), float(a), float(b)) if pd.notna(x) and pd.notna(a) and pd.notna(b) and a > 0 and b > 0 else None)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def tukey_sf_udf(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    out = []
    for x, kk, d in zip(q, k, df):
        ok = pd.notna(x) and pd.notna(kk) and pd.notna(d) and d > 0 and kk >= 2
        out.append(1.0 - ptukey(float(x), int(kk), float(d)) if ok else None)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def tukey_q_udf(p: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    cache: dict = {}
    out = []
    for x, kk, d in zip(p, k, df):
        key = (float(x), int(kk), float(d))
        if key not in cache:
            cache[key] = qtukey(*key) if d > 0 and kk >= 2 else None
        out.append(cache[key])
    return pd.Series(out, dtype="float64")
