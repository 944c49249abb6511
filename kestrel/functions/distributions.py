"""Distribution functions for p-values (scipy is not available).

These run on *result rows* (a handful of statistics), through the pandas
UDFs at the bottom, never over table rows.  Algorithms are the textbook
ones: continued fractions for the regularised incomplete beta and gamma
functions, Wichura's AS 241 for the normal quantile, Royston (1992/1995) for
Shapiro-Wilk, and Gauss-Legendre quadrature for the studentized range.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300


# ---------------------------------------------------------------- special functions
def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        de = d * c
        h *= de
        if abs(de - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    if x < a + 1.0:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(100000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * _EPS:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


# ---------------------------------------------------------------- distributions
def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


# fixed values: Wichura (1988) AS 241 PPND16, numerators and denominators from the highest power
_PPF = {
    "centre": ([2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
            13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608],
           [5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
            5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0]),
    "side": ([7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
            3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734],
           [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
            0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0]),
    "tail": ([2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
            0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772],
           [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
            0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0]),
}


def norm_ppf_array(p: np.ndarray) -> np.ndarray:
    """Normal quantiles (AS 241); NaN outside [0, 1]."""
    p = np.asarray(p, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        q, low = p - 0.5, np.minimum(p, 1 - p)
        r = np.sqrt(-np.log(low))
        side = np.where(r <= 5, _ratio("side", r - 1.6), _ratio("tail", r - 5.0))
        out = np.where(np.abs(q) <= 0.425, q * _ratio("centre", 0.180625 - q * q), np.copysign(side, q))
    return np.where(low == 0, np.copysign(np.inf, q), np.where(low > 0, out, np.nan))


def _ratio(name: str, r: np.ndarray) -> np.ndarray:
    num, den = _PPF[name]
    return np.polyval(num, r) / np.polyval(den, r)


def norm_ppf(p: float) -> float:
    return float(norm_ppf_array(np.array([p]))[0])


def t_sf_two_sided(t: float, df: float) -> float:
    if df <= 0 or t is None or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return math.nan
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x: float, k: float) -> float:
    if x is None or math.isnan(x) or k <= 0:
        return math.nan
    return gammaincc(k / 2.0, x / 2.0)


def corr_pvalue(r: float, n: float) -> float:
    """Two-sided p of a correlation by t = r·sqrt((n-2)/(1-r²)), df = n-2."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return math.nan
    if abs(r) >= 1.0:
        return 0.0
    t = r * math.sqrt((n - 2.0) / (1.0 - r * r))
    return t_sf_two_sided(t, n - 2.0)


# ---------------------------------------------------------------- Shapiro-Wilk
def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


# fixed values: Royston (1992, 1995) polynomial coefficients for Shapiro-Wilk
_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
_C6 = [-0.4803, -0.082676, 0.0030302]
_G = [-2.273, 0.459]


def shapiro_wilk(x) -> tuple[float, float]:
    """(W, p) by Royston's approximation (valid for 3 <= n <= 5000)."""
    x = np.sort(np.asarray(x, dtype=float))
    n = x.size
    if n < 3:
        return math.nan, math.nan
    rng = x[-1] - x[0]
    if rng <= 0:
        return 1.0, 1.0
    i = np.arange(1, n + 1)
    m = np.array([norm_ppf((k - 0.375) / (n + 0.25)) for k in i])
    ssm = float(np.dot(m, m))
    u = 1.0 / math.sqrt(n)
    a = np.zeros(n)
    if n == 3:
        a[-1] = math.sqrt(0.5)
        a[0] = -a[-1]
    else:
        c = m / math.sqrt(ssm)
        a_n = c[-1] + _poly(_C1, u)
        if n > 5:
            a_n1 = c[-2] + _poly(_C2, u)
            phi = (ssm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a_n ** 2 - 2 * a_n1 ** 2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-2], a[1] = a_n1, -a_n1
        else:
            phi = (ssm - 2 * m[-1] ** 2) / (1 - 2 * a_n ** 2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[-1], a[0] = a_n, -a_n
    xc = x - x.mean()
    w = float(np.dot(a, x) ** 2 / np.dot(xc, xc))
    w = min(w, 1.0)
    if n == 3:
        p = max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        return w, min(1.0, p)
    lw = math.log(1.0 - w) if w < 1.0 else -math.inf
    if n <= 11:
        gamma = _poly(_G, n)
        if lw >= gamma:
            return w, 0.0
        y = -math.log(gamma - lw)
        mu, sigma = _poly(_C3, n), math.exp(_poly(_C4, n))
    else:
        ln = math.log(n)
        y = lw
        mu, sigma = _poly(_C5, ln), math.exp(_poly(_C6, ln))
    if y == -math.inf:
        return w, 1.0
    return w, norm_sf((y - mu) / sigma)


# ---------------------------------------------------------------- studentized range
_GL_X, _GL_W = np.polynomial.legendre.leggauss(96)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _nodes(low: float, high: float, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on ``parts`` equal pieces of [low, high]."""
    edges = np.linspace(low, high, parts + 1)
    half = (edges[1:] - edges[:-1])[:, None] / 2
    return (edges[:-1, None] + half + half * _GL_X).ravel(), (half * _GL_W).ravel()


def _upper(z: np.ndarray) -> np.ndarray:
    """P(N > z)."""
    return 0.5 * _erfc(z / math.sqrt(2)).astype(float)


def _range_sf_z(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals > w), computed as such.

    The smallest value lies at z with density k φ(z) P(N > z)^(k-1); the others then all
    stay below z + w with probability (1 - u)^(k-1), u = P(N > z + w) / P(N > z), so the
    tail is the mean of 1 - (1 - u)^(k-1), without a difference of numbers near 1.
    """
    z, weight = _nodes(-9.0, 9.0, 2)
    upper = _upper(z)
    log_density = math.log(k) - 0.5 * z * z - 0.5 * math.log(2 * math.pi) + (k - 1) * np.log(np.maximum(upper, 1e-300))
    u = np.minimum(_upper(z + np.asarray(w, float)[:, None]) / np.maximum(upper, 1e-300), 1 - 1e-16)
    tail = -np.expm1((k - 1) * np.log1p(-u))
    # the smallest of k values is above z + w only if all are; it is beyond the grid never
    return np.minimum(1.0, (weight * np.exp(log_density) * tail).sum(1))


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(Q > q) for k means and ``df`` error degrees of freedom (Tukey HSD): one quadrature
    over s = sqrt(chi² / df) for every df, on the stretch that holds the integral."""
    if q <= 0 or k < 2:
        return 1.0
    # log density of s; its spread is about 1 / sqrt(2 df), and small s weigh more in the tail
    spread = 1 / math.sqrt(2 * df)
    low, high = max(1e-8, 1 - 40 * spread), 1 + 12 * spread
    const = (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + math.log(2)
    grid = np.linspace(low, high, 2001)

    def log_density(s):
        return const + (df - 1) * np.log(s) - df * s * s / 2
    with np.errstate(divide="ignore"):
        mass = log_density(grid) + np.log(np.maximum(_range_sf_z(q * grid[::20], k).repeat(20)[:len(grid)], 1e-300))
    some = grid[mass > mass.max() - 60]
    step = grid[1] - grid[0]
    s, weight = _nodes(max(low, some[0] - 21 * step), min(high, some[-1] + 21 * step), 2)
    return float(min(1.0, max(0.0, (weight * np.exp(log_density(s)) * _range_sf_z(q * s, k)).sum())))


def studentized_range_cdf(q: float, k: int, df: float) -> float:
    return 1.0 - studentized_range_sf(q, k, df)


def studentized_range_ppf(p: float, k: int, df: float) -> float:
    lo, hi = 0.0, 1.0
    while studentized_range_sf(hi, k, df) > 1 - p:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        if studentized_range_sf(mid, k, df) > 1 - p:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-12 * hi:
            break
    return 0.5 * (lo + hi)


# ---------------------------------------------------------------- pandas UDFs (result rows)
def _vec(fn, *cols):
    return pd.Series([fn(*vals) for vals in zip(*cols)], dtype="float64")


def _safe(fn):
    def g(*vals):
        if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in vals):
            return math.nan
        return fn(*vals)
    return g


@F.pandas_udf(T.DoubleType())
def corr_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return _vec(_safe(corr_pvalue), r, n)


@F.pandas_udf(T.DoubleType())
def f_sf_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _vec(_safe(f_sf), f, d1, d2)


@F.pandas_udf(T.DoubleType())
def chi2_sf_udf(x: pd.Series, k: pd.Series) -> pd.Series:
    return _vec(_safe(chi2_sf), x, k)



@F.pandas_udf(T.DoubleType())
def tukey_p_udf(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(_safe(lambda a, b, c: studentized_range_sf(a, int(b), c)), q, k, df)


#: Positions at each end of a long tied run whose quantiles are added one by one.
SCORE_ENDS = 256


def _scores_of(first: np.ndarray, count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of squares of the normal quantiles at Filliben's positions
    first .. first + count - 1 of ``total``, one by one."""
    run = np.repeat(np.arange(len(count)), count)
    pos = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    m = total[run]
    p = (pos - 0.3175) / (m + 0.365)
    p = np.where(pos == m, 0.5 ** (1 / m), np.where(pos == 1, 1 - 0.5 ** (1 / m), p))
    q = norm_ppf_array(p)
    return np.bincount(run, q, len(count)), np.bincount(run, q * q, len(count))


def _scores_between(first: np.ndarray, last: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for long stretches away from the ends of the scale: the integrals of z and z²
    from half a position before to half a position after, which are differences of the
    density φ(z) and of u - zφ(z), less the first term of the midpoint rule."""
    h = 1 / (total + 0.365)
    out = []
    for edge in ((last + 0.5 - 0.3175) * h, (first - 0.5 - 0.3175) * h):
        z = norm_ppf_array(edge)
        density = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
        out.append((-density, edge - z * density, 1 / density, 2 * z / density))
    (a1, a2, d1, d2), (b1, b2, e1, e2) = out
    return (a1 - b1) / h - h / 24 * (d1 - e1), (a2 - b2) / h - h / 24 * (d2 - e2)


def normal_scores(before: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and sum of squares, of the normal quantiles at positions before + 1 .. before + n
    of ``total`` ordered values, for each tied run."""
    long = n > 4 * SCORE_ENDS
    head = np.where(long, SCORE_ENDS, n)
    one, squares = _scores_of(before + 1, head, total)
    if long.any():
        b, k, m = before[long], n[long], total[long]
        ends = np.full(len(b), SCORE_ENDS)
        for part in (_scores_of(b + k - SCORE_ENDS + 1, ends, m), _scores_between(b + SCORE_ENDS + 1, b + k - SCORE_ENDS, m)):
            one[long] += part[0]
            squares[long] += part[1]
    return one / n, squares


@F.pandas_udf(T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("squares", T.DoubleType())]))
def normal_scores_udf(before: pd.Series, n: pd.Series, total: pd.Series) -> pd.DataFrame:
    mean, squares = normal_scores(*(c.to_numpy().astype("int64") for c in (before, n, total)))
    return pd.DataFrame({"mean": mean, "squares": squares})
