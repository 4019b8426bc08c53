"""Column functions: normal distribution, scores, Chebyshev polynomials, distances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_2PI = math.log(2 * math.pi)


_ERF_CENTRE, _ERF_DEGREE = 2.0, 20


def _scaled_erfc(t: np.ndarray) -> np.ndarray:
    """exp(x^2) erfc(x) at x = c (1 + t) / (1 - t), which maps [-1, 1) onto x >= 0; its limit 0 at t = 1."""
    x = _ERF_CENTRE * (1 + t) / np.maximum(1 - t, 1e-300)
    near = np.minimum(x, 20.0)
    value = np.array([math.exp(v * v) * math.erfc(v) for v in near])
    far = (1 - 1 / (2 * x**2) + 3 / (4 * x**4) - 15 / (8 * x**6)) / (x * math.sqrt(math.pi)) if len(x) else x
    return np.where(x > 20, far, value)


def _erf_terms() -> list[float]:
    """Coefficients of powers of t of the interpolating polynomial at Chebyshev points."""
    fit = np.polynomial.chebyshev.Chebyshev.interpolate(_scaled_erfc, _ERF_DEGREE)
    return fit.convert(kind=np.polynomial.Polynomial).coef.tolist()


_ERF = _erf_terms()


def erf(x: Column) -> Column:
    """The error function, 1 - exp(-x^2) p(t) with a polynomial p in t = (|x| - c) / (|x| + c); within 1e-14."""
    z = F.least(F.abs(x), F.lit(30.0))
    t = (z - _ERF_CENTRE) / (z + _ERF_CENTRE)
    p = F.lit(_ERF[-1])
    for c in reversed(_ERF[:-1]):
        p = p * t + c
    return F.when(F.isnan(x), x).otherwise(F.signum(x) * (1 - F.exp(-z * z) * p))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def gaussian_log_pdf(deviation: Column, variance: Column) -> Column:
    return -0.5 * (LOG_2PI + F.log(variance) + deviation * deviation / variance)


def gaussian_pdf(deviation: Column, variance: Column) -> Column:
    return F.exp(gaussian_log_pdf(deviation, variance))


def negative_log_likelihood(deviation: Column, variance: Column) -> Column:
    return -gaussian_log_pdf(deviation, variance)


def _finite(*columns: Column) -> Column:
    """Whether all are finite: neither NaN nor infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def crps_normal(y: Column, mean: Column, sd: Column) -> Column:
    """Continuous ranked probability score of a normal prediction; sd <= 0: |y - mean|; not finite: NaN."""
    z = (y - mean) / sd
    score = sd * (z * (2 * normal_cdf(z) - 1) + 2 * gaussian_pdf(z, F.lit(1.0)) - 1 / math.sqrt(math.pi))
    return F.when(~_finite(y, mean, sd), F.lit(float("nan"))).when(sd <= 0, F.abs(y - mean)).otherwise(score)


def expected_abs_normal(mean: Column, sd: Column, order: int = 1) -> Column:
    """E|X| (order 1) or E X^2 (order 2) of a normal X; sd <= 0: of its mean; not finite: NaN."""
    if order == 2:
        value = mean * mean + F.greatest(sd, F.lit(0.0)) * F.greatest(sd, F.lit(0.0))
        return F.when(~_finite(mean, sd), F.lit(float("nan"))).otherwise(value)
    z = mean / sd
    folded = sd * math.sqrt(2 / math.pi) * F.exp(-0.5 * z * z) + mean * erf(z / math.sqrt(2))
    return F.when(~_finite(mean, sd), F.lit(float("nan"))).when(sd <= 0, F.abs(mean)).otherwise(folded)


def lower_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function P(a, x), a > 0, x >= 0: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    log_gamma = np.frompyfunc(math.lgamma, 1, 1)(a).astype(float)
    out = np.zeros(a.shape)
    low = (x < a + 1) & (x > 0)
    if low.any():
        s, z = a[low], x[low]
        term = total = 1 / s
        n = s.copy()
        for _ in range(2000):
            n = n + 1
            term = term * z / n
            total = total + term
            if (np.abs(term) < np.abs(total) * 1e-16).all():
                break
        out[low] = total * np.exp(-z + s * np.log(z) - log_gamma[low])
    high = (x >= a + 1) & np.isfinite(x)
    if high.any():
        s, z = a[high], x[high]
        tiny = 1e-300
        b = z + 1 - s
        c, dd = np.full(len(s), 1 / tiny), 1 / b
        h = dd.copy()
        for i in range(1, 2000):
            an = -i * (i - s)
            b = b + 2
            dd = an * dd + b
            dd = 1 / np.where(np.abs(dd) < tiny, tiny, dd)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = dd * c
            h = h * step
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[high] = 1 - np.exp(-z + s * np.log(z) - log_gamma[high]) * h
    out[np.isposinf(x)] = 1.0
    return out


def chi_squared_cdf_values(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(dof/2, x/2); NaN or x < 0: NaN; dof 0: 1; x below machine precision: 0; infinite x: 1."""
    x, dof = np.broadcast_arrays(np.asarray(x, float), np.asarray(dof, float))
    out = np.full(x.shape, np.nan)
    ok = ~(np.isnan(x) | np.isnan(dof) | (x < 0))
    out[ok & (dof == 0)] = 1.0
    rest = ok & (dof > 0)
    out[rest & (x < np.finfo(float).eps)] = 0.0
    rest &= x >= np.finfo(float).eps
    out[rest] = lower_gamma(dof[rest] / 2, x[rest] / 2)
    return out


def chi_squared_cdf(x: Column | str, dof: Column | str) -> Column:
    """The chi-squared distribution function; see chi_squared_cdf_values. Batches, as Spark has no gamma function."""

    @F.pandas_udf("double")
    def cdf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(chi_squared_cdf_values(a.to_numpy(float), b.to_numpy(float)))

    return cdf(x, dof)


def _recurrence(x: Column, n: int, kind: str) -> list[Column]:
    out = [F.lit(1.0), x if kind == "t" else 2 * x]
    while len(out) <= n:
        out.append(2 * x * out[-1] - out[-2])
    return out[: n + 1]


def chebyshev_t(x: Column, n: int) -> Column:
    """T_n(x) by the three-term recurrence."""
    return chebyshev_basis(x, n, "t")[n]


def chebyshev_u(x: Column, n: int) -> Column:
    """U_n(x) by the three-term recurrence."""
    return chebyshev_basis(x, n, "u")[n]


def chebyshev_basis(x: Column, n_max: int, kind: str = "t") -> Column:
    """Array of the polynomials 0 .. n_max; a fold, so that high degrees don't nest expressions."""
    if n_max < 2:
        return F.array(*_recurrence(x, n_max, kind))
    grow = lambda a, _: F.concat(a, F.array(2 * x * F.element_at(a, -1) - F.element_at(a, -2)))
    return F.aggregate(F.sequence(F.lit(2), F.lit(n_max)), F.array(*_recurrence(x, 1, kind)), grow)


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def distance_euclidean(x: Column, y: Column, arrays: bool = False) -> Column:
    if not arrays:
        return F.abs(x - y)
    square = F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, v: s + v))


def norm(x: Column) -> Column:
    return F.sqrt(_dot(x, x))


def distance_radial(x: Column, y: Column) -> Column:
    return F.abs(norm(x) - norm(y))


def distance_angular(x: Column, y: Column) -> Column:
    """Angle between two vectors; cosines beyond one by rounding count as one."""
    cosine = _dot(x, y) / (norm(x) * norm(y))
    return F.when(cosine > 1 - 1e-16, 0.0).when(cosine < -1 + 1e-16, math.pi).otherwise(F.acos(cosine))


def elevation_scaling(height: Column, centre: float, factor: float) -> Column:
    return 1 + factor * F.greatest(F.lit(0.0), centre - height)


def ecef(latitude: Column, longitude: Column, height: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates in metres of geodetic degrees and metres (WGS84)."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    lat, lon = F.radians(latitude), F.radians(longitude)
    n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return (n + height) * F.cos(lat) * F.cos(lon), (n + height) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + height) * F.sin(lat)
