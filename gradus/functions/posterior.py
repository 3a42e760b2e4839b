"""Credible intervals of beta and gamma posteriors, vectorised over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A type object: workers import this module without a session to parse DDL.
INTERVAL = T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
STEPS = 1_000_000  # terms after which a series or continued fraction is given up with an error
HALVINGS = 400  # likewise for solver steps
LARGE = 1e4  # shapes from here on use the uniform expansion

# Lanczos coefficients (g = 7, n = 9).
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    small = x < 0.5
    y = np.where(small, 1.0 - x, x) - 1.0
    total = np.full_like(y, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        total = total + c / (y + i)
    t = y + 7.5
    value = 0.5 * np.log(2 * np.pi) + (y + 0.5) * np.log(t) - t + np.log(total)
    with np.errstate(divide="ignore", invalid="ignore"):
        reflected = np.log(np.pi / np.abs(np.sin(np.pi * x))) - value
    return np.where(small, reflected, value)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    z = np.clip(z, 1e-300, 1 - 1e-16)
    front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    c = np.ones_like(z)
    d = 1 / _away(1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, STEPS):
        before = h
        for term in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 / _away(1 + term * d)
            c = _away(1 + term / c)
            h = h * d * c
        if np.all(np.abs(h - before) <= 1e-15 * np.abs(h)):
            break
    else:
        raise ArithmeticError("the beta distribution function did not converge")
    value = front * h
    return np.clip(np.where(flip, 1 - value, value), 0, 1)


def gamma_cdf(x: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: series below the mode, fraction above, and for large shapes
    the uniform asymptotic expansion, whose error falls with the shape."""
    x, s = np.broadcast_arrays(np.maximum(np.asarray(x, float), 1e-300), np.asarray(shape, float))
    large = s >= LARGE
    if large.any():
        out = np.empty_like(x)
        out[large] = _uniform_gamma(x[large], s[large])
        if not large.all():
            out[~large] = gamma_cdf(x[~large], s[~large])
        return out
    front = np.exp(s * np.log(x) - x - log_gamma(s))
    low = x < s + 1
    out = np.empty_like(x)
    if low.any():
        xs, ss = x[low], s[low]
        term = 1 / ss
        total = term
        for n in range(1, STEPS):
            term = term * xs / (ss + n)
            total = total + term
            if np.all(term <= 1e-16 * total):
                break
        else:
            raise ArithmeticError("the gamma series did not converge")
        out[low] = front[low] * total
    if (~low).any():
        xs, ss = x[~low], s[~low]
        b = xs + 1 - ss
        c = np.full_like(xs, 1e300)
        d = 1 / _away(b)
        h = d.copy()
        for i in range(1, STEPS):
            an = -i * (i - ss)
            b = b + 2
            d = 1 / _away(an * d + b)
            c = _away(b + an / c)
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1) <= 1e-15):
                break
        else:
            raise ArithmeticError("the gamma fraction did not converge")
        out[~low] = 1 - front[~low] * h
    return np.clip(out, 0, 1)


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _uniform_gamma(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Temme's expansion around the normal distribution, with two correction terms."""
    gap = x / s - 1
    half = np.where(np.abs(gap) < 1e-3, gap**2 * (0.5 - gap * (1 / 3 - gap * (0.25 - gap * 0.2))), gap - np.log1p(gap))
    eta = np.sign(gap) * np.sqrt(2 * half)
    near = np.abs(eta) < 1e-2
    away = np.where(near, 1.0, eta)
    first = np.where(near, -1 / 3 + eta / 12 - 2 * eta**2 / 135 + eta**3 / 864, 1 / np.where(near, 1.0, gap) - 1 / away)
    inner = np.where(near, 1.0, gap)
    second = np.where(near, -1 / 540 - eta / 288, 1 / away**3 - 1 / inner**3 - 1 / inner**2 - 1 / (12 * inner))
    normal = 0.5 * _erfc(-eta * np.sqrt(s / 2)).astype(float)
    return np.clip(normal - np.exp(-s * half) / np.sqrt(2 * np.pi * s) * (first + second / s), 0, 1)


def _away(v: np.ndarray) -> np.ndarray:
    """Keep a denominator off zero."""
    return np.where(np.abs(v) < 1e-300, 1e-300, v)


def _solve(cdf, log_pdf, q: float, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Newton steps that fall back to halving whenever they would leave the bracket."""
    for _ in range(HALVINGS):
        f = cdf(x) - q
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            new = x - f / np.exp(log_pdf(x))
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        if np.all(np.abs(new - x) <= 1e-13 * np.maximum(1e-3, np.abs(new))):
            return new
        x = new
    if np.any(hi - lo > 1e-9 * np.maximum(1e-3, np.abs(x))):
        raise ArithmeticError("a quantile was not found")
    return x


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.asarray(a, float), np.asarray(b, float)
    norm = log_gamma(a + b) - log_gamma(a) - log_gamma(b)
    log_pdf = lambda x: norm + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    return _solve(lambda x: beta_cdf(x, a, b), log_pdf, q, np.zeros_like(a), np.ones_like(a), a / (a + b))


def gamma_quantile(q: float, shape: np.ndarray) -> np.ndarray:
    shape = np.asarray(shape, float)
    norm = log_gamma(shape)
    log_pdf = lambda x: (shape - 1) * np.log(x) - x - norm
    high = shape + 12 * np.sqrt(shape) + 30  # far in the upper tail
    return _solve(lambda x: gamma_cdf(x, shape), log_pdf, q, np.zeros_like(shape), high, shape.copy())


def _interval(first: pd.Series, second: pd.Series, solve) -> pd.DataFrame:
    """Both quantiles of the rows whose parameters are positive numbers; null elsewhere."""
    a, b = first.to_numpy(float), second.to_numpy(float)
    ok = np.isfinite(a) & np.isfinite(b) & (a > 0) & (b > 0)
    out = pd.DataFrame({"lo": np.full(len(a), np.nan), "hi": np.full(len(a), np.nan)})
    if ok.any():
        for name, q in (("lo", 0.05), ("hi", 0.95)):
            out.loc[ok, name] = solve(q, a[ok], b[ok])
    return out


@F.pandas_udf(INTERVAL)
def beta_interval(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """5% and 95% quantiles of Beta(alpha, beta)."""
    for alpha, beta in batches:
        yield _interval(alpha, beta, beta_quantile)


@F.pandas_udf(INTERVAL)
def gamma_interval(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """5% and 95% quantiles of Gamma(shape, rate)."""
    for shape, rate in batches:
        yield _interval(shape, rate, lambda q, s, r: gamma_quantile(q, s) / r)
