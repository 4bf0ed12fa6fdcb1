"""Statistics of base counts: divergence, gamma fits and tails, quality scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

#: Counts that a divergence compares.
CATEGORIES = ("nA", "nC", "nG", "nT", "nI", "nD")
#: Coefficients of Lanczos' approximation of the gamma function, g = 7 (fixed values).
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def _sum(columns: list[Column]) -> Column:
    return reduce(Column.__add__, columns)


def kld(sample: list[Column], whole: list[Column]) -> Column:
    """Kullback-Leibler divergence of counts from others: 0 for an empty sample, infinite where only the sample has any."""
    st, gt = (_sum(x).cast("double") for x in (sample, whole))
    terms = []
    for s, g in zip(sample, whole, strict=True):
        ratio = F.try_divide(s * gt, g * st)
        terms.append(F.when(s == 0, 0.0).when(g == 0, F.lit(float("inf"))).otherwise(F.try_divide(s.cast("double"), st) * F.log(ratio)))
    return F.when(st == 0, 0.0).otherwise(_sum(terms))


def relative_entropy(p: Column, q: Column) -> Column:
    """Divergence of two arrays of probabilities, p from q; an error if they differ in length or q lacks what p has."""
    bad = lambda text: F.raise_error(F.lit(text)).cast("double")
    term = lambda a, b: F.when(a == 0, 0.0).when(b == 0, bad("no probability where there is some")).otherwise(a * F.log(F.try_divide(a, b)))
    return F.when(F.size(p) != F.size(q), bad("arrays of unequal length")).otherwise(F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x))


def moments(n: Column, sx: Column, sxx: Column) -> tuple[Column, Column]:
    """Shape and scale of a gamma distribution from count, sum and sum of squares, by mean and variance."""
    mean = F.try_divide(sx, n)
    variance = F.try_divide(sxx, n) - mean * mean
    return F.try_divide(mean * mean, variance), F.try_divide(variance, mean)


def gamma_parameters(n: Column, sx: Column, slx: Column, sxlx: Column) -> tuple[Column, Column]:
    """Closed-form shape and scale from the count and the sums of x, ln x and x ln x; a fixed scale where x hardly varies."""
    v = n * sxlx - sx * slx
    varies = v > 1e-12
    k = F.when(varies, F.try_divide(n * sx, v)).otherwise(F.try_divide(sx, n) / 0.01)
    theta = F.when(varies, F.try_divide(v, (n * n).cast("double"))).otherwise(0.01)
    return k, theta


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0."""
    y = np.where(x < 0.5, x + 1, x) - 1
    a = LANCZOS[0] + sum(c / (y + i) for i, c in enumerate(LANCZOS[1:], 1))
    t = y + 7.5
    full = 0.5 * np.log(2 * np.pi) + (y + 0.5) * np.log(t) - t + np.log(a)
    return np.where(x < 0.5, full - np.log(np.where(x > 0, x, 1)), full)


def upper_gamma(k: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function; 1 at x <= 0, and 0 above for k <= 0; NaN stays NaN."""
    k, x = np.asarray(k, dtype=float), np.asarray(x, dtype=float)
    out = np.where(np.isnan(k) | np.isnan(x), np.nan, np.where(x <= 0, 1.0, 0.0))
    live = (k > 0) & (x > 0) & np.isfinite(x) & np.isfinite(k)
    if not live.any():
        return out
    kk, xx = k[live], x[live]
    with np.errstate(all="ignore"):
        front = np.exp(-xx + kk * np.log(xx) - lgamma(kk + 1))
        near = xx < kk + 1
        # Below the mode a series for the lower part; terms shrink once their index passes x - k.
        term, total, i = np.ones(len(kk)), np.ones(len(kk)), 0
        while i < 100_000 and (near & (term > total * 1e-17)).any():
            i += 1
            term = np.where(near, term * xx / (kk + i), 0)
            total += term
        low = 1 - front * total
        # Above it a continued fraction for the upper part itself, so that small tails keep their digits.
        tiny = 1e-300
        b = xx + 1 - kk
        c, d = np.full(len(kk), 1 / tiny), 1 / np.where(np.abs(b) < tiny, tiny, b)
        h, i, moving = d.copy(), 0, ~near
        while i < 100_000 and moving.any():
            i += 1
            a = -i * (i - kk)
            b = b + 2
            d = 1 / np.where(np.abs(a * d + b) < tiny, tiny, a * d + b)
            c = np.where(np.abs(b + a / c) < tiny, tiny, b + a / c)
            step = d * c
            h = np.where(moving, h * step, h)
            moving = moving & (np.abs(step - 1) > 1e-15)
        high = front * kk * h
        out[live] = np.clip(np.where(near, low, high), 0, 1)
    return out


@F.pandas_udf(DoubleType())
def gamma_sf(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Upper tail at x of the gamma distribution of shape k and scale theta: gamma_sf(k, theta, x)."""
    for k, theta, x in parts:
        with np.errstate(all="ignore"):
            yield pd.Series(upper_gamma(k.to_numpy(dtype=float), x.to_numpy(dtype=float) / theta.to_numpy(dtype=float)))


@F.pandas_udf(DoubleType())
def chi_squared_sf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Upper tail of the chi-squared distribution: chi_squared_sf(degrees, x)."""
    for n, x in parts:
        yield pd.Series(upper_gamma(n.to_numpy(dtype=float) / 2, x.to_numpy(dtype=float) / 2))


def phred(p: Column) -> Column:
    """-10 log10 p; infinite for 0."""
    return F.when(p <= 0, F.lit(float("inf"))).otherwise(-10 * F.log10(p))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; NaN for 0 / 0."""
    return F.when(b == 0, F.when(a == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def human(n: Column) -> Column:
    """A number with two decimals and K, M, G or T for a thousand to a billion thousand."""
    out = F.format_string("%.2f", n.cast("double"))
    for i, unit in enumerate("KMGT", 1):
        out = F.when(n >= 1000**i, F.concat(F.format_string("%.2f", n / float(1000**i)), F.lit(unit))).otherwise(out)
    return out
