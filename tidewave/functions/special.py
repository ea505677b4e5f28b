"""Special functions and distributions, as columns and as vectorised NumPy functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The five-term approximation of the error function in Abramowitz and Stegun, 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def erf(x: Column) -> Column:
    """Error function to about 1.5e-7, in plain expressions."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(z / math.sqrt(2.0)))


def erf_np(x):
    x = np.asarray(x, float)
    t = 1 / (1 + ERF_P * np.abs(x))
    return np.sign(x) * (1 - sum(a * t ** (k + 1) for k, a in enumerate(ERF_A)) * np.exp(-x * x))


def normal_cdf_np(z):
    return 0.5 * (1 + erf_np(np.asarray(z, float) / math.sqrt(2)))


def ln_gamma(x):
    """ln of the gamma function; NaN for x <= 0."""
    x = np.asarray(x, float)
    return np.where(x > 0, _lgamma(np.where(x > 0, x, 1.0)), np.nan)


def gamma(x):
    return np.exp(ln_gamma(x))


def ln_beta(a, b):
    return ln_gamma(a) + ln_gamma(b) - ln_gamma(np.asarray(a, float) + b)


def beta(a, b):
    return np.exp(ln_beta(a, b))


def beta_kernel(x: Column, a: float, b: float) -> Column:
    """x^(a-1) (1-x)^(b-1) within [0, 1], else 0."""
    return F.when((x >= 0) & (x <= 1), F.pow(x, a - 1) * F.pow(1 - x, b - 1)).otherwise(0.0)


def beta_pdf(x: Column, a: float, b: float) -> Column:
    return beta_kernel(x, a, b) / float(beta(a, b))


def gamma_kernel(x: Column, shape: float, rate: float) -> Column:
    """x^(shape-1) e^(-rate x) for x > 0, else 0."""
    return F.when(x > 0, F.pow(x, shape - 1) * F.exp(-rate * x)).otherwise(0.0)


def gamma_pdf(x: Column, shape: float, rate: float) -> Column:
    return gamma_kernel(x, shape, rate) * (rate**shape / float(gamma(shape)))


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of the chi-squared distribution, by the incomplete gamma function's series or continued fraction."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 1.0
    lead = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - lead * total)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h
