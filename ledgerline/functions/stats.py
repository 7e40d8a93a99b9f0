"""Tail probabilities and test statistics, as expressions or (where no function is built in) plain functions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-squared with 1 or 2 degrees of freedom."""
    if df == 1:
        return math.erfc(math.sqrt(max(x, 0.0) / 2))
    if df == 2:
        return math.exp(-max(x, 0.0) / 2)
    raise ValueError("1 or 2 degrees of freedom")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + n * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + n / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a (rank) correlation by Student's t."""
    if n < 3 or not abs(r) <= 1:
        return float("nan")
    return 0.0 if abs(r) == 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def erf_abs(x: Column) -> Column:
    """erfc of a non-negative column to 1.2e-7 (a rational Chebyshev fit), inside the JVM."""
    t = 1 / (1 + x / 2)
    poly = F.lit(0.0)
    for c in reversed((-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def kupiec_lr(n: Column, v: Column, alpha: float) -> Column:
    """Likelihood ratio of the proportion-of-failures test; null without observations."""
    p = v / n
    both = v * math.log(alpha) + (n - v) * math.log(1 - alpha) - v * F.ln(p) - (n - v) * F.ln(1 - p)
    return F.when(n == 0, None).when(v == 0, -2.0 * n * math.log(1 - alpha)).when(v == n, -2.0 * n * math.log(alpha)).otherwise(-2.0 * both)


def independence_lr(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    """Likelihood ratio of independent violations; 0 where a transition that it needs is missing."""
    term = lambda k, p: F.when(k == 0, 0.0).otherwise(k * F.ln(p))
    n0, n1 = n00 + n01, n10 + n11
    p01, p11, p = n01 / F.nullif(n0, F.lit(0)), n11 / F.nullif(n1, F.lit(0)), (n01 + n11) / F.nullif(n0 + n1, F.lit(0))
    lr = -2.0 * (term(n00, 1 - p) + term(n01, p) + term(n10, 1 - p) + term(n11, p) - term(n00, 1 - p01) - term(n01, p01) - term(n10, 1 - p11) - term(n11, p11))
    return F.when((n0 == 0) | (n1 == 0) | (n01 == 0) | (n10 == 0), 0.0).otherwise(lr)


def parametric_var(vol: Column, alpha: float, mu: Column | float = 0.0) -> Column:
    """One-day Gaussian value at risk, as a positive loss."""
    return -(F.lit(mu) if isinstance(mu, float) else mu) - normal_quantile(alpha) * vol
