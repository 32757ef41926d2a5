"""Tail probabilities: as column expressions where a closed form exists, as scalars elsewhere."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_sf_even(x: Column, dof: int) -> Column:
    """Upper tail of chi-square with an even number of degrees of freedom, as a column."""
    if dof <= 0 or dof % 2:
        raise ValueError("the closed form needs an even number of degrees of freedom")
    h = x / 2
    total = F.lit(0.0)
    for i in range(dof // 2):
        total = total + F.pow(h, F.lit(i)) / math.factorial(i)
    return F.exp(-h) * total


def chi2_sf(x: float, dof: int) -> float:
    if x <= 0:
        return 1.0
    h = x / 2
    if dof % 2 == 0:
        return math.exp(-h) * math.fsum(h**i / math.factorial(i) for i in range(dof // 2))
    tail = math.fsum(math.exp(-h + (i + 0.5) * math.log(h) - math.lgamma(i + 1.5)) for i in range((dof - 1) // 2))
    return math.erfc(math.sqrt(h)) + tail


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def norm_isf(p: float) -> float:
    return -NormalDist().inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def t_two_sided(t: float, dof: float) -> float:
    a, b, x = dof / 2, 0.5, dof / (dof + t * t)
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b
