"""Scalar functions that Spark lacks or gets wrong, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Hart's rational form of the normal tail, as given by West (2005).
HART_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BELOW = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SQRT_2PI = math.sqrt(2 * math.pi)


def asinh(x: Column) -> Column:
    """Odd in x: Spark's own cancels for large negative values."""
    return F.signum(x) * F.asinh(F.abs(x))


def _horner(z: Column, terms: tuple[float, ...]) -> Column:
    out = F.lit(terms[0])
    for term in terms[1:]:
        out = out * z + F.lit(term)
    return out


def normal_cdf(x: Column) -> Column:
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    near = e * _horner(z, HART_TOP) / _horner(z, HART_BELOW)
    far = e / (SQRT_2PI * (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))))
    tail = F.when(z > 37, F.lit(0.0)).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / SQRT_2PI


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null, unlike with greatest and least alone."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def sum_skipping_nulls(*xs: Column) -> Column:
    """Null only if all are."""
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0))
    return F.when(F.coalesce(*xs).isNotNull(), total)


_GRID = float(1 << 20)


def steady_sum(x: Column) -> Column:
    """Sum of doubles that the order of the rows does not change; a plain sum's last digits do change with it.

    Multiples of 2^-20 add up exactly while their sum is below 2^33; what is left of each value is too small for its sum's
    rounding to be seen. Beyond these sizes it is no worse than a plain sum. Null, NaN and infinity count as in a plain sum.
    """
    low = F.abs(x) < 2.0**33
    coarse = F.rint(x * _GRID) / _GRID
    return F.sum(F.when(low, coarse).otherwise(x)) + F.coalesce(F.sum(F.when(low, x - coarse)), F.lit(0.0))


def round_half_away(x: Column, digits: int) -> Column:
    """Rounds as DuckDB does: half away from zero of x times 10^digits. Spark's own rounds the shortest decimal that stands for x."""
    scale = 10.0**digits
    y = F.abs(x) * scale
    part = y % 1.0
    near = F.signum(x) * (y - part + F.when(part >= 0.5, 1.0).otherwise(0.0)) / scale
    return F.when(y < 2.0**52, near).otherwise(x)


def student_t_tail(t: float, dof: float) -> float:
    """Two-sided p-value by the regularised incomplete beta function (continued fraction)."""
    if dof <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 400):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + top * d, 1 + top / c
                d, c = 1 / (d if abs(d) > 1e-300 else 1e-300), c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
