"""Scores of predictive densities: likelihood, CRPS, PIT. r is prediction minus actual, s the standard deviation."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .maths import normal_cdf, normal_pdf

FAMILIES = ("gaussian", "laplace", "student_t")


def nll(r: Column, s: Column, family: str, dof: float | None = None) -> Column:
    if family == "gaussian":
        return 0.5 * math.log(2 * math.pi) + F.log(s) + r * r / (2 * s * s)
    if family == "laplace":
        b = s / math.sqrt(2)
        return F.log(2 * b) + F.abs(r) / b
    if family == "student_t":
        if dof is None:
            raise ValueError("student_t needs its degrees of freedom")
        c = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi)
        return F.lit(-c) + F.log(s) + (dof + 1) / 2 * F.log1p(r * r / (dof * s * s))
    raise ValueError(f"unknown family {family}")


def crps(r: Column, s: Column, family: str) -> Column:
    if family == "gaussian":
        w = r / s
        return s * (w * (2 * normal_cdf(w) - 1) + 2 * normal_pdf(w) - 1 / math.sqrt(math.pi))
    if family == "laplace":
        b = s / math.sqrt(2)
        z = F.abs(r) / b
        return b * (z + F.exp(-z) - 0.75)
    if family == "student_t":
        return F.lit(None).cast("double")
    raise ValueError(f"unknown family {family}")


def cdf_at_actual(r: Column, s: Column, family: str) -> Column:
    """The density's distribution function at the actual value."""
    if family == "gaussian":
        return normal_cdf(-r / s)
    x = -r * math.sqrt(2) / s
    return F.when(x <= 0, 0.5 * F.exp(x)).otherwise(1 - 0.5 * F.exp(-x))


def floored(s: Column, floor: float = 1e-4) -> Column:
    """Sigma raised to the floor; a floor of 0 drops what is not positive. Null stays null."""
    return F.when(s.isNotNull(), F.greatest(s, F.lit(floor))) if floor > 0 else F.when(s > 0, s)


def absolute_normal(m: Column, s: Column) -> Column:
    """E|X| of a normal variable."""
    return m * (2 * normal_cdf(m / s) - 1) + 2 * s * normal_pdf(m / s)


def absolute_laplace_difference(m: Column, b1: Column, b2: Column) -> Column:
    """E|X1 - X2| of Laplace variables whose locations differ by m; stable where the scales are close."""
    a, c, big = F.greatest(b1, b2), F.least(b1, b2), F.abs(m)
    t = big * (a - c) / (a * c)
    shrink = F.when(t == 0, F.lit(1.0)).otherwise(-F.expm1(-t) / t)
    return big + F.exp(-big / a) * (a * (a * a + a * c + c * c) + c * c * big * shrink) / (a * (a + c))


def mixture_crps(rs: list[Column], ss: list[Column], family: str) -> Column:
    """Exact CRPS of the equal mixture; the pairs are spelled out, so the expression stays in one projection."""
    k = len(rs)
    if family == "gaussian":
        own = [absolute_normal(r, s) for r, s in zip(rs, ss)]
        spread = [F.sqrt(s1 * s1 + s2 * s2) for s1 in ss for s2 in ss]
        between = [absolute_normal(r1 - r2, v) for (r1, r2), v in zip(((r1, r2) for r1 in rs for r2 in rs), spread)]
    elif family == "laplace":
        bs = [s / math.sqrt(2) for s in ss]
        own = [F.abs(r) + b * F.exp(-F.abs(r) / b) for r, b in zip(rs, bs)]
        between = [absolute_laplace_difference(r1 - r2, b1, b2) for r1, b1 in zip(rs, bs) for r2, b2 in zip(rs, bs)]
    else:
        raise ValueError("a mixture's CRPS is known for gaussian and laplace alone")
    return sum(own, F.lit(0.0)) / k - sum(between, F.lit(0.0)) / (2 * k * k)


def mixture_nll(each: Column) -> Column:
    """ln K - logsumexp(-nll) of an array of K values."""
    least = F.array_min(each)
    total = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + F.exp(least - x))
    return F.log(F.size(each).cast("double")) + least - F.log(total)
