"""Forecasts given as quantile knots: an array of values at fixed levels."""

from __future__ import annotations

import re
from statistics import NormalDist

from pyspark.sql import Column, functions as F

# The levels of a quantile forecast.
LEVELS = (0.01, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99)


def parse_columns(columns: list[str]) -> list[tuple[float, str]]:
    """(level, column) of the columns q_<level>, by level; malformed levels and those outside (0, 1) are errors."""
    out = []
    for name in columns:
        if name.startswith("q_"):
            if not re.fullmatch(r"q_\d*\.?\d+", name) or not 0 < float(name[2:]) < 1:
                raise ValueError(f"not a quantile column: {name}")
            out.append((float(name[2:]), name))
    return sorted(out)


def mean_weights(levels: tuple[float, ...] = LEVELS) -> list[float]:
    n = len(levels)
    ends = [0.0, *levels, 1.0]
    weights = [(ends[k + 2] - ends[k]) / 2 for k in range(n)]
    weights[0] += levels[0] / 2
    weights[-1] += (1 - levels[-1]) / 2
    total = sum(weights)
    return [w / total for w in weights]


def mean(knots: Column, levels: tuple[float, ...] = LEVELS) -> Column:
    weights = mean_weights(levels)
    return sum((F.get(knots, F.lit(k)) * w for k, w in enumerate(weights)), F.lit(0.0))


def moment_sigma(knots: Column, levels: tuple[float, ...] = LEVELS) -> Column:
    m = mean(knots, levels)
    return F.sqrt(F.greatest(mean(F.transform(knots, lambda z: z * z), levels) - m * m, F.lit(0.0)))


def sigma_from_pair(low: Column, high: Column, p_low: float, p_high: float) -> Column:
    z = NormalDist().inv_cdf
    return (high - low) / (z(p_high) - z(p_low))


def crps(knots: Column, y: Column, levels: tuple[float, ...] = LEVELS) -> Column:
    """Exact integral of twice the pinball loss of the piecewise linear quantile function, flat beyond the ends."""
    n = len(levels)
    ends = [0.0, *levels, 1.0]
    # One lambda over a literal array of segments keeps the generated code small.
    segments = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(max(k - 1, 0)).alias("lo"), F.lit(min(k, n - 1)).alias("hi")) for k, (a, b) in enumerate(zip(ends, ends[1:]))])

    def line(s: Column) -> Column:
        slope = (F.get(knots, s["hi"]) - F.get(knots, s["lo"])) / (s["b"] - s["a"])
        alpha = (y - F.get(knots, s["lo"])) + slope * s["a"]
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), alpha.alias("alpha"), (-slope).alias("beta"))

    def above(s: Column, t: Column) -> Column:
        return s["alpha"] * t * t + s["beta"] * t * t * t * (2 / 3)

    def below(s: Column, t: Column) -> Column:
        return above(s, t) - t * (2 * s["alpha"] + s["beta"] * t)

    def loss(s: Column) -> Column:
        left, right = s["alpha"] + s["beta"] * s["a"], s["alpha"] + s["beta"] * s["b"]
        cross = F.greatest(s["a"], F.least(s["b"], -s["alpha"] / F.when(s["beta"] != 0, s["beta"])))
        return (
            F.when((left >= 0) & (right >= 0), above(s, s["b"]) - above(s, s["a"]))
            .when((left < 0) & (right < 0), below(s, s["b"]) - below(s, s["a"]))
            .when(left >= 0, above(s, cross) - above(s, s["a"]) + below(s, s["b"]) - below(s, cross))
            .otherwise(below(s, cross) - below(s, s["a"]) + above(s, s["b"]) - above(s, cross))
        )

    return F.aggregate(F.transform(F.transform(segments, line), loss), F.lit(0.0), lambda acc, x: acc + x)


def pit(knots: Column, y: Column, levels: tuple[float, ...] = LEVELS) -> Column:
    """Level of y: linear between knots, the middle of tied levels, the end levels outside."""
    taus = F.array(*[F.lit(float(t)) for t in levels])
    lo, hi = F.size(F.filter(knots, lambda q: q < y)), F.size(F.filter(knots, lambda q: q <= y))
    n = len(levels)
    t = lambda i: F.get(taus, i)
    q = lambda i: F.get(knots, i)
    between = t(lo - 1) + (t(lo) - t(lo - 1)) * (y - q(lo - 1)) / F.when(q(lo) != q(lo - 1), q(lo) - q(lo - 1))
    return F.when(hi > lo, 0.5 * (t(lo) + t(hi - 1))).when(lo == 0, F.lit(levels[0])).when(lo == n, F.lit(levels[-1])).otherwise(between)
