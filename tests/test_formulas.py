"""Closed forms, quadrature and limits of the scalar functions."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from quarterline.functions import density, maths, quantiles, regular


def values(spark, rows, columns, *expressions):
    return [tuple(r) for r in spark.createDataFrame(rows, columns).select(*expressions).collect()]


def test_normal_cdf_is_exact_to_the_last_digits(spark):
    xs = [-40.0, -9.0, -3.2, -1.0, -1e-9, 0.0, 0.5, 2.5, 7.2, 9.0, 40.0]
    got = values(spark, [(x,) for x in xs], "x double", maths.normal_cdf(F.col("x")))
    for x, (p,) in zip(xs, got):
        assert p == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=3e-16)


def test_asinh_keeps_large_negative_values(spark):
    got = values(spark, [(-1e9,), (-1e5,), (3.0,)], "x double", maths.asinh(F.col("x")))
    assert [g[0] for g in got] == pytest.approx([math.asinh(-1e9), math.asinh(-1e5), math.asinh(3.0)], rel=1e-14)


def test_crps_at_zero_residual(spark):
    (g, l), = values(spark, [(0.0, 2.0)], "r double, s double", density.crps(F.col("r"), F.col("s"), "gaussian"), density.crps(F.col("r"), F.col("s"), "laplace"))
    assert g == pytest.approx(2 * (math.sqrt(2) - 1) / math.sqrt(math.pi))
    assert l == pytest.approx(0.25 * 2 / math.sqrt(2))


def test_student_t_needs_its_degrees_of_freedom():
    with pytest.raises(ValueError):
        density.nll(None, None, "student_t")


def integral(cdf, actual, low=-60.0, high=60.0, n=120_000):
    step = (high - low) / n
    return sum((cdf(x := low + (k + 0.5) * step) - (x >= actual)) ** 2 for k in range(n)) * step


@pytest.mark.parametrize("family", ["gaussian", "laplace"])
def test_mixture_crps_is_the_integral(spark, family):
    rs, ss = [0.7, -1.1, 0.2], [1.0, 0.5, 2.0]
    row = [tuple(rs + ss)]
    names = "r1 double, r2 double, r3 double, s1 double, s2 double, s3 double"
    (got,), = values(spark, row, names, density.mixture_crps([F.col(f"r{k}") for k in (1, 2, 3)], [F.col(f"s{k}") for k in (1, 2, 3)], family))

    def one(x, s):
        if family == "gaussian":
            return NormalDist(0, s).cdf(x)
        z = x * math.sqrt(2) / s
        return 0.5 * math.exp(z) if z <= 0 else 1 - 0.5 * math.exp(-z)

    assert got == pytest.approx(integral(lambda x: sum(one(x - r, s) for r, s in zip(rs, ss)) / 3, 0.0), rel=2e-5)


def test_a_mixture_of_one_is_the_family_itself(spark):
    for family in ("gaussian", "laplace"):
        (a, b), = values(spark, [(0.8, 1.3)], "r double, s double", density.mixture_crps([F.col("r")], [F.col("s")], family), density.crps(F.col("r"), F.col("s"), family))
        assert a == pytest.approx(b, rel=1e-12)


def test_mixture_nll_of_equal_seeds_is_that_of_one(spark):
    (got,), = values(spark, [([1.5, 1.5, 1.5],)], "x array<double>", density.mixture_nll(F.col("x")))
    assert got == pytest.approx(1.5)


def test_laplace_difference_is_stable_near_equal_scales(spark):
    for gap in (1e-2, 1e-6, 1e-12, 0.0):
        (got,), = values(spark, [(0.7, 1.0, 1.0 + gap)], "m double, a double, b double", density.absolute_laplace_difference(F.col("m"), F.col("a"), F.col("b")))
        assert got == pytest.approx(0.7 + math.exp(-0.7) * (3 + 0.7) / 2, rel=2 * gap + 1e-12)


def test_quantile_crps_and_pit(spark):
    knots = [NormalDist(0, 1).inv_cdf(t) for t in quantiles.LEVELS]
    ys = [-3.0, -0.4, 0.0, knots[3], 2.9]
    got = values(spark, [(knots, y) for y in ys], "k array<double>, y double", quantiles.crps(F.col("k"), F.col("y")), quantiles.pit(F.col("k"), F.col("y")))

    def quantile(t):
        if t <= quantiles.LEVELS[0]:
            return knots[0]
        if t >= quantiles.LEVELS[-1]:
            return knots[-1]
        k = max(i for i, x in enumerate(quantiles.LEVELS) if x <= t)
        a, b = quantiles.LEVELS[k], quantiles.LEVELS[k + 1]
        return knots[k] + (knots[k + 1] - knots[k]) * (t - a) / (b - a)

    for y, (crps, pit) in zip(ys, got):
        n = 40_000
        want = sum(2 * ((y < (q := quantile(t := (k + 0.5) / n))) - t) * (q - y) for k in range(n)) / n
        assert crps == pytest.approx(want, abs=2e-5)
    assert [g[1] for g in got][0] == 0.01 and got[4][1] == 0.99 and got[3][1] == pytest.approx(quantiles.LEVELS[3])


def test_quantile_columns():
    assert quantiles.parse_columns(["q_0.5", "x", "q_0.1"]) == [(0.1, "q_0.1"), (0.5, "q_0.5")]
    for bad in ("q_a", "q_1.5", "q_0"):
        with pytest.raises(ValueError):
            quantiles.parse_columns([bad])


def test_p_values():
    assert maths.student_t_tail(2.0, 10) == pytest.approx(0.07338803477074037, rel=1e-10)
    assert maths.student_t_tail(0.0, 5) == pytest.approx(1.0)
    assert maths.student_t_tail(-2.570581835636314, 5) == pytest.approx(0.05, rel=1e-9)


def test_null_and_infinite_inputs(spark):
    rows = [(None,), (float("nan"),), (float("inf"),), (2.0,)]
    got = values(spark, rows, "x double", maths.finite(F.col("x")), maths.clip(maths.finite(F.col("x")), -1.0, 1.0))
    assert got == [(None, None), (None, None), (None, None), (2.0, 1.0)]
    (label,), = values(spark, [(5.0, 0.0)], "v double, s double", regular.label(F.col("v"), F.col("s"), F.lit(1.0), F.lit(0.0), F.lit(1.0)))
    assert label is None
