"""Sums that do not hang on the order of the rows, and rounding as in the SQL."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from quarterline.functions import maths
from quarterline.operators import scoring


def test_scores_do_not_change_with_the_order_of_the_rows(spark):
    rng = random.Random(3)
    # Thousandths whose mean absolute value ends in a 5 at the seventh place, as in a1_rollup_levels.
    rows = [(k, k % 24, "qty", 2, "m", rng.randrange(-400, 400) / 1000, rng.randrange(100, 900) / 1000, 0.25, True) for k in range(1600)]
    schema = "firm_id long, qoff int, target string, horizon int, id string, r double, actual double, baseline double, common boolean"
    seen = set()
    for k in range(8):
        rng.shuffle(rows)
        out = scoring.point_scores(spark.createDataFrame(rows, schema).repartition(k + 1)).where("level = 'global'").first()
        seen.add((out.sum_y, out.sum_y2, out.sum_r2, out.sum_abs, out.r2, out.mae))
    y = [a - b for *_, a, b, _ in rows]
    assert len(seen) == 1
    assert seen.pop()[:4] == (math.fsum(y), math.fsum(v * v for v in y), math.fsum(r[5] * r[5] for r in rows), math.fsum(abs(r[5]) for r in rows))


def test_odd_values_count_as_in_a_plain_sum(spark):
    inf, nan = math.inf, math.nan
    for values in ([None, None], [], [None, 0.1, -0.0], [1e300, 0.1], [inf, 0.5], [inf, -inf], [nan, 1.0], [1e12, 0.25, 2.0**33], [5e-324, 1e-9]):
        got, want = spark.createDataFrame([(v,) for v in values], "x double").repartition(1).select(maths.steady_sum(F.col("x")), F.sum("x")).first()
        assert repr(got) == repr(want), values


def test_rounding_equals_the_sql(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, math.nan, math.inf, -math.inf, 1e300, -1e-9, 4503599627.370497]
    for _ in range(3000):
        t = (rng.randrange(-2_000_000, 2_000_000) + 0.5) / 1e6
        xs += [t, math.nextafter(t, 0), math.nextafter(t, 9)]
    got = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(maths.round_half_away(F.col("x"), 6).alias("y")).collect()]
    want = [v for (v,) in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [xs]).fetchall()]
    assert [g for g, w in zip(got, want) if g == w or g != g and w != w] and not [(x, g, w) for x, g, w in zip(xs, got, want) if g != w and (g == g or w == w)]
    assert spark.range(1).select(maths.round_half_away(F.lit(None).cast("double"), 6)).first()[0] is None
