"""Operators on a few literal rows."""

import pytest
from pyspark.sql import functions as F

from quarterline.functions import identities
from quarterline.operators import origins, panels, producers, responses, scoring
from quarterline.sources import configs, forecasts


def test_parse_response(spark):
    texts = [
        ("a", "Here is what I expect:\nQ3: xintq=7.25, dltisq=0.5\nQ12: xintq=8"), ("b", "Q2: xintq=9,876.5, dltisq=4"), ("c", "Q2: xintq=4,000,123.9, dltisq=4"),
        ("d", "Q2: xintq=9,870e4, dltisq=4"), ("e", "so\nQ5: xintq=-0.75, dltisq=2e2, spiq=n/a\nthat is all"), ("f", ""), ("g", None),
    ]
    got = {tuple(r) for r in responses.parse(spark.createDataFrame(texts, "custom_id string, completion string")).collect()}
    assert got == {("a", 3, "xintq", 7.25), ("a", 3, "dltisq", 0.5), ("a", 12, "xintq", 8.0), ("b", 2, "dltisq", 4.0), ("c", 2, "dltisq", 4.0), ("d", 2, "dltisq", 4.0), ("e", 5, "xintq", -0.75), ("e", 5, "dltisq", 200.0)}


def test_fingerprint_ignores_order_and_types(spark):
    a = spark.createDataFrame([("001004", "2010-03-31", 4), ("000007", "2011-06-30", 8)], "firm string, d string, h int")
    b = spark.createDataFrame([(7, "2011-06-30 00:00:00", "8", 1), (1004, "2010-03-31 00:00:00", "4", 2)], "firm int, d string, h string, extra int").withColumn("d", F.to_timestamp("d"))
    assert responses.fingerprint(a, "firm", "d", "h").first() == responses.fingerprint(b, "firm", "d", "h").first()


def test_ids_are_numbers_only_if_all_are(spark):
    assert panels.canonical_ids(spark.createDataFrame([("0012",), ("7",)], "f string"), "f").schema["f"].dataType.simpleString() == "bigint"
    assert panels.canonical_ids(spark.createDataFrame([("0012",), ("F1",)], "f string"), "f").schema["f"].dataType.simpleString() == "string"


def test_blocks_are_consecutive_and_repeatable(spark):
    rows = [(firm, q) for firm in range(40, 66) for q in range(3, 15)] + [(70, q) for q in [*range(7), *range(30, 34)]] + [(71, q) for q in (4, 5, 6)]
    pool = spark.createDataFrame(rows, "firm_id int, qoff int")
    one = sorted(tuple(r) for r in origins.block_sample(pool, 8, 4, 1).collect())
    assert one == sorted(tuple(r) for r in origins.block_sample(pool.orderBy(F.rand(3)), 8, 4, 1).collect())
    assert one != sorted(tuple(r) for r in origins.block_sample(pool, 8, 4, 2).collect())
    for firm in {f for f, _ in one}:
        quarters = [q for f, q in one if f == firm]
        assert len(quarters) == 4 and quarters == list(range(quarters[0], quarters[0] + 4))
    with pytest.raises(ValueError):
        origins.block_sample(pool, 2, 13, 1)


def test_runs_split_at_gaps(spark):
    pool = spark.createDataFrame([(1, q) for q in (1, 2, 3, 7, 8)], "firm_id int, qoff int")
    got = {(r.qoff, r.run_start, r.run_idx, r.run_size) for r in origins.runs(pool).collect()}
    assert got == {(1, 1, 0, 3), (2, 1, 1, 3), (3, 1, 2, 3), (7, 7, 0, 2), (8, 7, 1, 2)}


def test_nearest_takes_the_earlier_on_a_tie(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 100)], "feature string, qoff int")
    stats = spark.createDataFrame([("a", 3, 1.0, 0.1, 1.0), ("a", 7, 1.0, 0.2, 1.0)], "feature string, qoff int, k double, mu double, sigma double")
    assert {(r.qoff, r.stat_q) for r in origins.nearest(rows, stats).collect()} == {(5, 3), (100, 7)}


def test_missing_model_is_an_error(spark):
    rows = spark.createDataFrame([("a",)], "id string")
    scoring.check_models(rows, {"a"})
    scoring.check_models(rows, {"a", "b"}, allow_missing=True)
    with pytest.raises(ValueError):
        scoring.check_models(rows, {"a", "b"})


def test_derive_and_strict(spark):
    row = spark.createDataFrame([(10.0, 4.0, None)], "revtq double, cogsq double, xsgaq double")
    loose, strict = identities.derive(row).first(), identities.derive(row, strict=True).first()
    assert (loose.gpq, loose.oibdpq, loose.niq) == (6.0, 6.0, 6.0)
    assert (strict.gpq, strict.oibdpq, strict.niq) == (6.0, None, None)


def test_derived_items_satisfy_the_identities(spark):
    names = sorted({t[1:] for terms in identities.DERIVED.values() for t in terms.split()} - set(identities.DERIVED))
    row = spark.createDataFrame([(1, *[float(3 * k % 17 + 1) for k in range(len(names))])], "firm_id int, " + ", ".join(f"{n} double" for n in names))
    found = identities.residuals(identities.derive(row), ["firm_id"], identities.IDENTITIES).collect()
    assert len(found) == len(identities.IDENTITIES) - 1 and all(abs(r.residual) < 1e-9 for r in found if r.identity != "accounting_equation")


def test_reconciled_rows_satisfy_the_identities(spark):
    row = spark.createDataFrame([(1, 10.0, 3.0, 2.0, 1.0, 2.0, 4.0)], "k int, a double, b double, c double, v_a double, v_b double, v_c double")
    one = identities.reconcile(row, ["k"], [(1.0, "a"), (-1.0, "b"), (-1.0, "c")]).first()
    many = identities.reconcile_many(row, ["k"], ["a", "b", "c"], ["+a_0 -b_0 -c_0"]).first()
    assert one.a - one.b - one.c == pytest.approx(0, abs=1e-12)
    assert (many.a, many.b, many.c) == pytest.approx((one.a, one.b, one.c))


def test_terms():
    assert identities.parse_term("-atq_0") == (-1.0, "atq", 0)
    assert identities.parse_term("+xsgaq_ex_rd_-1") == (1.0, "xsgaq_ex_rd", -1)
    with pytest.raises(ValueError):
        identities.parse_term("atq_0")


def test_forecast_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("F1", "net", 1, 1.5, "x")], "firm_id string, target string, forecast_horizon int, prediction double, extra string")
    path = str(tmp_path / "llama__v2__core__3__test__predictions.parquet")
    assert forecasts.write(rows, path) and not forecasts.write(rows.limit(0), str(tmp_path / "none.parquet"))
    back = forecasts.read_forecasts(spark, str(tmp_path)).first()
    assert (back.model, back.feature_set, back.split, back.seed, back.prediction) == ("llama__v2", "core", "test", 3, 1.5)


def test_cache_rebuilds_when_its_sources_change(spark, tmp_path):
    cache, built = forecasts.Cache(spark, str(tmp_path / "c")), []

    def build(n):
        return lambda: built.append(n) or spark.range(n)

    assert cache.get({"v": 1}, build(3)).count() == 3 and cache.get({"v": 1}, build(4)).count() == 3 and cache.get({"v": 2}, build(5)).count() == 5
    assert built == [3, 5]


def test_configs():
    sets = {"a": {"columns": ["x"], "include_sets": ["b"]}, "b": {"columns": ["y", "x"]}, "loop": {"include_sets": ["loop"]}}
    assert configs.collect(sets, "a", "columns") == ["y", "x"]
    with pytest.raises(ValueError):
        configs.collect(sets, "loop", "columns")
    assert configs.targets("all", ["p", "q"]) == ["p", "q"] and configs.as_list("[1, 2]") == [1, 2] and configs.as_list("a, b") == ["a", "b"]
    with pytest.raises(ValueError):
        configs.targets("z", ["p"])
    assert configs.horizon_at(7, 4, 4, 3, 20) == 12
    with pytest.raises(ValueError):
        configs.guard_resume({"k": 1}, {"k": 2})
    with pytest.raises(ValueError):
        producers.produce("nowhere")
