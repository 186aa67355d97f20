"""Splits, shared parameters, stored models, places, fingerprints and the streams' result tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarterline.operators import origins, panels, producers, significance
from quarterline.sources import forecasts
from quarterline.sources.shared import fresh_folder
from quarterline.streaming import streams


def test_splits_take_the_first_that_fits(spark):
    rows = spark.createDataFrame([(q,) for q in (None, 1, 5, 6, 9, 20)], "qoff int")
    got = panels.splits(rows, "qoff", {"train": (None, 5), "val": (5, 8), "test": (9, 10)}).collect()
    assert sorted((r.qoff, r.split) for r in got) == [(1, "train"), (5, "train"), (6, "val"), (9, "test")]


def test_places_number_all_rows_in_order(spark):
    rows = spark.createDataFrame([((k * 37) % 101, k) for k in range(500)], "a int, b int").repartition(5)
    got = {(r.a, r.b): r.place for r in origins.places(rows, [F.desc("a"), F.asc("b")]).collect()}
    want = sorted(got, key=lambda x: (-x[0], x[1]))
    assert [got[x] for x in want] == list(range(1, 501))
    assert origins.places(rows.where("false"), [F.asc("a"), F.asc("b")]).count() == 0


def test_fingerprints_see_every_value(spark):
    rows = [(1, 2.0, "x", datetime.date(2020, 1, 1)), (2, None, "", None)]
    frame = lambda rows: spark.createDataFrame(rows, "k int, v double, s string, d date")
    same = forecasts.fingerprint(frame(rows)).first()[0]
    assert same == forecasts.fingerprint(frame(rows[::-1]).select("d", "s", "v", "k")).first()[0]
    for changed in ([(1, 9.0, *rows[0][2:]), rows[1]], [rows[0], (2, None, None, None)], [*rows, rows[0]], [rows[0], (2, 0.0, "", None)]):
        assert forecasts.fingerprint(frame(changed)).first()[0] != same
    assert forecasts.fingerprint(frame(rows), ["k"]).first() == forecasts.fingerprint(frame([(1, 9.0, *rows[0][2:]), rows[1]]), ["k"]).first()


def test_a_broken_store_is_no_empty_cache(spark):
    cache = forecasts.Cache(spark, fresh_folder(spark, "cache"))
    built = []
    build = lambda: built.append(1) or spark.range(3)
    assert cache.get({"a": 1}, build).count() == cache.get({"a": 1}, build).count() == 3 and len(built) == 1
    broken = forecasts.Cache(spark, "nosuchscheme://x/y")
    with pytest.raises(Exception):
        broken.get({"a": 1}, build)
    assert len(built) == 1


def test_a_stored_model_predicts_the_same(spark):
    rows = spark.createDataFrame([(float(k), 3.0 * k + 1, "train" if k % 3 else "val", k % 2) for k in range(60)] + [(None, 1.0, "val", 0)], "x double, y double, split string, horizon int")
    best, errors = producers.shared_strength(rows, "horizon", ["x"], "y", [0.0, 50.0])
    assert best == 0.0 and errors[0.0] < 1e-6 < errors[50.0]
    path = fresh_folder(spark, "model")
    for model in (producers.fit_linear(rows, rows, ["x"], "y", {})[0], producers.fit_trees(rows, ["x"], "y", maxIter=2, maxDepth=2)):
        producers.save(model, path, {"features": ["x"]})
        again, made_of = producers.load(spark, path)
        a, b = (sorted(map(tuple, producers.predict(m, rows, made_of["features"], "p").collect())) for m in (model, again))
        assert a == b and len(a) == 60


def test_differentials_need_the_reference_in_the_cell(spark):
    rows = [("naive", 1, 5, "net", 1, 2.0, True), ("m", 1, 5, "net", 1, 1.0, True), ("m", 2, 5, "net", 1, 4.0, True), ("m", 1, 6, "net", 1, 1.0, False), ("naive", 1, 6, "net", 1, 3.0, False)]
    scored = spark.createDataFrame(rows, "id string, firm_id int, qoff int, target string, horizon int, r double, common boolean")
    got = {tuple(r) for r in significance.differentials(scored, "naive").select("id", "horizon", "qoff", "d_sq", "d_abs", "n").collect()}
    assert got == {("m", 1, 5, 3.0, 1.0, 1), ("m", 0, 5, 3.0, 1.0, 1)}


def test_streams_drain_into_files(spark):
    path, checkpoint = fresh_folder(spark, "in"), fresh_folder(spark, "stream")
    make = lambda first, n: spark.range(first, first + n).select(F.col("id"), (F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") * 60 + 1_000_000_000).alias("ts"))
    make(0, 10).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema("id long, k long, ts timestamp").parquet(path)
    counts = lambda df: {r.k: r.n for r in df.groupBy("k").agg(F.count("*").alias("n")).collect()}
    once = lambda: streams.drain(streams.once_each(stream(), "id", "ts", "1 day"), checkpoint, "append")
    assert counts(once()) == {0: 5, 1: 5}
    make(5, 10).write.mode("append").parquet(path)
    assert counts(once()) == {0: 8, 1: 7}
    assert counts(once()) == {0: 8, 1: 7}
    sessions = streams.drain(streams.gap_runs(stream(), "k", "ts", "5 minutes", "1 hour"), fresh_folder(spark, "stream"))
    assert {(r.k, r.n) for r in sessions.collect()} == {(0, 10), (1, 10)}
