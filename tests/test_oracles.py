"""Queries against their SQL on the small tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarterline.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = "score_naive_global j1_unmatched j2_common_sample a1_rollup_levels a7_density a8_seed_mixture_nll a12_calibration_by_horizon a14_saturation_split m20_ensemble w11_newey_west f22_small_sample_t w10_calendar_features w2_ytd_to_quarter w6_run_positions m12_origin_pool_span o3_firm_blocks j7_nearest_stats j11_range_join j13_future_grid j14_identity_complete f26_identity_residuals a27_kurtosis_grid m15_regularization_stats f28_parse_response m17_finish_origins p18_render_history a21_cost_rollup f31_usage s5_file_names t1_streaming_stats t3_streaming_archive t4_gap_sessions".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)[:10] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_every_name_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) > 140


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
