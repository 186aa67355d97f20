"""Queries of sources, id maps, kernels and producers that the other modules leave."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import density, quantiles, schedules
from ..operators import panels, producers, scoring, significance
from ..sources import forecasts as files, maps, views
from ..sources.shared import fresh_folder as folder
from ..sources.views import FORECASTS, PANEL, SPARSE, TRUTH, with_views
from .registry import query
from .scoring_queries import ALL, CELLS, DENSE, DIFFS, KNOTS, NW, P_VALUES, PIT, mixture, quantile_cells, rounded, sample, tests


@query("s1_raw_panel_reader", "SELECT count(*) AS n, count(DISTINCT n_regionkey) AS regions FROM nation")
def s1_raw_panel_reader(spark, sf_dir):
    path = f"{folder(spark, 'raw')}.csv"
    views.table(spark, sf_dir, "nation").write.csv(path, header=True)
    a, b = files.read_panel(spark, path), files.read_panel(spark, f"{sf_dir}/nation.parquet")
    return a.select("n_nationkey", "n_regionkey").intersect(b.select("n_nationkey", "n_regionkey")).agg(F.count("*").alias("n"), F.count_distinct("n_regionkey").alias("regions"))


@query("s8_density_sidecars", "SELECT * FROM (VALUES ('a', 'laplace', NULL::DOUBLE), ('b', 'student_t', 6.0::DOUBLE), ('c', 'gaussian', NULL)) v(model, family, dof)")
def s8_density_sidecars(spark, sf_dir):
    base = folder(spark, "sidecars")
    for name, text in (("a", '{"family": "laplace"}'), ("b", '{"family": "student_t", "df": 6.0}'), ("c", "{broken")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{base}/{name}.nll.json")
    return files.read_sidecars(spark, [f"{base}/{name}.nll.json" for name in "abc"])


@query("s14_atomic_writer", with_views("SELECT CAST(horizon AS INTEGER) AS forecast_horizon, count(*) AS n FROM forecasts WHERE model = 'drift' GROUP BY 1", PANEL, TRUTH, FORECASTS))
def s14_atomic_writer(spark, sf_dir):
    path = f"{folder(spark, 'sink')}/drift__core__test__predictions.parquet"
    files.write(views.forecasts(spark, sf_dir).where("model = 'drift'").withColumnRenamed("horizon", "forecast_horizon"), path)
    return spark.read.parquet(path).groupBy("forecast_horizon").agg(F.count("*").alias("n"))


@query("s17_response_archive", "SELECT role, count(*) AS n, count(DISTINCT left(sha256(text), 16)) AS texts FROM conversations GROUP BY 1")
def s17_response_archive(spark, sf_dir):
    path = folder(spark, "archive")
    rows = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.substring(F.sha2("text", 256), 1, 16).alias("text_sha"))
    for part in (0, 1):  # a run, and what a later one appends
        rows.where(F.col("conv_id") % 2 == part).write.mode("append").json(path)
    back = spark.read.schema("conv_id long, turn long, role string, text_sha string").json(path)
    return back.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("text_sha").alias("texts"))


@query("s22_id_maps", "SELECT r_name, count(*) AS n_nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def s22_id_maps(spark, sf_dir):
    nation, region = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "region")
    firms = maps.id_map(nation.union(nation), "n_nationkey", "n_name")
    names = maps.id_map(region, "r_regionkey", "r_name").withColumnRenamed("id", "n_regionkey")
    both = firms.join(nation.select(F.col("n_nationkey").alias("id"), "n_regionkey"), "id").join(F.broadcast(names.select("n_regionkey", F.col("name").alias("r_name"))), "n_regionkey")
    return both.groupBy("r_name").agg(F.count("*").alias("n_nations"))


@query("s24_seed_manifest", "SELECT * FROM (VALUES ('a__core__test__predictions.parquet', 3, 'laplace'), ('b__core__test__predictions.parquet', 5, 'gaussian')) v(file_name, seed, family)")
def s24_seed_manifest(spark, sf_dir):
    path = folder(spark, "manifest")
    lines = ["filename\tseed", "a__core__test__predictions.parquet\t3", "b__core__test__predictions.parquet\t5"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    families = spark.createDataFrame([("a", "laplace")], "model string, family string")
    return maps.seed_manifest(spark, path, families)


@query("s26_cache", "SELECT 2 AS builds, count(*) AS n FROM nation")
def s26_cache(spark, sf_dir):
    cache, built = files.Cache(spark, folder(spark, "cache")), []

    def build() -> DataFrame:
        built.append(1)
        return views.table(spark, sf_dir, "nation")

    for manifest in ({"v": 1}, {"v": 1}, {"v": 2}):
        rows = cache.get(manifest, build)
    return rows.agg(F.lit(len(built)).alias("builds"), F.count("*").alias("n"))


@query("p4_label_discovery", "SELECT * FROM (VALUES ('net', 1), ('net', 2), ('net', 3), ('net', 4)) v(target, horizon)")
def p4_label_discovery(spark, sf_dir):
    wide = panels.features(views.panel(spark, sf_dir), "net").withColumn("other_t1", F.lit(1))
    return spark.createDataFrame(panels.label_columns(wide.columns), "target string, horizon int")


@query("p21_quantile_columns", "SELECT * FROM (VALUES (0.05::DOUBLE, 'q_0.05'), (0.5::DOUBLE, 'q_0.5')) v(level, name)")
def p21_quantile_columns(spark, sf_dir):
    return spark.createDataFrame(quantiles.parse_columns(["firm_id", "q_0.5", "q_0.05"]), "level double, name string")


@query("p22_origin_preparation", with_views("""SELECT o.firm_id, o.qoff, count(CASE WHEN p.qoff <= o.qoff THEN 1 END) AS n_history, count(CASE WHEN p.qoff > o.qoff THEN 1 END) AS n_ahead,
 string_agg(CASE WHEN p.qoff <= o.qoff THEN CAST(p.n AS VARCHAR) END, ',' ORDER BY p.qoff) AS history
 FROM sparse o JOIN sparse p ON p.firm_id = o.firm_id AND p.qoff BETWEEN o.qoff - 7 AND o.qoff + 4 WHERE o.total > 0 GROUP BY 1, 2""", SPARSE))
def p22_origin_preparation(spark, sf_dir):
    from ..operators.origins import windows

    p = views.sparse_panel(spark, sf_dir)
    rows = windows(p.where("total > 0").select("firm_id", "qoff"), p.select("firm_id", "qoff", "n"), 8, 4)
    past = F.col("rel") <= 0
    cells = F.array_sort(F.collect_list(F.when(past, F.struct("rel", "n"))))
    return rows.groupBy("firm_id", "qoff").agg(F.count(F.when(past, 1)).alias("n_history"), F.count(F.when(~past, 1)).alias("n_ahead"), F.array_join(F.transform(cells, lambda c: c["n"].cast("string")), ",").alias("history"))


@query("f8_mixture_nll", with_views("""SELECT horizon, round(avg(m), 6) AS mixture_nll FROM (SELECT firm_id, qoff, target, horizon, ln(3.0::DOUBLE) + min(nll) - ln(sum(exp(lo - nll))) AS m
 FROM (SELECT *, min(nll) OVER (PARTITION BY firm_id, qoff, target, horizon) AS lo FROM dense WHERE model = 'ens') GROUP BY 1, 2, 3, 4 HAVING count(*) = 3) GROUP BY 1""", *ALL, DENSE))
def f8_mixture_nll(spark, sf_dir):
    out = scoring.seed_mixture_nll(sample(spark, sf_dir), "laplace", "ens", 3).where("level = 'by_horizon'")
    return rounded(out.select("horizon", "mixture_nll"), "mixture_nll")


@query("f9_moment_matching", with_views("SELECT horizon, round(avg(s), 6) AS sigma FROM (SELECT horizon, sqrt(avg(sigma * sigma) + var_pop(prediction)) AS s FROM forecasts WHERE model = 'ens' GROUP BY firm_id, qoff, target, horizon) GROUP BY 1", PANEL, TRUTH, FORECASTS))
def f9_moment_matching(spark, sf_dir):
    out = scoring.ensemble(views.forecasts(spark, sf_dir).where("model = 'ens'"))
    return rounded(out.groupBy("horizon").agg(F.avg("sigma").alias("sigma")), "sigma")


@query("f11_laplace_kernel", with_views("SELECT horizon, round(avg(abs(r) + sigma / sqrt(2.0::DOUBLE) * exp(-abs(r) / (sigma / sqrt(2.0::DOUBLE))) - 0.75::DOUBLE * sigma / sqrt(2.0::DOUBLE)), 6) AS crps FROM sample WHERE model = 'ens' AND seed = 1 AND r IS NOT NULL GROUP BY 1", *ALL))
def f11_laplace_kernel(spark, sf_dir):
    rows = sample(spark, sf_dir).where("model = 'ens' and seed = 1 and r is not null")
    return rounded(rows.groupBy("horizon").agg(F.avg(density.mixture_crps([F.col("r")], [F.col("sigma")], "laplace")).alias("crps")), "crps")


@query("f19_interval_coverage", with_views("SELECT target, count(CASE WHEN round(pit, 9) BETWEEN 0.25 AND 0.75 THEN 1 END) AS inside FROM cells GROUP BY 1", *ALL, CELLS))
def f19_interval_coverage(spark, sf_dir):
    from ..operators.calibration import covered

    return mixture(spark, sf_dir).groupBy("target").agg(F.count(F.when(covered(F.round("pit", 9), 0.5), 1)).alias("inside"))


@query("f21_newey_west_t", with_views("SELECT id, horizon, round(mean / nullif(sqrt(lrv / n_quarters), 0), 4) AS t FROM tests", *ALL, DIFFS, NW))
def f21_newey_west_t(spark, sf_dir):
    return rounded(tests(spark, sf_dir).select("id", "horizon", "t"), "t", digits=4)


@query("f23_markers", with_views("SELECT marker, count(*) AS n FROM marked GROUP BY 1", *ALL, DIFFS, NW, P_VALUES))
def f23_markers(spark, sf_dir):
    out = significance.with_p_values(significance.corrected(tests(spark, sf_dir), F.greatest("horizon", F.lit(1))))
    return out.groupBy("marker").agg(F.count("*").alias("n"))


@query("f36_schedules", f"SELECT CAST(e AS INTEGER) AS epoch, round(CASE WHEN e < 3 THEN (e + 1) / 3 ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos({math.pi!r}::DOUBLE * least(1, (e - 3) / 7))) END, 9) AS factor FROM range(0, 12) r(e)")
def f36_schedules(spark, sf_dir):
    epochs = spark.range(12).select(F.col("id").cast("int").alias("epoch"))
    return rounded(epochs.select("epoch", schedules.warmup_cosine(F.col("epoch"), 3, 10, 0.1).alias("factor")), "factor", digits=9)


@query("a26_coefficient_summary", "SELECT 4.0::DOUBLE AS l1, round(sqrt(6.0::DOUBLE), 6) AS l2, 2.0::DOUBLE AS largest, 1.0::DOUBLE AS mean, CAST(3 AS INTEGER) AS nonzero, 0.25::DOUBLE AS sparsity")
def a26_coefficient_summary(spark, sf_dir):
    rows = spark.createDataFrame([([1.0, -2.0, 0.0, 1.0],)], "coefficients array<double>")
    return rounded(rows.select(*[c.alias(n) for n, c in producers.coefficient_summary(F.col("coefficients")).items()]), "l2")


@query("u2_multi_split_union", with_views("SELECT count(*) AS n FROM (SELECT DISTINCT firm_id, qoff FROM sparse WHERE qoff < 118)", SPARSE))
def u2_multi_split_union(spark, sf_dir):
    p = views.sparse_panel(spark, sf_dir).select("firm_id", "qoff")
    parts = [p.where("qoff < 112").withColumn("split", F.lit(1)), p.where("qoff between 110 and 117").withColumn("split", F.lit(2))]
    return scoring.keep_first(parts[0].unionByName(parts[1]), ["firm_id", "qoff"], "split").agg(F.count("*").alias("n"))


@query("u6_map_equality", "SELECT 0 AS n_differences FROM region LIMIT 1")
def u6_map_equality(spark, sf_dir):
    region = views.table(spark, sf_dir, "region")
    return maps.differences(region, region.orderBy(F.desc("r_name"))).agg(F.count("*").cast("int").alias("n_differences"))


@query("m8_quantile_transform", with_views("SELECT horizon, round(avg(greatest(-2.5::DOUBLE, least(2.5::DOUBLE, k[11]))), 6) AS median, round(avg((k[19] - k[3]) / 2.563103131089201::DOUBLE), 6) AS sigma FROM q GROUP BY 1", *ALL[:3], KNOTS))
def m8_quantile_transform(spark, sf_dir):
    from .scoring_queries import quantile_forecasts

    rows = quantile_forecasts(spark, sf_dir).join(views.truth(spark, sf_dir), scoring.CELL).where("actual is not null").withColumn("knots", F.array_sort("knots"))
    out = rows.select("horizon", *[c.alias(n) for n, c in producers.from_quantiles(F.col("knots"), limit=2.5).items()])
    return rounded(out.groupBy("horizon").agg(F.avg("median").alias("median"), F.avg("sigma").alias("sigma")), "median", "sigma")


@query("m22_mixture_calibration", with_views("SELECT round(avg(crps), 6) AS crps, round(avg(pit), 6) AS mean_pit, round(avg(CASE WHEN round(pit, 9) BETWEEN 0.05 AND 0.95 THEN 1.0 ELSE 0.0 END), 6) AS cover_90 FROM cells", *ALL, CELLS))
def m22_mixture_calibration(spark, sf_dir):
    from ..operators.calibration import covered

    out = mixture(spark, sf_dir).agg(F.avg("crps").alias("crps"), F.avg("pit").alias("mean_pit"), F.avg(covered(F.round("pit", 9), 0.9).cast("double")).alias("cover_90"))
    return rounded(out, "crps", "mean_pit", "cover_90")


@query("m23_quantile_calibration", with_views("SELECT horizon, round(avg(CASE WHEN round(pit, 9) BETWEEN 0.25 AND 0.75 THEN 1.0 ELSE 0.0 END), 6) AS cover_50 FROM pits GROUP BY 1", *ALL[:3], KNOTS, PIT))
def m23_quantile_calibration(spark, sf_dir):
    from ..operators.calibration import covered

    return rounded(quantile_cells(spark, sf_dir).groupBy("horizon").agg(F.avg(covered(F.round("pit", 9), 0.5).cast("double")).alias("cover_50")), "cover_50")


@query("m24_graph_rows", with_views("SELECT firm_id, count(*) + 1 AS n_nodes, count(CASE WHEN qoff <= 115 THEN 1 END) AS n_visible FROM panel GROUP BY 1", PANEL))
def m24_graph_rows(spark, sf_dir):
    rows = views.panel(spark, sf_dir).select("firm_id", "qoff", F.col("qoff").alias("at"))
    graph = producers.graph_rows(rows, "firm_id", "at", 115)
    return graph.groupBy("firm_id").agg(F.count("*").alias("n_nodes"), F.count(F.when(F.col("visible") & ~F.col("is_industry"), 1)).alias("n_visible"))


@query("j16_anchor_merge", with_views("SELECT count(*) AS n, round(avg(abs(prediction - actual)), 6) AS mae FROM forecasts JOIN truth USING (firm_id, qoff, target, horizon) WHERE model = 'drift' AND actual IS NOT NULL", PANEL, TRUTH, FORECASTS))
def j16_anchor_merge(spark, sf_dir):
    rows = scoring.residuals(views.forecasts(spark, sf_dir).where("model = 'drift'"), views.truth(spark, sf_dir)).where("r is not null")
    return rounded(rows.agg(F.count("*").alias("n"), F.avg(F.abs("r")).alias("mae")), "mae")


