"""Queries of the scoring, calibration and significance operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import density, maths, quantiles
from ..operators import calibration, scoring, significance
from ..sources import views
from ..sources.views import FORECASTS, PANEL, TRUTH, with_views
from . import sqltext as sql
from .registry import query

MODELS = 5
SCORED = """scored AS (
 SELECT f.*, t.actual, t.baseline, f.model || coalesce('__seed' || f.seed, '') AS id, f.prediction - t.actual AS r
 FROM forecasts f JOIN truth t USING (firm_id, qoff, target, horizon)),
sample AS (SELECT *, count(CASE WHEN r IS NOT NULL AND baseline IS NOT NULL THEN 1 END) OVER (PARTITION BY firm_id, qoff, target, horizon) = 5 AS common FROM scored)"""
ALL = (PANEL, TRUTH, FORECASTS, SCORED)
LEVEL = "CASE WHEN grouping(target) = 0 AND grouping(horizon) = 0 THEN 'by_target_horizon' WHEN grouping(target) = 0 THEN 'by_target' WHEN grouping(horizon) = 0 THEN 'by_horizon' ELSE 'global' END AS level"
SETS = "GROUPING SETS ((id, target, horizon), (id, target), (id, horizon), (id))"
STATS = f"""stats AS (
 SELECT id, target, horizon, {LEVEL},
  count(CASE WHEN common THEN actual - baseline END) AS n_complete, sum(CASE WHEN common THEN actual - baseline END) AS sum_y,
  sum(CASE WHEN common THEN (actual - baseline) * (actual - baseline) END) AS sum_y2, count(DISTINCT CASE WHEN actual IS NOT NULL THEN qoff END) AS quarters,
  count(r) AS n_obs, sum(CASE WHEN common THEN r * r END) AS sum_r2, sum(CASE WHEN common THEN abs(r) END) AS sum_abs, count(CASE WHEN common THEN r END) AS n_metric
 FROM sample GROUP BY {SETS}),
metrics AS (
 SELECT *, CASE WHEN sum_y2 - sum_y * sum_y / nullif(n_complete, 0) > 1e-15 THEN 1 - sum_r2 / (sum_y2 - sum_y * sum_y / nullif(n_complete, 0) + 1e-12) END AS r2,
  sum_abs / nullif(n_complete, 0) AS mae, n_obs / nullif(quarters, 0) AS avg_obs FROM stats)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.residuals(views.forecasts(spark, sf_dir), views.truth(spark, sf_dir))


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.common_sample(scored(spark, sf_dir), MODELS)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("score_naive_global", with_views("""SELECT count(*) AS n, round(1 - sum(r * r) / (sum(y * y) - sum(y) * sum(y) / count(*) + 1e-12), 6) AS r2, round(avg(abs(r)), 6) AS mae
 FROM (SELECT r, actual - baseline AS y FROM scored WHERE model = 'naive' AND r IS NOT NULL)""", *ALL))
def score_naive_global(spark, sf_dir):
    rows = scored(spark, sf_dir).where("model = 'naive' and r is not null").select("r", (F.col("actual") - F.col("baseline")).alias("y"))
    sst = F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / F.count("*")
    return rows.agg(F.count("*").alias("n"), F.round(1 - F.sum(F.col("r") * F.col("r")) / (sst + 1e-12), 6).alias("r2"), F.round(F.avg(F.abs("r")), 6).alias("mae"))


@query("j1_residuals", with_views("SELECT id, count(*) AS n_rows, count(r) AS n_res, round(sum(r), 4) AS sum_r FROM scored GROUP BY id", *ALL))
def j1_residuals(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n_rows"), F.count("r").alias("n_res"), F.round(F.sum("r"), 4).alias("sum_r"))


@query("j1_unmatched", with_views("SELECT model, count(*) AS n_unmatched FROM forecasts f WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.qoff < 120 AND t.firm_id = f.firm_id AND t.qoff = f.qoff AND t.target = f.target AND t.horizon = f.horizon) GROUP BY model", *ALL))
def j1_unmatched(spark, sf_dir):
    return scoring.unmatched(views.forecasts(spark, sf_dir), views.truth(spark, sf_dir).where("qoff < 120"))


@query("j2_common_sample", with_views("SELECT id, count(*) AS n_rows, count(CASE WHEN common THEN 1 END) AS n_common FROM sample GROUP BY id", *ALL))
def j2_common_sample(spark, sf_dir):
    return sample(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("common"), 1)).alias("n_common"))


@query("j3_family_mask", with_views("""SELECT model, count(*) AS n FROM scored s WHERE r IS NOT NULL AND EXISTS (
 SELECT 1 FROM scored o WHERE o.model = 'drift' AND o.r IS NOT NULL AND o.firm_id = s.firm_id AND o.qoff = s.qoff AND o.target = s.target AND o.horizon = s.horizon) GROUP BY model""", *ALL))
def j3_family_mask(spark, sf_dir):
    rows = scored(spark, sf_dir).where("r is not null")
    return rows.join(rows.where("model = 'drift'").select(*scoring.CELL), scoring.CELL, "left_semi").groupBy("model").agg(F.count("*").alias("n"))


@query("j4_k_draws", with_views("SELECT target, count(*) AS n FROM (SELECT firm_id, qoff, target, horizon FROM scored WHERE model = 'ens' AND r IS NOT NULL GROUP BY ALL HAVING count(*) = 3) GROUP BY target", *ALL))
def j4_k_draws(spark, sf_dir):
    cells = scored(spark, sf_dir).where("model = 'ens' and r is not null").groupBy(*scoring.CELL).agg(F.count("*").alias("k")).where("k = 3")
    return cells.groupBy("target").agg(F.count("*").alias("n"))


@query("j5_seed_alignment", with_views("""SELECT count(*) AS n_misaligned FROM (SELECT firm_id, qoff, target, horizon FROM forecasts WHERE model = 'ens' GROUP BY ALL HAVING count(DISTINCT seed) < 3)""", *ALL))
def j5_seed_alignment(spark, sf_dir):
    seeds = views.forecasts(spark, sf_dir).where("model = 'ens'")
    return seeds.groupBy(*scoring.CELL).agg(F.count_distinct("seed").alias("k")).where("k < 3").agg(F.count("*").alias("n_misaligned"))


@query("a1_rollup_levels", with_views("SELECT id, target, horizon, level, n_complete, n_obs, n_metric, quarters, round(r2, 6) AS r2, round(mae, 6) AS mae, round(avg_obs, 6) AS avg_obs FROM metrics", *ALL, STATS))
def a1_rollup_levels(spark, sf_dir):
    out = scoring.point_scores(sample(spark, sf_dir)).select("id", "target", "horizon", "level", "n_complete", "n_obs", "n_metric", "quarters", "r2", "mae", "avg_obs")
    return out.withColumns({c: maths.round_half_away(F.col(c), 6) for c in ("r2", "mae", "avg_obs")})


@query("a2_truth_stats", with_views("SELECT target, horizon, n_complete, round(sum_y, 4) AS sum_y, round(sum_y2, 4) AS sum_y2, quarters FROM stats WHERE id = 'naive' AND level = 'by_target_horizon'", *ALL, STATS))
def a2_truth_stats(spark, sf_dir):
    out = scoring.point_scores(sample(spark, sf_dir)).where("id = 'naive' and level = 'by_target_horizon'")
    return rounded(out.select("target", "horizon", "n_complete", "sum_y", "sum_y2", "quarters"), "sum_y", "sum_y2", digits=4)


@query("a3_model_stats", with_views("SELECT id, n_obs, n_metric, round(sum_r2, 3) AS sum_r2, round(sum_abs, 3) AS sum_abs FROM stats WHERE level = 'global'", *ALL, STATS))
def a3_model_stats(spark, sf_dir):
    out = scoring.point_scores(sample(spark, sf_dir)).where("level = 'global'")
    return rounded(out.select("id", "n_obs", "n_metric", "sum_r2", "sum_abs"), "sum_r2", "sum_abs", digits=3)


@query("a4_pooled_r2", with_views("SELECT id, round(r2, 6) AS r2 FROM metrics WHERE level = 'global'", *ALL, STATS))
def a4_pooled_r2(spark, sf_dir):
    return rounded(scoring.point_scores(sample(spark, sf_dir)).where("level = 'global'").select("id", "r2"), "r2")


@query("a5_pooled_mae", with_views("SELECT id, horizon, round(mae, 6) AS mae FROM metrics WHERE level = 'by_horizon'", *ALL, STATS))
def a5_pooled_mae(spark, sf_dir):
    return rounded(scoring.point_scores(sample(spark, sf_dir)).where("level = 'by_horizon'").select("id", "horizon", "mae"), "mae")


@query("a6_avg_obs", with_views("SELECT id, target, round(avg_obs, 6) AS avg_obs FROM metrics WHERE level = 'by_target'", *ALL, STATS))
def a6_avg_obs(spark, sf_dir):
    return rounded(scoring.point_scores(sample(spark, sf_dir)).where("level = 'by_target'").select("id", "target", "avg_obs"), "avg_obs")


def meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("drift", "gaussian", None), ("ens", "laplace", None)], "model string, family string, dof double")


_S = "greatest(sigma, 1e-4::DOUBLE)"
DENSE = f"""dense AS (
 SELECT *, CASE WHEN model = 'ens' THEN {sql.nll_laplace('r', _S)} ELSE {sql.nll_gaussian('r', _S)} END AS nll,
  CASE WHEN model = 'ens' THEN {sql.crps_laplace('r', _S)} ELSE {sql.crps_gaussian('r', _S)} END AS crps,
  CASE WHEN model <> 'ens' THEN (r / {_S}) * (r / {_S}) END AS z2
 FROM sample WHERE common AND sigma IS NOT NULL)"""


@query("a7_density", with_views(f"SELECT id, target, horizon, {LEVEL}, round(avg(nll), 6) AS nll, round(avg(crps), 6) AS crps, round(avg(z2), 6) AS z2, count(nll) AS n FROM dense GROUP BY {SETS}", *ALL, DENSE))
def a7_density(spark, sf_dir):
    return rounded(scoring.density_scores(sample(spark, sf_dir), meta(spark)), "nll", "crps", "z2")


@query("a8_seed_mixture_nll", with_views(f"""SELECT target, horizon, {LEVEL}, round(avg(m), 6) AS mixture_nll, count(*) AS n FROM (
 SELECT firm_id, qoff, target, horizon, ln(3.0::DOUBLE) + min(nll) - ln(sum(exp(lo - nll))) AS m
 FROM (SELECT *, min(nll) OVER (PARTITION BY firm_id, qoff, target, horizon) AS lo FROM dense WHERE model = 'ens') GROUP BY 1, 2, 3, 4 HAVING count(*) = 3)
 GROUP BY GROUPING SETS ((target, horizon), (target), (horizon), ())""", *ALL, DENSE))
def a8_seed_mixture_nll(spark, sf_dir):
    return rounded(scoring.seed_mixture_nll(sample(spark, sf_dir), "laplace", "ens", 3), "mixture_nll")


@query("a9_seed_summary", with_views("""SELECT split_part(id, '__seed', 1) AS model, level, target, horizon, round(avg(r2), 6) AS r2_mean, round(stddev_samp(r2), 6) AS r2_std, round(avg(mae), 6) AS mae_mean, count(DISTINCT id) AS n_seeds
 FROM metrics WHERE id LIKE '%\\_\\_seed%' ESCAPE '\\' GROUP BY 1, 2, 3, 4""", *ALL, STATS))
def a9_seed_summary(spark, sf_dir):
    return rounded(scoring.seed_summary(scoring.point_scores(sample(spark, sf_dir))), "r2_mean", "r2_std", "mae_mean")


@query("a10_invariant", with_views("SELECT id, level FROM stats WHERE n_metric <> n_complete", *ALL, STATS))
def a10_invariant(spark, sf_dir):
    return scoring.invariant_violations(scoring.point_scores(sample(spark, sf_dir))).select("id", "level")


@query("a11_coverage_report", with_views("SELECT id, count(r) AS n_finite, count(DISTINCT CASE WHEN r IS NOT NULL THEN target END) AS n_targets FROM scored GROUP BY id", *ALL))
def a11_coverage_report(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("id").agg(F.count("r").alias("n_finite"), F.count_distinct(F.when(F.col("r").isNotNull(), F.col("target"))).alias("n_targets"))


@query("a29_wide_distinct", with_views("SELECT count(DISTINCT target) AS n_targets, count(DISTINCT firm_id) AS n_firms, count(DISTINCT qoff) AS n_quarters FROM truth", *ALL))
def a29_wide_distinct(spark, sf_dir):
    return views.truth(spark, sf_dir).agg(F.count_distinct("target").alias("n_targets"), F.count_distinct("firm_id").alias("n_firms"), F.count_distinct("qoff").alias("n_quarters"))


@query("s16_metric_pivot", with_views("""SELECT horizon, round(max(CASE WHEN id = 'naive' THEN r2 END), 6) AS naive, round(max(CASE WHEN id = 'drift' THEN r2 END), 6) AS drift FROM metrics WHERE level = 'by_horizon' GROUP BY horizon""", *ALL, STATS))
def s16_metric_pivot(spark, sf_dir):
    scores = scoring.point_scores(sample(spark, sf_dir)).where("level = 'by_horizon'")
    return rounded(scoring.pivot_models(scores, ["horizon"], "r2", ["naive", "drift"]), "naive", "drift")


@query("m20_ensemble", with_views("""SELECT target, horizon, count(*) AS n, round(avg(p), 6) AS prediction, round(avg(s), 6) AS sigma FROM (
 SELECT firm_id, qoff, target, horizon, avg(prediction) AS p, sqrt(avg(sigma * sigma) + var_pop(prediction)) AS s FROM forecasts WHERE model = 'ens' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""", *ALL))
def m20_ensemble(spark, sf_dir):
    out = scoring.ensemble(views.forecasts(spark, sf_dir).where("model = 'ens'"))
    return rounded(out.groupBy("target", "horizon").agg(F.count("*").alias("n"), F.avg("prediction").alias("prediction"), F.avg("sigma").alias("sigma")), "prediction", "sigma")


@query("m20_point_only_arm", with_views("""SELECT model, count(*) AS n, CAST(0 AS BIGINT) AS n_sigma FROM (SELECT DISTINCT firm_id, qoff, target, horizon, model FROM forecasts WHERE model IN ('naive', 'ens')) GROUP BY model""", *ALL))
def m20_point_only_arm(spark, sf_dir):
    rows = views.forecasts(spark, sf_dir).where("model in ('naive', 'ens')")
    rows = rows.withColumn("sigma", F.when(~((F.col("firm_id") == 1) & (F.col("horizon") == 1)), F.col("sigma")))
    return scoring.ensemble(rows).groupBy("model").agg(F.count("*").alias("n"), F.count("sigma").alias("n_sigma"))


@query("m19_group_seeds", with_views("SELECT model, count(DISTINCT seed) AS n_seeds, min(seed) AS least, max(seed) AS most FROM forecasts WHERE seed IS NOT NULL GROUP BY model HAVING min(seed) >= 0", *ALL))
def m19_group_seeds(spark, sf_dir):
    out = views.forecasts(spark, sf_dir).where("seed is not null").groupBy("model").agg(F.count_distinct("seed").alias("n_seeds"), F.min("seed").alias("least"), F.max("seed").alias("most"))
    return out.where("least >= 0")


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.mixture_cells(sample(spark, sf_dir), "ens", "laplace", views.SEEDS)


_B = [f"(s{k}/sqrt(2.0::DOUBLE))" for k in (1, 2, 3)]
_OWN = "+".join(f"(abs(r{k})+{b}*exp(-abs(r{k})/{b}))" for k, b in zip((1, 2, 3), _B))


def _between(m: str, b1: str, b2: str) -> str:
    a, c, big = f"greatest({b1},{b2})", f"least({b1},{b2})", f"abs({m})"
    t = f"({big}*({a}-{c})/({a}*{c}))"
    shrink = f"(CASE WHEN abs({t})<1e-5 THEN 1-{t}/2+{t}*{t}/6 ELSE (1-exp(-{t}))/{t} END)"
    return f"({big}+exp(-{big}/{a})*({a}*({a}*{a}+{a}*{c}+{c}*{c})+{c}*{c}*{big}*{shrink})/({a}*({a}+{c})))"


_PAIRS = "+".join(_between(f"(r{i}-r{j})", _B[i - 1], _B[j - 1]) for i in (1, 2, 3) for j in (1, 2, 3))
_PIT = "+".join(f"(CASE WHEN r{k}>=0 THEN 0.5::DOUBLE*exp(-r{k}/{b}) ELSE 1-0.5::DOUBLE*exp(r{k}/{b}) END)" for k, b in zip((1, 2, 3), _B))
CELLS = f"""wide AS (
 SELECT firm_id, qoff, target, horizon, {', '.join(f'max(CASE WHEN seed = {k} THEN r END) AS r{k}, max(CASE WHEN seed = {k} THEN sigma END) AS s{k}' for k in (1, 2, 3))}
 FROM sample WHERE model = 'ens' AND common AND sigma > 0 GROUP BY 1, 2, 3, 4 HAVING count(*) = 3),
cells AS (
 SELECT firm_id, qoff, target, horizon, ({_PIT})/3 AS pit, ({_OWN})/3-({_PAIRS})/18 AS crps,
  ((r1+r2+r3)/3)*((r1+r2+r3)/3)/((s1*s1+s2*s2+s3*s3)/3+(pow(r1-(r1+r2+r3)/3,2)+pow(r2-(r1+r2+r3)/3,2)+pow(r3-(r1+r2+r3)/3,2))/3) AS z2 FROM wide)"""


@query("a12_calibration_by_horizon", with_views("""SELECT coalesce(CAST(horizon AS VARCHAR), 'pooled') AS horizon, count(*) AS n,
 round(avg(CASE WHEN pit BETWEEN 0.25 AND 0.75 THEN 1.0 ELSE 0.0 END), 6) AS cover_50, round(avg(CASE WHEN pit BETWEEN (1-0.8::DOUBLE)/2 AND (1+0.8::DOUBLE)/2 THEN 1.0 ELSE 0.0 END), 6) AS cover_80,
 round(avg(CASE WHEN pit BETWEEN (1-0.9::DOUBLE)/2 AND (1+0.9::DOUBLE)/2 THEN 1.0 ELSE 0.0 END), 6) AS cover_90, round(avg(CASE WHEN pit BETWEEN (1-0.95::DOUBLE)/2 AND (1+0.95::DOUBLE)/2 THEN 1.0 ELSE 0.0 END), 6) AS cover_95,
 round(avg(pit), 6) AS mean_pit, round(avg(z2), 6) AS z2, round(avg(crps), 6) AS crps FROM cells GROUP BY ROLLUP (horizon)""", *ALL, CELLS))
def a12_calibration_by_horizon(spark, sf_dir):
    return rounded(calibration.coverage(mixture(spark, sf_dir)), "cover_50", "cover_80", "cover_90", "cover_95", "mean_pit", "z2", "crps")


@query("a13_pit_histogram", with_views("SELECT CAST(least(floor(round(pit, 9) * 20), 19) AS INTEGER) AS bin, count(*) AS n, round(count(*) / (SELECT count(*) FROM cells) * 20, 6) AS density FROM cells GROUP BY 1", *ALL, CELLS))
def a13_pit_histogram(spark, sf_dir):
    return rounded(calibration.pit_histogram(rounded(mixture(spark, sf_dir), "pit", digits=9)), "density")


@query("f12_mixture_crps", with_views("SELECT target, round(avg(crps), 6) AS crps, round(max(crps), 6) AS worst FROM cells GROUP BY target", *ALL, CELLS))
def f12_mixture_crps(spark, sf_dir):
    return rounded(mixture(spark, sf_dir).groupBy("target").agg(F.avg("crps").alias("crps"), F.max("crps").alias("worst")), "crps", "worst")


@query("f13_mixture_pit", with_views("SELECT target, round(avg(pit), 6) AS pit, round(min(pit), 6) AS least FROM cells GROUP BY target", *ALL, CELLS))
def f13_mixture_pit(spark, sf_dir):
    return rounded(mixture(spark, sf_dir).groupBy("target").agg(F.avg("pit").alias("pit"), F.min("pit").alias("least")), "pit", "least")


@query("f14_total_variance_z2", with_views("SELECT horizon, round(avg(z2), 6) AS z2 FROM cells GROUP BY horizon", *ALL, CELLS))
def f14_total_variance_z2(spark, sf_dir):
    return rounded(mixture(spark, sf_dir).groupBy("horizon").agg(F.avg("z2").alias("z2")), "z2")


@query("f6_nll_families", with_views(f"SELECT model, round(avg({sql.nll_gaussian('r', 'sigma')}), 6) AS gaussian, round(avg({sql.nll_laplace('r', 'sigma')}), 6) AS laplace FROM scored WHERE sigma > 0 AND r IS NOT NULL GROUP BY model", *ALL))
def f6_nll_families(spark, sf_dir):
    rows = scored(spark, sf_dir).where("sigma > 0 and r is not null")
    r, s = F.col("r"), F.col("sigma")
    return rounded(rows.groupBy("model").agg(F.avg(density.nll(r, s, "gaussian")).alias("gaussian"), F.avg(density.nll(r, s, "laplace")).alias("laplace")), "gaussian", "laplace")


@query("f7_crps_families", with_views(f"SELECT model, round(avg({sql.crps_gaussian('r', 'sigma')}), 6) AS gaussian, round(avg({sql.crps_laplace('r', 'sigma')}), 6) AS laplace FROM scored WHERE sigma > 0 AND r IS NOT NULL GROUP BY model", *ALL))
def f7_crps_families(spark, sf_dir):
    rows = scored(spark, sf_dir).where("sigma > 0 and r is not null")
    r, s = F.col("r"), F.col("sigma")
    return rounded(rows.groupBy("model").agg(F.avg(density.crps(r, s, "gaussian")).alias("gaussian"), F.avg(density.crps(r, s, "laplace")).alias("laplace")), "gaussian", "laplace")


@query("f10_normal_cdf", with_views(f"SELECT horizon, round(sum({sql.cdf('(r/sigma)')}), 5) AS s FROM scored WHERE sigma > 0 AND r IS NOT NULL GROUP BY horizon", *ALL))
def f10_normal_cdf(spark, sf_dir):
    from ..functions.maths import normal_cdf

    rows = scored(spark, sf_dir).where("sigma > 0 and r is not null").withColumn("w", F.col("r") / F.col("sigma"))
    return rounded(rows.groupBy("horizon").agg(F.sum(normal_cdf(F.col("w"))).alias("s")), "s", digits=5)


@query("f20_sigma_floor", with_views("SELECT model, round(sum(CASE WHEN sigma IS NOT NULL THEN greatest(sigma, 0.7::DOUBLE) END), 4) AS floored, count(CASE WHEN sigma > 0 THEN 1 END) AS positive FROM forecasts GROUP BY model", *ALL))
def f20_sigma_floor(spark, sf_dir):
    s = F.col("sigma")
    return rounded(views.forecasts(spark, sf_dir).groupBy("model").agg(F.sum(density.floored(s, 0.7)).alias("floored"), F.count(density.floored(s, 0.0)).alias("positive")), "floored", digits=4)


Z = [round(-2.0 + 0.2 * k, 1) for k in range(21)]
KNOTS = f"""quantile_forecasts AS (
 SELECT firm_id, qoff, target, horizon, list_transform([{', '.join(f'{z!r}::DOUBLE' for z in Z)}], lambda z: prediction + sigma * (CASE WHEN firm_id % 7 = 0 AND z > 1.7::DOUBLE THEN 1 ELSE z END)) AS knots
 FROM forecasts WHERE model = 'drift'),
taus AS (SELECT [{', '.join(f'{t!r}::DOUBLE' for t in quantiles.LEVELS)}] AS tau),
q AS (
 SELECT f.firm_id, f.qoff, f.target, f.horizon, f.knots <> list_sort(f.knots) AS crossed, list_sort(f.knots) AS k, t.actual AS y
 FROM quantile_forecasts f JOIN truth t USING (firm_id, qoff, target, horizon) WHERE t.actual IS NOT NULL)"""


def quantile_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.forecasts(spark, sf_dir).where("model = 'drift'")
    z = F.array(*[F.lit(float(x)) for x in Z])
    knots = F.transform(z, lambda x: F.col("prediction") + F.col("sigma") * F.when((F.col("firm_id") % 7 == 0) & (x > 1.7), F.lit(1.0)).otherwise(x))
    return rows.select(*scoring.CELL, knots.alias("knots"))


def quantile_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.quantile_cells(quantile_forecasts(spark, sf_dir), views.truth(spark, sf_dir), limit=3.0)


PIT = """pits AS (
 SELECT *, CASE WHEN hi > lo THEN 0.5::DOUBLE * (tau[lo + 1] + tau[hi]) WHEN lo = 0 THEN tau[1] WHEN lo = 21 THEN tau[21]
  ELSE tau[lo] + (tau[lo + 1] - tau[lo]) * (y - k[lo]) / nullif(k[lo + 1] - k[lo], 0) END AS pit
 FROM (SELECT *, len(list_filter(k, lambda x: x < y)) AS lo, len(list_filter(k, lambda x: x <= y)) AS hi FROM q CROSS JOIN taus))"""


@query("f18_quantile_pit", with_views("SELECT horizon, count(*) AS n, round(avg(pit), 6) AS pit FROM pits GROUP BY horizon", *ALL[:3], KNOTS, PIT))
def f18_quantile_pit(spark, sf_dir):
    return rounded(quantile_cells(spark, sf_dir).groupBy("horizon").agg(F.count("*").alias("n"), F.avg("pit").alias("pit")), "pit")


SEGMENTS = """segments AS (
 SELECT firm_id, qoff, target, horizon, k, y, i, a, b, (y - qa) + (qb - qa) / (b - a) * a AS al, -(qb - qa) / (b - a) AS be FROM (
  SELECT *, CASE WHEN i = 0 THEN 0 ELSE tau[i] END AS a, CASE WHEN i = 21 THEN 1 ELSE tau[i + 1] END AS b, k[greatest(i, 1)] AS qa, k[least(i + 1, 21)] AS qb
  FROM q CROSS JOIN taus CROSS JOIN range(0, 22) g(i))),
parts AS (
 SELECT *, al + be * a AS dl, al + be * b AS dr, greatest(a, least(b, -al / nullif(be, 0))) AS c FROM segments),
losses AS (
 SELECT firm_id, qoff, target, horizon, sum(CASE
  WHEN dl >= 0 AND dr >= 0 THEN (al*b*b+be*b*b*b*2/3) - (al*a*a+be*a*a*a*2/3)
  WHEN dl < 0 AND dr < 0 THEN (al*b*b+be*b*b*b*2/3-b*(2*al+be*b)) - (al*a*a+be*a*a*a*2/3-a*(2*al+be*a))
  WHEN dl >= 0 THEN (al*c*c+be*c*c*c*2/3) - (al*a*a+be*a*a*a*2/3) + (al*b*b+be*b*b*b*2/3-b*(2*al+be*b)) - (al*c*c+be*c*c*c*2/3-c*(2*al+be*c))
  ELSE (al*c*c+be*c*c*c*2/3-c*(2*al+be*c)) - (al*a*a+be*a*a*a*2/3-a*(2*al+be*a)) + (al*b*b+be*b*b*b*2/3) - (al*c*c+be*c*c*c*2/3) END) AS crps
 FROM parts GROUP BY 1, 2, 3, 4)"""


@query("f17_quantile_crps", with_views("SELECT target, count(*) AS n, round(avg(crps), 6) AS crps FROM losses GROUP BY target", *ALL[:3], KNOTS, SEGMENTS))
def f17_quantile_crps(spark, sf_dir):
    return rounded(quantile_cells(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n"), F.avg("crps").alias("crps")), "crps")


@query("a14_saturation_split", with_views("""SELECT part, count(*) AS n, round(avg(crps), 6) AS crps, round(avg(pit), 6) AS mean_pit, round(count(*) / (SELECT count(*) FROM pits), 6) AS share FROM (
 SELECT p.pit, l.crps, CASE WHEN p.k[21] = p.k[1] OR abs(p.y) >= 3 THEN 'saturated' ELSE 'interior' END AS part FROM pits p JOIN losses l USING (firm_id, qoff, target, horizon)) GROUP BY part""", *ALL[:3], KNOTS, PIT, SEGMENTS))
def a14_saturation_split(spark, sf_dir):
    return rounded(calibration.saturation_split(quantile_cells(spark, sf_dir)), "crps", "mean_pit", "share")


@query("o9_crossing_repair", with_views("SELECT crossed, count(*) AS n FROM q GROUP BY crossed", *ALL[:3], KNOTS))
def o9_crossing_repair(spark, sf_dir):
    return quantile_cells(spark, sf_dir).groupBy("crossed").agg(F.count("*").alias("n"))


@query("f16_quantile_mean", with_views(f"SELECT horizon, round(avg(m), 6) AS mean, round(avg(s), 6) AS sigma FROM (SELECT horizon, {'+'.join(f'k[{i + 1}]*{w!r}::DOUBLE' for i, w in enumerate(quantiles.mean_weights()))} AS m, sqrt(greatest({'+'.join(f'k[{i + 1}]*k[{i + 1}]*{w!r}::DOUBLE' for i, w in enumerate(quantiles.mean_weights()))}-pow({'+'.join(f'k[{i + 1}]*{w!r}::DOUBLE' for i, w in enumerate(quantiles.mean_weights()))},2),0)) AS s FROM q) GROUP BY horizon", *ALL[:3], KNOTS))
def f16_quantile_mean(spark, sf_dir):
    rows = quantile_forecasts(spark, sf_dir).join(views.truth(spark, sf_dir), scoring.CELL).where("actual is not null").withColumn("knots", F.array_sort("knots"))
    return rounded(rows.groupBy("horizon").agg(F.avg(quantiles.mean(F.col("knots"))).alias("mean"), F.avg(quantiles.moment_sigma(F.col("knots"))).alias("sigma")), "mean", "sigma")


@query("f15_sigma_from_quantiles", with_views("SELECT horizon, round(avg((k[19] - k[3]) / 2.563103131089201::DOUBLE), 6) AS sigma FROM q GROUP BY horizon", *ALL[:3], KNOTS))
def f15_sigma_from_quantiles(spark, sf_dir):
    rows = quantile_forecasts(spark, sf_dir).join(views.truth(spark, sf_dir), scoring.CELL).where("actual is not null").withColumn("knots", F.array_sort("knots"))
    return rounded(rows.groupBy("horizon").agg(F.avg(quantiles.sigma_from_pair(F.get("knots", F.lit(2)), F.get("knots", F.lit(18)), 0.1, 0.9)).alias("sigma")), "sigma")


DIFFS = """diffs AS (
 SELECT o.id, coalesce(o.horizon, 0) AS horizon, o.qoff, avg(f.r * f.r - o.r * o.r) AS d_sq, avg(abs(f.r) - abs(o.r)) AS d_abs, count(*) AS n
 FROM sample o JOIN sample f USING (firm_id, qoff, target, horizon) WHERE o.common AND f.common AND f.id = 'naive' AND o.id <> 'naive'
 GROUP BY GROUPING SETS ((o.id, o.horizon, o.qoff), (o.id, o.qoff)))"""


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significance.differentials(sample(spark, sf_dir), "naive")


@query("a15_loss_differentials", with_views("SELECT id, CAST(horizon AS INTEGER) AS horizon, qoff, round(d_sq, 6) AS d_sq, round(d_abs, 6) AS d_abs, n FROM diffs", *ALL, DIFFS))
def a15_loss_differentials(spark, sf_dir):
    return rounded(diffs(spark, sf_dir), "d_sq", "d_abs")


@query("w12_rank_and_gap", with_views("""SELECT id, CAST(horizon AS INTEGER) AS horizon, CAST(max(rk) AS INTEGER) AS quarters, coalesce(bool_or(step > 1), false) AS has_gap FROM (
 SELECT id, horizon, dense_rank() OVER w AS rk, qoff - lag(qoff) OVER w AS step FROM diffs WINDOW w AS (PARTITION BY id, horizon ORDER BY qoff)) GROUP BY 1, 2""", *ALL, DIFFS))
def w12_rank_and_gap(spark, sf_dir):
    return significance.gaps(diffs(spark, sf_dir), ["id", "horizon"])


NW = """demeaned AS (
 SELECT id, horizon, d_abs - avg(d_abs) OVER (PARTITION BY id, horizon) AS dc, avg(d_abs) OVER (PARTITION BY id, horizon) AS m,
  row_number() OVER (PARTITION BY id, horizon ORDER BY qoff) AS rk, count(*) OVER (PARTITION BY id, horizon) AS T FROM diffs),
gammas AS (
 SELECT a.id, a.horizon, l.l, sum(a.dc * b.dc) / max(a.T) AS g, max(a.T) AS T FROM demeaned a CROSS JOIN range(0, 8) l(l)
 JOIN demeaned b ON b.id = a.id AND b.horizon = a.horizon AND b.rk = a.rk - l.l
 WHERE l.l <= least(greatest(CASE WHEN a.horizon = 0 THEN 7 ELSE a.horizon - 1 END, 0), a.T - 1) GROUP BY 1, 2, 3),
lrvs AS (
 SELECT id, horizon, max(T) AS T, sum(CASE WHEN l = 0 THEN g ELSE 2 * (1 - l / (least(greatest(CASE WHEN horizon = 0 THEN 7 ELSE horizon - 1 END, 0), T - 1) + 1)) * g END) AS v, max(CASE WHEN l = 0 THEN g END) AS g0 FROM gammas GROUP BY 1, 2),
tests AS (
 SELECT r.id, CAST(r.horizon AS INTEGER) AS horizon, CAST(r.T AS INTEGER) AS n_quarters, m AS mean, CASE WHEN v > 0 THEN v ELSE g0 END AS lrv
 FROM lrvs r JOIN (SELECT DISTINCT id, horizon, m FROM (SELECT id, horizon, min(m) AS m FROM demeaned GROUP BY 1, 2)) d ON d.id = r.id AND d.horizon = r.horizon)"""


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diffs(spark, sf_dir).withColumn("bw", F.when(F.col("horizon") == 0, F.lit(views.HORIZONS - 1)).otherwise(F.col("horizon") - 1))
    return significance.newey_west(rows, ["id", "horizon"], "d_abs", "bw")


@query("w11_newey_west", with_views("SELECT id, horizon, n_quarters, round(mean, 6) AS mean, round(lrv, 6) AS lrv FROM tests", *ALL, DIFFS, NW))
def w11_newey_west(spark, sf_dir):
    return rounded(tests(spark, sf_dir).select("id", "horizon", "n_quarters", "mean", "lrv"), "mean", "lrv")


@query("f22_small_sample_t", with_views("""SELECT id, horizon, round(t, 4) AS t, round(CASE WHEN f > 0 THEN t * sqrt(f) ELSE t END, 4) AS t_corrected FROM (
 SELECT id, horizon, mean / nullif(sqrt(lrv / n_quarters), 0) AS t, (n_quarters + 1 - 2 * greatest(horizon, 1) + greatest(horizon, 1) * (greatest(horizon, 1) - 1) / n_quarters) / n_quarters AS f FROM tests)""", *ALL, DIFFS, NW))
def f22_small_sample_t(spark, sf_dir):
    out = significance.corrected(tests(spark, sf_dir), F.greatest("horizon", F.lit(1)))
    return rounded(out.select("id", "horizon", "t", "t_corrected"), "t", "t_corrected", digits=4)


#: Two-sided p of Student's t by the finite series for whole degrees of freedom.
P_VALUES = """corrected AS (
 SELECT id, horizon, n_quarters - 1 AS df, t, CASE WHEN f > 0 THEN t * sqrt(f) ELSE t END AS tc FROM (
  SELECT id, horizon, n_quarters, mean / nullif(sqrt(lrv / n_quarters), 0) AS t, (n_quarters + 1 - 2 * greatest(horizon, 1) + greatest(horizon, 1) * (greatest(horizon, 1) - 1) / n_quarters) / n_quarters AS f FROM tests)),
angles AS (SELECT *, atan(abs(tc) / sqrt(df::DOUBLE)) AS a FROM corrected),
judged AS (
 SELECT id, horizon, t, 1 - CASE WHEN df % 2 = 0 THEN sin(a) * (SELECT coalesce(sum(exp(lgamma(k + 0.5::DOUBLE) - lgamma(0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE)) * pow(cos(a), 2 * k)), 0) FROM range(0, 200) r(k) WHERE k < df // 2)
  ELSE 2 / pi() * (a + sin(a) * (SELECT coalesce(sum(exp(lgamma(k + 1.0::DOUBLE) + lgamma(1.5::DOUBLE) - lgamma(k + 1.5::DOUBLE)) * pow(cos(a), 2 * k + 1)), 0) FROM range(0, 200) r(k) WHERE k < (df - 1) // 2)) END AS p FROM angles),
marked AS (SELECT *, repeat(CASE WHEN t < 0 THEN '*' ELSE '†' END, CASE WHEN p <= 0.01 THEN 3 WHEN p <= 0.05 THEN 2 WHEN p <= 0.1 THEN 1 ELSE 0 END) AS marker FROM judged)"""


@query("m21_diebold_mariano", with_views("SELECT id, horizon, round(t, 6) AS t, round(p, 6) AS p, marker FROM marked", *ALL, DIFFS, NW, P_VALUES))
def m21_diebold_mariano(spark, sf_dir):
    out = significance.with_p_values(significance.corrected(tests(spark, sf_dir), F.greatest("horizon", F.lit(1))))
    return rounded(out.select("id", "horizon", "t", "p", "marker"), "t", "p")


@query("m1_naive", with_views("SELECT target, horizon, count(naive) AS n, round(avg(naive), 6) AS naive FROM base GROUP BY 1, 2", *ALL))
def m1_naive(spark, sf_dir):
    from ..operators.producers import naive_drift

    base = naive_drift(views.panel(spark, sf_dir), views.TARGETS, views.HORIZONS)
    return rounded(base.groupBy("target", "horizon").agg(F.count("naive").alias("n"), F.avg("naive").alias("naive")), "naive")


@query("m2_naive_drift", with_views("SELECT target, horizon, count(drift) AS n, round(avg(drift), 6) AS drift FROM base GROUP BY 1, 2", *ALL))
def m2_naive_drift(spark, sf_dir):
    from ..operators.producers import naive_drift

    base = naive_drift(views.panel(spark, sf_dir), views.TARGETS, views.HORIZONS)
    return rounded(base.groupBy("target", "horizon").agg(F.count("drift").alias("n"), F.avg("drift").alias("drift")), "drift")


@query("m3_ols_by_horizon", with_views("SELECT target, horizon, round(regr_slope(actual, baseline), 6) AS slope, round(regr_intercept(actual, baseline), 6) AS intercept, count(*) AS n FROM truth WHERE actual IS NOT NULL AND baseline IS NOT NULL GROUP BY 1, 2", PANEL, TRUTH))
def m3_ols_by_horizon(spark, sf_dir):
    from ..operators.producers import ols_by_group

    return rounded(ols_by_group(views.truth(spark, sf_dir), ["target", "horizon"], "baseline", "actual"), "slope", "intercept")


@query("f35_masked_losses", with_views("""SELECT round(avg(r * r), 6) AS global_mse, (SELECT round(avg(m), 6) FROM (SELECT target, horizon, avg(r * r) AS m FROM scored WHERE model = 'drift' AND r IS NOT NULL GROUP BY 1, 2)) AS per_target_mse
 FROM scored WHERE model = 'drift' AND r IS NOT NULL""", *ALL))
def f35_masked_losses(spark, sf_dir):
    rows = scored(spark, sf_dir).where("model = 'drift' and r is not null").withColumn("sq", F.col("r") * F.col("r"))
    each = rows.groupBy("target", "horizon").agg(F.sum("sq").alias("s"), F.count("*").alias("n"), F.avg("sq").alias("m"))
    return rounded(each.agg((F.sum("s") / F.sum("n")).alias("global_mse"), F.avg("m").alias("per_target_mse")), "global_mse", "per_target_mse")
