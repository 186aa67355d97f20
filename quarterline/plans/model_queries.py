"""Queries of splits, configurations, model selection and persistence, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import panels, producers
from ..sources import configs, views
from ..sources.shared import fresh_folder as folder
from ..sources.views import FORECASTS, PANEL, SPARSE, TRUTH, with_views
from .registry import query
from .scoring_queries import rounded

SPLITS = {"train": (None, 111), "val": (112, 114), "test": (115, None)}


def _names(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    """The regions' keys and names; a fixed table of a few rows."""
    return sorted((r["r_regionkey"], r["r_name"]) for r in views.table(spark, sf_dir, "region").select("r_regionkey", "r_name").limit(100).collect())


@query("s3_row_group_stream", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' GROUP BY 1")
def s3_row_group_stream(spark, sf_dir):
    """Row groups are skipped by their statistics and read a batch at a time by the Parquet scan itself."""
    rows = views.table(spark, sf_dir, "lineitem").where("l_shipdate >= date '1996-01-01'")
    return rounded(rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")), "quantity", digits=2)


@query("s4_batch_iteration", "SELECT count(*) AS n_rows, sum(o_custkey) AS s FROM orders")
def s4_batch_iteration(spark, sf_dir):
    """Arrow batches of a partition, one after another, each reduced before the next is read."""

    def reduce(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([pc.sum(batch.column(0)).as_py() or 0])], names=["n", "s"])

    parts = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("k")).mapInArrow(reduce, "n long, s long")
    return parts.agg(F.sum("n").alias("n_rows"), F.sum("s").alias("s"))


@query("s7_dataset_paths", "SELECT r_name, CASE WHEN r_regionkey % 2 = 0 THEN 'data/panel_core_' || lower(r_name) || '.parquet' ELSE 'data/panel_core.parquet' END AS path FROM region")
def s7_dataset_paths(spark, sf_dir):
    names = _names(spark, sf_dir)
    there = {f"data/panel_core_{name.lower()}.parquet" for k, name in names if k % 2 == 0}
    rows = [(name, configs.dataset_path("data", "panel", "core", name.lower(), there.__contains__)) for _, name in names]
    return spark.createDataFrame(rows, "r_name string, path string")


@query("s25_output_tags", "SELECT r_name, trim(regexp_replace(r_name, '[^A-Za-z0-9]', '_', 'g'), '_') || '__core__' || r_regionkey AS tag FROM region")
def s25_output_tags(spark, sf_dir):
    return spark.createDataFrame([(name, configs.output_tag(name, None, "core", "", k)) for k, name in _names(spark, sf_dir)], "r_name string, tag string")


@query("s27_splits", with_views("""SELECT split, count(*) AS n, min(qoff) AS first, max(qoff) AS last, count(DISTINCT firm_id) AS firms FROM (
 SELECT *, CASE WHEN qoff <= 111 THEN 'train' WHEN qoff <= 114 THEN 'val' ELSE 'test' END AS split FROM sparse) GROUP BY 1""", SPARSE))
def s27_splits(spark, sf_dir):
    rows = panels.splits(views.sparse_panel(spark, sf_dir), "qoff", SPLITS)
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("qoff").alias("first"), F.max("qoff").alias("last"), F.count_distinct("firm_id").alias("firms"))


@query("s27_data_module", with_views("SELECT split, target, horizon, count(*) AS n, round(avg(actual), 6) AS label FROM (SELECT *, CASE WHEN qoff <= 111 THEN 'train' WHEN qoff <= 114 THEN 'val' ELSE 'test' END AS split FROM truth) WHERE actual IS NOT NULL AND baseline IS NOT NULL GROUP BY 1, 2, 3", PANEL, TRUTH))
def s27_data_module(spark, sf_dir):
    """Complete rows of features and labels for each split, as a trainer reads them."""
    rows = panels.splits(views.truth(spark, sf_dir).dropna(subset=["actual", "baseline"]), "qoff", SPLITS)
    return rounded(rows.groupBy("split", "target", "horizon").agg(F.count("*").alias("n"), F.avg("actual").alias("label")), "label")


@query("p23_config_resolution", "SELECT r_name, count(*) AS n_columns FROM (SELECT a.r_name, n.n_name FROM region a JOIN region b ON b.r_regionkey <= a.r_regionkey JOIN nation n ON n.n_regionkey = b.r_regionkey) GROUP BY 1")
def p23_config_resolution(spark, sf_dir):
    """Each region's set holds its nations and includes the set of the region before."""
    names = dict(_names(spark, sf_dir))
    own = {r["n_regionkey"]: r["all"] for r in views.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("all")).limit(100).collect()}
    sets = {name: {"columns": own.get(k, []), "include_sets": [names[k - 1]] if k - 1 in names else []} for k, name in names.items()}
    return spark.createDataFrame([(name, len(configs.collect(sets, name, "columns"))) for name in names.values()], "r_name string, n_columns long")


@query("p24_target_columns", "SELECT 'all' AS wanted, r_name AS target FROM region UNION ALL SELECT 'some', r_name FROM region WHERE r_regionkey < 2")
def p24_target_columns(spark, sf_dir):
    names = [name for _, name in _names(spark, sf_dir)]
    chosen = {"all": configs.targets("all", names), "some": configs.targets(", ".join(names[:2]), names)}
    return spark.createDataFrame([(k, t) for k, some in chosen.items() for t in some], "wanted string, target string")


@query("m4_shared_strength")
def m4_shared_strength(spark, sf_dir):
    """One ridge strength for all horizons: the one with the least mean validation error over them."""
    rows = panels.splits(views.truth(spark, sf_dir).where("target = 'net' and actual is not null and baseline is not null"), "qoff", SPLITS)
    best, errors = producers.shared_strength(rows, "horizon", ["baseline"], "actual", [0.0, 0.1, 10.0])
    return rounded(spark.createDataFrame([(s, float(e), s == best) for s, e in errors.items()], "strength double, error double, chosen boolean"), "error")


@query("m5_boosted_trees")
def m5_boosted_trees(spark, sf_dir):
    rows = panels.splits(panels.features(views.panel(spark, sf_dir), "net"), "qoff", SPLITS)
    used = [f"net_level_{k}" for k in range(4)]
    model = producers.fit_trees(rows.where("split = 'train'"), used, "net_t1", maxIter=5, maxDepth=3)
    return rounded(producers.predict(model, rows.where("split = 'test'"), used, "net_t1_pred").select("firm_id", "qoff", "net_t1_pred"), "net_t1_pred")


LINE = """fitted AS (SELECT regr_slope(actual, baseline) AS a, regr_intercept(actual, baseline) AS b FROM truth WHERE target = 'net' AND horizon = 1 AND actual IS NOT NULL AND baseline IS NOT NULL)"""


def _first_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.truth(spark, sf_dir).where("target = 'net' and horizon = 1 and actual is not null and baseline is not null")


@query("m29_model_round_trip", with_views("SELECT qoff, count(*) AS n, round(avg(a * baseline + b), 5) AS prediction FROM truth CROSS JOIN fitted WHERE target = 'net' AND horizon = 1 AND actual IS NOT NULL AND baseline IS NOT NULL GROUP BY 1", PANEL, TRUTH, LINE))
def m29_model_round_trip(spark, sf_dir):
    """A model is stored with what it was made of, read back, and predicts."""
    rows, path = _first_horizon(spark, sf_dir), folder(spark, "model")
    producers.save(producers.fit_linear(rows, rows, ["baseline"], "actual", {})[0], path, {"features": ["baseline"], "target": "actual"})
    model, made_of = producers.load(spark, path)
    out = producers.predict(model, rows, made_of["features"], "prediction")
    return rounded(out.groupBy("qoff").agg(F.count("*").alias("n"), F.avg("prediction").alias("prediction")), "prediction", digits=5)


@query("s20_model_artifacts", "SELECT 'features' AS key, 'baseline' AS value UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM nation")
def s20_model_artifacts(spark, sf_dir):
    """What lies beside a stored model."""
    nation = views.table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("double").alias("baseline"), F.col("n_nationkey").cast("double").alias("actual"))
    path = folder(spark, "model")
    producers.save(producers.fit_linear(nation, nation, ["baseline"], "actual", {})[0], path, {"features": ["baseline"], "rows": nation.count()})
    made_of = producers.load(spark, path)[1]
    return spark.createDataFrame([("features", ",".join(made_of["features"])), ("rows", str(made_of["rows"]))], "key string, value string")


@query("m14_curriculum", "SELECT CAST(e AS INTEGER) AS epoch, CAST(least(20, 2 + 3 * (e // 5)) AS INTEGER) AS horizon FROM range(0, 40) r(e)")
def m14_curriculum(spark, sf_dir):
    return spark.createDataFrame([(e, configs.horizon_at(e, 2, 3, 5, 20)) for e in range(40)], "epoch int, horizon int")


@query("m18_resume_guards", "SELECT r_name, CASE WHEN r_regionkey < 2 THEN 'go on' ELSE 'made with other settings: seed (' || r_regionkey || ', now ' || r_regionkey % 2 || ')' END AS outcome FROM region")
def m18_resume_guards(spark, sf_dir):
    out = []
    for k, name in _names(spark, sf_dir):
        try:
            configs.guard_resume({"seed": k, "kind": "naive"}, {"seed": k % 2, "kind": "naive"})
            out.append((name, "go on"))
        except ValueError as error:
            out.append((name, str(error)))
    return spark.createDataFrame(out, "r_name string, outcome string")


@query("m28_factory", with_views("SELECT target, count(naive) AS n_naive, round(avg(drift), 6) AS drift FROM base GROUP BY 1", PANEL, TRUTH, FORECASTS))
def m28_factory(spark, sf_dir):
    made = producers.produce("naive_drift", views.panel(spark, sf_dir), views.TARGETS, views.HORIZONS)
    return rounded(made.groupBy("target").agg(F.count("naive").alias("n_naive"), F.avg("drift").alias("drift")), "drift")


@query("m31_user_producer", with_views("SELECT firm_id, qoff, 'net' AS target, round(net * 1.5, 6) AS prediction FROM panel", PANEL))
def m31_user_producer(spark, sf_dir):
    """A producer from outside: any function of frames, as a zero-shot model would be called."""

    def ahead(frames):
        for frame in frames:
            frame["prediction"], frame["target"] = frame["net"] * 1.5, "net"
            yield frame[["firm_id", "qoff", "target", "prediction"]]

    rows = views.panel(spark, sf_dir).select("firm_id", "qoff", "net")
    return rounded(producers.with_function(rows, ahead, "firm_id long, qoff int, target string, prediction double"), "prediction")
