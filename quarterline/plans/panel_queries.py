"""Queries of the panel, key, window, origin, identity and sampling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import identities, maths, regular
from ..operators import origins, panels, producers
from ..sources import forecasts as files, views
from ..sources.views import PANEL, SPARSE, with_views
from .registry import query


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("p1_canonical_ids", "SELECT count(*) AS n, sum(CAST(c_custkey AS BIGINT)) AS s, 'bigint' AS id_type FROM customer")
def p1_canonical_ids(spark, sf_dir):
    ids = views.table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("firm_id"))
    out = panels.canonical_ids(ids, "firm_id")
    return out.agg(F.count("*").alias("n"), F.sum("firm_id").alias("s"), F.lit(out.schema["firm_id"].dataType.simpleString()).alias("id_type"))


@query("p2_canonical_quarters", "SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, count(*) AS n FROM orders GROUP BY 1")
def p2_canonical_quarters(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").groupBy(panels.quarter_start(F.col("o_orderdate")).alias("quarter")).agg(F.count("*").alias("n"))


@query("p3_quarter_codecs", with_views("SELECT DISTINCT qoff, CAST(make_date(CAST(1970 + floor((qoff - 1) / 4) AS BIGINT), CAST((qoff - 1) % 4 * 3 + 3 AS BIGINT), 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, 'Q' || (qoff - 120) AS label FROM panel", PANEL))
def p3_quarter_codecs(spark, sf_dir):
    q = views.panel(spark, sf_dir).select("qoff").distinct()
    return q.select("qoff", panels.quarter_end(F.col("qoff")).alias("quarter_end"), panels.relative_label(F.col("qoff") - 120).alias("label"))


FEATURES = """features AS (
 SELECT p.firm_id, p.qoff, p.net AS net_level_0, {levels}, {yoys}, {labels} FROM panel p {joins})""".format(
    levels=", ".join(f"m{k}.net AS net_level_{k}" for k in range(1, 4)),
    yoys=", ".join(f"{'p' if k == 0 else f'm{k}'}.net - m{k + 4}.net AS net_yoy_{k}" for k in range(4)),
    labels=", ".join(f"a{h}.net AS net_t{h}" for h in range(1, 5)),
    joins=" ".join([f"LEFT JOIN panel m{k} ON m{k}.firm_id = p.firm_id AND m{k}.qoff = p.qoff - {k}" for k in range(1, 8)] + [f"LEFT JOIN panel a{h} ON a{h}.firm_id = p.firm_id AND a{h}.qoff = p.qoff + {h}" for h in range(1, 5)]),
)
FEATURE_COLUMNS = [f"net_level_{k}" for k in range(4)] + [f"net_yoy_{k}" for k in range(4)] + [f"net_t{h}" for h in range(1, 5)]


@query("w10_calendar_features", with_views("SELECT firm_id, qoff, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURE_COLUMNS) + " FROM features", PANEL, FEATURES))
def w10_calendar_features(spark, sf_dir):
    return rounded(panels.features(views.panel(spark, sf_dir), "net"), *FEATURE_COLUMNS)


@query("p5_melt_labels", with_views("SELECT target, horizon, count(value) AS n, round(sum(value), 4) AS s FROM (" + " UNION ALL ".join(f"SELECT 'net' AS target, {h} AS horizon, net_t{h} AS value FROM features" for h in range(1, 5)) + ") GROUP BY 1, 2", PANEL, FEATURES))
def p5_melt_labels(spark, sf_dir):
    wide = panels.features(views.panel(spark, sf_dir), "net")
    columns = [f"{t}_t{h}" for t, h in panels.label_columns(wide.columns)]
    long = panels.melt(wide, ["firm_id", "qoff"], columns)
    return rounded(long.groupBy("target", "horizon").agg(F.count("value").alias("n"), F.sum("value").alias("s")), "s", digits=4)


@query("a25_avg_growth", with_views("SELECT firm_id, qoff, round((coalesce(net_yoy_0,0)+coalesce(net_yoy_1,0)+coalesce(net_yoy_2,0)+coalesce(net_yoy_3,0)) / nullif((net_yoy_0 IS NOT NULL)::INT+(net_yoy_1 IS NOT NULL)::INT+(net_yoy_2 IS NOT NULL)::INT+(net_yoy_3 IS NOT NULL)::INT, 0), 6) AS growth FROM features", PANEL, FEATURES))
def a25_avg_growth(spark, sf_dir):
    rows = panels.features(views.panel(spark, sf_dir), "net")
    return rounded(rows.select("firm_id", "qoff", panels.row_mean([f"net_yoy_{k}" for k in range(4)]).alias("growth")), "growth")


@query("p10_listwise_drop", with_views("SELECT count(*) AS n FROM features WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLUMNS), PANEL, FEATURES))
def p10_listwise_drop(spark, sf_dir):
    return panels.features(views.panel(spark, sf_dir), "net").dropna(how="any", subset=FEATURE_COLUMNS).agg(F.count("*").alias("n"))


@query("p8_level_panel", with_views("SELECT firm_id, qoff, round(net_level_0, 6) AS net FROM features", PANEL, FEATURES))
def p8_level_panel(spark, sf_dir):
    wide = panels.features(views.panel(spark, sf_dir), "net")
    return wide.select("firm_id", "qoff", *[F.round(c, 6).alias(c.removesuffix("_level_0")) for c in wide.columns if c.endswith("_level_0")])


@query("p9_numeric_coercion", "SELECT count(TRY_CAST(substr(p_type, 1, 3) AS FLOAT)) AS bad, count(TRY_CAST(CAST(p_size AS VARCHAR) AS FLOAT)) AS good FROM part")
def p9_numeric_coercion(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    return part.agg(F.count(F.substring("p_type", 1, 3).try_cast("float")).alias("bad"), F.count(F.col("p_size").cast("string").try_cast("float")).alias("good"))


@query("p7_dense_grid", with_views("SELECT s.firm_id, count(*) AS n_grid, count(p.total) AS n_seen FROM (SELECT firm_id, unnest(range(min(qoff), max(qoff) + 1)) AS qoff FROM sparse GROUP BY firm_id) s LEFT JOIN sparse p ON p.firm_id = s.firm_id AND p.qoff = s.qoff GROUP BY 1", SPARSE))
def p7_dense_grid(spark, sf_dir):
    grid = panels.dense(views.sparse_panel(spark, sf_dir), "firm_id", "qoff", "total")
    return grid.groupBy("firm_id").agg(F.count("*").alias("n_grid"), F.count("total").alias("n_seen"))


@query("p11_finite_filter", "SELECT count(*) AS n, count(CASE WHEN l_quantity % 7 <> 0 AND l_quantity % 5 <> 0 THEN 1 END) AS n_finite FROM lineitem")
def p11_finite_filter(spark, sf_dir):
    q = F.col("l_quantity")
    odd = F.when(q % 7 == 0, F.lit(float("nan"))).when(q % 5 == 0, F.lit(float("inf"))).otherwise(q)
    return views.table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.count(maths.finite(odd)).alias("n_finite"))


@query("p12_sector_exclusion", "SELECT p_brand, count(*) AS n FROM part WHERE NOT (nullif(p_size, 7) BETWEEN 10 AND 20) GROUP BY p_brand")
def p12_sector_exclusion(spark, sf_dir):
    return views.table(spark, sf_dir, "part").where(~F.expr("nullif(p_size, 7)").between(10, 20)).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("p17_filter_sets", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 3) GROUP BY n_name")
def p17_filter_sets(spark, sf_dir):
    nations = views.table(spark, sf_dir, "nation").where(F.col("n_regionkey").isin(1, 3))
    both = views.table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name").agg(F.count("*").alias("n"))


TALL = """tall AS (SELECT firm_id, qoff, 'net' AS account, net AS value FROM panel UNION ALL SELECT firm_id, qoff, 'qty', qty FROM panel
 UNION ALL SELECT firm_id, qoff, 'disc', CASE WHEN (firm_id + qoff) % 3 = 0 THEN NULL ELSE disc END FROM panel)"""


def tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panel(spark, sf_dir).withColumn("disc", F.when((F.col("firm_id") + F.col("qoff")) % 3 != 0, F.col("disc")))
    return p.unpivot(["firm_id", "qoff"], ["net", "qty", "disc"], "account", "value")


WINDOW = """origins AS (SELECT DISTINCT firm_id, qoff FROM panel),
win AS (SELECT o.firm_id, o.qoff, t.account, t.qoff - o.qoff AS rel, t.value FROM origins o JOIN tall t ON t.firm_id = o.firm_id AND t.qoff BETWEEN o.qoff - 7 AND o.qoff + 4 WHERE t.value IS NOT NULL)"""


def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = views.panel(spark, sf_dir).select("firm_id", "qoff").distinct()
    return origins.windows(chosen, tall(spark, sf_dir).where("value is not null"), 8, 4).select("firm_id", "qoff", "account", "rel", "value")


@query("j12_window_slice", with_views("SELECT qoff, rel, count(*) AS n, round(sum(value), 4) AS s FROM win GROUP BY 1, 2", PANEL, TALL, WINDOW))
def j12_window_slice(spark, sf_dir):
    return rounded(window_rows(spark, sf_dir).groupBy("qoff", "rel").agg(F.count("*").alias("n"), F.sum("value").alias("s")), "s", digits=4)


@query("p6_window_pivot", with_views("SELECT firm_id, qoff, account, " + ", ".join(f"round(max(CASE WHEN rel = {k} THEN value END), 6) AS q{k + 7}" for k in range(-7, 1)) + " FROM win WHERE rel <= 0 GROUP BY 1, 2, 3", PANEL, TALL, WINDOW))
def p6_window_pivot(spark, sf_dir):
    rows = window_rows(spark, sf_dir).where("rel <= 0").withColumn("rel", F.col("rel") + 7)
    out = rows.groupBy("firm_id", "qoff", "account").pivot("rel", list(range(8))).agg(F.first("value"))
    return out.select("firm_id", "qoff", "account", *[F.round(F.col(str(k)), 6).alias(f"q{k}") for k in range(8)])


@query("j13_future_grid", with_views("SELECT account, count(*) AS n FROM (SELECT DISTINCT firm_id, qoff, account FROM win) a CROSS JOIN range(1, 5) r(h) WHERE NOT EXISTS (SELECT 1 FROM win w WHERE w.firm_id = a.firm_id AND w.qoff = a.qoff AND w.account = a.account AND w.rel = r.h) GROUP BY 1", PANEL, TALL, WINDOW))
def j13_future_grid(spark, sf_dir):
    return origins.future_grid(window_rows(spark, sf_dir), 4).groupBy("account").agg(F.count("*").alias("n"))


@query("p13_present_in_q0", with_views("SELECT account, count(*) AS n FROM win w WHERE rel <= 0 OR EXISTS (SELECT 1 FROM win z WHERE z.firm_id = w.firm_id AND z.qoff = w.qoff AND z.account = w.account AND z.rel = 0) GROUP BY 1", PANEL, TALL, WINDOW))
def p13_present_in_q0(spark, sf_dir):
    rows = window_rows(spark, sf_dir)
    now = rows.where("rel = 0").select("firm_id", "qoff", "account", F.lit(True).alias("now"))
    return rows.join(now, ["firm_id", "qoff", "account"], "left").where("rel <= 0 or now").groupBy("account").agg(F.count("*").alias("n"))


@query("p14_scale_account", with_views("SELECT account, count(*) AS n FROM win WHERE account <> 'qty' OR rel = 0 GROUP BY 1", PANEL, TALL, WINDOW))
def p14_scale_account(spark, sf_dir):
    return window_rows(spark, sf_dir).where("account <> 'qty' or rel = 0").groupBy("account").agg(F.count("*").alias("n"))


@query("p15_active_accounts", with_views("SELECT firm_id, qoff, account, max(CASE WHEN rel = 0 THEN 1 ELSE 0 END) = 1 AS at_q0 FROM win WHERE rel <= 0 GROUP BY 1, 2, 3", PANEL, TALL, WINDOW))
def p15_active_accounts(spark, sf_dir):
    return window_rows(spark, sf_dir).where("rel <= 0").groupBy("firm_id", "qoff", "account").agg(F.max(F.col("rel") == 0).alias("at_q0"))


@query("m10_masks", with_views("SELECT account, count(CASE WHEN rel > 0 THEN 1 END) AS masked, count(CASE WHEN rel > 0 AND account <> 'qty' THEN 1 END) AS masked_unless_pinned FROM win GROUP BY 1", PANEL, TALL, WINDOW))
def m10_masks(spark, sf_dir):
    ahead = F.col("rel") > 0
    return window_rows(spark, sf_dir).groupBy("account").agg(F.count(F.when(ahead, 1)).alias("masked"), F.count(F.when(ahead & (F.col("account") != "qty"), 1)).alias("masked_unless_pinned"))


@query("w1_positional_shift", with_views("SELECT firm_id, qoff, lag(n, 4) OVER w AS back, lead(n, 4) OVER w AS ahead FROM sparse WINDOW w AS (PARTITION BY firm_id ORDER BY qoff)", SPARSE))
def w1_positional_shift(spark, sf_dir):
    w = Window.partitionBy("firm_id").orderBy("qoff")
    return views.sparse_panel(spark, sf_dir).select("firm_id", "qoff", F.lag("n", 4).over(w).alias("back"), F.lead("n", 4).over(w).alias("ahead"))


YTD = """ytd AS (SELECT firm_id, CAST(floor((qoff + 3) / 4) AS INTEGER) AS fy, CAST((qoff + 3) % 4 + 1 AS INTEGER) AS fq, sum(n) OVER (PARTITION BY firm_id, floor((qoff + 3) / 4) ORDER BY qoff) AS ytd FROM sparse)"""


@query("w2_ytd_to_quarter", with_views("SELECT firm_id, fy, fq, CAST(CASE WHEN fq = 1 THEN ytd WHEN lag(fq) OVER w = fq - 1 THEN ytd - lag(ytd) OVER w END AS BIGINT) AS flow FROM ytd WINDOW w AS (PARTITION BY firm_id, fy ORDER BY fq)", SPARSE, YTD))
def w2_ytd_to_quarter(spark, sf_dir):
    rows = views.sparse_panel(spark, sf_dir).withColumns({"fy": F.floor((F.col("qoff") + 3) / 4).cast("int"), "fq": ((F.col("qoff") + 3) % 4 + 1).cast("int")})
    rows = rows.withColumn("ytd", F.sum("n").over(Window.partitionBy("firm_id", "fy").orderBy("qoff")))
    return panels.to_quarterly(rows, "firm_id", "fy", "fq", "ytd").select("firm_id", "fy", "fq", "flow")


@query("w3_rolling_mean", with_views("SELECT firm_id, qoff, round(avg(net) OVER (PARTITION BY firm_id ORDER BY qoff ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS rolled FROM panel", PANEL))
def w3_rolling_mean(spark, sf_dir):
    w = Window.partitionBy("firm_id").orderBy("qoff").rowsBetween(-3, 0)
    return rounded(views.panel(spark, sf_dir).select("firm_id", "qoff", F.avg("net").over(w).alias("rolled")), "rolled")


DATE_RUNS = """gaps AS (SELECT firm_id, last_date, date_diff('day', lag(last_date) OVER w, last_date) AS gap FROM sparse WINDOW w AS (PARTITION BY firm_id ORDER BY last_date)),
date_runs AS (SELECT *, sum(CASE WHEN gap > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY firm_id ORDER BY last_date) AS run_id FROM gaps)"""


@query("w4_gap_flags", with_views("SELECT firm_id, last_date, gap FROM gaps", SPARSE, DATE_RUNS))
def w4_gap_flags(spark, sf_dir):
    return origins.date_runs(views.sparse_panel(spark, sf_dir), "firm_id", "last_date").select("firm_id", "last_date", "gap")


@query("w5_date_islands", with_views("SELECT firm_id, CAST(run_id AS BIGINT) AS run_id, count(*) AS n, min(last_date) AS first, max(last_date) AS last FROM date_runs GROUP BY 1, 2", SPARSE, DATE_RUNS))
def w5_date_islands(spark, sf_dir):
    rows = origins.date_runs(views.sparse_panel(spark, sf_dir), "firm_id", "last_date")
    return rows.groupBy("firm_id", "run_id").agg(F.count("*").alias("n"), F.min("last_date").alias("first"), F.max("last_date").alias("last"))


RUNS = """marked AS (SELECT firm_id, qoff, qoff - row_number() OVER (PARTITION BY firm_id ORDER BY qoff) AS g FROM sparse),
runs AS (SELECT firm_id, qoff, min(qoff) OVER r AS run_start, CAST(row_number() OVER (PARTITION BY firm_id, g ORDER BY qoff) - 1 AS INTEGER) AS run_idx, count(*) OVER r AS run_size FROM marked WINDOW r AS (PARTITION BY firm_id, g))"""


@query("w6_run_positions", with_views("SELECT * FROM runs", SPARSE, RUNS))
def w6_run_positions(spark, sf_dir):
    return origins.runs(views.sparse_panel(spark, sf_dir).select("firm_id", "qoff"))


@query("w7_keep_first", "SELECT l_orderkey, l_linenumber, max(n) AS n, min(l_suppkey) AS l_suppkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1 GROUP BY 1, 2")
def w7_keep_first(spark, sf_dir):
    from ..operators.scoring import keep_first

    rows = views.table(spark, sf_dir, "lineitem").withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber")))
    rows = rows.withColumn("input_order", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"))
    return keep_first(rows, ["l_orderkey", "l_linenumber"], "input_order").select("l_orderkey", "l_linenumber", "n", "l_suppkey")


@query("w8_first_split_wins", with_views("SELECT split, count(*) AS n FROM (SELECT firm_id, qoff, min(CASE WHEN qoff < 112 THEN 1 WHEN qoff < 120 THEN 2 ELSE 3 END) AS split FROM (SELECT firm_id, qoff FROM sparse UNION ALL SELECT firm_id, qoff FROM sparse WHERE n > 1) GROUP BY 1, 2) GROUP BY 1", SPARSE))
def w8_first_split_wins(spark, sf_dir):
    from ..operators.scoring import keep_first

    rows = views.sparse_panel(spark, sf_dir).withColumn("split", F.when(F.col("qoff") < 112, 1).when(F.col("qoff") < 120, 2).otherwise(3))
    both = rows.unionByName(rows.where("n > 1"))
    return keep_first(both, ["firm_id", "qoff"], "split").groupBy("split").agg(F.count("*").alias("n"))


@query("w9_context_window", with_views("SELECT firm_id, qoff, list(n ORDER BY qoff) OVER (PARTITION BY firm_id ORDER BY qoff ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS context FROM sparse".replace("list(n ORDER BY qoff)", "list(n)"), SPARSE))
def w9_context_window(spark, sf_dir):
    return panels.context(views.sparse_panel(spark, sf_dir), "firm_id", "qoff", "n", 12)


@query("w13_block_starts", with_views("SELECT firm_id, qoff FROM runs WHERE run_idx + 4 <= run_size", SPARSE, RUNS))
def w13_block_starts(spark, sf_dir):
    return origins.runs(views.sparse_panel(spark, sf_dir)).where("run_idx + 4 <= run_size").select("firm_id", "qoff")


@query("w14_future_available", with_views("SELECT firm_id, qoff, CAST(least(20, run_size - run_idx - 1) AS INTEGER) AS max_horizon FROM runs", SPARSE, RUNS))
def w14_future_available(spark, sf_dir):
    rows = origins.runs(views.sparse_panel(spark, sf_dir))
    return rows.select("firm_id", "qoff", F.least(F.lit(20), F.col("run_size") - F.col("run_idx") - 1).cast("int").alias("max_horizon"))


@query("m13_origin_pool_runs", with_views("SELECT firm_id, qoff, CAST(least(20, run_size - run_idx - 1) AS INTEGER) AS max_horizon FROM runs WHERE run_idx + 1 >= 4 AND run_size - run_idx - 1 >= 1", SPARSE, RUNS))
def m13_origin_pool_runs(spark, sf_dir):
    return origins.pool_by_runs(views.sparse_panel(spark, sf_dir).select("firm_id", "qoff"), history=4).select("firm_id", "qoff", "max_horizon")


@query("m12_origin_pool_span", with_views("SELECT p.firm_id, p.qoff, CAST(least(20, 125 - p.qoff) AS INTEGER) AS max_horizon FROM sparse p JOIN (SELECT firm_id, min(qoff) AS a, max(qoff) AS b FROM sparse GROUP BY 1) s USING (firm_id) WHERE p.qoff >= greatest(105, a + 3) AND p.qoff < 125 AND b > p.qoff", SPARSE))
def m12_origin_pool_span(spark, sf_dir):
    return origins.pool_by_span(views.sparse_panel(spark, sf_dir), 105, 125)


@query("m11_centers", with_views("SELECT count(*) AS n FROM (SELECT firm_id, unnest(range(min(qoff) + 3, max(qoff) - 1)) AS c FROM sparse GROUP BY 1) g WHERE EXISTS (SELECT 1 FROM sparse p WHERE p.firm_id = g.firm_id AND p.qoff = g.c)", SPARSE))
def m11_centers(spark, sf_dir):
    p = views.sparse_panel(spark, sf_dir)
    span = p.groupBy("firm_id").agg((F.min("qoff") + 3).alias("a"), (F.max("qoff") - 2).alias("b")).where("a <= b")
    centers = span.select("firm_id", F.explode(F.sequence("a", "b")).alias("qoff"))
    return centers.join(p.select("firm_id", "qoff"), ["firm_id", "qoff"], "left_semi").agg(F.count("*").alias("n"))


@query("o2_origin_sample", with_views("SELECT firm_id, qoff FROM sparse ORDER BY md5(firm_id || '|' || qoff || '|7'), firm_id, qoff LIMIT 50", SPARSE))
def o2_origin_sample(spark, sf_dir):
    return origins.sample(views.sparse_panel(spark, sf_dir).select("firm_id", "qoff"), 50, 7)


@query("o3_firm_blocks", with_views("""SELECT firm_id, qoff + CAST(k AS INTEGER) AS qoff FROM (
 SELECT firm_id, qoff FROM (SELECT firm_id, qoff, row_number() OVER (PARTITION BY firm_id ORDER BY md5(firm_id || '|' || qoff || '|3'), qoff) AS p FROM runs WHERE run_idx + 3 <= run_size) WHERE p = 1
 ORDER BY md5(firm_id || '|3'), firm_id LIMIT 10) CROSS JOIN range(0, 3) r(k)""", SPARSE, RUNS))
def o3_firm_blocks(spark, sf_dir):
    return origins.block_sample(views.sparse_panel(spark, sf_dir), 10, 3, 3)


@query("o4_balanced_blocks")
def o4_balanced_blocks(spark, sf_dir):
    return origins.balanced_blocks(views.sparse_panel(spark, sf_dir), 12, 2, 4, 5)


@query("o5_noise_subset", with_views("SELECT firm_id, qoff FROM (SELECT firm_id, qoff FROM sparse ORDER BY md5(firm_id || '|' || qoff || '|11'), firm_id, qoff LIMIT 20) ORDER BY 1, 2", SPARSE))
def o5_noise_subset(spark, sf_dir):
    return origins.sample(views.sparse_panel(spark, sf_dir).select("firm_id", "qoff"), 20, 11).orderBy("firm_id", "qoff")


@query("o6_limit_after_resume", with_views("SELECT firm_id, qoff FROM sparse WHERE firm_id % 2 = 1 ORDER BY firm_id, qoff LIMIT 25", SPARSE))
def o6_limit_after_resume(spark, sf_dir):
    todo = views.sparse_panel(spark, sf_dir).select("firm_id", "qoff")
    done = todo.where("firm_id % 2 = 0")
    return todo.join(done, ["firm_id", "qoff"], "left_anti").orderBy("firm_id", "qoff").limit(25)


@query("o7_top_values", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def o7_top_values(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query("o8_best_of_grid", with_views("SELECT firm_id, arg_min(qoff, (-total, qoff)) AS qoff FROM sparse GROUP BY 1", SPARSE))
def o8_best_of_grid(spark, sf_dir):
    best = F.min_by("qoff", F.struct((-F.col("total")).alias("v"), "qoff")).alias("qoff")
    return views.sparse_panel(spark, sf_dir).groupBy("firm_id").agg(best)


@query("o1_stable_sort", with_views("SELECT firm_id, qoff, row_number() OVER (ORDER BY total DESC, firm_id, qoff) AS place FROM sparse", SPARSE))
def o1_stable_sort(spark, sf_dir):
    rows = views.sparse_panel(spark, sf_dir).select("firm_id", "qoff", "total")
    return origins.places(rows, [F.desc("total"), F.asc("firm_id"), F.asc("qoff")]).select("firm_id", "qoff", "place")


STATS = """reg_stats AS (SELECT 'net' AS feature, qoff, 2.0::DOUBLE AS k, avg(net) AS mu, coalesce(stddev_samp(net), 1) AS sigma FROM panel WHERE qoff % 3 = 0 GROUP BY qoff)"""


def reg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panel(spark, sf_dir).where("qoff % 3 = 0")
    return p.groupBy("qoff").agg(F.avg("net").alias("mu"), F.coalesce(F.stddev_samp("net"), F.lit(1.0)).alias("sigma")).select(F.lit("net").alias("feature"), "qoff", F.lit(2.0).alias("k"), "mu", "sigma")


@query("j6_exact_stats", with_views("SELECT p.firm_id, p.qoff, coalesce(k, 1) AS k, round(coalesce(mu, 0), 6) AS mu, round(coalesce(sigma, 1), 6) AS sigma FROM panel p LEFT JOIN reg_stats s ON s.qoff = p.qoff", PANEL, STATS))
def j6_exact_stats(spark, sf_dir):
    both = views.panel(spark, sf_dir).select("firm_id", "qoff").join(reg_stats(spark, sf_dir), "qoff", "left")
    both = both.select("firm_id", "qoff", F.coalesce("k", F.lit(1.0)).alias("k"), F.coalesce("mu", F.lit(0.0)).alias("mu"), F.coalesce("sigma", F.lit(1.0)).alias("sigma"))
    return rounded(both, "mu", "sigma")


@query("j7_nearest_stats", with_views("SELECT firm_id, qoff, stat_q, round(mu, 6) AS mu FROM (SELECT p.firm_id, p.qoff, s.qoff AS stat_q, s.mu, row_number() OVER (PARTITION BY p.firm_id, p.qoff ORDER BY abs(s.qoff - p.qoff), s.qoff) AS k FROM panel p CROSS JOIN reg_stats s) WHERE k = 1", PANEL, STATS))
def j7_nearest_stats(spark, sf_dir):
    rows = views.panel(spark, sf_dir).select("firm_id", "qoff", F.lit("net").alias("feature"))
    return rounded(origins.nearest(rows, reg_stats(spark, sf_dir)).select("firm_id", "qoff", "stat_q", "mu"), "mu")


@query("f1_asinh", with_views("SELECT firm_id, qoff, round(asinh(-1000 * net), 6) AS low, round(asinh(3 * net), 6) AS high FROM panel", PANEL))
def f1_asinh(spark, sf_dir):
    x = F.col("net")
    return rounded(views.panel(spark, sf_dir).select("firm_id", "qoff", regular.transform(x, F.lit(-1000.0)).alias("low"), regular.transform(x, F.lit(3.0)).alias("high")), "low", "high")


@query("f2_regularize", with_views("""SELECT firm_id, qoff, round((asinh(2*net)-0.5)/(1.5+1e-8), 6) AS reg, round(sinh(((asinh(2*net)-0.5)/(1.5+1e-8))*1.5+0.5)/(2+1e-8), 6) AS back,
 round(2/(1.5*sqrt(1+(2*net)*(2*net))+1e-8), 6) AS slope FROM panel""".replace("0.5", "0.5::DOUBLE").replace("1.5", "1.5::DOUBLE").replace("1e-8", "1e-8::DOUBLE"), PANEL))
def f2_regularize(spark, sf_dir):
    k, mu, sigma = F.lit(2.0), F.lit(0.5), F.lit(1.5)
    v = F.col("net")
    reg = regular.regularize(v, k, mu, sigma)
    out = views.panel(spark, sf_dir).select("firm_id", "qoff", reg.alias("reg"), regular.de_regularize(reg, k, mu, sigma).alias("back"), regular.derivative(v, k, mu, sigma).alias("slope"))
    return rounded(out, "reg", "back", "slope")


@query("f3_clipped_label", with_views("SELECT firm_id, qoff, round(CASE WHEN disc - 0.05::DOUBLE > 0 THEN greatest(-6.0::DOUBLE, least(6.0::DOUBLE, (asinh(40.0::DOUBLE*(net/(disc-0.05::DOUBLE)))-3)/(0.5::DOUBLE+1e-8::DOUBLE))) END, 6) AS label FROM panel", PANEL))
def f3_clipped_label(spark, sf_dir):
    p = views.panel(spark, sf_dir)
    return rounded(p.select("firm_id", "qoff", regular.label(F.col("net"), F.col("disc") - 0.05, F.lit(40.0), F.lit(3.0), F.lit(0.5)).alias("label")), "label")


@query("f4_clip", with_views("SELECT firm_id, qoff, round(CASE WHEN v IS NOT NULL THEN greatest(5.0::DOUBLE, least(10.0::DOUBLE, v)) END, 6) AS v FROM (SELECT firm_id, qoff, nullif(net, 0) * CASE WHEN qoff % 4 = 0 THEN NULL ELSE 1 END AS v FROM panel)", PANEL))
def f4_clip(spark, sf_dir):
    v = F.when(F.col("qoff") % 4 != 0, F.col("net"))
    return rounded(views.panel(spark, sf_dir).select("firm_id", "qoff", maths.clip(v, 5.0, 10.0).alias("v")), "v")


@query("f5_scale", with_views("SELECT firm_id, qoff, round(coalesce(abs(CASE WHEN qoff % 2 = 0 THEN disc END) + abs(tax) + 1e-3::DOUBLE, abs(gross) + 1e-3::DOUBLE), 6) AS scale FROM panel", PANEL))
def f5_scale(spark, sf_dir):
    p = views.panel(spark, sf_dir)
    return rounded(p.select("firm_id", "qoff", regular.scale(F.when(F.col("qoff") % 2 == 0, F.col("disc")), F.col("tax"), F.col("gross")).alias("scale")), "scale")


@query("a27_kurtosis_grid", with_views("""SELECT feature, n, round(CASE WHEN n < 30 THEN 1 ELSE k END, 6) AS k FROM (
 SELECT feature, max(n) AS n, arg_min(k, (round(abs(e), 9), i)) AS k FROM (
  SELECT 'gross' AS feature, i, pow(10.0::DOUBLE, -2 + 5 * i / 249) AS k, kurtosis_pop(asinh(pow(10.0::DOUBLE, -2 + 5 * i / 249) * gross)) AS e, count(*) AS n FROM panel CROSS JOIN range(0, 250) g(i) GROUP BY i) GROUP BY feature)""", PANEL))
def a27_kurtosis_grid(spark, sf_dir):
    return rounded(panels.best_k(views.panel(spark, sf_dir).select(F.lit("gross").alias("feature"), "gross"), "feature", "gross"), "k")


@query("a16_lead_lag_moments", with_views("""SELECT qoff, round(avg(a), 6) AS mean_ahead, round(stddev_samp(a), 6) AS std_ahead, round(avg(b), 6) AS mean_behind FROM (SELECT qoff, asinh(lead(net, 4) OVER w) AS a, asinh(lag(net, 4) OVER w) AS b FROM panel WINDOW w AS (PARTITION BY firm_id ORDER BY qoff)) GROUP BY qoff""", PANEL))
def a16_lead_lag_moments(spark, sf_dir):
    w = Window.partitionBy("firm_id").orderBy("qoff")
    rows = views.panel(spark, sf_dir).select("qoff", maths.asinh(F.lead("net", 4).over(w)).alias("a"), maths.asinh(F.lag("net", 4).over(w)).alias("b"))
    return rounded(rows.groupBy("qoff").agg(F.avg("a").alias("mean_ahead"), F.stddev_samp("a").alias("std_ahead"), F.avg("b").alias("mean_behind")), "mean_ahead", "std_ahead", "mean_behind")


@query("m15_regularization_stats", with_views("""SELECT qoff, round(avg(mu0) OVER r, 6) AS mu, round(avg(s0) OVER r + 1e-8::DOUBLE, 6) AS sigma, 2.0::DOUBLE AS k FROM (
 SELECT qoff, coalesce((coalesce(ma, 0) + coalesce(mb, 0)) / nullif((ma IS NOT NULL)::INT + (mb IS NOT NULL)::INT, 0), 0) AS mu0,
  CASE WHEN coalesce((coalesce(sa, 0) + coalesce(sb, 0)) / nullif((sa IS NOT NULL)::INT + (sb IS NOT NULL)::INT, 0), 0) = 0 THEN 1 ELSE (coalesce(sa, 0) + coalesce(sb, 0)) / nullif((sa IS NOT NULL)::INT + (sb IS NOT NULL)::INT, 0) END + 1e-8::DOUBLE AS s0
 FROM (SELECT qoff, avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM (
  SELECT qoff, asinh(2 * lead(net, 4) OVER w) AS a, asinh(2 * lag(net, 4) OVER w) AS b FROM panel WINDOW w AS (PARTITION BY firm_id ORDER BY qoff)) GROUP BY qoff)) WINDOW r AS (ORDER BY qoff ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""", PANEL))
def m15_regularization_stats(spark, sf_dir):
    return rounded(panels.regularization_stats(views.panel(spark, sf_dir), "net", 2.0), "mu", "sigma")


@query("j10_outer_stats", with_views("SELECT coalesce(a.qoff, b.qoff) AS qoff, a.n AS n_a, b.n AS n_b FROM (SELECT qoff + 2 AS qoff, count(*) AS n FROM sparse GROUP BY 1) a FULL JOIN (SELECT qoff, count(*) AS n FROM sparse GROUP BY 1) b ON a.qoff = b.qoff", SPARSE))
def j10_outer_stats(spark, sf_dir):
    counts = views.sparse_panel(spark, sf_dir).groupBy("qoff").agg(F.count("*").alias("n_b"))
    moved = counts.select((F.col("qoff") + 2).alias("qoff"), F.col("n_b").alias("n_a"))
    return moved.join(counts, "qoff", "full").select("qoff", "n_a", "n_b")


@query("j11_range_join", "SELECT p_partkey, coalesce(CASE WHEN p_size BETWEEN 1 AND 9 THEN 1 WHEN p_size BETWEEN 5 AND 20 THEN 2 WHEN p_size BETWEEN 30 AND 39 THEN 3 END, 48) AS range_id FROM part")
def j11_range_join(spark, sf_dir):
    ranges = spark.createDataFrame([(1, 9, 1, 0), (5, 20, 2, 1), (30, 39, 3, 2)], "low int, high int, range_id int, `order` int")
    return origins.range_lookup(views.table(spark, sf_dir, "part").select("p_partkey", "p_size"), ranges, "p_size", 48).select("p_partkey", "range_id")


@query("a23_modal_value", "SELECT l_suppkey, l_linenumber FROM (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def a23_modal_value(spark, sf_dir):
    return panels.modal(views.table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber")


@query("a24_attrition", with_views("SELECT min(n) AS least, median(n) AS middle, max(n) AS most FROM (SELECT firm_id, count(*) AS n FROM sparse GROUP BY 1)", SPARSE))
def a24_attrition(spark, sf_dir):
    each = views.sparse_panel(spark, sf_dir).groupBy("firm_id").agg(F.count("*").alias("k"))
    return each.agg(F.min("k").alias("least"), F.median("k").alias("middle"), F.max("k").alias("most"))


@query("a28_year_distribution", "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1")
def a28_year_distribution(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("s23_firm_map", "SELECT c_name, CAST(row_number() OVER (ORDER BY c_name) - 1 AS INTEGER) AS firm_int FROM (SELECT DISTINCT c_name FROM customer)")
def s23_firm_map(spark, sf_dir):
    names = views.table(spark, sf_dir, "customer").select("c_name").distinct()
    return origins.places(names, [F.asc("c_name")]).select("c_name", (F.col("place") - 1).cast("int").alias("firm_int"))


@query("s12_map_equality", "SELECT count(*) AS n_differences FROM ((SELECT n_nationkey, n_name FROM nation EXCEPT ALL SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END FROM nation) UNION ALL (SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END FROM nation EXCEPT ALL SELECT n_nationkey, n_name FROM nation))")
def s12_map_equality(spark, sf_dir):
    a = views.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    b = a.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "X").otherwise(F.col("n_name")))
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("n_differences"))


@query("j9_dimension_names", "SELECT r_name, n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def j9_dimension_names(spark, sf_dir):
    s, n, r = (views.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    both = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


@query("s15_decode_ids", with_views("SELECT lpad(CAST(firm_id AS VARCHAR), 6, '0') AS firm_id, CAST(make_date(CAST(1970 + floor((qoff - 1) / 4) AS BIGINT), CAST((qoff - 1) % 4 * 3 + 3 AS BIGINT), 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS quarter, 'net' AS target FROM panel WHERE firm_id % 3 <> 0", PANEL))
def s15_decode_ids(spark, sf_dir):
    p = views.panel(spark, sf_dir)
    firms = p.where("firm_id % 3 <> 0").select(F.col("firm_id").alias("firm_int"), F.col("firm_id").cast("string").alias("firm_id")).distinct()
    accounts = spark.createDataFrame([(4, "net")], "account_int int, target string")
    known, _ = files.decode(p.select(F.col("firm_id").alias("firm_int"), "qoff", F.lit(4).alias("account_int")), firms, accounts)
    return known.select("firm_id", "quarter", "target")


@query("s13_finalize", with_views("SELECT CAST(firm_id AS VARCHAR) AS firm_id, target, CAST(horizon AS INTEGER) AS forecast_horizon, round(CAST(CAST(prediction AS FLOAT) AS DOUBLE), 4) AS prediction, model FROM forecasts WHERE model = 'drift'", PANEL, views.TRUTH, views.FORECASTS))
def s13_finalize(spark, sf_dir):
    rows = views.forecasts(spark, sf_dir).where("model = 'drift'").withColumnRenamed("horizon", "forecast_horizon")
    out = files.finalize(files.finalize(rows))
    return out.drop("sigma").withColumn("prediction", F.round(F.col("prediction").cast("double"), 4))


IDS = """wide AS (SELECT firm_id, qoff, gross AS revtq, disc AS cogsq, tax AS xsgaq, CASE WHEN qoff % 3 <> 0 THEN qty END AS dpq, net AS capxq FROM panel)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panel(spark, sf_dir)
    return p.select("firm_id", "qoff", F.col("gross").alias("revtq"), F.col("disc").alias("cogsq"), F.col("tax").alias("xsgaq"), F.when(F.col("qoff") % 3 != 0, F.col("qty")).alias("dpq"), F.col("net").alias("capxq"))


@query("f24_derive_all", with_views("SELECT firm_id, qoff, round(revtq - cogsq, 6) AS gpq, round(cogsq + xsgaq, 6) AS xoprq, round(revtq - cogsq - xsgaq - coalesce(dpq, 0), 6) AS oiadpq, round(revtq - cogsq - xsgaq - coalesce(dpq, 0), 6) AS niq, round(-capxq, 6) AS fcfq FROM wide", PANEL, IDS))
def f24_derive_all(spark, sf_dir):
    out = identities.derive(wide(spark, sf_dir))
    return rounded(out.select("firm_id", "qoff", "gpq", "xoprq", "oiadpq", "niq", "fcfq"), "gpq", "xoprq", "oiadpq", "niq", "fcfq")


@query("f25_derive_strict", with_views("SELECT firm_id, qoff, round(revtq - cogsq, 6) AS gpq, round(revtq - cogsq - xsgaq - dpq, 6) AS oiadpq, CAST(NULL AS DOUBLE) AS niq FROM wide", PANEL, IDS))
def f25_derive_strict(spark, sf_dir):
    return rounded(identities.derive(wide(spark, sf_dir), strict=True).select("firm_id", "qoff", "gpq", "oiadpq", "niq"), "gpq", "oiadpq", "niq")


@query("f26_identity_residuals", with_views("SELECT firm_id, qoff, identity, round(residual, 5) + 0.0 AS residual FROM (SELECT firm_id, qoff, 'net' AS identity, gross - disc - net AS residual FROM panel UNION ALL SELECT firm_id, qoff, 'tax', tax - 2 * disc FROM (SELECT * FROM panel) WHERE disc IS NOT NULL)".replace("tax - 2 * disc", "tax - disc"), PANEL))
def f26_identity_residuals(spark, sf_dir):
    out = identities.residuals(views.panel(spark, sf_dir), ["firm_id", "qoff"], {"net": "+gross_0 -disc_0 -net_0", "tax": "+tax_0 -disc_0", "absent": "+nowhere_0 -net_0"})
    return out.withColumn("residual", F.round("residual", 5) + 0.0)


@query("f27_reconcile_one", with_views("SELECT firm_id, qoff, round(gross - 1*g/6, 6) AS gross, round(disc + 2*g/6, 6) AS disc, round(tax + 3*g/6, 6) AS tax FROM (SELECT *, gross - disc - tax AS g FROM panel)", PANEL))
def f27_reconcile_one(spark, sf_dir):
    p = views.panel(spark, sf_dir).withColumns({"v_gross": F.lit(1.0), "v_disc": F.lit(2.0), "v_tax": F.lit(3.0)})
    return rounded(identities.reconcile(p, ["firm_id", "qoff"], [(1.0, "gross"), (-1.0, "disc"), (-1.0, "tax")]), "gross", "disc", "tax")


@query("f27_reconcile_many")
def f27_reconcile_many(spark, sf_dir):
    p = views.panel(spark, sf_dir).withColumns({f"v_{a}": F.lit(v) for a, v in (("gross", 1.0), ("disc", 2.0), ("tax", 3.0), ("net", 1.0))})
    return rounded(identities.reconcile_many(p, ["firm_id", "qoff"], ["gross", "disc", "tax", "net"], ["+gross_0 -disc_0 -net_0", "+net_0 -tax_0"]), "gross", "disc", "tax", "net")


@query("f34_identity_terms", "SELECT DISTINCT '+' || lower(replace(r_name, ' ', '_')) || '_' || r_regionkey AS term, 1.0::DOUBLE AS sign, lower(replace(r_name, ' ', '_')) AS account, r_regionkey AS lag FROM region")
def f34_identity_terms(spark, sf_dir):
    names = F.lower(F.replace(F.col("r_name"), F.lit(" "), F.lit("_")))
    rows = views.table(spark, sf_dir, "region").select(F.concat(F.lit("+"), names, F.lit("_"), F.col("r_regionkey").cast("string")).alias("term")).distinct()
    return identities.parse_terms(rows)


TERMS = """terms(identity, account, lag) AS (VALUES ('a', 'net', 0), ('a', 'disc', 0), ('b', 'disc', 0), ('b', 'disc', 1))"""


@query("j14_identity_complete", with_views("SELECT identity, count(*) AS n FROM (SELECT t.firm_id, t.qoff + m.lag AS q, identity FROM (SELECT * FROM tall WHERE value IS NOT NULL) t JOIN terms m ON m.account = t.account GROUP BY 1, 2, 3 HAVING count(DISTINCT (m.account, lag)) = 2) GROUP BY 1", PANEL, TALL, TERMS))
def j14_identity_complete(spark, sf_dir):
    terms = spark.createDataFrame([("a", "net", 0), ("a", "disc", 0), ("b", "disc", 0), ("b", "disc", 1)], "identity string, account string, lag int")
    return identities.complete(tall(spark, sf_dir).where("value is not null"), terms).groupBy("identity").agg(F.count("*").alias("n"))


@query("j15_identity_edges", with_views("SELECT identity, account, count(*) AS n FROM (SELECT t.firm_id, t.qoff + m.lag AS q, identity, m.account, lag, count(*) OVER (PARTITION BY t.firm_id, t.qoff + m.lag, identity) AS c FROM (SELECT * FROM tall WHERE value IS NOT NULL) t JOIN terms m ON m.account = t.account) WHERE c = 2 GROUP BY 1, 2", PANEL, TALL, TERMS))
def j15_identity_edges(spark, sf_dir):
    terms = spark.createDataFrame([("a", "net", 0), ("a", "disc", 0), ("b", "disc", 0), ("b", "disc", 1)], "identity string, account string, lag int")
    rows = tall(spark, sf_dir).where("value is not null")
    nodes = identities.complete(rows, terms).join(F.broadcast(terms), "identity").withColumn("at", F.col("qoff") - F.col("lag"))
    edges = nodes.join(rows.select("firm_id", F.col("qoff").alias("at"), "account"), ["firm_id", "at", "account"], "left_semi")
    return edges.groupBy("identity", "account").agg(F.count("*").alias("n"))


@query("j8_cascade_features", with_views("SELECT p.firm_id, p.qoff, round(p.net, 6) AS net, round(coalesce(a.tax, 0), 6) AS upstream FROM panel p LEFT JOIN panel a ON a.firm_id = p.firm_id AND a.qoff = p.qoff + 1", PANEL))
def j8_cascade_features(spark, sf_dir):
    p = views.panel(spark, sf_dir)
    ahead = p.select("firm_id", (F.col("qoff") - 1).alias("qoff"), F.col("tax").alias("upstream"))
    return rounded(p.select("firm_id", "qoff", "net").join(ahead, ["firm_id", "qoff"], "left").fillna(0.0, subset=["upstream"]), "net", "upstream")


@query("j17_resume_anti_join", with_views("SELECT count(*) AS n FROM sparse WHERE NOT (n > 1)", SPARSE))
def j17_resume_anti_join(spark, sf_dir):
    p = views.sparse_panel(spark, sf_dir)
    return p.join(p.where("n > 1").select("firm_id", "qoff"), ["firm_id", "qoff"], "left_anti").agg(F.count("*").alias("n"))


@query("j18_stored_or_derived", with_views("SELECT firm_id, qoff, round(coalesce(CASE WHEN qoff % 2 = 0 THEN net END, gross - disc), 6) AS value FROM panel", PANEL))
def j18_stored_or_derived(spark, sf_dir):
    stored = F.when(F.col("qoff") % 2 == 0, F.col("net"))
    return rounded(views.panel(spark, sf_dir).select("firm_id", "qoff", F.coalesce(stored, F.col("gross") - F.col("disc")).alias("value")), "value")


@query("u1_union_splits", with_views("SELECT count(*) AS n FROM (SELECT firm_id FROM sparse WHERE qoff < 110 UNION ALL SELECT firm_id FROM sparse WHERE qoff BETWEEN 110 AND 115)", SPARSE))
def u1_union_splits(spark, sf_dir):
    p = views.sparse_panel(spark, sf_dir)
    return p.where("qoff < 110").unionByName(p.where("qoff between 110 and 115")).agg(F.count("*").alias("n"))


@query("u3_intersection", "SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '2%'")
def u3_intersection(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    return o.where("o_orderpriority like '1%'").select("o_custkey").intersect(o.where("o_orderpriority like '2%'").select("o_custkey"))


@query("u4_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def u4_difference(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select("c_custkey").subtract(views.table(spark, sf_dir, "orders").select("o_custkey"))


@query("m16_q0_repeat", with_views("SELECT firm_id, qoff, CAST(h AS INTEGER) AS horizon, round(net, 6) AS net FROM panel CROSS JOIN range(1, 4) r(h)", PANEL))
def m16_q0_repeat(spark, sf_dir):
    return rounded(producers.q0_repeat(views.panel(spark, sf_dir).select("firm_id", "qoff", "net"), 3), "net")


@query("s19_fingerprint")
def s19_fingerprint(spark, sf_dir):
    return files.fingerprint(views.table(spark, sf_dir, "orders"))


@query("s2_pruned_read", "SELECT sum(o_custkey) AS s, count(*) AS n FROM orders")
def s2_pruned_read(spark, sf_dir):
    return files.pruned(views.table(spark, sf_dir, "orders"), ["o_custkey", "o_missing"], ("o_missing",)).agg(F.sum("o_custkey").alias("s"), F.count("*").alias("n"))


@query("s10_sql_scan", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_totalprice > 1000 GROUP BY 1")
def s10_sql_scan(spark, sf_dir):
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_orderdate >= DATE '1997-01-01' AND o_totalprice > 1000 GROUP BY 1", orders=views.table(spark, sf_dir, "orders"))


@query("m3_linear_grid")
def m3_linear_grid(spark, sf_dir):
    rows = panels.features(views.panel(spark, sf_dir), "net")
    columns = [f"net_level_{k}" for k in range(4)]
    model, best = producers.fit_linear(rows.where("qoff < 112"), rows.where("qoff between 112 and 118"), columns, "net_t1", {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 1.0]})
    return spark.createDataFrame([(name, float(c)) for name, c in zip(columns, model.coefficients)] + [("intercept", float(model.intercept))], "term string, coefficient double")


@query("m6_chained_trees")
def m6_chained_trees(spark, sf_dir):
    rows = views.panel(spark, sf_dir)
    out = producers.chained(rows.where("qoff < 115"), rows.where("qoff >= 115"), ["qty", "gross"], ["disc", "net"], maxIter=3, maxDepth=3)
    return rounded(out.select("firm_id", "qoff", "disc_pred", "net_pred"), "disc_pred", "net_pred")
