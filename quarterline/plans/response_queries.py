"""Queries of the response archive, of file names and of the streaming operators."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import responses
from ..sources import forecasts as files, views
from ..sources.shared import fresh_folder
from ..sources.views import FORECASTS, PANEL, SPARSE, TRUTH, with_views
from ..streaming import streams
from .registry import query


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


RESPONSES = """answers AS (
 SELECT firm_id || '-' || qoff AS custom_id, firm_id, qoff, 'Sure.' || chr(10) || 'Q01: qty=' || nline || '.5, net=' || (nline * 3) || chr(10) || 'Q2: qty=1,' || nline || ', net=-' || nline || 'e1, bad=x' || chr(10) || 'not a line' AS completion FROM panel)"""
PARSED = """parsed AS (
 SELECT custom_id, CAST(1 AS INTEGER) AS horizon, 'qty' AS code, nline + 0.5::DOUBLE AS value FROM (SELECT firm_id || '-' || qoff AS custom_id, nline FROM panel)
 UNION ALL SELECT custom_id, 1, 'net', nline * 3.0::DOUBLE FROM (SELECT firm_id || '-' || qoff AS custom_id, nline FROM panel)
 UNION ALL SELECT custom_id, 2, 'net', -10.0::DOUBLE * nline FROM (SELECT firm_id || '-' || qoff AS custom_id, nline FROM panel))"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panel(spark, sf_dir)
    n = F.col("nline").cast("string")
    text = F.concat(F.lit("Sure.\nQ01: qty="), n, F.lit(".5, net="), (F.col("nline") * 3).cast("string"), F.lit("\nQ2: qty=1,"), n, F.lit(", net=-"), n, F.lit("e1, bad=x\nnot a line"))
    return p.select(F.concat_ws("-", F.col("firm_id").cast("string"), F.col("qoff").cast("string")).alias("custom_id"), "firm_id", "qoff", text.alias("completion"))


@query("f28_parse_response", with_views("SELECT * FROM parsed", PANEL, PARSED))
def f28_parse_response(spark, sf_dir):
    return responses.parse(answers(spark, sf_dir))


@query("p16_hallucination_filter", with_views("SELECT horizon, count(*) AS n FROM parsed WHERE code = 'net' GROUP BY 1", PANEL, PARSED))
def p16_hallucination_filter(spark, sf_dir):
    active = spark.createDataFrame([("net",), ("tax",)], "code string")
    return responses.parse(answers(spark, sf_dir)).join(F.broadcast(active), "code", "left_semi").groupBy("horizon").agg(F.count("*").alias("n"))


@query("a18_parse_coverage", with_views("SELECT round(count(*) / (SELECT count(*) * 2 * 4 FROM panel), 6) AS coverage FROM parsed", PANEL, PARSED))
def a18_parse_coverage(spark, sf_dir):
    asked = answers(spark, sf_dir)
    each = asked.select("custom_id").join(responses.parse(asked).groupBy("custom_id").agg(F.count("*").alias("k")), "custom_id", "left")
    return each.agg(F.round(F.sum(F.coalesce("k", F.lit(0))) / (F.count("*") * 2 * 4), 6).alias("coverage"))


@query("m17_finish_origins", with_views("""SELECT p.firm_id, p.qoff, r.horizon, r.code, round(r.value, 6) AS prediction, round(CASE r.code WHEN 'net' THEN a.net ELSE a.qty END, 6) AS actual
 FROM parsed r JOIN panel p ON r.custom_id = p.firm_id || '-' || p.qoff LEFT JOIN panel a ON a.firm_id = p.firm_id AND a.qoff = p.qoff + r.horizon
 WHERE r.custom_id IN (SELECT custom_id FROM parsed GROUP BY 1 HAVING count(DISTINCT horizon) >= greatest(1, 4 / 2))""", PANEL, PARSED))
def m17_finish_origins(spark, sf_dir):
    asked = answers(spark, sf_dir)
    parsed = responses.parse(asked)
    enough = parsed.groupBy("custom_id").agg(F.count_distinct("horizon").alias("h")).where(F.col("h") >= max(1, 4 // 2)).select("custom_id")
    rows = parsed.join(enough, "custom_id", "left_semi").join(asked.select("custom_id", "firm_id", "qoff"), "custom_id")
    actual = views.panel(spark, sf_dir).unpivot(["firm_id", "qoff"], ["net", "qty"], "code", "actual").withColumnRenamed("qoff", "at")
    out = rows.withColumn("at", F.col("qoff") + F.col("horizon")).join(actual, ["firm_id", "at", "code"], "left")
    return rounded(out.select("firm_id", "qoff", "horizon", "code", F.col("value").alias("prediction"), "actual"), "prediction", "actual")


@query("p18_render_history", with_views("""SELECT firm_id, string_agg(line, chr(10) ORDER BY account) AS text FROM (
 SELECT firm_id, account, account || ',' || string_agg(CASE WHEN v IS NULL THEN '' ELSE CAST(v AS VARCHAR) END, ',' ORDER BY qoff) AS line
 FROM (SELECT firm_id, qoff, 'n' AS account, CAST(n AS DECIMAL(18,2)) AS v FROM sparse UNION ALL SELECT firm_id, qoff, 'odd', CASE WHEN n % 2 = 1 THEN CAST(n AS DECIMAL(18,2)) END FROM sparse)
 GROUP BY 1, 2 HAVING count(v) > 0) GROUP BY 1""", SPARSE))
def p18_render_history(spark, sf_dir):
    p = views.sparse_panel(spark, sf_dir).withColumns({"n": F.col("n").cast("double"), "odd": F.when(F.col("n") % 2 == 1, F.col("n").cast("double"))})
    return responses.render(p.unpivot(["firm_id", "qoff"], ["n", "odd"], "account", "value"), ["firm_id"], "account", "qoff", "value")


@query("p19_placeholders", "SELECT r_regionkey, 'Look back 12 quarters (Q-11) at ' || r_name || ' {x}' AS prompt FROM region")
def p19_placeholders(spark, sf_dir):
    template = F.concat(F.lit("Look back {back} quarters (Q-{first}) at "), F.col("r_name"), F.lit(" {x}"))
    return views.table(spark, sf_dir, "region").select("r_regionkey", responses.fill(template, {"back": 12, "first": 11}).alias("prompt"))


ARCHIVE = """archive AS (
 SELECT conv_id AS custom_id, turn, role, length(text) AS output_tokens, turn % 3 = 1 AS failed, CASE WHEN role = 'user' THEN 'route/Model-A ' WHEN role = 'assistant' THEN 'model-b' ELSE '' END AS raw_model FROM conversations)"""


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("role") == "user", "route/Model-A ").when(F.col("role") == "assistant", "model-b").otherwise("")
    return views.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("custom_id"), "turn", "role", F.length("text").cast("long").alias("output_tokens"), (F.col("turn") % 3 == 1).alias("failed"), model.alias("raw_model"))


@query("a19_keep_largest", with_views("SELECT custom_id, turn, output_tokens, n_copies FROM (SELECT *, count(*) OVER (PARTITION BY custom_id) AS n_copies, row_number() OVER (PARTITION BY custom_id ORDER BY output_tokens DESC, turn) AS k FROM archive) WHERE k = 1", ARCHIVE))
def a19_keep_largest(spark, sf_dir):
    return responses.keep_largest(archive(spark, sf_dir), "custom_id", "output_tokens", "turn").select("custom_id", "turn", "output_tokens", "n_copies")


@query("a20_error_sets", with_views("SELECT status, count(*) AS n FROM (SELECT custom_id, CASE WHEN bool_or(failed) AND NOT bool_or(NOT failed) THEN 'errored' WHEN bool_or(failed) THEN 'transient' ELSE 'ok' END AS status FROM archive GROUP BY 1) GROUP BY 1", ARCHIVE))
def a20_error_sets(spark, sf_dir):
    return responses.error_sets(archive(spark, sf_dir), "custom_id", F.col("failed")).groupBy("status").agg(F.count("*").alias("n"))


@query("f30_names", with_views("SELECT DISTINCT raw_model, CASE WHEN raw_model = '' THEN '?' ELSE lower(trim(split_part(raw_model, '/', -1))) END AS model, trim(regexp_replace(raw_model, '[^A-Za-z0-9]', '_', 'g'), '_') AS slug FROM archive", ARCHIVE))
def f30_names(spark, sf_dir):
    raw = F.col("raw_model")
    return archive(spark, sf_dir).select("raw_model", responses.bare_model(raw).alias("model"), responses.slug(raw).alias("slug")).distinct()


@query("a21_cost_rollup", with_views("""SELECT coalesce(model, 'all') AS model, sum(output_tokens) AS output_tokens, round(sum(output_tokens * r) / 1e6, 9) AS cost FROM (
 SELECT CASE WHEN raw_model = '' THEN '?' ELSE lower(trim(split_part(raw_model, '/', -1))) END AS model, output_tokens, CASE WHEN raw_model LIKE '%-A%' THEN 2.5 WHEN raw_model = 'model-b' THEN 10.0 ELSE 0.0 END::DOUBLE AS r FROM archive) GROUP BY ROLLUP (model)""", ARCHIVE))
def a21_cost_rollup(spark, sf_dir):
    rates = spark.createDataFrame([("model-a", 1.0, 2.5, 0.1, 1.25), ("model-b", 3.0, 10.0, 0.3, 3.75)], "model string, r_in double, r_out double, r_cr double, r_cw double")
    zero = F.lit(0).cast("long")
    rows = archive(spark, sf_dir).select(responses.bare_model(F.col("raw_model")).alias("model"), "output_tokens", zero.alias("input_tokens"), zero.alias("cache_read"), zero.alias("cache_write"))
    out = responses.cost(rows, rates).rollup("model").agg(F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))
    return rounded(out.select(F.coalesce("model", F.lit("all")).alias("model"), "output_tokens", "cost"), "cost", digits=9)


@query("f32_cost_of", with_views("SELECT custom_id, turn, round(output_tokens * CASE WHEN raw_model LIKE '%-A%' THEN 2.5 WHEN raw_model = 'model-b' THEN 10.0 ELSE 0.0 END::DOUBLE / 1e6, 9) AS cost FROM archive", ARCHIVE))
def f32_cost_of(spark, sf_dir):
    rates = spark.createDataFrame([("model-a", 1.0, 2.5, 0.1, 1.25), ("model-b", 3.0, 10.0, 0.3, 3.75)], "model string, r_in double, r_out double, r_cr double, r_cw double")
    zero = F.lit(0).cast("long")
    rows = archive(spark, sf_dir).select("custom_id", "turn", responses.bare_model(F.col("raw_model")).alias("model"), "output_tokens", zero.alias("input_tokens"), zero.alias("cache_read"), zero.alias("cache_write"))
    return rounded(responses.cost(rows, rates).select("custom_id", "turn", "cost"), "cost", digits=9)


@query("p20_near_cap", with_views("SELECT count(*) AS n FROM archive WHERE output_tokens >= 0.94::DOUBLE * 900", ARCHIVE))
def p20_near_cap(spark, sf_dir):
    return archive(spark, sf_dir).where(F.col("output_tokens") >= 0.94 * 900).agg(F.count("*").alias("n"))


@query("f31_usage", "SELECT event_id, greatest(k - event_id % 3, 0) AS input_tokens, k * 2 AS output_tokens, event_id % 3 AS cache_read FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def f31_usage(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    block = F.to_json(F.struct(F.col("k").alias("prompt_tokens"), (F.col("k") * 2).alias("completion_tokens"), F.struct((F.col("event_id") % 3).alias("cached_tokens")).alias("prompt_tokens_details")))
    return e.withColumn("usage", block).select("event_id", *[c.alias(n) for n, c in responses.usage(F.col("usage")).items()])


@query("s11_jsonl_tolerant", "SELECT count(*) AS n, sum(k) AS s FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 0)")
def s11_jsonl_tolerant(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("line"))
    parsed = e.select(F.from_json("line", "k long, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    return parsed.where("j._corrupt_record is null").agg(F.count("*").alias("n"), F.sum("j.k").alias("s"))


@query("p25_result_lines", "SELECT event_id, 'a' || CAST(json_extract(props, '$.k') AS VARCHAR) AS text, event_id % 4 = 0 AS failed FROM events")
def p25_result_lines(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.lit("a").alias("text")), F.struct(F.lit("tool").alias("type"), F.lit("zz").alias("text")), F.struct(F.lit("text").alias("type"), F.col("k").alias("text")))
    line = F.to_json(F.struct("event_id", F.struct(blocks.alias("content")).alias("message"), F.when(F.col("event_id") % 4 == 0, F.lit("overloaded")).alias("error")))
    shape = "event_id long, message struct<content: array<struct<type: string, text: string>>>, error string"
    j = e.select(F.from_json(line, shape).alias("j"))
    text = F.array_join(F.transform(F.filter("j.message.content", lambda b: b["type"] == "text"), lambda b: b["text"]), "")
    return j.select("j.event_id", text.alias("text"), F.col("j.error").isNotNull().alias("failed"))


@query("s18_result_dedupe", "SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def s18_result_dedupe(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", "user_id")
    return e.union(e.where("event_id % 2 = 0")).dropDuplicates(["event_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("f29_origins_fingerprint", with_views("SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS sha FROM (SELECT lpad(CAST(firm_id AS VARCHAR), 6, '0') || chr(9) || strftime(last_date, '%Y-%m-%d') || chr(9) || n AS line FROM sparse)", SPARSE))
def f29_origins_fingerprint(spark, sf_dir):
    return responses.fingerprint(views.sparse_panel(spark, sf_dir), "firm_id", "last_date", "n")


@query("f33_sum_skipping_nulls", with_views("SELECT firm_id, qoff, CAST(CASE WHEN n % 2 = 0 OR n % 3 = 0 THEN CASE WHEN n % 2 = 0 THEN n ELSE 0 END + CASE WHEN n % 3 = 0 THEN n ELSE 0 END END AS DOUBLE) AS total FROM sparse", SPARSE))
def f33_sum_skipping_nulls(spark, sf_dir):
    from ..functions.maths import sum_skipping_nulls

    n = F.col("n").cast("double")
    return views.sparse_panel(spark, sf_dir).select("firm_id", "qoff", sum_skipping_nulls(F.when(n % 2 == 0, n), F.when(n % 3 == 0, n)).alias("total"))


@query("a17_self_reported_r2", with_views("""SELECT target, horizon, n, round(CASE WHEN yy - sy * sy / n > 0 THEN 1 - sse / (yy - sy * sy / n) END, 6) AS r2, round(sqrt(sse / n), 6) AS rmse FROM (
 SELECT f.target, f.horizon, count(*) AS n, sum((prediction - actual) * (prediction - actual)) AS sse, sum((actual - baseline) * (actual - baseline)) AS yy, sum(actual - baseline) AS sy
 FROM forecasts f JOIN truth t USING (firm_id, qoff, target, horizon) WHERE model = 'drift' AND actual IS NOT NULL AND baseline IS NOT NULL GROUP BY 1, 2)""", PANEL, TRUTH, FORECASTS))
def a17_self_reported_r2(spark, sf_dir):
    rows = views.forecasts(spark, sf_dir).where("model = 'drift'").join(views.truth(spark, sf_dir), ["firm_id", "qoff", "target", "horizon"])
    return rounded(responses.self_reported_r2(rows, ["target", "horizon"]), "r2", "rmse")


@query("a22_noise_dispersion", with_views("""SELECT coalesce(CAST(horizon AS VARCHAR), 'all') AS horizon, round(avg(sd), 6) AS mean, round(quantile_cont(sd, 0.5), 6) AS median, round(quantile_cont(sd, 0.9), 6) AS p90, round(avg(CASE WHEN sd < 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS still FROM (
 SELECT firm_id, qoff, target, horizon, stddev_samp(prediction) AS sd FROM forecasts WHERE model = 'ens' GROUP BY 1, 2, 3, 4 HAVING count(*) = 3) GROUP BY ROLLUP (horizon)""", PANEL, TRUTH, FORECASTS))
def a22_noise_dispersion(spark, sf_dir):
    draws = views.forecasts(spark, sf_dir).where("model = 'ens'").groupBy("firm_id", "qoff", "target", "horizon").agg(F.stddev_samp("prediction").alias("sd"), F.count("*").alias("k")).where("k = 3")
    out = draws.rollup("horizon").agg(F.avg("sd").alias("mean"), F.percentile("sd", 0.5).alias("median"), F.percentile("sd", 0.9).alias("p90"), F.avg((F.col("sd") < 1e-9).cast("double")).alias("still"))
    return rounded(out.withColumn("horizon", F.coalesce(F.col("horizon").cast("string"), F.lit("all"))), "mean", "median", "p90", "still")


@query("s5_file_names", """SELECT * FROM (VALUES ('m__core__predictions.parquet', 'm', 'core', 'test', NULL), ('m__core__test__predictions.parquet', 'm', 'core', 'test', NULL), ('m__core__7__val__predictions.parquet', 'm', 'core', 'val', 7),
 ('deep__a__b__core__test__predictions.parquet', 'deep__a__b', 'core', 'test', NULL), ('x_predictions.parquet', NULL, NULL, NULL, NULL), ('m__core__s7__test__predictions.parquet', 'm__core', 's7', 'test', NULL)) v(file_name, model, feature_set, split, seed)""")
def s5_file_names(spark, sf_dir):
    names = ["m__core__predictions.parquet", "m__core__test__predictions.parquet", "m__core__7__val__predictions.parquet", "deep__a__b__core__test__predictions.parquet", "x_predictions.parquet", "m__core__s7__test__predictions.parquet"]
    return files.file_parts(spark.createDataFrame([(n,) for n in names], "file_name string"))


@query("s6_feature_sets", "SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS feature_set FROM part")
def s6_feature_sets(spark, sf_dir):
    name = F.concat(F.lit("m__"), F.lower(F.get(F.split("p_type", " "), F.lit(0))), F.lit("__test__predictions.parquet"))
    return files.file_parts(views.table(spark, sf_dir, "part").select(name.alias("file_name"))).select("feature_set").distinct()


@query("s9_density_families", "SELECT * FROM (VALUES ('ffnn_laplace_5', 'laplace'), ('m_Student_t', 'student_t'), ('plain', 'gaussian')) v(stem, family)")
def s9_density_families(spark, sf_dir):
    return spark.createDataFrame([("ffnn_laplace_5",), ("m_Student_t",), ("plain",)], "stem string").withColumn("family", files.density_of(F.col("stem")))


@query("u5_feature_set_union", """WITH RECURSIVE tree(name, part) AS (SELECT n_name, n_name FROM nation WHERE n_nationkey < 3 UNION SELECT t.name, n.n_name FROM tree t JOIN nation a ON a.n_name = t.part JOIN nation n ON n.n_nationkey = a.n_nationkey + 7) SELECT name, count(*) AS n FROM tree GROUP BY 1""")
def u5_feature_set_union(spark, sf_dir):
    from ..sources.configs import collect

    rows = [r.asDict() for r in views.table(spark, sf_dir, "nation").collect()]
    by_key = {r["n_nationkey"]: r["n_name"] for r in rows}
    sets = {r["n_name"]: {"columns": [r["n_name"]], "include_sets": [by_key[r["n_nationkey"] + 7]] if r["n_nationkey"] + 7 in by_key else []} for r in rows}
    return spark.createDataFrame([(by_key[k], len(collect(sets, by_key[k], "columns"))) for k in range(3)], "name string, n long")


def _stream_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """A stream over the table events, and a fresh checkpoint in the folder that the session names."""
    schema = views.table(spark, sf_dir, "events").schema
    # As a glob the path may be a file or a folder.
    found = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return found.withColumn("ts", F.col("ts").cast("timestamp")), fresh_folder(spark, "stream")


@query("t1_streaming_stats", "SELECT event_type, count(value) AS n, round(sum(value), 4) AS s, round(sum(value * value), 2) AS ss FROM events GROUP BY 1")
def t1_streaming_stats(spark, sf_dir):
    stream, checkpoint = _stream_files(spark, sf_dir)
    out = streams.drain(streams.sufficient_stats(stream, ["event_type"], "value"), checkpoint)
    return out.select("event_type", "n", F.round("s", 4).alias("s"), F.round("ss", 2).alias("ss"))


@query("t2_streaming_dedupe", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def t2_streaming_dedupe(spark, sf_dir):
    stream, checkpoint = _stream_files(spark, sf_dir)
    out = streams.drain(streams.once_each(stream.select("event_id", "event_type", "ts"), "event_id", "ts", "40 days"), checkpoint, "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("t3_streaming_archive", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def t3_streaming_archive(spark, sf_dir):
    stream, checkpoint = _stream_files(spark, sf_dir)
    for _ in range(2):  # a second run finds nothing new
        streams.archive(stream.select("event_id", "event_type"), f"{checkpoint}-out", checkpoint).awaitTermination()
    return spark.read.schema("event_id long, event_type string").json(f"{checkpoint}-out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("t4_gap_sessions", """SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, sid, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (
 SELECT user_id, ts, event_id, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS g FROM events)) GROUP BY 1, 2) GROUP BY 1""")
def t4_gap_sessions(spark, sf_dir):
    stream, checkpoint = _stream_files(spark, sf_dir)
    runs = streams.drain(streams.gap_runs(stream, "user_id", "ts", "6 hours", "1 day"), checkpoint)
    return runs.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("t5_streaming_quarters", "SELECT CAST(date_trunc('quarter', ts) AS DATE) AS quarter, count(*) AS n FROM events GROUP BY 1")
def t5_streaming_quarters(spark, sf_dir):
    stream, checkpoint = _stream_files(spark, sf_dir)
    out = streams.drain(streams.by_quarter(stream, "ts"), checkpoint)
    return out.select(F.col("quarter").cast("date").alias("quarter"), "n")
