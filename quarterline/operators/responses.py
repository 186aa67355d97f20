"""Archived responses of text models: parsing, deduplication, usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_NUMBER = r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"


def parse(responses: DataFrame, id_col: str = "custom_id", text_col: str = "completion") -> DataFrame:
    """(id, horizon, code, value) of lines like 'Q1: a=1.5, b=2'.

    A piece without '=' that is a bare number is the tail of a number with thousands separators: the value
    before it is dropped. A later line of the same horizon replaces the earlier, a later pair the earlier pair.
    """
    lines = responses.select(id_col, F.posexplode(F.split(F.trim(text_col), r"\r?\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim("line")).where(F.col("line").rlike(r"^Q\d+:\s*.+$"))
    lines = lines.select(id_col, "line_no", F.regexp_extract("line", r"^Q(\d+):", 1).cast("int").alias("horizon"), F.split(F.regexp_extract("line", r"^Q\d+:\s*(.+)$", 1), ",").alias("pieces"))
    last = Window.partitionBy(id_col, "horizon")
    lines = lines.withColumn("last", F.max("line_no").over(last)).where("line_no = last")
    pieces = F.transform("pieces", lambda p: F.trim(p))
    lines = lines.withColumn("pieces", pieces)

    def pair(p: Column, i: Column) -> Column:
        after = F.get("pieces", i + 1)
        cut = F.coalesce(~after.contains("=") & after.rlike(_NUMBER), F.lit(False))
        key = F.trim(F.substring_index(p, "=", 1))
        value = F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).try_cast("double")
        return F.struct(key.alias("code"), F.when(~cut, value).alias("value"), (p.contains("=") & value.isNotNull()).alias("is_pair"), i.alias("i"))

    pairs = lines.select(id_col, "horizon", F.inline(F.transform("pieces", pair))).where("is_pair")
    w = Window.partitionBy(id_col, "horizon", "code").orderBy(F.col("i").desc())
    return pairs.withColumn("place", F.row_number().over(w)).where("place = 1 and value is not null").select(id_col, "horizon", "code", "value")


def render(rows: DataFrame, keys: list[str], account: str, quarter: str, value: str) -> DataFrame:
    """History as text for each key: a line for each account, values with two digits by quarter, all-null accounts left out."""
    cell = F.struct(F.col(quarter), F.when(F.col(value).isNotNull(), F.format_string("%.2f", F.col(value))).otherwise("").alias("v"))
    lines = rows.groupBy(*keys, account).agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.count(value).alias("some")).where("some > 0")
    line = F.concat_ws(",", F.col(account), F.array_join(F.transform("cells", lambda c: c["v"]), ","))
    lines = lines.withColumn("line", line)
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(account, "line"))), lambda s: s["line"]), "\n").alias("text"))


def fill(template: Column, values: dict[str, object]) -> Column:
    """Literal replacement of {name} tokens; other braces stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.lit(str(value)))
    return template


def keep_largest(archive: DataFrame, key: str, size: str, order: str) -> DataFrame:
    """One row for each key: the largest size, the earliest on a tie; n_copies counts what there was."""
    w = Window.partitionBy(key)
    ranked = archive.withColumn("n_copies", F.count("*").over(w)).withColumn("__place", F.row_number().over(w.orderBy(F.col(size).desc(), F.col(order))))
    return ranked.where("__place = 1").drop("__place")


def error_sets(archive: DataFrame, key: str, error: Column) -> DataFrame:
    """For each key: errored for good (errors alone) or transient (errors and a success)."""
    kind = archive.groupBy(key).agg(F.bool_or(error).alias("err"), F.bool_or(~error).alias("ok"))
    return kind.select(key, F.when(F.col("err") & ~F.col("ok"), "errored").when(F.col("err"), "transient").otherwise("ok").alias("status"))


def bare_model(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "?").otherwise(F.lower(F.trim(F.element_at(F.split(name, "/"), -1))))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")


def usage(json: Column) -> dict[str, Column]:
    """Token counts from a usage block, cached tokens taken out of the prompt's."""
    got = lambda path: F.coalesce(F.get_json_object(json, path).cast("long"), F.lit(0).cast("long"))
    cached = got("$.prompt_tokens_details.cached_tokens")
    return {"input_tokens": F.greatest(got("$.prompt_tokens") - cached, F.lit(0).cast("long")), "output_tokens": got("$.completion_tokens"), "cache_read": cached}


def cost(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds cost from token counts and a rate table by model, per million tokens; a model without rates costs 0."""
    both = rows.join(F.broadcast(rates), "model", "left")
    pay = F.col("input_tokens") * F.col("r_in") + F.col("output_tokens") * F.col("r_out") + F.col("cache_read") * F.col("r_cr") + F.col("cache_write") * F.col("r_cw")
    return both.withColumn("cost", F.coalesce(pay / 1e6, F.lit(0.0))).drop("r_in", "r_out", "r_cr", "r_cw")


def fingerprint(rows: DataFrame, firm: str, date: str, horizon: str) -> DataFrame:
    """sha256 of the sorted (firm, date, horizon) rows, whatever their order and types; a driver-sized set of origins."""
    line = F.concat_ws("\t", F.lpad(F.col(firm).cast("string"), 6, "0"), F.date_format(F.col(date).cast("date"), "yyyy-MM-dd"), F.col(horizon).cast("int").cast("string"))
    return rows.select(line.alias("line")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("sha"))


def self_reported_r2(rows: DataFrame, keys: list[str]) -> DataFrame:
    """R2 and RMSE in change space without the guard of the evaluator; null where the sum of squares is not positive."""
    y = F.col("actual") - F.col("baseline")
    r = F.col("prediction") - F.col("actual")
    good = rows.where(y.isNotNull() & r.isNotNull())
    out = good.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(r * r).alias("sse"), F.sum(y * y).alias("yy"), F.sum(y).alias("sy"))
    sst = F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    return out.select(*keys, "n", F.when(sst > 0, 1 - F.col("sse") / sst).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))
