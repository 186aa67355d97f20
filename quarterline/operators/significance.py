"""Diebold-Mariano tests of loss differentials by origin quarter."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.maths import student_t_tail


def differentials(scored: DataFrame, reference: str) -> DataFrame:
    """Mean squared and absolute loss differences to the reference by model, horizon (0: pooled) and quarter."""
    rows = scored.where("common").select("id", "firm_id", "qoff", "target", "horizon", "r")
    # On the partitioning that the common sample left, instead of a join of the rows with themselves.
    cell = Window.partitionBy("firm_id", "qoff", "target", "horizon")
    rows = rows.withColumn("r_ref", F.max(F.when(F.col("id") == reference, F.col("r"))).over(cell))
    both = rows.where((F.col("id") != reference) & F.col("r_ref").isNotNull())
    both = both.select("id", "horizon", "qoff", (F.col("r_ref") ** 2 - F.col("r") ** 2).alias("d_sq"), (F.abs("r_ref") - F.abs("r")).alias("d_abs"))
    sets = [[F.col("id"), F.col("horizon"), F.col("qoff")], [F.col("id"), F.col("qoff")]]
    out = both.groupingSets(sets, "id", "horizon", "qoff").agg(F.avg("d_sq").alias("d_sq"), F.avg("d_abs").alias("d_abs"), F.count("*").alias("n"))
    return out.withColumn("horizon", F.coalesce("horizon", F.lit(0)))


def gaps(series: DataFrame, keys: list[str], order: str = "qoff") -> DataFrame:
    """Chronological rank and whether any quarter is missing in between."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = series.withColumn("rank", F.dense_rank().over(w)).withColumn("step", F.col(order) - F.lag(order).over(w))
    return rows.groupBy(*keys).agg(F.max("rank").cast("int").alias("quarters"), F.coalesce(F.max(F.col("step") > 1), F.lit(False)).alias("has_gap"))


def newey_west(series: DataFrame, keys: list[str], value: str, bandwidth, order: str = "qoff") -> DataFrame:
    """Mean, long-run variance with Bartlett weights, and t for each group's series; bandwidth is a column.

    The series is one array a group (as many entries as quarters), so the autocovariances need no self-join.
    A long-run variance that is not positive falls back to the variance.
    """
    packed = series.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("x"), F.max(bandwidth).alias("bw"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    packed = packed.withColumn("n_quarters", F.size("x")).withColumn("mean", total(F.col("x")) / F.col("n_quarters"))
    packed = packed.withColumn("dc", F.transform("x", lambda x: x - F.col("mean"))).withColumn("L", F.least(F.greatest("bw", F.lit(0)), F.col("n_quarters") - 1))

    def gamma(lag):
        return F.aggregate(F.zip_with(F.slice("dc", lag + 1, F.greatest(F.col("n_quarters") - lag, F.lit(0))), F.slice("dc", F.lit(1), F.greatest(F.col("n_quarters") - lag, F.lit(0))), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x) / F.col("n_quarters")

    lags = F.when(F.col("L") > 0, F.sequence(F.lit(1), F.greatest("L", F.lit(1)))).otherwise(F.array().cast("array<int>"))
    packed = packed.withColumn("gamma0", gamma(F.lit(0)))
    packed = packed.withColumn("lrv", F.col("gamma0") + 2 * F.aggregate(lags, F.lit(0.0), lambda acc, lag: acc + (1 - lag / (F.col("L") + 1)) * gamma(lag)))
    packed = packed.withColumn("lrv", F.when(F.col("lrv") > 0, F.col("lrv")).otherwise(F.col("gamma0")))
    return packed.select(*keys, "n_quarters", "mean", "lrv", (F.col("mean") / F.nullif(F.sqrt(F.col("lrv") / F.col("n_quarters")), F.lit(0.0))).alias("t"))


def corrected(tests: DataFrame, h) -> DataFrame:
    """The small-sample correction of t for horizon h; t itself where it doesn't apply."""
    T = F.col("n_quarters")
    factor = (T + 1 - 2 * h + h * (h - 1) / T) / T
    return tests.withColumn("t_corrected", F.when(factor > 0, F.col("t") * F.sqrt(factor)).otherwise(F.col("t")))


def with_p_values(tests: DataFrame) -> DataFrame:
    """Adds p by a pandas step over the small table of tests, and a marker: significance from p, direction from t."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["p"] = [student_t_tail(t, n - 1) if t is not None and not math.isnan(t) else None for t, n in zip(batch["t_corrected"], batch["n_quarters"])]
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tests.schema.fields)
    marks = F.when(F.col("p") <= 0.01, 3).when(F.col("p") <= 0.05, 2).when(F.col("p") <= 0.1, 1).otherwise(0)
    return tests.mapInPandas(run, fields + ", p double").withColumn("marker", F.repeat(F.when(F.col("t") < 0, "*").otherwise("†"), marks))
