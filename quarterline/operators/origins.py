"""Forecast origins: runs without gaps, pools, windows and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def runs(panel: DataFrame, firm: str = "firm_id", quarter: str = "qoff") -> DataFrame:
    """Adds run_start, run_idx (from 0) and run_size of unbroken quarters; rows are distinct by firm and quarter."""
    w = Window.partitionBy(firm).orderBy(quarter)
    rows = panel.withColumn("run_start", F.col(quarter) - F.row_number().over(w) + 1)
    of_run = Window.partitionBy(firm, "run_start")
    rows = rows.withColumn("run_idx", (F.row_number().over(of_run.orderBy(quarter)) - 1)).withColumn("run_size", F.count("*").over(of_run))
    first = F.min(quarter).over(of_run)
    return rows.withColumn("run_start", first)


def date_runs(rows: DataFrame, firm: str, date: str, gap_days: int = 120) -> DataFrame:
    """Runs by date: a new one starts where more than gap_days lie between two rows."""
    w = Window.partitionBy(firm).orderBy(date)
    gap = F.datediff(F.col(date), F.lag(date).over(w))
    rows = rows.withColumn("gap", gap).withColumn("run_id", F.sum((gap > gap_days).cast("int")).over(w))
    return rows.withColumn("run_id", F.coalesce("run_id", F.lit(0)))


def pool_by_runs(panel: DataFrame, history: int = 8, furthest: int = 20) -> DataFrame:
    """Origins with enough quarters behind them and at least one ahead, in the same run."""
    rows = runs(panel)
    ahead = F.col("run_size") - F.col("run_idx") - 1
    rows = rows.withColumn("max_horizon", F.least(ahead, F.lit(furthest)).cast("int"))
    return rows.where((F.col("run_idx") + 1 >= history) & (ahead >= 1)).select("firm_id", "qoff", "max_horizon", "run_idx", "run_size")


def pool_by_span(panel: DataFrame, start: int, end: int, history: int = 4, furthest: int = 20, valid: Column | None = None) -> DataFrame:
    """Origins by a firm's first and last quarter, blind to when it leaves: max_horizon reaches to the sample's end."""
    span = panel.groupBy("firm_id").agg(F.min("qoff").alias("first"), F.max("qoff").alias("last"))
    rows = panel if valid is None else panel.where(valid)
    rows = rows.select("firm_id", "qoff").distinct().join(span, "firm_id")
    low = F.greatest(F.lit(start), F.col("first") + history - 1)
    rows = rows.where((F.col("qoff") >= low) & (F.col("qoff") < end) & (F.col("last") > F.col("qoff")))
    return rows.select("firm_id", "qoff", F.least(F.lit(furthest), F.lit(end) - F.col("qoff")).cast("int").alias("max_horizon"))


def hash_rank(*keys: Column, seed: int) -> Column:
    """A rank that any engine computes alike: md5 of the keys and the seed."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))))


def sample(origins: DataFrame, n: int, seed: int) -> DataFrame:
    """n origins by hash; the same draw in every run."""
    return origins.orderBy(hash_rank(F.col("firm_id"), F.col("qoff"), seed=seed), "firm_id", "qoff").limit(n)


def block_sample(origins: DataFrame, firms: int, length: int, seed: int) -> DataFrame:
    """A block of consecutive origins from each of some firms; too few firms with a long enough run is an error."""
    rows = runs(origins.select("firm_id", "qoff"))
    starts = rows.where(F.col("run_idx") + length <= F.col("run_size"))
    w = Window.partitionBy("firm_id").orderBy(hash_rank(F.col("firm_id"), F.col("qoff"), seed=seed), "qoff")
    starts = starts.withColumn("__place", F.row_number().over(w)).where("__place = 1")
    chosen = starts.orderBy(hash_rank(F.col("firm_id"), seed=seed), "firm_id").limit(firms)
    if chosen.count() < firms:
        raise ValueError(f"fewer than {firms} firms have {length} consecutive origins")
    return chosen.select("firm_id", F.explode(F.sequence(F.col("qoff"), F.col("qoff") + length - 1)).alias("qoff"))


def balanced_blocks(origins: DataFrame, firms: int, shortest: int, longest: int, seed: int) -> DataFrame:
    """Blocks of hashed length spread over the years of their start: firms take turns year by year."""
    rows = runs(origins.select("firm_id", "qoff"))
    span = F.conv(F.substring(hash_rank(F.col("firm_id"), seed=seed), 1, 6), 16, 10).cast("long") % (longest - shortest + 1) + shortest
    starts = rows.withColumn("length", span.cast("int")).where(F.col("run_idx") + F.col("length") <= F.col("run_size"))
    year = F.floor((F.col("qoff") + 3) / 4).cast("int")
    in_year = Window.partitionBy("year").orderBy(hash_rank(F.col("firm_id"), F.col("qoff"), seed=seed), "firm_id", "qoff")
    turns = starts.withColumn("year", year).withColumn("turn", F.row_number().over(in_year))
    once = Window.partitionBy("firm_id").orderBy("turn", "year", "qoff")
    turns = turns.withColumn("__place", F.row_number().over(once)).where("__place = 1").orderBy("turn", "year", "firm_id").limit(firms)
    return turns.select("firm_id", "year", "length", F.explode(F.sequence(F.col("qoff"), F.col("qoff") + F.col("length") - 1)).alias("qoff"))


def places(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds place, the number of each row from 1 in the given order, without a single task for all rows.

    Rows are dealt by range and numbered within each range; the ranges' sizes, a row each, give what comes before. The
    rows are written in between, so that both see the same ranges. The order should be total.
    """
    from ..sources.shared import fresh_folder

    spark = rows.sparkSession
    path = fresh_folder(spark, "places")
    rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(StructType([*rows.schema.fields, StructField("__range", IntegerType())])).parquet(path)
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn("place", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    out = numbered.join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range")
    return out.select(*rows.columns, (F.col("place") + F.col("__before")).alias("place"))


def windows(origins: DataFrame, panel: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """Panel rows around each origin: an equi-join on the firm with a range on the quarter."""
    rows = panel.withColumnRenamed("qoff", "at")
    near = (F.col("at") >= F.col("qoff") - lookback + 1) & (F.col("at") <= F.col("qoff") + horizon)
    return origins.join(rows, "firm_id").where(near).withColumn("rel", F.col("at") - F.col("qoff"))


def future_grid(window_rows: DataFrame, horizon: int) -> DataFrame:
    """Account and future quarter pairs that a window lacks."""
    accounts = window_rows.select("firm_id", "qoff", "account").distinct()
    grid = accounts.withColumn("rel", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return grid.join(window_rows.select("firm_id", "qoff", "account", "rel"), ["firm_id", "qoff", "account", "rel"], "left_anti")


def nearest(origins: DataFrame, stats: DataFrame, at: str = "qoff") -> DataFrame:
    """For each origin and feature the statistics of the nearest quarter, the earlier on a tie.

    stats has one row for a feature and quarter; features and quarters are few, so the side is broadcast.
    """
    side = stats.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("q"), "k", "mu", "sigma"))).alias("all"))
    both = origins.join(F.broadcast(side), "feature")
    scored = F.transform("all", lambda s: F.struct(F.abs(s["q"] - F.col(at)).alias("d"), s["q"].alias("q"), s["k"].alias("k"), s["mu"].alias("mu"), s["sigma"].alias("sigma")))
    best = F.array_min(scored)
    return both.withColumn("best", best).select(*origins.columns, F.col("best.q").alias("stat_q"), F.col("best.k").alias("k"), F.col("best.mu").alias("mu"), F.col("best.sigma").alias("sigma"))


def range_lookup(rows: DataFrame, ranges: DataFrame, value: str, default: int) -> DataFrame:
    """The first range (by order) that holds the value, else the default; the ranges are a short fixed table."""
    both = rows.join(F.broadcast(ranges), F.col(value).between(F.col("low"), F.col("high")), "left")
    return both.groupBy(*rows.columns).agg(F.min_by("range_id", "order").alias("range_id")).withColumn("range_id", F.coalesce("range_id", F.lit(default)))
