"""Keys, calendar features, regularisation statistics and other panel operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.maths import asinh


def canonical_ids(frame: DataFrame, column: str) -> DataFrame:
    """Ids as integers if every one of them is one, else as they are."""
    counts = frame.agg(F.count(column), F.count(F.col(column).try_cast("bigint"))).first()
    return frame.withColumn(column, F.col(column).cast("bigint")) if counts[0] == counts[1] else frame


def quarter_start(stamp: Column) -> Column:
    return F.date_trunc("quarter", stamp).cast("date")


def quarter_end(qoff: Column) -> Column:
    """Last day of the quarter of an offset; 0 is the last quarter of 1969."""
    return F.last_day(F.make_date(1970 + F.floor((qoff - 1) / 4), F.pmod(qoff - 1, F.lit(4)) * 3 + 3, F.lit(1)))


def relative_label(rel: Column) -> Column:
    return F.concat(F.lit("Q"), rel.cast("string"))


def label_columns(columns: list[str]) -> list[tuple[str, int]]:
    """(target, horizon) of the columns <target>_t<horizon> whose <target>_level_0 is there too."""
    found = (re.fullmatch(r"(.+)_t(\d+)", c) for c in columns)
    return sorted((m[1], int(m[2])) for m in found if m and f"{m[1]}_level_0" in columns)


def melt(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Label columns as rows (target, horizon, value)."""
    long = wide.unpivot(keys, columns, "name", "value")
    return long.select(*keys, F.regexp_extract("name", r"^(.+)_t\d+$", 1).alias("target"), F.regexp_extract("name", r"_t(\d+)$", 1).cast("int").alias("horizon"), "value")


def dense(panel: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Every quarter between a key's first and last, null where the panel has none."""
    span = panel.groupBy(key).agg(F.sequence(F.min(order), F.max(order)).alias("all")).select(key, F.explode("all").alias(order))
    return span.join(panel.select(key, order, value), [key, order], "left")


def context(panel: DataFrame, key: str, order: str, value: str, length: int) -> DataFrame:
    """The last values up to each row, oldest first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - length, 0)
    return panel.select(key, order, F.collect_list(value).over(w).alias("context"))


def features(panel: DataFrame, value: str, lags: int = 4, yoy: int = 4, horizons: int = 4) -> DataFrame:
    """Calendar levels, changes against the year before, and labels; null where the panel has no such quarter."""
    w = Window.partitionBy("firm_id").orderBy("qoff")
    at = lambda k: F.max(value).over(w.rangeBetween(k, k)) if k else F.col(value)
    columns = {f"{value}_level_{k}": at(-k) for k in range(lags)}
    columns |= {f"{value}_yoy_{k}": at(-k) - at(-k - 4) for k in range(yoy)}
    columns |= {f"{value}_t{h}": at(h) for h in range(1, horizons + 1)}
    return panel.select("firm_id", "qoff", *[c.alias(n) for n, c in columns.items()])


def row_mean(columns: list[str]) -> Column:
    """Mean of a row's values that are not null; null if all are, 0 without columns."""
    if not columns:
        return F.lit(0.0)
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0)) / F.nullif(n, F.lit(0))


def to_quarterly(rows: DataFrame, firm: str, year: str, quarter: str, value: str) -> DataFrame:
    """Year-to-date values as those of the quarter: the first as it is, others less the quarter before, null if that is missing."""
    w = Window.partitionBy(firm, year).orderBy(quarter)
    before, at = F.lag(value).over(w), F.lag(quarter).over(w)
    return rows.withColumn("flow", F.when(F.col(quarter) == 1, F.col(value)).when(at == F.col(quarter) - 1, F.col(value) - before))


def best_k(values: DataFrame, feature: str, value: str, points: int = 250) -> DataFrame:
    """For each feature the k of a logarithmic grid that brings the kurtosis of asinh(k v) nearest 3; 1 below 30 values.

    The grid is a fixed number of columns' worth of rows; kurtosis is one pass of partial aggregates.
    """
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.alias("i"), F.pow(F.lit(10.0), -2 + 5 * i / (points - 1)).alias("k"))))
    rows = values.where(F.col(value).isNotNull()).select(feature, value, grid.alias("g")).select(feature, value, "g.i", "g.k")
    each = rows.groupBy(feature, "i", "k").agg(F.kurtosis(asinh(F.col("k") * F.col(value))).alias("excess"), F.count("*").alias("n"))
    best = each.groupBy(feature).agg(F.min(F.struct(F.abs("excess").alias("off"), "i", "k")).alias("best"), F.max("n").alias("n"))
    return best.select(feature, "n", F.when(F.col("n") < 30, 1.0).otherwise(F.col("best.k")).alias("k"))


def regularization_stats(panel: DataFrame, value: str, k: float, lead: int = 4) -> DataFrame:
    """mu and sigma for each quarter: means of the lead and lag transforms, rolled over four quarters."""
    w = Window.partitionBy("firm_id").orderBy("qoff")
    rows = panel.select("qoff", *[asinh(F.lit(k) * f(value, lead).over(w)).alias(n) for n, f in (("ahead", F.lead), ("behind", F.lag))])
    each = rows.groupBy("qoff").agg(F.avg("ahead").alias("ma"), F.stddev_samp("ahead").alias("sa"), F.avg("behind").alias("mb"), F.stddev_samp("behind").alias("sb"))
    mu = F.coalesce(row_mean(["ma", "mb"]), F.lit(0.0))
    sigma = row_mean(["sa", "sb"])
    each = each.select("qoff", mu.alias("mu0"), (F.when(F.coalesce(sigma, F.lit(0.0)) == 0, 1.0).otherwise(sigma) + 1e-8).alias("s0"))
    # One row for each quarter of the calendar.
    roll = Window.partitionBy(F.lit(0)).orderBy("qoff").rowsBetween(-3, 0)
    return each.select("qoff", F.avg("mu0").over(roll).alias("mu"), (F.avg("s0").over(roll) + 1e-8).alias("sigma"), F.lit(k).alias("k"))


def splits(rows: DataFrame, at: str, bounds: dict[str, tuple[int | None, int | None]]) -> DataFrame:
    """Adds split: the first whose bounds, both included, hold the value; rows of none are left out."""
    split = F.lit(None).cast("string")
    for name, (first, last) in reversed(bounds.items()):
        inside = (F.col(at) >= first if first is not None else F.col(at).isNotNull()) & (F.col(at) <= last if last is not None else F.lit(True))
        split = F.when(inside, F.lit(name)).otherwise(split)
    return rows.withColumn("split", split).where("split is not null")


def modal(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value for each key, the smallest on a tie."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias(value))
