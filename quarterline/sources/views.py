"""Domain views over the driver's tables: panels, labels, forecasts, and the SQL of each for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

HORIZONS = 8
TARGETS = ("net", "qty")
SEEDS = (1, 2, 3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quarter_offset(date):
    """Quarters since the last of 1969."""
    return ((F.year(date) - 1969) * 4 + F.quarter(date) - 4).cast("int")


def _money(expr, digits: int = 6):
    """Exact sum: the order of summation can't change it."""
    return F.sum(expr.cast(f"decimal(28,{digits})")).cast("double")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each supplier and calendar quarter; one shuffle, with partial sums before it."""
    lines = table(spark, sf_dir, "lineitem")
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    return (
        lines.groupBy(F.col("l_suppkey").alias("firm_id"), quarter_offset(F.col("l_shipdate")).alias("qoff"))
        .agg(
            (_money(F.col("l_quantity")) / 1000).alias("qty"),
            (_money(price) / 100000).alias("gross"),
            (_money(price * off) / 100000).alias("disc"),
            (_money(price * (1 - off) * F.col("l_tax"), 8) / 100000).alias("tax"),
            F.count("*").alias("nline"),
        )
        .withColumn("net", F.col("gross") - F.col("disc"))
    )


PANEL = """panel AS (
 SELECT *, gross - disc AS net FROM (
  SELECT l_suppkey AS firm_id, CAST((year(l_shipdate) - 1969) * 4 + quarter(l_shipdate) - 4 AS INTEGER) AS qoff,
   CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) / 1000 AS qty,
   CAST(sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS DOUBLE) / 100000 AS gross,
   CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(28,6))) AS DOUBLE) / 100000 AS disc,
   CAST(sum(CAST(l_extendedprice * (1 - l_discount) * l_tax AS DECIMAL(28,8))) AS DOUBLE) / 100000 AS tax,
   count(*) AS nline FROM lineitem GROUP BY 1, 2))"""


def sparse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("firm_id"), quarter_offset(F.col("o_orderdate")).alias("qoff")).agg(
        (_money(F.col("o_totalprice")) / 1000).alias("total"), F.count("*").alias("n"), F.max(F.to_date("o_orderdate")).alias("last_date")
    )


SPARSE = """sparse AS (
 SELECT o_custkey AS firm_id, CAST((year(o_orderdate) - 1969) * 4 + quarter(o_orderdate) - 4 AS INTEGER) AS qoff,
  CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) / 1000 AS total, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS last_date
 FROM orders GROUP BY 1, 2)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by calendar: actual of each target h quarters ahead, null where the panel has no such quarter."""
    long = panel(spark, sf_dir).unpivot(["firm_id", "qoff"], list(TARGETS), "target", "baseline")
    ahead = long.select("firm_id", (F.col("qoff")).alias("at"), "target", F.col("baseline").alias("actual"))
    grid = long.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(HORIZONS))))
    joined = grid.withColumn("at", F.col("qoff") + F.col("horizon")).join(ahead, ["firm_id", "target", "at"], "left")
    return joined.select("firm_id", "qoff", "target", "horizon", "actual", "baseline")


TRUTH = """long AS (SELECT firm_id, qoff, 'net' AS target, net AS baseline FROM panel UNION ALL SELECT firm_id, qoff, 'qty', qty FROM panel),
truth AS (
 SELECT l.firm_id, l.qoff, l.target, CAST(h AS INTEGER) AS horizon, a.baseline AS actual, l.baseline
 FROM long l CROSS JOIN range(1, 9) r(h) LEFT JOIN long a ON a.firm_id = l.firm_id AND a.target = l.target AND a.qoff = l.qoff + h)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive, drift and three seeds of an ensemble; columns of a tall forecast."""
    from ..operators.producers import naive_drift

    base = naive_drift(panel(spark, sf_dir), TARGETS, HORIZONS)
    plain = base.select("firm_id", "qoff", "target", "horizon", F.lit("naive").alias("model"), F.lit(None).cast("int").alias("seed"), F.col("naive").alias("prediction"), F.lit(None).cast("double").alias("sigma"))
    drift = base.select("firm_id", "qoff", "target", "horizon", F.lit("drift").alias("model"), F.lit(None).cast("int").alias("seed"), F.col("drift").alias("prediction"), (0.4 + 0.05 * F.col("horizon")).alias("sigma"))
    seeds = base.withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    shift = 0.01 * ((F.col("firm_id") * 31 + F.col("horizon") * 17 + F.col("seed") * 7) % 13 - 6)
    sigma = 0.5 + 0.05 * F.col("horizon") + 0.1 * ((F.col("firm_id") + F.col("seed")) % 5)
    seeds = seeds.where((F.col("firm_id") + F.col("horizon")) % 11 != F.col("seed"))
    ens = seeds.select("firm_id", "qoff", "target", "horizon", F.lit("ens").alias("model"), "seed", (F.col("naive") + shift).alias("prediction"), sigma.alias("sigma"))
    return plain.unionByName(drift).unionByName(ens).where(F.col("prediction").isNotNull())


FORECASTS = """base AS (
 SELECT l.firm_id, l.qoff, l.target, CAST(h AS INTEGER) AS horizon, b.baseline AS naive,
  b.baseline + (h + (4 - h % 4) % 4) * g.growth / 4 AS drift
 FROM long l CROSS JOIN range(1, 9) r(h)
 LEFT JOIN long b ON b.firm_id = l.firm_id AND b.target = l.target AND b.qoff = l.qoff - (4 - h % 4) % 4
 LEFT JOIN (
  SELECT a.firm_id, a.qoff, a.target, avg(c.baseline - d.baseline) AS growth FROM long a
  JOIN long c ON c.firm_id = a.firm_id AND c.target = a.target AND c.qoff BETWEEN a.qoff - 3 AND a.qoff
  JOIN long d ON d.firm_id = c.firm_id AND d.target = c.target AND d.qoff = c.qoff - 4 GROUP BY 1, 2, 3) g
 ON g.firm_id = l.firm_id AND g.target = l.target AND g.qoff = l.qoff),
forecasts AS (
 SELECT * FROM (
  SELECT firm_id, qoff, target, horizon, 'naive' AS model, CAST(NULL AS INTEGER) AS seed, naive AS prediction, CAST(NULL AS DOUBLE) AS sigma FROM base
  UNION ALL SELECT firm_id, qoff, target, horizon, 'drift', NULL, drift, CAST(0.4 AS DOUBLE) + CAST(0.05 AS DOUBLE) * horizon FROM base
  UNION ALL SELECT firm_id, qoff, target, horizon, 'ens', CAST(s AS INTEGER), naive + CAST(0.01 AS DOUBLE) * ((firm_id * 31 + horizon * 17 + s * 7) % 13 - 6),
   CAST(0.5 AS DOUBLE) + CAST(0.05 AS DOUBLE) * horizon + CAST(0.1 AS DOUBLE) * ((firm_id + s) % 5)
  FROM base CROSS JOIN range(1, 4) q(s) WHERE (firm_id + horizon) % 11 <> s) WHERE prediction IS NOT NULL)"""


def with_views(body: str, *views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body


SCORED = (PANEL, TRUTH, FORECASTS)
