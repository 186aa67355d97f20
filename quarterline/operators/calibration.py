"""Calibration of mixtures and quantile forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import density, quantiles
from .scoring import CELL

COVERAGES = (0.5, 0.8, 0.9, 0.95)
BINS = 20


def mixture_cells(scored: DataFrame, model: str, family: str, seeds: tuple[int, ...]) -> DataFrame:
    """PIT, CRPS and z2 of the equal mixture of a model's seeds, for the common cells with a positive sigma of each."""
    if family == "student_t":
        raise ValueError("mixtures of student_t are not calibrated")
    rows = scored.where((F.col("model") == model) & F.col("common") & (F.col("sigma") > 0))
    each = [F.max(F.when(F.col("seed") == k, F.struct("r", "sigma"))).alias(f"k{k}") for k in seeds]
    cells = rows.groupBy(*CELL).agg(*each).dropna(subset=[f"k{k}" for k in seeds])
    rs, ss = [F.col(f"k{k}.r") for k in seeds], [F.col(f"k{k}.sigma") for k in seeds]
    n = len(seeds)
    mean = sum(rs, F.lit(0.0)) / n
    spread = sum(((r - mean) * (r - mean) for r in rs), F.lit(0.0)) / n
    second = sum((s * s for s in ss), F.lit(0.0)) / n
    pit = sum((density.cdf_at_actual(r, s, family) for r, s in zip(rs, ss)), F.lit(0.0)) / n
    return cells.select(*CELL, pit.alias("pit"), density.mixture_crps(rs, ss, family).alias("crps"), (mean * mean / (second + spread)).alias("z2"))


def by_horizon(cells: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregates for each horizon and pooled."""
    out = cells.rollup("horizon").agg(F.grouping("horizon").alias("__all"), *aggs)
    return out.withColumn("horizon", F.when(F.col("__all") == 1, "pooled").otherwise(F.col("horizon").cast("string"))).drop("__all")


def covered(pit: Column, share: float) -> Column:
    """Closed central interval."""
    return pit.between((1 - share) / 2, (1 + share) / 2)


def coverage(cells: DataFrame) -> DataFrame:
    shares = [F.avg(covered(F.col("pit"), c).cast("double")).alias(f"cover_{int(c * 100)}") for c in COVERAGES]
    return by_horizon(cells, F.count("*").alias("n"), *shares, F.avg("pit").alias("mean_pit"), F.avg("z2").alias("z2"), F.avg("crps").alias("crps"))


def pit_histogram(cells: DataFrame) -> DataFrame:
    bin_ = F.least(F.floor(F.col("pit") * BINS), F.lit(BINS - 1)).cast("int")
    counts = cells.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    total = cells.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("bin", "n", (F.col("n") / F.col("total") * BINS).alias("density"))


def quantile_cells(forecasts: DataFrame, truth: DataFrame, limit: float = 6.0) -> DataFrame:
    """PIT, CRPS and saturation of quantile forecasts; knots are sorted, which repairs crossings."""
    rows = forecasts.join(truth, CELL).where(F.col("actual").isNotNull())
    knots, y = F.col("knots"), F.col("actual")
    rows = rows.withColumn("crossed", knots != F.array_sort(knots)).withColumn("knots", F.array_sort(knots))
    saturated = (F.element_at(knots, -1) == F.element_at(knots, 1)) | (F.abs(y) >= limit)
    return rows.select(*CELL, "crossed", saturated.alias("saturated"), quantiles.pit(knots, y).alias("pit"), quantiles.crps(knots, y).alias("crps"), quantiles.mean(knots).alias("mean"))


def saturation_split(cells: DataFrame) -> DataFrame:
    group = F.when(F.col("saturated"), "saturated").otherwise("interior").alias("part")
    total = cells.agg(F.count("*").alias("total"))
    split = cells.groupBy(group).agg(F.count("*").alias("n"), F.avg("crps").alias("crps"), F.avg("pit").alias("mean_pit"))
    return split.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")
