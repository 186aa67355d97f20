"""Scoring: forecasts against truth over a sample that all models share, at four levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import density, maths

CELL = ["firm_id", "qoff", "target", "horizon"]
LEVELS = {0: "by_target_horizon", 1: "by_target", 2: "by_horizon", 3: "global"}


def display_id(model: str = "model", seed: str = "seed") -> Column:
    return F.concat(F.col(model), F.coalesce(F.concat(F.lit("__seed"), F.col(seed).cast("string")), F.lit("")))


def keep_first(forecasts: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key in the input's order."""
    w = Window.partitionBy(*key).orderBy(order)
    return forecasts.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def residuals(forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    """Forecast rows with a cell of the truth; r is null where prediction or actual is."""
    joined = forecasts.join(truth, CELL)
    return joined.withColumn("id", display_id()).withColumn("r", F.col("prediction") - F.col("actual"))


def unmatched(forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    return forecasts.join(truth.select(*CELL), CELL, "left_anti").groupBy("model").agg(F.count("*").alias("n_unmatched"))


def common_sample(scored: DataFrame, models: int | None = None) -> DataFrame:
    """Adds common: the cell has an actual, a baseline and a residual of every model.

    One window over the cell, on the partitioning that the join left, instead of a join for each model.
    """
    n = models or scored.select("id").distinct().count()
    seen = F.count(F.when(F.col("r").isNotNull() & F.col("baseline").isNotNull(), 1)).over(Window.partitionBy(*CELL))
    return scored.withColumn("common", seen == n)


def check_models(scored: DataFrame, expected: set[str], allow_missing: bool = False) -> None:
    """A model that is missing changes everyone's sample, so that is an error unless it is allowed."""
    found = {row["id"] for row in scored.select("id").distinct().collect()}
    if expected - found and not allow_missing:
        raise ValueError(f"no forecasts of {', '.join(sorted(expected - found))}")


def roll_up(rows: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Aggregates at the four levels in one pass; level names which."""
    sets = [[*keys, "target", "horizon"], [*keys, "target"], [*keys, "horizon"], keys]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, "target", "horizon"]])
    out = out.agg(F.grouping("target").alias("__t"), F.grouping("horizon").alias("__h"), *aggs)
    level = F.when((F.col("__t") == 0) & (F.col("__h") == 0), LEVELS[0]).when(F.col("__t") == 0, LEVELS[1]).when(F.col("__h") == 0, LEVELS[2]).otherwise(LEVELS[3])
    return out.withColumn("level", level).drop("__t", "__h")


def truth_stats() -> list[Column]:
    y = F.when(F.col("common"), F.col("actual") - F.col("baseline"))
    return [F.count(y).alias("n_complete"), maths.steady_sum(y).alias("sum_y"), maths.steady_sum(y * y).alias("sum_y2"), F.count_distinct(F.when(F.col("actual").isNotNull(), F.col("qoff"))).alias("quarters")]


def point_scores(scored: DataFrame) -> DataFrame:
    """R2, MAE, observations for each model at each level; the order of the rows does not change them."""
    r = F.when(F.col("common"), F.col("r"))
    stats = roll_up(scored, ["id"], *truth_stats(), F.count("r").alias("n_obs"), maths.steady_sum(r * r).alias("sum_r2"), maths.steady_sum(F.abs(r)).alias("sum_abs"), F.count(r).alias("n_metric"))
    return with_metrics(stats)


def with_metrics(stats: DataFrame) -> DataFrame:
    n = F.col("n_complete")
    sst = F.col("sum_y2") - F.col("sum_y") * F.col("sum_y") / F.nullif(n, F.lit(0))
    return stats.withColumns({
        "r2": F.when(sst > 1e-15, 1 - F.col("sum_r2") / (sst + 1e-12)),
        "mae": F.col("sum_abs") / F.nullif(n, F.lit(0)),
        "avg_obs": F.col("n_obs") / F.nullif(F.col("quarters"), F.lit(0)),
    })


def invariant_violations(stats: DataFrame) -> DataFrame:
    return stats.where("n_metric <> n_complete")


def density_scores(scored: DataFrame, meta: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Mean NLL, CRPS and z2 of each model over the common cells with a sigma; z2 for gaussian models alone."""
    rows = scored.where("common").join(F.broadcast(meta), "model", "left").withColumn("family", F.coalesce("family", F.lit("gaussian")))
    s = density.floored(F.col("sigma"), floor)
    r = F.col("r")
    nll = F.when(F.col("family") == "laplace", density.nll(r, s, "laplace")).when(F.col("family") == "student_t", density.nll(r, s, "student_t", 6.0)).otherwise(density.nll(r, s, "gaussian"))
    crps = F.when(F.col("family") == "laplace", density.crps(r, s, "laplace")).when(F.col("family") == "gaussian", density.crps(r, s, "gaussian"))
    z2 = F.when(F.col("family") == "gaussian", (r / s) * (r / s))
    rows = rows.where(s.isNotNull()).select("*", nll.alias("nll"), crps.alias("crps"), z2.alias("z2"))
    return roll_up(rows, ["id"], F.avg("nll").alias("nll"), F.avg("crps").alias("crps"), F.avg("z2").alias("z2"), F.count("nll").alias("n"))


def seed_mixture_nll(scored: DataFrame, family: str, model: str, seeds: int, floor: float = 1e-4) -> DataFrame:
    """NLL of the equal mixture of a model's seeds over the cells that all of them have."""
    s = density.floored(F.col("sigma"), floor)
    rows = scored.where(F.col("common") & (F.col("model") == model) & s.isNotNull()).withColumn("nll", density.nll(F.col("r"), s, family))
    cells = rows.groupBy(*CELL).agg(F.collect_list("nll").alias("each")).where(F.size("each") == seeds)
    return roll_up(cells.withColumn("nll", density.mixture_nll(F.col("each"))), [], F.avg("nll").alias("mixture_nll"), F.count("*").alias("n"))


def seed_summary(scores: DataFrame) -> DataFrame:
    """Mean and spread of a metric over the seeds of a model, at each level."""
    model = F.split("id", "__seed")
    rows = scores.where(F.col("id").contains("__seed")).withColumn("model", F.get(model, F.lit(0)))
    return rows.groupBy("model", "level", "target", "horizon").agg(F.avg("r2").alias("r2_mean"), F.stddev_samp("r2").alias("r2_std"), F.avg("mae").alias("mae_mean"), F.count_distinct("id").alias("n_seeds"))


def pivot_models(scores: DataFrame, keys: list[str], metric: str, models: list[str]) -> DataFrame:
    """A column for each model that has the metric at all."""
    return scores.where(F.col(metric).isNotNull()).groupBy(*keys).pivot("id", models).agg(F.first(metric))


def ensemble(forecasts: DataFrame) -> DataFrame:
    """Moment-matched mean of the seeds; one unusable sigma anywhere in the arm makes the whole arm point-only."""
    mean = forecasts.groupBy(*CELL, "model").agg(
        F.avg("prediction").alias("prediction"),
        F.sqrt(F.avg(F.col("sigma") * F.col("sigma")) + F.var_pop("prediction")).alias("sigma"),
        F.count("*").alias("n_seeds"),
        F.bool_and(F.col("sigma").isNotNull()).alias("usable"),
    )
    arm = forecasts.groupBy("model").agg(F.bool_and(F.col("sigma").isNotNull()).alias("arm_usable"))
    return mean.join(F.broadcast(arm), "model").withColumn("sigma", F.when(F.col("arm_usable"), F.col("sigma"))).drop("usable", "arm_usable")
