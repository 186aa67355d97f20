"""Forecast producers and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def seasonal_lag(horizon):
    """How far back the level of the same season stands: horizon 1 uses lag 3, 4 uses lag 0."""
    return (4 - horizon % 4) % 4


def naive_drift(panel: DataFrame, targets: tuple[str, ...], horizons: int) -> DataFrame:
    """(firm_id, qoff, target, horizon, naive, drift): the level of the same season, and that plus average growth.

    Growth is the mean over the last four quarters of the change against the quarter a year before, by
    calendar, nulls skipped; without any, drift is null. Rows without the lagged level have null forecasts.
    All lookbacks are range frames over one shuffle by firm and target.
    """
    long = panel.unpivot(["firm_id", "qoff"], list(targets), "target", "level")
    w = Window.partitionBy("firm_id", "target").orderBy("qoff")

    def back(k: int, name: str):
        return F.max(name).over(w.rangeBetween(-k, -k))

    change = long.withColumn("change", F.col("level") - back(4, "level"))
    growth = F.avg("change").over(w.rangeBetween(-3, 0))
    lags = F.array(*[back(k, "level") if k else F.col("level") for k in range(4)])
    rows = change.select("firm_id", "qoff", "target", growth.alias("growth"), lags.alias("lags"), F.explode(F.sequence(F.lit(1), F.lit(horizons))).alias("horizon"))
    lag = seasonal_lag(F.col("horizon"))
    rows = rows.withColumn("naive", F.get("lags", lag))
    return rows.select("firm_id", "qoff", "target", "horizon", "naive", (F.col("naive") + (F.col("horizon") + lag) * F.col("growth") / 4).alias("drift"))


def q0_repeat(levels: DataFrame, horizon: int) -> DataFrame:
    """The level at the origin for every horizon."""
    return levels.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def ols_by_group(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Closed-form least squares with one feature for each group, rows with a null left out."""
    return pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def fit_linear(train: DataFrame, valid: DataFrame, features: list[str], label: str, grid: dict[str, list[float]]):
    """Elastic-net regression: the grid's best by the validation split's squared error, then refitted on both.

    The grid is tried in order and a later point must be strictly better.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    shaped = [assembler.transform(d.dropna(subset=[*features, label])).select("features", F.col(label).alias("label")) for d in (train, valid)]
    best = None
    for strength in grid.get("regParam", [0.0]):
        for mix in grid.get("elasticNetParam", [0.0]):
            model = LinearRegression(regParam=strength, elasticNetParam=mix).fit(shaped[0])
            error = model.transform(shaped[1]).agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0]
            if best is None or error < best[0]:
                best = (error, strength, mix)
    return LinearRegression(regParam=best[1], elasticNetParam=best[2]).fit(shaped[0].union(shaped[1])), best


def fit_trees(train: DataFrame, features: list[str], label: str, kind: str = "gbt", **params):
    """Boosted or bagged trees on complete rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    shaped = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(train.dropna(subset=[*features, label])).withColumn("label", F.col(label))
    return (GBTRegressor if kind == "gbt" else RandomForestRegressor)(seed=params.pop("seed", 1), **params).fit(shaped)


def predict(model, rows: DataFrame, features: list[str], name: str) -> DataFrame:
    """rows with the model's prediction; rows that lack a feature are left out."""
    from pyspark.ml.feature import VectorAssembler

    shaped = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows.dropna(subset=features))
    return model.transform(shaped).withColumnRenamed("prediction", name).drop("features")


def shared_strength(rows: DataFrame, group: str, features: list[str], label: str, strengths: list[float]) -> tuple[float, dict[float, float]]:
    """The ridge strength with the least mean validation error over all groups, and each one's error.

    rows has split train and val. Fits are as many as groups times strengths; the groups are horizons, so few.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    shaped = VectorAssembler(inputCols=features, outputCol="features").transform(rows.dropna(subset=[*features, label]))
    shaped = shaped.select("split", group, "features", F.col(label).alias("label")).persist()
    groups = sorted(r[0] for r in shaped.select(group).distinct().collect())
    errors = {}
    for strength in strengths:
        each = []
        for g in groups:
            part = shaped.where(F.col(group) == g)
            model = LinearRegression(regParam=strength).fit(part.where("split = 'train'"))
            each.append(model.transform(part.where("split = 'val'")).agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0])
        known = [e for e in each if e is not None]
        errors[strength] = sum(known) / len(known) if known else float("inf")
    shaped.unpersist()
    return min(errors, key=errors.get), errors


def save(model, path: str, made_of: dict) -> None:
    """Stores a fitted model and, beside it, what it was made of."""
    import json

    model.write().overwrite().save(f"{path}/model")
    spark = model.write().sparkSession if hasattr(model.write(), "sparkSession") else SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(made_of | {"class": f"{type(model).__module__}.{type(model).__name__}"}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/made_of")


def load(spark: SparkSession, path: str):
    """A stored model and what it was made of."""
    import importlib
    import json

    made_of = json.loads(spark.read.text(f"{path}/made_of").first()[0])
    module, name = made_of["class"].rsplit(".", 1)
    if not module.startswith("pyspark.ml."):
        raise ValueError(f"{made_of['class']} is no model of pyspark.ml")
    return getattr(importlib.import_module(module), name).load(f"{path}/model"), made_of


def chained(train: DataFrame, test: DataFrame, features: list[str], chain: list[str], **params) -> DataFrame:
    """Fits each item with those before it as features (their true values), then predicts with their predictions; nulls count as 0."""
    from pyspark.ml.feature import VectorAssembler

    out = test
    for step, item in enumerate(chain):
        before = chain[:step]
        used = [*features, *before]
        model = fit_trees(train.fillna(0.0, subset=before) if before else train, used, item, **params)
        ahead = out.select("*", *[F.coalesce(F.col(f"{b}_pred"), F.lit(0.0)).alias(f"__{b}") for b in before])
        shaped = VectorAssembler(inputCols=[*features, *[f"__{b}" for b in before]], outputCol="features", handleInvalid="keep").transform(ahead)
        out = model.transform(shaped).withColumnRenamed("prediction", f"{item}_pred").drop("features", *[f"__{b}" for b in before])
    return out


def coefficient_summary(c):
    """Norms and sparsity of an array of coefficients, as columns by name."""
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + F.abs(x))
    nonzero = F.size(F.filter(c, lambda x: x != 0))
    return {
        "l1": total,
        "l2": F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)),
        "largest": F.array_max(F.transform(c, lambda x: F.abs(x))),
        "mean": total / F.nullif(F.size(c), F.lit(0)),
        "nonzero": nonzero,
        "sparsity": 1 - nonzero / F.nullif(F.size(c), F.lit(0)),
    }


def from_quantiles(knots, limit: float = 6.0):
    """Point and spread of a sampled forecast's sorted quantiles: clipped median and mean, sigma by moments and by the 10-90 span."""
    from ..functions import maths, quantiles

    clipped = F.transform(knots, lambda z: F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))
    low, mid, high = (quantiles.LEVELS.index(t) for t in (0.1, 0.5, 0.9))
    return {
        "median": maths.clip(F.get(knots, F.lit(mid)), -limit, limit),
        "mean": quantiles.mean(clipped),
        "moment_sigma": quantiles.moment_sigma(knots),
        "sigma": quantiles.sigma_from_pair(F.get(knots, F.lit(low)), F.get(knots, F.lit(high)), 0.1, 0.9),
    }


def graph_rows(rows: DataFrame, key: str, at: str, center: int) -> DataFrame:
    """A window's nodes as flat rows: future ones are masked, and each key gets a node for its industry that never is."""
    nodes = rows.select(key, at, (F.col(at) <= center).alias("visible"), F.lit(False).alias("is_industry"))
    extra = rows.select(key).distinct().select(key, F.lit(0).alias(at), F.lit(True).alias("visible"), F.lit(True).alias("is_industry"))
    return nodes.unionByName(extra)


#: Producer types by name; the neural ones of the domain are outside this engine and are called through mapInPandas.
PRODUCERS: dict[str, Callable] = {"naive_drift": naive_drift, "q0_repeat": q0_repeat, "ols": ols_by_group, "linear": fit_linear, "trees": fit_trees, "chained": chained}


def produce(kind: str, *args, **kwargs):
    if kind not in PRODUCERS:
        raise ValueError(f"unknown producer {kind}; there are {', '.join(sorted(PRODUCERS))}")
    return PRODUCERS[kind](*args, **kwargs)


def with_function(frame: DataFrame, function: Callable, schema: str) -> DataFrame:
    """A user's producer: an iterator of pandas frames in, tall forecast rows out."""
    return frame.mapInPandas(function, schema)
