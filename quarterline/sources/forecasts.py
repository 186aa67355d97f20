"""Forecast files: naming, discovery, densities, the output schema and its sinks."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMA = {"firm_id": "string", "target": "string", "quarter": "date", "forecast_horizon": "int", "prediction": "float", "sigma": "float", "model": "string"}


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by suffix; anything else is an error."""
    kind = PurePosixPath(path.rstrip("/")).suffix.lower()
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    raise ValueError(f"neither .parquet nor .csv: {path}")


def pruned(frame: DataFrame, columns: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """The columns; an optional one that is missing is left out, another is an error."""
    return frame.select(*[c for c in columns if c in frame.columns or c not in optional])


def file_parts(names: DataFrame, column: str = "file_name") -> DataFrame:
    """Adds model, feature_set, split, seed from the right of a name; what doesn't match has a null model.

    model__features__predictions (split test), model__features__split__predictions, or with an integer seed
    between features and split; the model itself may hold the separator.
    """
    stem = F.regexp_replace(F.col(column), r"\.parquet$", "")
    parts = F.split(stem, "__")
    n = F.size(parts)
    at = lambda k: F.get(parts, n - k)
    ok = (n >= 3) & (at(1) == "predictions") & F.col(column).endswith("predictions.parquet")
    seeded = (n >= 5) & at(3).rlike(r"^\d+$")
    head = lambda k: F.array_join(F.slice(parts, 1, F.greatest(n - k, F.lit(0))), "__")
    pick = lambda three, five, four: F.when(ok, F.when(n == 3, three).when(seeded, five).otherwise(four))
    return names.withColumns({
        "model": pick(F.get(parts, F.lit(0)), head(4), head(3)),
        "feature_set": pick(F.get(parts, F.lit(1)), at(4), at(3)),
        "split": pick(F.lit("test"), at(2), at(2)),
        "seed": F.when(ok & seeded, at(3).cast("int")),
    })


def read_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """All forecast files of a folder with the parts of their names; others are left out."""
    rows = spark.read.parquet(f"{folder}/*predictions.parquet")
    named = rows.withColumn("file_name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*predictions\.parquet)", 1))
    return file_parts(named.drop("model")).where("model is not null")


def density_of(stem: Column) -> Column:
    """Family by the file's stem where no sidecar names it."""
    return F.when(F.lower(stem).contains("laplace"), "laplace").when(F.lower(stem).contains("student"), "student_t").otherwise("gaussian")


def read_sidecars(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(model, family, dof) of JSON sidecars; one that is broken or lacks a family means gaussian."""
    rows = spark.read.schema("family string, df double").option("multiLine", "true").json(paths)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.nll\.json(?:/|$)", 1)
    return rows.select(stem.alias("model"), F.coalesce("family", F.lit("gaussian")).alias("family"), F.col("df").alias("dof"))


def finalize(forecasts: DataFrame) -> DataFrame:
    """The output schema in its order, numbers as float, other columns dropped; the same if done twice."""
    return forecasts.select(*[F.col(c).cast(kind) for c, kind in SCHEMA.items() if c in forecasts.columns])


def write(forecasts: DataFrame, path: str, partitions: tuple[str, ...] = ()) -> bool:
    """Writes finalised forecasts as zstd Parquet; Spark's committer publishes them at the end. False if there are none."""
    rows = finalize(forecasts)
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*partitions).parquet(path)
    return True


def decode(rows: DataFrame, firms: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names for the ids and dates for the offsets; and the number of rows whose id is unknown."""
    both = rows.join(F.broadcast(firms), "firm_int", "left").join(F.broadcast(accounts), "account_int", "left")
    last_month = F.make_date(1970 + F.floor((F.col("qoff") - 1) / 4), F.pmod(F.col("qoff") - 1, F.lit(4)) * 3 + 3, F.lit(1))
    named = both.withColumn("quarter", F.last_day(last_month)).withColumn("firm_id", F.lpad("firm_id", 6, "0"))
    known = F.col("firm_id").isNotNull() & F.col("target").isNotNull()
    return named.where(known), named.where(~known).agg(F.count("*").alias("n_unmapped"))


def fingerprint(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, columns and sums of row hashes as one hash: the same content gives the same, in any order; a null is not an empty value.

    columns: those that count, by default all. Two sums of differently seeded hashes, added up in partial aggregates.
    """
    cells = [x for c in sorted(columns or frame.columns) for x in (F.col(c), F.col(c).isNull())]
    sums = [F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return frame.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.lit(",".join(sorted(frame.columns))), *sums), 256).alias("fingerprint"))


class Cache:
    """A table beside a manifest of what it was built from; any difference rebuilds it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def get(self, manifest: dict, build) -> DataFrame:
        want = json.dumps(manifest, sort_keys=True)
        try:
            row = self.spark.read.text(f"{self.path}/manifest").first()
        except AnalysisException as error:  # no manifest, no cache; anything else is not for us to overwrite
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        have = row[0] if row else None
        if have != want:
            build().write.mode("overwrite").parquet(f"{self.path}/data")
            self.spark.createDataFrame([(want,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest")
        return self.spark.read.parquet(f"{self.path}/data")
