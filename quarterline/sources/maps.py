"""Id maps and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .forecasts import file_parts


def id_map(rows: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(id, name), each id once; an id with two names is an error where the map is checked with sizes."""
    return rows.select(F.col(id_col).alias("id"), F.col(name_col).alias("name")).dropDuplicates(["id"])


def check_size(entries: DataFrame, size: int) -> DataFrame:
    """The map if it has exactly the size that a model was built for."""
    n = entries.count()
    if n != size:
        raise ValueError(f"the map has {n} entries, the model {size}")
    return entries


def check_firms(firms: DataFrame, tuples: DataFrame) -> DataFrame:
    """The firm map if every integer id of the tuples lies within it."""
    most = tuples.agg(F.max("firm_id")).first()[0]
    if most is not None and most >= firms.count():
        raise ValueError(f"tuples have the firm {most}, beyond the map")
    return firms


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two maps has and the other has not; none if they are equal in whatever order."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def seed_manifest(spark: SparkSession, path: str, families: DataFrame) -> DataFrame:
    """(file_name, seed, family) of a tab-separated manifest; gaussian where no family is known."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="filename string, seed int").withColumnRenamed("filename", "file_name")
    named = file_parts(rows.select("file_name")).select("file_name", "model")
    both = rows.join(named, "file_name").join(F.broadcast(families), "model", "left")
    return both.select("file_name", "seed", F.coalesce("family", F.lit("gaussian")).alias("family"))
