"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def once_each(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """One row for each key across restarts; keys older than the delay are forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def sufficient_stats(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts and sums that grow with each batch; to be written in update or complete mode."""
    v = F.col(value)
    return stream.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))


def gap_runs(stream: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Sessions that end where more than the gap passes."""
    runs = stream.withWatermark(time, delay).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return runs.select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "n")


def by_quarter(stream: DataFrame, time: str) -> DataFrame:
    return stream.groupBy(F.date_trunc("quarter", time).alias("quarter")).agg(F.count("*").alias("n"))


def archive(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new as JSON lines and goes on from the checkpoint after a stop."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is and returns the result table, as Parquet beside the checkpoint.

    A batch that is run again after a stop writes its own folder again; in complete mode the last batch is the result.
    """
    path, spark = f"{checkpoint}-result", stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{0 if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(f"{path}/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stream.schema)
