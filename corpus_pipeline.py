"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarterline.llm import jaccard, packing, quality, secrets, substrings
from quarterline.llm.shared import discard_since, read_table, written
from quarterline.sources.shared import fresh_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier accepts."""
    net = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, net, keep=tuple(COLUMNS)).where("predicted = 1").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document, or the same one before, has; documents of which nothing stays go."""
    left = substrings.drop_repeats(docs.select(*COLUMNS), within=True)
    return _columns(left.where((F.col("n_removed") == 0) | (F.trim("text") != "")))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in the texts."""
    return _columns(secrets.masked(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in the training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", repeated_passage_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: Training, near duplicates and column generation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents, each written and read again before the next.

    What a stage stored for itself, and the output of the stage before, are deleted once its own output is written.
    """
    docs = read_table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path, mark = f"{folder}/{k}", written()
        stage(spark, docs, sf_dir).write.parquet(path)
        discard_since(spark, mark)
        if k:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        docs = spark.read.parquet(path)
    return docs
