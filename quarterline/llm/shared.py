"""Reading tables, intermediate tables in the shared folder, and connected components."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import fresh_folder

#: Rows of text in one Arrow batch; keeps a worker's batch small when texts are long.
TEXT_BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Python stages over whole texts get batches of TEXT_BATCH_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


#: Keys that hold more than 1 / HOT of all rows, of which there can be HOT at most, are broadcast in join_by_key.
HOT = 10_000
#: Folders of the tables written by this process that are still there, in order.
_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage.

    A lost executor then costs no more than its running tasks.
    """
    path = fresh_folder(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables. Only for those that nothing reads any more: what was made of them is stored itself."""
    for df in tables:
        _delete(df.sparkSession, df.stored_path)


def written() -> int:
    """A mark for discard_since."""
    return len(_written)


def discard_since(spark: SparkSession, mark: int) -> None:
    """Deletes the tables stored since the mark, when the result that was made of them has been written."""
    for path in _written[mark:]:
        _delete(spark, path)


def join_by_key(rows: DataFrame, keys: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """rows with what keys, a stored table of one row for each value of on, has for them; n is about how many rows a value has.

    Values that hold more than 1 / HOT of all are fewer than HOT whatever the input, so these are broadcast and their rows
    stay where they are. The others are joined by a shuffle in which none of them makes a task of its own.
    """
    often = (keys.agg(F.sum(n)).first()[0] or 0) / HOT
    hot, cold = keys.where(F.col(n) > often), keys.where(F.col(n) <= often)
    few = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(few)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges(a, b); component is the smallest node that links reach.

    In each round the nodes get new pseudo-random ranks, every node goes to its neighbour of least rank, if that is
    below its own, and from there once more in the same way; the links between the nodes so reached are all that the
    next round reads. A node that has a link stays where it is with a probability of at most one half, however
    the ids lie along a chain, so the rounds grow with the logarithm of the number of nodes; they go on until no link is left.
    Each round is written to the shared folder; nothing but whether links are left comes to the driver. Nulls in
    a or b are ignored.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    both = stored(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    steps: list[DataFrame] = []
    while not both.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("rank"), F.col(c).alias("id"))  # noqa: E731, B023
        first = both.groupBy("a").agg(F.min(rank("b")).alias("least")).select(F.col("a").alias("node"), F.least("least", rank("a"))["id"].alias("up"))
        first = stored(first, "hooks")
        second = first.select(F.col("node").alias("up"), F.col("up").alias("top"))
        steps.append(stored(first.join(second, "up").select("node", F.col("top").alias("up")), "steps"))
        left, right = (steps[-1].select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in ("a", "b"))
        moved = both.join(left, "a").join(right, "b").where("up_a <> up_b")
        before, both = both, stored(moved.select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).distinct(), "edges")
        discard(before, first)
    if not steps:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = steps.pop()
    while steps:
        later, step = roots.select(F.col("node").alias("up"), F.col("up").alias("root")), steps.pop()
        before, roots = roots, stored(step.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("up")), "roots")
        discard(before, step)
    least = roots.groupBy("up").agg(F.min("node").alias("component"))
    return stored(roots.join(least, "up").select("node", "component"), "components")


def map_texts(docs: DataFrame, keep: dict[str, str], text_col: str, fields: str, make: Callable, also: tuple[str, ...] = ()) -> DataFrame:
    """Columns of docs (keep: their names to new names) beside what a Python function makes of each whole text.

    make() is called once for each partition and returns f(texts) -> (columns, rows): a list for each of the
    fields, and the index of the text each entry comes from, or None if there is one entry for each text.
    The columns in also are given to f as further lists. Kept columns pass through Arrow unchanged, so nulls and large ids stay exact. A null text counts as empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    small_batches(docs.sparkSession)
    added = _parse_datatype_string(fields)
    schema = StructType([StructField(new, docs.schema[old].dataType) for old, new in keep.items()] + list(added))
    arrow = to_arrow_schema(schema)
    width = len(keep)

    def run(batches):
        import pyarrow as pa

        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                columns, rows = f(*(part.column(width + k).to_pylist() for k in range(1 + len(also))))
                index = None if rows is None else pa.array(rows, type=pa.int64())
                kept = [part.column(k) if index is None else part.column(k).take(index) for k in range(width)]
                made = [pa.array(values, type=arrow.field(width + k).type) for k, values in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([x.cast(arrow.field(k).type) for k, x in enumerate(kept)] + made, schema=arrow)

    source = docs.select(*[F.col(old).alias(f"kept{k}") for k, old in enumerate(keep)], F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"also{k}") for k, c in enumerate(also)])
    return source.mapInArrow(run, schema)


def recall_depth(similarity: float, trees: int, deepest: int, target: float) -> int:
    """The longest prefix at which a pair of this similarity meets in one of the trees with probability target.

    Shortens the prefix step by step from the deepest level, as a forest does for a query.
    """
    for depth in range(deepest, 1, -1):
        if -math.expm1(trees * math.log1p(-(similarity**depth))) >= target:
            return depth
    return 1
