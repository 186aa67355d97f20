"""Near-duplicate embeddings: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import connected_components, read_table, stored

COSINE = 0.93
#: Tables, rotations of a table's code, and buckets of each table that a vector is put in, where two rotations suffice.
TABLES, ROTATIONS, PROBES = 10, 2, 4
#: A rotation more is taken while a bucket would hold more than this many vectors on average.
HELD = 64
#: Vectors of a bucket that are compared at once; larger buckets are compared block against block.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their number of columns is a power of two."""
    width = x.shape[1]
    step = 1
    while step < width:
        x = x.reshape(-1, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, width)
        step *= 2
    return x


def buckets(x: np.ndarray, tables: int = TABLES, rotations: int = ROTATIONS, probes: int = PROBES, seed: int = 5) -> np.ndarray:
    """Codes of the nearest buckets, rows by tables by probes.

    A pseudo-random rotation is three rounds of random signs and a Hadamard transform. A rotation's hash is
    the nearest of the axes and their opposites; a table's code joins several. The probes are the codes whose
    coordinates are the largest after the best: per rotation the second, then both second.
    """
    rng = np.random.default_rng(seed)
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    padded /= np.maximum(np.linalg.norm(padded, axis=1, keepdims=True), 1e-300)
    out = np.zeros((len(x), tables, probes), dtype=np.int64)
    rows = np.arange(len(x))[:, None]
    for t in range(tables):
        options = np.zeros((len(x), 1), dtype=np.int64)
        losses = np.zeros((len(x), 1))
        for _ in range(rotations):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width)) / width**0.5
            size = np.abs(y)
            take = min(probes, width)
            axis = np.argsort(-size, axis=1, kind="stable")[:, :take]
            code = 2 * axis + (y[rows, axis] < 0)
            loss = size[rows, axis[:, :1]] - size[rows, axis]
            options = (options[:, :, None] * (2 * width) + code[:, None, :]).reshape(len(x), -1)
            losses = (losses[:, :, None] + loss[:, None, :]).reshape(len(x), -1)
            best = np.argsort(losses, axis=1, kind="stable")[:, :probes]
            options, losses = options[rows, best], losses[rows, best]
        out[:, t, : options.shape[1]] = options
        out[:, t, options.shape[1] :] = options[:, :1]
    return out


def plan(n: int, width: int, cosine: float = COSINE, recall: float = 0.999) -> tuple[int, int, int]:
    """(tables, rotations, probes) for n vectors of a width: buckets get finer as the vectors get more, so that their size stays.

    For more rotations than ROTATIONS the tables and probes are those with the fewest buckets a vector at which pairs
    at the threshold, drawn at random, meet with the given recall.
    """
    codes = 2 << max(1, (width - 1).bit_length())
    rotations = ROTATIONS
    while n * PROBES > HELD * codes**rotations and codes ** (rotations + 1) < 1 << 62:
        rotations += 1
    if rotations == ROTATIONS and cosine >= COSINE:
        return TABLES, ROTATIONS, PROBES
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 1500, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + (1 - cosine**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    found = []
    for probes in (4, 8, 16, 32):
        x, y = (buckets(v, 2, rotations, probes) for v in (a, b))
        met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3)).mean()
        tables = int(np.ceil(np.log(1 - recall) / np.log(1 - min(max(met, 1e-3), 0.999))))
        found.append((tables * probes, tables, probes))
    _, tables, probes = min(found)
    return tables, rotations, probes


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v) of the rows that can link."""
    # Floats stay as short as they are; they are compared as doubles.
    kind = vectors.schema[vector_col].dataType.elementType.typeName()
    v = F.col(vector_col) if kind in ("float", "double") else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))


def _linked_pairs(a: np.ndarray, b: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    other = a if b is None else b
    alike = a @ other.T >= cosine
    return np.nonzero(np.triu(alike, 1) if b is None else alike)


def _once(codes_a: np.ndarray, codes_b: np.ndarray, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether the pairs meet here first: in no earlier table, and in no smaller bucket of this one."""
    first = np.ones(len(table), dtype=bool)
    for at in range(0, len(table), 20_000):
        part = slice(at, at + 20_000)
        same = codes_a[part, :, :, None] == codes_b[part, :, None, :]
        tables = same.any(axis=(2, 3))
        earlier = (tables & (np.arange(tables.shape[1]) < table[part, None])).any(axis=1)
        pick = np.arange(len(table[part])), table[part]
        here = np.where(same[pick].any(axis=2), codes_a[part][pick], np.iinfo(codes_a.dtype).max).min(axis=1)
        first[part] = ~earlier & (here == bucket[part])
    return first


def links(classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): for b null, n vectors are linked to class a; else classes a and b are linked.

    Links with n = 0 connect what is linked; those with n = 1 are every link, once, of which a class is shared.

    A bucket's vectors are compared where the bucket's rows meet after a shuffle; a pair that shares several
    buckets counts in the first. Of the links of a bucket only a spanning forest is returned. Buckets of more
    than BLOCK vectors are dealt to pairs of blocks, so that none is a single task.
    """
    spark = classes.sparkSession
    n_classes, longest = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    tables, rotations, probes = plan(n_classes, longest or 1, cosine)
    width = tables * probes
    kind, arrow_kind, numpy_kind = ("int", "int32", np.int32) if (2 << max(1, ((longest or 1) - 1).bit_length())) ** rotations < 1 << 31 else ("long", "int64", np.int64)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1).to_pylist()
            sizes = np.array([len(x) for x in lists])
            for size in np.unique(sizes):
                some = np.flatnonzero(sizes == size)
                codes = buckets(np.array([lists[k] for k in some], dtype=float), tables, rotations, probes).reshape(len(some), -1).astype(numpy_kind)
                take = pa.array(some)
                offsets = pa.array(np.arange(len(some) + 1) * width, type=pa.int32())
                listed = pa.ListArray.from_arrays(offsets, pa.array(codes.ravel(), getattr(pa, arrow_kind)()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), listed], names=["vec_id", "codes"])

    coded = classes.join(classes.select("vec_id", "v").mapInArrow(place, f"vec_id long, codes array<{kind}>"), "vec_id")
    coded = stored(coded.withColumn("size", F.size("v")), "coded")
    each = coded.select("vec_id", "n", "label", "size", F.posexplode("codes").alias("probe", "bucket"))
    each = each.select("vec_id", "n", "label", "size", F.floor(F.col("probe") / probes).cast("int").alias("table"), "bucket").distinct()
    key = ["label", "size", "table", "bucket"]
    full = each.groupBy(*key).agg(F.count("*").alias("held")).where("held > 1")
    full = full.withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int")).drop("held")
    met = each.join(full, key)
    met = met.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*key, "vec_id", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    cell = [*key, "low", "high"]
    loaded = met.join(coded.select("vec_id", "n", "v", "codes", "shared"), "vec_id").withColumn("cell", F.xxhash64(*cell))
    loaded = loaded.repartition("cell").sortWithinPartitions("cell", *cell, "vec_id").select("cell", *cell, "vec_id", "block", "n", "v", "codes", "shared")

    def compare(batches):
        import pyarrow as pa

        def cells():
            """Runs of equal cells, across batches; cells of a batch stay together as one table of arrays."""
            rest = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                if rest is not None:
                    table = pa.concat_tables([rest, table])
                marks = np.column_stack([table.column(k).to_numpy() for k in (0, 3, 4, 5, 6)])
                if not len(marks):
                    continue
                changes = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
                if not len(changes):
                    rest = table
                    continue
                yield table.slice(0, changes[-1]), np.r_[0, changes]
                rest = table.slice(changes[-1])
            if rest is not None and len(rest):
                yield rest, np.array([0, len(rest)])

        for table, cuts in cells():
            table = table.combine_chunks()
            where, bucket, low, high, ids, block, n = (table.column(k).to_numpy() for k in (3, 4, 5, 6, 7, 8, 9))
            v = table.column("v").combine_chunks()
            sizes = table.column("size").to_numpy()
            flat, begin = v.flatten().to_numpy(), v.offsets.to_numpy() - v.offsets[0].as_py()
            shared = table.column("shared").to_numpy()
            codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), tables, probes)
            xs, ys = [], []
            for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if q - p < 2:
                    continue
                unit = flat[begin[p] : begin[q]].reshape(q - p, int(sizes[p])).astype(float)
                # Scaled by the largest entry first, so that no square overflows or vanishes.
                unit = unit / np.abs(unit).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                if low[p] == high[p]:
                    x, y = _linked_pairs(unit, None, cosine)
                else:
                    left, right = np.flatnonzero(block[p:q] == low[p]), np.flatnonzero(block[p:q] == high[p])
                    x, y = _linked_pairs(unit[left], unit[right], cosine)
                    x, y = left[x], right[y]
                if len(x):
                    xs.append(x + p), ys.append(y + p)
            if not xs:
                continue
            x, y = np.concatenate(xs), np.concatenate(ys)
            once = _once(codes[x], codes[y], where[x].astype(np.int64), bucket[x])
            x, y = x[once], y[once]
            linked = np.bincount(x, weights=n[y], minlength=len(ids)) + np.bincount(y, weights=n[x], minlength=len(ids))
            up = {}

            def root(k):
                while up.get(k, k) != k:
                    up[k] = up.get(up[k], up[k])
                    k = up[k]
                return k

            a, b = [], []
            for p, q in zip(ids[x].tolist(), ids[y].tolist()):
                p, q = root(p), root(q)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    a.append(p), b.append(q)
            some = np.flatnonzero(linked)
            listed = shared[x] | shared[y]
            a, b = a + ids[x[listed]].tolist(), b + ids[y[listed]].tolist()
            kind = np.r_[linked[some], np.zeros(len(a) - listed.sum()), np.ones(listed.sum())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[ids[some], np.array(a, dtype=np.int64)]), pa.array([None] * len(some) + b, pa.int64()), pa.array(kind.astype(np.int64))],
                names=["a", "b", "n"],
            )

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    return loaded.mapInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each vector: id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and not null and their cosine, in double precision, is at
    least the given one. Candidates share a bucket of one of TABLES tables (recall at the threshold is above
    0.99, see the tests); every candidate is verified, so no link is wrong. n_links counts the other vectors linked directly, component_id
    is the least id that links reach, and kept tells if that is the vector itself.

    Equal vectors of a label are one class from the start, and all classes are compared. Null and zero vectors,
    those with null or non-finite components, and null labels are linked to nothing; vectors of different length
    are not compared. Rows with the same id are one vector with the links of each, counted once; a null id gets
    null results. Of classes that hold an id with several vectors all links are listed, so that no id counts twice.
    """
    rows = _usable(vectors, id_col, vector_col, label_col)
    classes = rows.groupBy("label", "v").agg(F.min("vec_id").alias("head")).withColumn("class", F.monotonically_increasing_id())
    # The numbers hold from here on, as they are written.
    classes = stored(classes, "classes")
    member = rows.distinct().join(classes, ["label", "v"]).select("vec_id", "class")
    member = stored(member, "members")
    several = member.groupBy("vec_id").agg(F.count("*").alias("held")).where("held > 1").select("vec_id", F.lit(True).alias("several"))
    member = member.join(several, "vec_id", "left").select("vec_id", "class", F.coalesce("several", F.lit(False)).alias("several"))
    many = stored(member.where("several").select("vec_id", "class"), "several")
    sized = member.groupBy("class").agg(F.count(F.when(~F.col("several"), 1)).alias("n"), F.max("several").alias("shared"))
    sized = stored(classes.join(sized, "class"), "sized")
    found = stored(links(sized.select(F.col("class").alias("vec_id"), "label", "v", "n", "shared"), cosine), "links")
    ties = many.join(many.groupBy("vec_id").agg(F.min("class").alias("a")), "vec_id").select("a", F.col("class").alias("b"))
    joined = connected_components(found.where("b is not null and n = 0").select("a", "b").union(ties)).withColumnRenamed("node", "class")
    least = joined.join(classes.select("class", "head"), "class").groupBy("component").agg(F.min("head").alias("component_id"))
    joined = joined.join(least, "component").select("class", "component_id")
    # Classes and those they reach, as far as ids with several vectors are in either.
    pairs = found.where("b is not null and n = 1")
    own = sized.where("shared").select("class", F.col("class").alias("near"))
    near = stored(own.union(pairs.select("a", "b")).union(pairs.select("b", "a")), "near")
    reached = many.select(F.col("vec_id").alias("other"), F.col("class").alias("near"))
    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("single"))
    extra = near.join(reached, "near").groupBy("class").agg(F.count_distinct("other").alias("extra"))
    each = sized.select("class", "head", "n").join(counts, "class", "left").join(joined, "class", "left").join(extra, "class", "left")
    each = each.select("class", F.coalesce("component_id", "head").alias("component_id"), (F.col("n") + F.coalesce("single", F.lit(0)) + F.coalesce("extra", F.lit(0)) - 1).alias("n_links"))
    each = stored(each, "each")
    alone = member.where("not several").join(each, "class").select("vec_id", "component_id", "n_links")
    reach = many.join(near, "class").select("vec_id", "near").distinct()
    once = reach.join(sized.select(F.col("class").alias("near"), "n"), "near").groupBy("vec_id").agg(F.sum("n").alias("single"))
    again = reach.join(reached, "near").groupBy("vec_id").agg(F.count_distinct("other").alias("extra"))
    placed = many.join(each, "class").groupBy("vec_id").agg(F.min("component_id").alias("component_id"))
    both = placed.join(once, "vec_id").join(again, "vec_id").select("vec_id", "component_id", (F.col("single") + F.col("extra") - 1).alias("n_links"))
    out = alone.union(both)
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    full = every.join(out, "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return full.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
