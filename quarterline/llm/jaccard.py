"""Documents whose sets of word n-grams are alike: a MinHash LSH forest, then exact Jaccard similarities."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import connected_components, discard, join_by_key, map_texts, read_table, recall_depth, stored

NGRAM = 5
SIMILARITY = 0.8
TREES, DEEPEST, RECALL = 32, 8, 0.9999
#: Candidate clusters are verified in up to BLOCKS blocks of BLOCK documents; beyond, blocks grow up to MOST documents or BLOCK_BYTES of text.
BLOCK, BLOCKS, MOST, BLOCK_BYTES = 256, 64, 4096, 1 << 23
#: Parts of the hash of id and text; a document outside all parts that hold candidates isn't shuffled with its text.
PARTS = 1 << 20
#: Parts that the documents of a class of equal words are dealt to, so that no class is one task.
SALTS = 256
MEMO = 300_000
_words = re.compile(r"\w+").findall
_rng = np.random.default_rng(20)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _rng.integers(1, 1 << 31, TREES * DEEPEST, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, TREES * DEEPEST, dtype=np.uint32)


def word_hashes():
    """words of a text -> 64-bit hashes; a bounded memo keeps frequent words."""
    import xxhash

    class Known(dict):
        def __missing__(self, word: str) -> int:
            if len(self) >= MEMO:
                self.clear()
            value = self[word] = xxhash.xxh3_64_intdigest(word)
            return value

    get = Known().__getitem__
    return lambda words: np.fromiter(map(get, words), dtype=np.uint64, count=len(words))


def shingles(hashes: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """Hashes of the n-grams of words; fewer than n words are one shingle, none have none."""
    if not len(hashes):
        return hashes
    size = min(n, len(hashes))
    with np.errstate(over="ignore"):
        mixed = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            mixed += hashes[k : len(hashes) - size + 1 + k] * _PLACE[k]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(29))


def labels(grams: np.ndarray) -> bytes:
    """The trees' labels: DEEPEST MinHash values of 16 bits for each tree, as big-endian bytes that sort as prefixes."""
    least = np.full(TREES * DEEPEST, 0xFFFFFFFF, dtype=np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(short), 512):
            np.minimum(least, (short[at : at + 512, None] * _TIMES + _PLUS).min(axis=0), out=least)
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes()


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc_id, text_hash, same_a, same_b, trie): texts with equal words have equal hashes; no words give nulls."""

    def make():
        import xxhash

        hashed = word_hashes()

        def run(texts: list[str]):
            out = []
            for text in texts:
                words = _words(text.lower())
                if not words:
                    out.append((None, None, None))
                    continue
                both = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
                out.append((*np.frombuffer(both, dtype="<i8").tolist(), labels(shingles(hashed(words), n))))
            return [list(x) for x in zip(*out)] or [[], [], []], None

        return run

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _text_hash(text_col).alias("text_hash"))
    return map_texts(rows, {"doc_id": "doc_id", "text_hash": "text_hash"}, "text", "same_a long, same_b long, trie binary", make)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def neighbours(tries: DataFrame, shallowest: int) -> tuple[DataFrame, DataFrame]:
    """A stored table, and made of it the pairs (a, b, depth) of neighbours in the sorted tries; depth is the longest prefix of their labels that they share.

    Labels are sorted over the whole cluster, tree by tree; in that order the classes below a node of the
    trie stand together, so the pairs of at least its depth tie them all. A node whose classes reach over several
    partitions is tied together through the first and last rows of each, two per partition. Pairs that
    share less than the shallowest prefix are left out.
    """
    width = 2 * DEEPEST
    rows = tries.select("class", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "trie")
    rows = rows.select("tree", F.expr(f"substring(trie, tree * {width} + 1, {width})").alias("label"), "class")
    rows = rows.repartitionByRange("tree", "label", "class").sortWithinPartitions("tree", "label", "class")

    def walk(batches):
        import pyarrow as pa

        def table(tree, label, a, b, depth):
            return pa.RecordBatch.from_arrays(
                [pa.array(tree, pa.int32()), pa.array(label, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(depth, pa.int32())],
                names=["tree", "label", "a", "b", "depth"],
            )

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy(zero_copy_only=False)
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u2").reshape(-1, DEEPEST)
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            if last is None:
                yield table([int(tree[0])], [label[0].tobytes()], [int(ids[0])], [None], [None])
            else:
                tree, label, ids = np.r_[last[0], tree], np.vstack([last[1], label]), np.r_[last[2], ids]
            shared = np.logical_and.accumulate(label[1:] == label[:-1], axis=1).sum(axis=1)
            at = np.flatnonzero((tree[1:] == tree[:-1]) & (shared >= shallowest) & (ids[1:] != ids[:-1]))
            yield table(np.zeros(len(at), np.int32), [None] * len(at), ids[at], ids[at + 1], shared[at])
            last = tree[-1:], label[-1:], ids[-1:]
        if last is not None:
            yield table([int(last[0][0])], [last[1][0].tobytes()], [int(last[2][0])], [None], [None])

    found = stored(rows.mapInArrow(walk, "tree int, label binary, a long, b long, depth int"), "neighbours")
    ends = found.where("b is null").select("tree", "label", "a", F.explode(F.sequence(F.lit(shallowest), F.lit(DEEPEST))).alias("depth"))
    ends = ends.groupBy("tree", "depth", F.expr("substring(label, 1, 2 * depth)")).agg(F.min("a").alias("a"), F.collect_set("a").alias("all"))
    pairs = found.where("b is not null").select("a", "b", "depth").union(ends.select("a", F.explode("all").alias("b"), "depth"))
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "depth")
    return found, pairs.groupBy("a", "b").agg(F.max("depth").alias("depth"))


def meets(similarity: float | np.ndarray, depth: int) -> float | np.ndarray:
    """The probability that two sets of this similarity share a prefix of the given depth in one of the trees."""
    return -np.expm1(TREES * np.log1p(-np.minimum(similarity, 1 - 1e-12) ** depth))


def matched_depth(pairs: DataFrame, tries: DataFrame, similarity: float, shallowest: int) -> int:
    """The longest prefix with which the pairs in these data are found with a probability of RECALL.

    A quarter of the MinHash values of each pair of neighbours are compared, which estimates its similarity. From the deepest
    level on the prefix is shortened until the pairs of at least the given similarity meet, on average, with the target
    recall; the shallowest prefix reaches it for every such pair. A count for each number of
    equal values comes to the driver.
    """
    width = 2 * TREES * DEEPEST // 4
    sides = [tries.select(F.col("class").alias(c), F.substring("trie", 1, width).alias(f"trie_{c}")) for c in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("trie_a", "trie_b")

    def agree(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=">u2").reshape(-1, width // 2) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array((x == y).sum(axis=1).astype(np.int32))], names=["equal"])

    counts = both.mapInArrow(agree, "equal int").groupBy("equal").count().collect()
    alike = np.array([(2 * r["equal"] / width, r["count"]) for r in counts]).reshape(-1, 2)
    alike = alike[alike[:, 0] >= similarity]
    depth = DEEPEST
    while depth > shallowest and len(alike) and np.average(meets(alike[:, 0], depth), weights=alike[:, 1]) < RECALL:
        depth -= 1
    return depth if len(alike) else shallowest


def _intersections(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set in rows with each in columns."""
    sizes = [len(x) for x in rows], [len(x) for x in columns]
    everything = np.concatenate([*rows, *columns])
    which = np.repeat(np.arange(len(rows) + len(columns)), sizes[0] + sizes[1])
    _, code, count = np.unique(everything, return_inverse=True, return_counts=True)
    common = count[code] > 1  # what one set alone holds meets nothing
    code, which = code[common], which[common]
    order = np.argsort(code, kind="stable")
    code, which = code[order], which[order]
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    if not len(code):
        return out
    dense = np.r_[0, np.cumsum(code[1:] != code[:-1])]
    for at in range(0, int(dense[-1]) + 1, 4096):
        a, b = np.searchsorted(dense, [at, at + 4096])
        part = np.zeros((len(rows) + len(columns), 4096), dtype=np.float32)
        part[which[a:b], dense[a:b] - at] = 1
        out += part[: len(rows)] @ part[len(rows) :].T
    return out


def links_between(texts_a: list[np.ndarray], texts_b: list[np.ndarray] | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose Jaccard similarity is at least the given one; texts_b None: pairs within texts_a."""
    other = texts_a if texts_b is None else texts_b
    common = _intersections(texts_a, other)
    a, b = np.array([len(x) for x in texts_a], dtype=float), np.array([len(x) for x in other], dtype=float)
    alike = common >= similarity * (a[:, None] + b[None, :] - common) - 1e-9
    if texts_b is None:
        alike = np.triu(alike, 1)
    return np.nonzero(alike)


def verify(members: DataFrame, similarity: float, n: int) -> DataFrame:
    """(a, b, n): for b null, n documents are linked to class a; else classes a and b are linked.

    members has class, cluster, n (documents of the class), block, blocks, text. Within each pair of blocks
    all classes are compared; of the links found, only as many are returned as connect the same classes.
    """
    pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    rows = members.select("class", "cluster", "n", "block", "text", pair)
    rows = rows.select("class", "cluster", "n", "block", "text", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))

    def compare(key, batch):
        import pandas as pd

        hashed = word_hashes()
        batch = batch.sort_values("class", ignore_index=True)
        grams = [np.unique(shingles(hashed(_words(text.lower())), n)) for text in batch["text"]]
        ids, weight = batch["class"].to_numpy(), batch["n"].to_numpy()
        if key[1] == key[2]:
            left = right = np.arange(len(ids))
            x, y = links_between(grams, None, similarity)
        else:
            left, right = (np.flatnonzero(batch["block"].to_numpy() == k) for k in key[1:])
            if not len(left) or not len(right):
                return pd.DataFrame({"a": [], "b": [], "n": []})
            x, y = links_between([grams[k] for k in left], [grams[k] for k in right], similarity)
        x, y = left[x], right[y]
        linked = np.bincount(x, weights=weight[y], minlength=len(ids)) + np.bincount(y, weights=weight[x], minlength=len(ids))
        up = list(range(len(ids)))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        tree = []
        for p, q in zip(x.tolist(), y.tolist()):
            p, q = root(p), root(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                tree.append((p, q))
        some = np.flatnonzero(linked)
        a = np.r_[ids[some], ids[[p for p, _ in tree]] if tree else np.zeros(0, np.int64)]
        b = [None] * len(some) + [int(ids[q]) for _, q in tree]
        return pd.DataFrame({"a": a, "b": pd.array(b, dtype="Int64"), "n": np.r_[linked[some], np.zeros(len(tree))].astype(np.int64)})

    # Else all pairs of a cluster's blocks would stay where the cluster is.
    rows = rows.repartition("cluster", "low", "high")
    return rows.groupBy("cluster", "low", "high").applyInPandas(compare, "a long, b long, n long")


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text", depth: int | None = None) -> DataFrame:
    """One row for each id: class_id, n_links, representative.

    Two documents are linked if the sets of their n-grams of words (lower case, runs of letters, digits and
    underscores) have at least the given Jaccard similarity. n_links counts the documents linked directly,
    class_id is the least id that links reach, representative the least id with the same words.

    Documents with the same words are one class from the start. Each class's MinHash labels go into the
    sorted tries of a forest; matched prefixes are shortened from the deepest until the pairs in these data
    meet with probability RECALL (matched_depth), or to the given depth. What meets is tied into candidate clusters, and within a
    cluster all classes are compared exactly, in blocks, so no pair is emitted or compared twice.

    Texts without words are linked to nothing; fewer than n words are one n-gram. Repeated rows count once. An id
    with several texts is one document whose links are those of each text added up. Null ids get null results.
    Ids are integers. An empty table gives no rows; other columns are not read.
    """
    signed = stored(signatures(docs, id_col, text_col, n), "signatures")
    named = signed.where("doc_id is not null and trie is not null")
    same = ["same_a", "same_b"]
    # A class of many documents is reduced, and later joined, in SALTS parts.
    each = stored(named.select("doc_id", *same, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).distinct(), "each")
    parts = stored(each.groupBy(*same, "salt").agg(F.count("*").alias("part")), "parts")
    heads = named.groupBy(*same).agg(F.min(F.struct("doc_id", "text_hash")).alias("head"), F.first("trie").alias("trie"))
    heads = heads.join(parts.groupBy(*same).agg(F.sum("part").alias("n")), same)
    # The numbers hold from here on, as they are written.
    classes = stored(heads.select(F.monotonically_increasing_id().alias("class"), F.col("head.doc_id").alias("representative"), "head.text_hash", "n", *same, "trie"), "classes")
    # Dealt by all keys of the next join, or that would run where the classes are.
    numbers = parts.select(*same, "salt").join(classes.select("class", *same), same).repartition(*same, "salt")
    member = stored(each.join(numbers, [*same, "salt"]).select("doc_id", "class"), "members")
    without = signed.where("doc_id is null or trie is null").select("doc_id").distinct().join(member.select("doc_id"), "doc_id", "left_anti")
    without = stored(without, "without")
    discard(signed, each, parts)

    tries = classes.select("class", "trie")
    shallowest = min(depth or recall_depth(similarity, TREES, DEEPEST, RECALL), DEEPEST)
    found, pairs = neighbours(tries, shallowest)
    pairs = stored(pairs, "pairs")
    discard(found)
    depth = depth or matched_depth(pairs, tries, similarity, shallowest)
    clusters = connected_components(pairs.where(F.col("depth") >= depth)).select(F.col("node").alias("class"), F.col("component").alias("cluster"))

    wanted = clusters.join(classes.select("class", F.col("representative").alias("doc_id"), "n", "text_hash"), "class")
    part = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(PARTS)).alias("part")
    wanted = stored(wanted.select("class", "cluster", "n", "doc_id", "text_hash", part), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(text_col).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # At most PARTS rows, whatever the input.
    texts = texts.withColumn("part", part).join(F.broadcast(wanted.select("part").distinct()), "part", "left_semi").drop("part")
    placed = texts.join(wanted.drop("part"), ["doc_id", "text_hash"]).dropDuplicates(["class"])
    placed = stored(placed.select("class", "cluster", "n", "text"), "placed")
    size = F.least(F.greatest(F.lit(BLOCK), F.count("*") / BLOCKS), F.lit(max(BLOCK, MOST)))
    sizes = placed.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / size), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed_in = join_by_key(placed, stored(sizes.withColumn("n_in", F.col("blocks")), "sizes"), ["cluster"], "n_in").drop("n_in")
    placed_in = placed_in.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    checked = stored(verify(placed_in, similarity, n), "links")
    discard(pairs, wanted, placed)

    counts = checked.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    # An id with several texts ties its classes together.
    several = member.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z").select("doc_id", "a")
    ties = member.join(several, "doc_id").select("a", F.col("class").alias("b"))
    joined = connected_components(checked.where("b is not null").select("a", "b").union(ties)).withColumnRenamed("node", "class")
    least = joined.join(classes.select("class", "representative"), "class").groupBy("component").agg(F.min("representative").alias("class_id"))
    joined = joined.join(least, "component").select("class", "class_id")
    known = classes.select("class", "representative", "n").join(counts, "class", "left").join(joined, "class", "left")
    known = known.select("class", "representative", F.coalesce("class_id", "representative").alias("class_id"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    # Members go to their class in as many parts as before.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    present = member.select("class", salt).distinct()
    known = present.join(known, "class").repartition("class", "salt")
    out = member.select("doc_id", "class", salt).join(known, ["class", "salt"])
    out = out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"), F.min("representative").alias("representative"))
    without = without.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("representative"))
    return out.unionByName(without).withColumnRenamed("doc_id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the least id of their class; rows with a null id stay. Columns of docs may have any name."""
    classes = jaccard_join(docs, id_col=id_col, text_col=text_col)
    gone = classes.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col))
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))
