"""Order MinHash: fingerprints whose likeness follows edit distance, not only shared content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import read_table, stored

#: Words of a k-mer, tuples of a fingerprint, and k-mers of a tuple.
K, TUPLES, PICKS = 2, 64, 2
_HEX = 4
_EMPTY = "0" * _HEX
_PLACE_BITS = 24
#: Characters of scripts that are written without spaces, and how many characters a word may have: what is beyond goes by characters.
_UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"
_LONGEST = 48


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def units(text: Column) -> Column:
    """Array of words: what white space separates, single characters in scripts without spaces, and beyond the 48th in a word."""
    spaced = F.when(text.rlike(_UNSPACED), F.regexp_replace(text, f"({_UNSPACED})", " $1 ")).otherwise(text)
    spaced = F.when(text.rlike(rf"\S{{{_LONGEST + 1}}}"), F.regexp_replace(spaced, rf"(?<=\S{{{_LONGEST}}})(\S)", " $1")).otherwise(spaced)
    return F.split(F.trim(F.regexp_replace(spaced, r"\s+", " ")), " ")


def order_minhash(text: Column, rotate: bool = False) -> Column:
    """TUPLES hashes of 16 bits as hexadecimal text.

    A k-mer is K words in a row (a shorter text is one k-mer), numbered by its occurrence, so repeats count. One hash
    gives the numbered k-mers places on a circle. Rotating it by multiples of 1 / TUPLES gives TUPLES permutations;
    under each the PICKS least of all k-mers are selected, put back in the order of the text, and hashed together (rotate).
    Each permutation is uniform, so the share of equal tuples estimates the same likeness as independent hashes do.
    Without rotate only the k-mers of an arc of 1 / TUPLES are at choice, and a tuple without any is '0000'.

    Place numbers end at 2^24 - 2: the order of the words behind them isn't told apart.
    """
    words = units(text)
    place_mask = F.lit((1 << _PLACE_BITS) - 1).cast("long")

    def placed(w: Column) -> Column:
        """Sorted longs: the k-mer's hash above, its place in the text below."""
        n = F.greatest(F.size(w) - K + 1, F.lit(1))

        def one(i: Column) -> Column:
            h = F.xxhash64(*[F.coalesce(F.get(w, i + j), F.lit("")) for j in range(K)])
            return F.shiftleft(F.shiftright(h, _PLACE_BITS), _PLACE_BITS).bitwiseOR(F.least(i, F.lit((1 << _PLACE_BITS) - 2)).cast("long"))

        return F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), one))

    def same(s: Column, i: Column, j: Column) -> Column:
        return F.shiftright(F.get(s, i), _PLACE_BITS) == F.shiftright(F.get(s, j), _PLACE_BITS)

    def numbered(s: Column) -> Column:
        """Hash of k-mer and occurrence above, place below, sorted. Equal k-mers stand together in s, by place;
        how far the first of them is back is found by halving steps."""
        steps = F.array(*[F.lit(1 << b) for b in range(_PLACE_BITS - 1, -1, -1)])

        def back(i: Column) -> Column:
            return F.aggregate(steps, F.lit(0), lambda got, step: F.when((i - got - step >= 0) & same(s, i, i - got - step), got + step).otherwise(got))

        def one(x: Column, i: Column) -> Column:
            occurrence = F.when((i > 0) & same(s, i, i - 1), back(i)).otherwise(F.lit(0))
            h = F.xxhash64(F.shiftright(x, _PLACE_BITS), occurrence)
            return F.shiftleft(F.shiftright(h, _PLACE_BITS), _PLACE_BITS).bitwiseOR(x.bitwiseAND(place_mask))

        return F.sort_array(F.transform(s, one))

    shift = 64 - (TUPLES.bit_length() - 1)

    def least(s: Column) -> Column:
        """The first PICKS of each tuple: those that PICKS places before belong to another tuple."""
        return F.filter(s, lambda x, i: (i < PICKS) | (F.shiftright(F.get(s, i - PICKS), shift) != F.shiftright(x, shift)))

    def tuple_of(mine: Column) -> Column:
        ordered = F.array_sort(F.transform(mine, lambda x: F.struct(x.bitwiseAND(place_mask).alias("place"), F.shiftright(x, _PLACE_BITS).alias("kmer"))))
        h = F.xxhash64(F.transform(ordered, lambda x: x["kmer"]))
        # A tuple that hashes to the mark of an empty one takes the next value.
        return F.lpad(F.lower(F.hex(F.greatest(F.shiftrightunsigned(h, 64 - 4 * _HEX), F.lit(1)))), _HEX, "0")

    def binned(p: Column) -> Column:
        def one(t: Column) -> Column:
            mine = F.filter(p, lambda x: F.shiftright(x, shift) == t)
            return F.when(F.size(mine) == 0, F.lit(_EMPTY)).otherwise(tuple_of(mine))

        tuples = F.sequence(F.lit(-TUPLES // 2).cast("long"), F.lit(TUPLES // 2 - 1).cast("long"))
        return F.array_join(F.transform(tuples, one), "")

    def rotated(p: Column) -> Column:
        """The first two of each arc hold the two successors of the start of every arc. A mark that no k-mer equals is sorted
        in before each start, so its place tells how many k-mers lie before."""
        low = (1 << shift) - 1
        marks = F.array(*[F.lit((t << shift) - 1) for t in range(-TUPLES // 2 + 1, TUPLES // 2)])
        sorted_in = F.transform(F.sort_array(F.concat(p, marks)), lambda x, i: F.when(x.bitwiseAND(F.lit(low)) == low, i))
        before = F.concat(F.array(F.lit(0)), F.transform(F.filter(sorted_in, lambda i: i.isNotNull()), lambda i, r: i - r))

        def one(twice: Column) -> Column:
            return F.array_join(F.transform(before, lambda at: tuple_of(F.slice(twice, at + 1, F.least(F.size(p), F.lit(PICKS))))), "")

        return _let(F.concat(p, F.slice(p, 1, PICKS)), one)

    return _let(words, lambda w: _let(placed(w), lambda s: _let(numbered(s), lambda q: _let(least(q), rotated if rotate else binned))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among those that either text has."""
    def tuple_of(fingerprint: Column, k: Column) -> Column:
        return F.substring(fingerprint, k * _HEX + 1, F.lit(_HEX))

    places = F.sequence(F.lit(0), F.lit(TUPLES - 1))
    either = F.size(F.filter(places, lambda k: (tuple_of(a, k) != _EMPTY) | (tuple_of(b, k) != _EMPTY)))
    equal = F.size(F.filter(places, lambda k: (tuple_of(a, k) == tuple_of(b, k)) & (tuple_of(a, k) != _EMPTY)))
    return F.when(a == b, F.lit(1.0)).when(either == 0, F.lit(0.0)).otherwise(equal / either)


def successors(keys: DataFrame) -> DataFrame:
    """(doc_id, text_hash, next_id, next_hash) over distinct (doc_id, text_hash) in ascending order, the last's next is the first.

    Keys are dealt by range and chained within each range; the ranges' first keys, one row each, chain the ends.
    """
    dealt = stored(keys.repartitionByRange("doc_id", "text_hash").withColumn("part", F.spark_partition_id()), "keys")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    key = F.struct("doc_id", "text_hash")
    chained = dealt.withColumn("next", F.lead(key).over(Window.partitionBy("part").orderBy(*order)))
    firsts = dealt.groupBy("part").agg(F.min(key).alias("first"))
    everywhere = Window.partitionBy(F.lit(0))
    # One row for each partition of the range exchange.
    firsts = firsts.withColumn("after", F.coalesce(F.lead("first").over(everywhere.orderBy("part")), F.min("first").over(everywhere)))
    out = chained.join(firsts.select("part", "after"), "part")
    following = F.coalesce("next", "after")
    return out.select("doc_id", "text_hash", following["doc_id"].alias("next_id"), following["text_hash"].alias("next_hash"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of an edited copy, and how alike they and the next text's are.

    The copy has its last floor(n / 4) code points replaced by as many from the start of the next document
    (all, if that has fewer). Next is by ascending id, after the last the first; rows of the same id follow
    each other by their text's hash, and rows alike in id and text are one document in that order and repeat
    in the result. A null text counts as empty; a null id comes first. Ids are integers above -2^63. An empty table gives no
    rows; other columns are not read. Only JVM expressions are used.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    unnamed = F.lit(-(1 << 63))
    # Both joins of the texts read exactly these columns, so that they share one exchange.
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), unnamed).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    # As bytes a fingerprint takes half the room of its text.
    marked = stored(rows.select("doc_id", "text_hash", F.length("text").cast("long").alias("n_chars"), F.unhex(order_minhash(F.col("text"), rotate=True)).alias("fingerprint")), "fingerprints")
    one = marked.dropDuplicates(["doc_id", "text_hash"])
    chain = successors(one.select("doc_id", "text_hash"))
    # What each document has to give to the one before it.
    asked = chain.join(one.select("doc_id", "text_hash", F.floor(F.col("n_chars") / 4).cast("int").alias("need")), ["doc_id", "text_hash"])
    asked = asked.select(F.col("next_id").alias("doc_id"), F.col("next_hash").alias("text_hash"), F.col("doc_id").alias("to_id"), F.col("text_hash").alias("to_hash"), "need")
    given = rows.join(asked, ["doc_id", "text_hash"]).select("to_id", "to_hash", F.substring(F.col("text"), F.lit(1), F.col("need")).alias("tail"))
    given = given.dropDuplicates(["to_id", "to_hash"]).select(F.col("to_id").alias("doc_id"), F.col("to_hash").alias("text_hash"), "tail")
    n = F.length("text")
    edited = rows.join(given, ["doc_id", "text_hash"]).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 4)).cast("int")), "tail"))
    edited = edited.select("doc_id", "text_hash", F.sha2("edited", 256).alias("edited_sha256"), order_minhash(F.col("edited"), rotate=True).alias("edited_fingerprint"))
    following = chain.join(one.select(F.col("doc_id").alias("next_id"), F.col("text_hash").alias("next_hash"), F.col("fingerprint").alias("next_fingerprint")), ["next_id", "next_hash"])
    full = edited.join(one, ["doc_id", "text_hash"]).join(following.select("doc_id", "text_hash", "next_fingerprint"), ["doc_id", "text_hash"])
    full = full.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "next_fingerprint")})
    return full.select(
        F.when(F.col("doc_id") != unnamed, F.col("doc_id")).alias(id_col),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(read_table(spark, sf_dir, "documents"))
