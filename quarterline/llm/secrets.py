"""Credentials in texts, told apart by how many repositories and owners hold the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import join_by_key, read_table, stored

# The patterns of the base kinds, and the least length of what counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Bare words that may be credentials: counted over the corpus before they are believed.
LOOSE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])"
KINDS = ("assign", "access", "hex", "owned")
#: A value held by this many owners, or in this many repositories, is taken for an example that is copied around.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 25


def _located(text: Column, pattern: str, group: int, rank: int) -> Column:
    """Array of (start, rank, end, value) of the matches: what lies between them gives their places."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    parts = F.arrays_zip(found.alias("found"), values.alias("value"), F.slice(between, 1, F.greatest(F.size(found), F.lit(1))).alias("gap"))
    parts = F.filter(parts, lambda p: p["found"].isNotNull())
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def add(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["gap"])
        end = start + F.length(p["found"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), p["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(state["out"], one).alias("out"))

    return F.aggregate(parts, empty, add, lambda state: state["out"])


_FOUND = "array<struct<start:int,rank:int,end:int,value:string>>"
#: Of a value only its place and its hash are ever written.
_SPANS = "array<struct<start:int,rank:int,end:int,from:int,value_hash:string>>"


def hashed(spans: Column) -> Column:
    """The spans with the start of their value, which reaches to the end of the span, and its hash in place of the value."""

    def one(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), (s["end"] - F.length(s["value"])).alias("from"), F.sha2(s["value"], 256).alias("value_hash"))

    return F.transform(spans, one)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, in the order of their start and then kind; texts without any cost one test a kind."""
    none = F.array().cast(_FOUND)
    assign = F.when(text.rlike(r"(?i)pass(word|wd)|secret|token|api_?key"), F.filter(_located(text, ASSIGN, 2, 0), lambda s: F.length(s["value"]) >= 8)).otherwise(none)
    access = F.when(text.contains("AKIA"), _located(text, ACCESS, 0, 1)).otherwise(none)
    hexes = F.when(text.rlike(HEX), _located(text, HEX, 0, 2)).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


def loose_spans(text: Column, base: Column) -> Column:
    """Bare words of letters and digits outside the base spans, with a mixture that prose doesn't have."""
    none = F.array().cast(_FOUND)
    spans = F.when(text.rlike(r"[0-9]") & text.rlike(LOOSE), _located(text, LOOSE, 0, 3)).otherwise(none)

    def looks_random(s: Column) -> Column:
        value = s["value"]
        digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
        letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
        kinds = F.size(F.array_distinct(F.split(value, "")))
        return (digits >= 5) & (letters >= 5) & (kinds >= 12) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return F.filter(spans, looks_random)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Per row: id, owner, base and loose spans; written once, so that each text is scanned once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("loose", loose_spans(F.col("text"), F.col("base")))
    return rows.select("doc_id", "owner", F.xxhash64("text").alias("text_hash"), hashed(F.col("base")).alias("base"), hashed(F.col("loose")).alias("loose"))


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate value's hash: how many repositories and owners hold it, if it was ever assigned, and in how many spans (n).

    A repository is a text: copies of it are one repository, of its least owner. Each (value, text, owner) is reduced before
    the shuffle and counted in steps, so a value that a third of all documents hold is no single task's work.
    """
    held = _exploded(found.select("text_hash", "owner", "base", "loose"), "text_hash", "owner")
    each = held.groupBy("value_hash", "text_hash", "owner").agg(F.max(F.col("s.rank") == 0).alias("assigned"), F.count("*").alias("n"))
    by_text = each.groupBy("value_hash", "text_hash").agg(F.min("owner").alias("owner"), F.max("assigned").alias("assigned"), F.sum("n").alias("n"))
    by_owner = by_text.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"), F.max("assigned").alias("assigned"), F.sum("n").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.max("assigned").alias("assigned"), F.sum("n").alias("n"))


def _exploded(found: DataFrame, *keep: str) -> DataFrame:
    some = found.where((F.size("base") > 0) | (F.size("loose") > 0))
    return some.select(*keep, F.explode(F.concat("base", "loose")).alias("s")).withColumn("value_hash", F.col("s.value_hash"))


def judged(found: DataFrame) -> DataFrame:
    """Candidates with their added spans (owned), and how many spans look live or copied.

    A value is copied if COPIED_OWNERS owners hold it, or COPIED_REPOSITORIES repositories; else it looks live. A loose
    word is added if the same value is assigned to a key somewhere, or if a single owner holds it and it isn't copied.
    """
    some = found.where((F.size("base") > 0) | (F.size("loose") > 0)).select("doc_id", "text_hash", "base", "loose").distinct()
    known = join_by_key(_exploded(some, "doc_id", "text_hash"), stored(ownership(found), "ownership"), ["value_hash"])
    live = (F.col("owners") < COPIED_OWNERS) & (F.col("repositories") < COPIED_REPOSITORIES)
    added = (F.col("s.rank") == 3) & (F.col("assigned") | (F.col("owners") == 1) & live)
    counted = (F.col("s.rank") < 3) | added
    return known.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.when(added, F.col("s")))).alias("owned"),
        F.count(F.when(counted & live, 1)).alias("n_live"),
        F.count(F.when(counted & ~live, 1)).alias("n_copied"),
    )


def _count(spans: str, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row for each input row: counts and hash of the base spans, all spans, and their ownership.

    A text is a repository, owner_col its owner (a null owner is an owner like any other). A null or
    empty text has no spans. Repeated rows give repeated results, and copies count as one repository. Other columns
    of docs are not read. An empty table gives no rows. Only JVM expressions are used.
    """
    found = stored(candidates(docs, id_col, text_col, owner_col), "candidates")
    some = (F.size("base") > 0) | (F.size("loose") > 0)
    kept = judged(found).withColumnRenamed("doc_id", "judged_id").withColumnRenamed("text_hash", "judged_hash")
    hits = found.where(some).join(kept, F.col("doc_id").eqNullSafe(F.col("judged_id")) & (F.col("text_hash") == F.col("judged_hash")), "left")
    hits = hits.select("doc_id", "base", "owned", "n_live", "n_copied")
    rest = found.where(~some).select("doc_id", "base", F.array().cast(_SPANS).alias("owned"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    spans = hits.unionByName(rest).withColumn("owned", F.coalesce("owned", F.array().cast(_SPANS)))
    return spans.select(
        F.col("doc_id").alias(id_col),
        *[_count("base", rank) for rank in range(3)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "owned"))).alias("spans"),
        F.size("owned").cast("long").alias("n_owned"),
        "n_live",
        "n_copied",
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mask: str = "[secret]") -> DataFrame:
    """docs with the value of every span replaced by the mask; spans that overlap get one mask.

    The same word outside a span stays. Rows without a span stay as they are; a null id is an id. Columns of docs
    may have any name, and their order stays.
    """
    all_found = candidates(docs, id_col, text_col, owner_col)
    found = stored(all_found.where((F.size("base") > 0) | (F.size("loose") > 0)), "candidates")
    owned = judged(found).select(F.col("doc_id").alias("judged_id"), F.col("text_hash").alias("judged_hash"), "owned")
    same = F.col("doc_id").eqNullSafe(F.col("judged_id")) & (F.col("text_hash") == F.col("judged_hash"))
    hits = found.select("doc_id", "text_hash", "base").distinct().join(owned, same)
    values = F.transform(F.concat("base", "owned"), lambda s: F.struct(s["from"].alias("from"), s["end"].alias("end")))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), F.array_sort(values).alias("hit_values"))
    keep = {c: f"kept_{k}" for k, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(c).alias(new) for c, new in keep.items()])
    text = F.coalesce(F.col(keep[text_col]), F.lit(""))
    both = named.join(hits, F.col(keep[id_col]).eqNullSafe(F.col("hit_id")) & (F.xxhash64(text) == F.col("hit_hash")), "left")

    def add(state: Column, v: Column) -> Column:
        """Text up to the value and a mask; a value that begins within the last one only moves the end."""
        between = F.substring(text, state["at"] + 1, F.greatest(v["from"] - state["at"], F.lit(0)))
        out = F.when(v["from"] >= state["at"], F.concat(state["out"], between, F.lit(mask))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], v["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    new = F.aggregate("hit_values", start, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    new = F.when(F.col("hit_values").isNull() | (F.size("hit_values") == 0), F.col(keep[text_col])).otherwise(new)
    return both.select(*[(new if c == text_col else F.col(kept)).alias(c) for c, kept in keep.items()])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
