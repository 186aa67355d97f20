"""Removes passages that repeat across documents, and inside one where asked: sliding spans of consecutive sentences, joined by hash."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import discard, join_by_key, map_texts, read_table, stored

#: A span is a run of consecutive sentences with at least this many words; the shortest of them cover all others.
SPAN_WORDS = 25
#: Sentences of more words are cut behind the words that their hash picks, one in PICK, or else after as many words.
LONGEST, PICK = 24, 6
_ends = re.compile(r"[。！？][.!?…。！？]*[」』”’）]*\s*|[.!?…]+\s+|\n\s*").finditer
_word = re.compile(r"\S+\s*").finditer
_LAST = (1 << 63) - 1
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def sentences(text: str) -> list[str]:
    """The text cut behind sentence marks and line breaks; joined they are the text again. Full-width marks need no space behind them."""
    cuts = [0, *(m.end() for m in _ends(text))]
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


class _Picks(dict):
    """Whether a sentence may be cut behind a word; frequent words are remembered."""

    def __missing__(self, word: str) -> bool:
        picked = zlib.crc32(word.encode("utf-8", "surrogatepass")) % PICK == 0
        if len(self) < 300_000 and len(word) < 64:
            self[word] = picked
        return picked


_picks = _Picks()


def _cuts(words: list[str]) -> list[int]:
    """Numbers of words before each cut of an overlong sentence; where it is cut hangs on the words nearby alone."""
    cuts, last = [], 0
    for k, picked in enumerate(map(_picks.__getitem__, words), 1):
        if picked or k - last == LONGEST:
            cuts.append(k)
            last = k
    return cuts


def parts(text: str) -> tuple[list[str], list[int]]:
    """The sentences, overlong ones in parts, and the number of the sentence each is of; joined they are the text again."""
    out, sentence = [], []
    for k, s in enumerate(sentences(text)):
        words = s.split()
        at = [0]
        if len(words) > LONGEST:
            ends = [m.end() for m in _word(s)]
            at += [ends[n - 1] for n in _cuts(words) if n < len(words)]
        for x, y in zip(at, [*at[1:], len(s)]):
            out.append(s[x:y])
            sentence.append(k)
    return out, sentence


def _words_of_parts(text: str) -> list[list[str]]:
    out = []
    for s in sentences(text):
        words = s.split()
        if len(words) > LONGEST:
            cuts = [n for n in _cuts(words) if n < len(words)]
            out += [words[x:y] for x, y in zip([0, *cuts], [*cuts, len(words)])]
        else:
            out.append(words)
    return out


def spans(text: str, span_words: int = SPAN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, first part, last part) of the shortest runs of span_words, from each first and to each last part.

    A longer run that repeats is covered by the shortest runs in it, which repeat with it, so these stand for every run.
    """
    import xxhash

    words = _words_of_parts(text)
    n = len(words)
    none = np.zeros(0, dtype=np.int64)
    if not n:
        return none, none, none, none
    # A script without spaces counts ten characters as a word.
    sizes = np.fromiter((max(len(w), sum(map(len, w)) // 10) for w in words), dtype=np.int64, count=n)
    total = np.r_[0, sizes.cumsum()]
    at = np.arange(n)
    last = np.searchsorted(total, total[:-1] + span_words) - 1
    first = np.searchsorted(total, total[1:] - span_words, side="right") - 1
    pairs = np.unique(np.r_[(at * n + last)[last < n], (first * n + at)[first >= 0]])
    start, end = pairs // n, pairs % n
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words), dtype="<u8").reshape(n, 2)
    keys = []
    with np.errstate(over="ignore"):
        shift = np.cumprod(np.full(n, _BACK, dtype=np.uint64))
        steps = np.cumprod(np.full(n, _STEP, dtype=np.uint64))
        for side in range(2):
            sums = np.r_[np.zeros(1, np.uint64), np.cumsum(digests[:, side] * steps, dtype=np.uint64)]
            key = (sums[end + 1] - sums[start]) * shift[start]
            key ^= (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            keys.append((key ^ (key >> np.uint64(29))).view(np.int64))
    return keys[0], keys[1], start, end


def held_again(key: np.ndarray, check: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of a text's spans, in order of first, it holds earlier. Those that overlap the first of their kind are not meant: that stays whole."""
    kinds, at, kind = np.unique(key, return_index=True, return_inverse=True)
    if len(kinds) == len(key):
        return np.zeros(len(key), dtype=bool)
    at = at[kind]
    return (first > last[at]) & (check == check[at])


def held_by_several(rows: DataFrame, key: list[str], holder: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows whose key several holders have (documents, if none are given), with the least of these as owner; and the stored table of such keys.

    Rows are reduced to least and greatest holder before the shuffle, and the keys held join back.
    """
    holder = F.col("doc_id") if holder is None else holder
    held = rows.groupBy(*key).agg(F.min(holder).alias("owner"), F.max(holder).alias("other"), F.count("*").alias("n"))
    held = stored(held.where(F.col("owner") < F.col("other")).select(*key, "owner", "n"), "held")
    return join_by_key(rows, held, key), held


def repeated_parts(docs: DataFrame, span_words: int = SPAN_WORDS, within: bool = False) -> DataFrame:
    """(doc_id, text_hash, marks) of the documents that lose parts; marks holds (first, last) pairs.

    Spans meet by 64 bits of their hash first; those that meet, by 96. With within, what a text holds again is marked where
    the text is read and meets no other text, and the texts of one id are holders of their own, in order of id and hash.
    """

    def make():
        def run(texts: list[str]):
            found, rows = [[], [], [], []], []
            for k, text in enumerate(texts):
                span_a, span_b, first, last = spans(text, span_words)
                if len(span_a):
                    again = held_again(span_a, span_b, first, last) if within else np.zeros(len(span_a), dtype=bool)
                    for column, values in zip(found, (span_a, (span_b >> 32).astype(np.int32), first << 32 | last, again)):
                        column.append(values)
                    rows.append(np.full(len(span_a), k))
            if not rows:
                return [[], [], [], []], []
            return [np.concatenate(x) for x in found], np.concatenate(rows)

        return run

    # A null id comes after all others.
    read = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.hash("text").alias("text_hash"), "text")
    found = stored(map_texts(read, {"doc_id": "doc_id", "text_hash": "text_hash"}, "text", "span_a long, span_b int, place long, again boolean", make), "spans")
    # Whether holders differ is all that 64 bits decide; which is the first is decided by the few that meet, whose numbers are longer.
    some, ordered = F.xxhash64("doc_id", "text_hash"), F.col("doc_id").cast("decimal(20)") * F.lit(1 << 32).cast("decimal(11)") + F.col("text_hash")
    some, ordered = (some, ordered) if within else (F.col("doc_id"), F.col("doc_id"))
    alike, held = held_by_several(found.where(~F.col("again")).drop("again"), ["span_a"], some)
    alike = stored(alike.drop("owner", "n"), "alike")
    inside = [stored(found.where("again").select("doc_id", "text_hash", "place"), "inside")] if within else []
    discard(found, held)
    later = held_by_several(alike, ["span_a", "span_b"], ordered)[0].where(ordered > F.col("owner")).select("doc_id", "text_hash", "place")
    for more in inside:
        later = later.unionByName(more)
    mark = F.struct(F.shiftright("place", 32).cast("int").alias("first"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("last"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(mark).alias("marks"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span_words: int = SPAN_WORDS, within: bool = False) -> DataFrame:
    """All columns of docs with the text less the sentences that any non-first repeated span covers.

    A span repeats if two documents hold it; the first of them is the one with the least id, and it keeps its text whole.
    With within, it also repeats if one document holds it twice, in places that do not overlap or in different texts of its id, null
    or not (these in order of their hash); the first place stays. Rows alike in id and text are one text and lose the same.
    Sentences of more than LONGEST words go in parts. Adds n_sentences and n_removed, the sentences that lose anything;
    columns of these names are replaced. A text that loses nothing stays as it is, a null text
    stays null, runs of fewer than span_words words are never looked for. Ids are integers. Rows with the same id count as one
    document; a null id comes after all others, and nulls are one document. An empty table gives no rows.
    """
    id_of = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_LAST))
    ours = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = repeated_parts(ours, span_words, within).select(F.col("doc_id").alias("marked_id"), F.col("text_hash").alias("marked_hash"), "marks")
    # Columns of docs may have any name, so they go by number until the end.
    keep = {c: f"kept_{k}" for k, c in enumerate(docs.columns) if c not in ("n_sentences", "n_removed")}
    named = docs.select(*[F.col(c).alias(new) for c, new in keep.items()])
    text_kept, id_kept = keep[text_col], keep[id_col]
    both = named.join(marks, (F.hash(F.coalesce(F.col(text_kept), F.lit(""))) == F.col("marked_hash")) & (id_of(id_kept) == F.col("marked_id")), "left")

    def make():
        def run(texts: list[str], marked: list):
            out, total, removed = [], [], []
            for text, pairs in zip(texts, marked):
                if pairs is None:
                    out.append(text)
                    total.append(len(sentences(text)))
                    removed.append(0)
                    continue
                some, sentence = parts(text)
                gone = set().union(*(range(p["first"], p["last"] + 1) for p in pairs))
                out.append("".join(s for k, s in enumerate(some) if k not in gone).rstrip())
                total.append(sentence[-1] + 1)
                removed.append(len({sentence[k] for k in gone}))
            return [out, total, removed], None

        return run

    done = map_texts(both.drop("marked_id", "marked_hash"), {new: new for new in keep.values()}, text_kept, "text_left string, n_sentences int, n_removed int", make, also=("marks",))
    new = F.when(F.col(text_kept).isNotNull(), F.col("text_left"))
    return done.select(*[(new if c == text_col else F.col(kept)).alias(c) for c, kept in keep.items()], "n_sentences", "n_removed")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs, within=True).select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "n_sentences", "n_removed")
