"""Packs documents into token sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import cutting_stock
from .shared import map_texts, read_table, stored
from .word_pieces import word_encoder

#: Lengths are rounded up to multiples of this for the linear program: 1024 classes for 2048 tokens.
GRAIN = 2
#: Pieces of a length class are ranked in parts of at most about RANKED, and in SALTS at least, so that no class is one task.
SALTS, RANKED = 256, 100_000


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Each document's ids with end_id behind them, cut into pieces of capacity and a rest."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def make():
        encode = word_encoder(tokenizer_path)

        def run(texts: list[str]):
            rows, source = [], []
            for k, ids in enumerate(encode(texts)):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    rows.append((at, len(piece) // 4, zlib.crc32(piece), n, zlib.crc32(piece, 1)))
                    source.append(k)
            return [list(x) for x in zip(*rows)] or [[]] * 5, source

        return run

    return map_texts(docs, {id_col: "doc_id"}, text_col, "start long, length long, ids_crc32 long, doc_tokens long, again long", make)


def plan_intervals(demand: np.ndarray, capacity: int) -> pd.DataFrame:
    """Which ranks of each class go to which sequences: rows (cls, first, places, base, slot), by cls and first.

    Rank r in [first, first + ...) goes to sequence base + (r - first) // places, at slot + (r - first) % places.
    There are at most as many patterns as classes and rounded-off items, whatever the number of documents.
    """
    base, given, rows = 0, np.zeros(len(demand), dtype=np.int64), []
    for pattern, times in cutting_stock.patterns(demand, capacity):
        slot = 0
        for k in np.flatnonzero(pattern)[::-1]:
            places = int(pattern[k])
            rows.append((int(k), int(given[k]), places, base, slot))
            given[k] += places * times
            slot += places
        base += times
    return pd.DataFrame(rows, columns=["cls", "first", "places", "base", "slot"]).sort_values(["cls", "first"], ignore_index=True)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document of more than capacity tokens is cut into full pieces and a rest; nothing else is cut. The
    histogram of lengths (capacity / GRAIN counts) goes to the driver, column generation finds patterns and
    rounds them down, what is left is packed by best fit, and the pieces of each class are dealt to the
    patterns' places by their rank. Offsets then follow from the true lengths, so they are gapless.

    A null or empty text is the end token alone. Repeated rows are packed as often as they occur; a null id
    stays null. A very long text is one row in Python and its pieces are small; no step holds more than one batch of texts. Ranks go by id, start and hashes, so ties fall the same way in every run (equal rows are
    interchangeable). An empty table gives no rows. Other columns of docs are not read.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    cls = F.ceil(F.col("length") / GRAIN).cast("long") - 1
    pieces = pieces.withColumn("cls", cls)
    # One count for each class: at most capacity / GRAIN rows.
    demand = np.zeros(-(-capacity // GRAIN), dtype=np.int64)
    for row in pieces.groupBy("cls").count().collect():
        demand[row["cls"]] = row["count"]
    salts = max(SALTS, -(-int(demand.max()) // RANKED))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "again"), F.lit(salts)))
    table = plan_intervals(demand, capacity // GRAIN)

    parts = pieces.groupBy("cls", "salt").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("cls", "salt", before.alias("before"))
    by_part = Window.partitionBy("cls", "salt").orderBy("doc_id", "start", "ids_crc32", "again", "doc_tokens")
    ranked = pieces.withColumn("rank", F.row_number().over(by_part) - 1).join(parts, ["cls", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "again", "cls", (F.col("rank") + F.col("before")).alias("rank"))

    key = (table["cls"].to_numpy(np.int64) << 44) + table["first"].to_numpy(np.int64)
    first, places, base, slot = (table[c].to_numpy(np.int64) for c in ("first", "places", "base", "slot"))

    kind = docs.schema[id_col].dataType
    from pyspark.sql.types import StructType

    schema = StructType().add("doc_id", kind)
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"):
        schema = schema.add(name, "long")

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            rank, cls = (batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("rank", "cls"))
            at = np.searchsorted(key, (cls << 44) + rank, side="right") - 1
            ahead = rank - first[at]
            places_of = [pa.array(base[at] + ahead // places[at]), pa.array(slot[at] + ahead % places[at])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + places_of, names=[*names, "sequence_id", "slot"])

    dealt = ranked.mapInArrow(deal, schema)
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset")
    return dealt.select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
