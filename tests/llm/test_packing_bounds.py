"""How tightly sequences are filled, hot length classes, and punctuation outside of Latin-1."""

import collections
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarterline.llm import cutting_stock, packing, word_pieces
from quarterline.llm.shared import read_table

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_padding_is_small_on_the_synthetic_table(spark):
    pieces = packing.op2_packing(spark, "/root/testdata/sf0.01").collect()
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    tokens = sum(p.length for p in pieces)
    sequences = len({p.sequence_id for p in pieces})
    assert sequences <= -(-tokens // 2048) * 1.005 + 1 and 1 - tokens / (2048 * sequences) < 0.01
    assert sum(p.doc_tokens for p in pieces if p.start == 0) == tokens and len({p.doc_id for p in pieces}) == docs.count()


@pytest.mark.parametrize("ranked", [3, 100_000])
def test_a_hot_length_class_is_ranked_in_parts(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    monkeypatch.setattr(packing, "SALTS", 2)
    rows = [(k, "word " * (63 if k % 3 else 40 + k)) for k in range(90)] + [(None, None), (None, None), (1, "word " * 63)]
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, start int, salt int, cls string").repartition(4)
    pieces = packing.pack(table, PATH, capacity=64).collect()
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    want = collections.Counter((d, (len(t.split()) if t else 0) + 1) for d, t in rows)
    assert collections.Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
    assert sum(p.length for p in pieces) == sum(n * k for (_, n), k in want.items())


def test_pieces_and_memos_equal_the_library(monkeypatch):
    monkeypatch.setattr(word_pieces, "MEMO", 50)
    packing.word_encoder.cache_clear()
    encode, tokenizer = packing.word_encoder(PATH), Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    rng = random.Random(9)
    parts = ["'", "'s", "'re", "'LL", "''", "s", "re", "'d9", "“", "”", "–", "—", "…", "€", "™", "‘s", "a", "Ab", "1", "!", " ", "\n", "中", "x" * 70, "tion", " ", "​", "⁰", "♥"]
    assert encode([]) == [] and encode([""]) == [b""] and encode(["", " ", ""]) == [b""] * 3
    for _ in range(60):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(25)]
        for text, got in zip(texts, encode(texts)):
            assert np.frombuffer(got, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    packing.word_encoder.cache_clear()


def test_an_unproven_end_warns():
    demand = np.zeros(50, dtype=int)
    demand[[6, 10, 12, 16, 18]] = 97, 89, 83, 79, 73
    with pytest.warns(UserWarning, match="against a bound"):
        cutting_stock.solve_relaxation(demand, 50, gap=1e-12, stalled=0)


def test_the_table_finds_what_was_added(monkeypatch):
    monkeypatch.setattr(word_pieces, "MEMO", 1000)
    table, rng = word_pieces.Table(), np.random.default_rng(3)
    held = {}
    for _ in range(12):
        keys = np.unique(rng.integers(1, 1 << 62, 300).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        # Neighbours in one slot.
        keys[:50] = (keys[0] >> np.uint64(40) << np.uint64(40)) + np.arange(1, 101, 2, dtype=np.uint64)
        keys = np.array([k for k in dict.fromkeys(keys.tolist()) if k not in held], dtype=np.uint64)
        counts = rng.integers(1, 5, len(keys)).astype(np.int32)
        ids = rng.integers(0, 49_000, counts.sum()).astype("<u4")
        if table.held >= 1000:
            table.forget()
            known = table.find(np.array(list(held), dtype=np.uint64)) >= 0
            held = {k: v for (k, v), some in zip(held.items(), known) if some}
        table.add(keys, ids, counts)
        held.update(zip(keys.tolist(), (x.tolist() for x in np.split(ids, counts.cumsum()[:-1]))))
        asked = rng.permutation(np.array(list(held), dtype=np.uint64))[:400]
        got, counts = table.take(table.find(asked))
        assert [x.tolist() for x in np.split(got, counts.cumsum()[:-1])] == [held[k] for k in asked.tolist()]
        table.used[table.find(asked)] = True
        assert (table.find(np.array([2, 4], dtype=np.uint64)) == -1).all()
