"""The operators on texts, held against brute force on a small corpus with odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarterline.llm import bpe, cutting_stock, fingerprints, jaccard, licences, packing, quality, secrets, substrings
from tests.llm.conftest import SHARED, corpus

ROWS = corpus()


def test_bpe_equals_the_library(docs, no_docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = bpe.encode_decode(docs, path, public_tokenizers.PATTERN)
    want = []
    for doc_id, text, _ in ROWS:
        ids = ref.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert bpe.encode_decode(no_docs, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_hostile_pieces():
    import random

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encode, decode = bpe.codec(path, public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "中", "\x1c", "'s", "'ll", "1", "23", "!!", "　", " ", "😀", "the", "tion", "\x85", "_", "==="]
    for text in ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(1500)] + ["a" * 9000, " " * 9000, "ab" * 4000]:
        ids = encode(text)
        assert list(memoryview(ids).cast("I")) == ref.encode_ordinary(text) and decode(ids) == text.encode()


def test_word_encoder_equals_the_library():
    import random

    path = public_tokenizers.path("word_bpe_49k.json")
    encode, tokenizer = packing.word_encoder(path), Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rng = random.Random(1)
    parts = ["a", "B", " ", "É", "é", "́", "'s", "’", "1", "²", "½", "!!", "中", "\x1c", "\x85", " ", "Σ", "ΑΣ ", "İ", "<|endoftext|>", "ß", "ﬁ", "#", "_", "ǅ", "ŉ", "ª"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 20))) for _ in range(1500)] + [t or "" for _, t, _ in ROWS]
    for text, got in zip(texts, encode(texts)):
        assert np.frombuffer(got, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text[:50])


def test_packing_holds_every_id_once(docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = packing.word_encoder(path)
    pieces = packing.pack(docs, path, capacity=256).collect()
    assert packing.pack(no_docs, path).count() == 0
    want = collections.Counter()
    for doc_id, ids in zip([r[0] for r in ROWS], encode([r[1] or "" for r in ROWS])):
        ids += np.array([1], dtype="<u4").tobytes()
        for at in range(0, len(ids), 1024):
            want[doc_id, at // 4, len(ids[at : at + 1024]) // 4, zlib.crc32(ids[at : at + 1024]), len(ids) // 4] += 1
    assert collections.Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256


def test_column_generation_finds_the_optimum():
    # 20 bins of 6 + 4 and 10 of 5 + 5 are full; only pairs of patterns found by pricing reach that.
    demand = np.zeros(10, dtype=int)
    demand[[5, 3, 4]] = 20, 20, 20
    chosen = cutting_stock.patterns(demand, 10)
    assert sum(t for _, t in chosen) == 30
    assert (sum(p * t for p, t in chosen) >= demand).all() and all((p * np.arange(1, 11)).sum() <= 10 for p, _ in chosen)
    # Items of 3 fit in tens by threes; the bound of the total size is not reached, the dual bound is.
    thirds = np.zeros(10, dtype=int)
    thirds[2] = 30
    assert sum(t for _, t in cutting_stock.patterns(thirds, 10)) == 10
    assert cutting_stock.patterns(np.zeros(10, dtype=int), 10) == []


def base_spans(text: str) -> list[tuple]:
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secrets(spark, docs, no_docs):
    live, copied, bare = "zQ9xw7Lk2PpR5tY8mN3bVc6D", "Xk2PpR5tY8mN3bVc6Dq9Lw71", "hJ4kd8sLq2Wm5nRt7yUx3aBc"
    texts = [
        (1, "é password = 'abc' Secret: 'hunter2hunter2' token=secret:abcdefgh12", "a"), (2, "x AKIAABCDEFGHIJKL12 AKIA12 " + "0123456789abcdef" * 2, "a"), (3, f"apikey={live} and {bare} here", "a"),
        (4, f"seen {live} again", "b"), (5, f"api_key: {copied}", "a"), (6, f"API_KEY = {copied}", "b"), (7, f"token={copied} {copied}", "c"), (8, "TOKEN==" + "=" * 9, None),
        (9, f'passwd="{"a1" * 20}"', "d"), (10, f"a {bare[::-1]} b", "a"), (11, f"c {bare[::-1]} d", "b"),
    ]
    table = spark.createDataFrame(texts, "doc_id long, text string, source string").unionByName(docs.select("doc_id", "text", "source").where("doc_id is null or doc_id > 11"))
    others = [r for r in ROWS if r[0] is None or r[0] > 11]
    got = collections.defaultdict(list)
    for r in secrets.scan(table).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(texts) + len(others)
    for doc_id, text, _ in texts + [r for r in others if r[0] is not None]:
        want = base_spans(text or "")
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        row = got[doc_id][0]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3)), text
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert "owned:" in got[3][0].spans and "owned:" in got[4][0].spans and "owned:" in got[7][0].spans
    assert "owned:" not in got[10][0].spans and got[7][0].n_copied == 2 and got[3][0].n_live == 2
    assert secrets.scan(no_docs).count() == 0
    clean = {r.doc_id: r.text for r in secrets.masked(table).where("doc_id < 12").collect()}
    assert live not in clean[3] and bare not in clean[3] and "hunter2" not in clean[1] and clean[10] == texts[9][1]
    same = secrets.masked(docs)
    assert same.columns == docs.columns and same.exceptAll(docs).count() == 0 and docs.exceptAll(same).count() == 0


def test_jaccard_equals_brute_force(docs, no_docs):
    got = {r.doc_id: r for r in jaccard.jaccard_join(docs).collect()}
    sets = {}
    for doc_id, text, _ in ROWS:
        words = re.findall(r"\w+", (text or "").lower())
        if words and doc_id is not None:
            sets[doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    links = {(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(20, 3), (20, 21), (22, 23), (44, 45)} <= links
    for k in sets:
        assert got[k].n_links == sum(a == k for a, _ in links)
        reach, todo = {k}, [k]
        while todo:
            x = todo.pop()
            todo += [b for a, b in links if a == x and b not in reach]
            reach |= {b for a, b in links if a == x}
        assert got[k].class_id == min(reach)
    for k in (40, 41, 42):
        assert (got[k].class_id, got[k].n_links) == (k, 0)
    assert set(got) == {r[0] for r in ROWS}
    assert jaccard.jaccard_join(no_docs).count() == 0


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    import random

    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(40):
        mine = words.copy()
        for at in rng.sample(range(150), rng.randint(0, 4)):
            mine[at] = f"x{k}y{at}"
        texts.append((k, " ".join(mine)))
    got = {r.doc_id: r for r in jaccard.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(146)} for k, t in texts}
    for k in sets:
        assert got[k].n_links == sum(len(sets[k] & sets[o]) / len(sets[k] | sets[o]) >= 0.8 for o in sets if o != k)


def test_repeated_passages_go_but_the_first(docs, no_docs):
    rows = [(r.doc_id, r.text, r.n_removed) for r in substrings.drop_repeats(docs).collect()]
    got = {a: (b, n) for a, b, n in rows if a is not None}
    assert len(rows) == len(ROWS) and SHARED in got[30][0] and got[30][1] == 0
    assert SHARED.split(". ")[3] not in got[31][0] and got[31][0].startswith(ROWS[17][1][:40])
    assert got[40] == (None, 0) and got[41] == ("", 0) and got[20][0] == ""
    for doc_id, text, _ in ROWS:
        if doc_id is not None and doc_id < 12:
            assert got[doc_id] == (text, 0)
    assert substrings.drop_repeats(no_docs).count() == 0


def test_spans_cover_passages_whatever_stands_around_them():
    from tests.llm.conftest import prose

    for k in range(30):
        passage = prose(1000 + k, 6)
        inside = set(substrings.spans(passage)[0].tolist())
        around = set(substrings.spans(prose(2000 + k, 3) + "\n" + passage + " " + prose(3000 + k, 3))[0].tolist())
        assert inside <= around


def test_fingerprints(docs, no_docs):
    got = fingerprints.compare_with_edits(docs).collect()
    assert len(got) == len(ROWS)
    named = sorted({(r[0], r[1] or "") for r in ROWS if r[0] is not None})
    texts = dict(named)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    ids = list(texts)
    for k, doc_id in enumerate(ids[:-1]):
        text, after, row = texts[doc_id], texts[ids[k + 1]], by_id[doc_id]
        q = len(text) // 4
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert by_id[3].fingerprint == by_id[20].fingerprint and by_id[44].near_next == 1.0
    assert 0.15 < by_id[48].near_edited < 0.7 and by_id[7].near_next < 0.1
    assert fingerprints.compare_with_edits(no_docs).count() == 0


def test_order_minhash_by_hand(spark):
    import xxhash

    text = "b a b a b c a b " * 9 + "z y x"
    words = text.split()
    mask = (1 << 64) - 1

    def h(*parts):
        seed = 42
        for p in parts:
            data = p.encode()
            seed = xxhash.xxh64_intdigest(data, seed)
        return seed

    seen, keyed = collections.Counter(), []
    for k in range(len(words) - 1):
        kmer = h(words[k], words[k + 1]) >> 24
        signed = kmer - (1 << 40) if kmer >> 39 else kmer
        n = seen[signed]
        seen[signed] += 1
        v = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), xxhash.xxh64_intdigest(int(signed).to_bytes(8, "little", signed=True), 42))
        keyed.append(((v >> 24 << 24) | k) & mask)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in keyed)
    out = ""
    for t in range(-32, 32):
        mine = [v for v in signed if v >> 58 == t][:2]
        if not mine:
            out += "0000"
            continue
        seed = 42
        for v in sorted(mine, key=lambda v: v & 0xFFFFFF):
            seed = xxhash.xxh64_intdigest((v >> 24).to_bytes(8, "little", signed=True), seed)
        out += f"{max(1, seed >> 48):04x}"
    got = spark.createDataFrame([(text,)], "t string").select(fingerprints.order_minhash(F.col("t"))).first()[0]
    assert got == out


def test_licences(spark, docs, no_docs):
    texts = [
        (1, "Intro.\nReleased under the MIT License.\nMore", None), (2, "LICENSED### under the APACHE License,*** Version 2.0.", None), (3, "This work is licensed under the GNU General Public License, version 2.", None),
        (4, licences.TEMPLATES[20][1] + " extra words", None), (5, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0. Then text.", None), (6, "The licence of the poet", None),
    ]
    table = spark.createDataFrame(texts, "doc_id long, text string, source string").unionByName(docs.select("doc_id", "text", "source"))
    got = {(r.doc_id, r.licence) for r in licences.scan(table).collect()}
    assert got == {(1, "MIT"), (2, "Apache-2.0"), (3, "GPL-2.0"), (4, "MIT"), (5, "CC-BY-NC-4.0"), (49, "MIT")}
    assert licences.scan(no_docs).count() == 0


def test_quality_learns_without_labels_of_the_negatives(spark, docs, no_docs):
    from tests.llm.conftest import prose

    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = " ".join(f"{w}###" for w in prose(k).split()) if bad else prose(k)
        rows.append((k, text))
        if k % 2 == 0 or not bad:
            labels.append((k, 0 if bad else 1))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int")
    scored = quality.score(table, quality.train(table, marks)).collect()
    held = [r for r in scored if r.held_out]
    assert len(held) == sum(zlib.crc32(str(k).encode()) % 5 == 0 for k in range(400))
    assert np.mean([(r.predicted == 1) == (r.doc_id % 4 != 0) for r in held]) > 0.95
    net = quality.train(table, marks)
    odd = quality.score(docs, net)
    assert odd.count() == len(ROWS) and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.train(no_docs, marks.where("false").select("doc_id", "quality")) is None
    assert quality.score(no_docs, None).count() == 0


@pytest.mark.parametrize("depth", [4, 6, 8])
def test_the_forest_shortens_prefixes_until_the_recall(depth):
    from quarterline.llm.shared import recall_depth

    target = 1 - (1 - 0.8**depth) ** 32
    assert recall_depth(0.8, 32, 8, target - 1e-12) == depth
