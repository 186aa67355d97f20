"""Order MinHash against brute force: every column, every row."""

import collections
import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from quarterline.llm import fingerprints
from tests.llm.conftest import prose

MASK = (1 << 64) - 1
UNSPACED = re.compile(fingerprints._UNSPACED.replace(r"\x{20000}-\x{3FFFF}", "\U00020000-\U0003ffff"))


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprint(text: str) -> str:
    text = UNSPACED.sub(lambda m: f" {m[0]} ", text)
    words = " ".join(" ".join([w[:48], *w[48:]]) if len(w) > 48 else w for w in re.split(r"[\t-\r ]+", text)).strip(" ").split(" ")
    seen, keyed = collections.Counter(), []
    for k in range(max(1, len(words) - 1)):
        seed = 42
        for w in (words[k], words[k + 1] if k + 1 < len(words) else ""):
            seed = xxhash.xxh64_intdigest(w.encode(), seed)
        kmer = signed(seed) >> 24
        n, seen[kmer] = seen[kmer], seen[kmer] + 1
        v = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), xxhash.xxh64_intdigest(kmer.to_bytes(8, "little", signed=True), 42))
        keyed.append((v >> 24, k))
    out = ""
    for t in range(-32, 32):
        # The permutation: distance from the start of the arc, all the way around; unsigned 40-bit places.
        start = (t << 34) & ((1 << 40) - 1)
        two = sorted(keyed, key=lambda x: (x[0] - start) % (1 << 40))[:2]
        seed = 42
        for v, _ in sorted(two, key=lambda x: x[1]):
            seed = xxhash.xxh64_intdigest((v - (1 << 40) if v >> 39 else v).to_bytes(8, "little", signed=True), seed)
        out += f"{max(1, seed >> 48):04x}"
    return out


def near(a: str, b: str) -> float:
    return sum(a[k : k + 4] == b[k : k + 4] for k in range(0, 256, 4)) / 64


def test_every_row_equals_brute_force(spark):
    rows = [(k * 3, prose(k, k % 5)) for k in range(12)]
    rows += [(1, None), (4, ""), (5, "one"), (7, "two words"), (8, "a b " * 40), (8, "other text of the same id"), (10, "漢字かな交じり文。" * 30), (11, "x" * 500), (13, "\n tabs\tand  spaces \n"), (9, prose(3, 3)), (9, prose(3, 3)), (None, "no id"), (None, None), (40, "é😀 " * 30)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, need int, edited string").repartition(4)
    order = sorted({(-(1 << 63) if d is None else d, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), t or "") for d, t in rows})
    want = collections.Counter()
    for d, t in rows:
        key = (-(1 << 63) if d is None else d, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), t or "")
        after = order[(order.index(key) + 1) % len(order)][2]
        text, q = t or "", len(t or "") // 4
        edited = text[: len(text) - q] + after[:q]
        f, e, g = fingerprint(text), fingerprint(edited), fingerprint(after)
        want[d, len(text), hashlib.sha256(edited.encode()).hexdigest(), f, e, near(f, e), near(f, g)] += 1
    assert collections.Counter(map(tuple, fingerprints.compare_with_edits(table).collect())) == want


def test_texts_without_spaces_and_moved_sentences(spark):
    rng = random.Random(1)
    signs = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400))
    short = prose(5, 6)
    moved = " ".join(reversed(short.split(". ")))
    blob = "".join(rng.choices("abcdef0123456789", k=3000))
    texts = [signs, signs[:300] + signs[:100], short, moved, blob, blob[:2250] + "z" * 750]
    got = [r.f for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select(fingerprints.order_minhash(F.col("t"), rotate=True).alias("f")).collect()]
    assert got == [fingerprint(t) for t in texts]
    # Of the k-mers that either text has, 0.6 are in both, and both of a tuple must be: 0.36 on average.
    assert 0.2 < near(got[0], got[1]) < 0.55 and 0.2 < near(got[4], got[5]) < 0.55
    # The same words in another order: a bag of words is the same, an ordered fingerprint is not.
    assert near(got[2], got[3]) < 0.75


