"""Repeats inside one document, and among texts whose ids are null or the same."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from quarterline.llm import shared, substrings
from tests.llm.test_span_rules import corpus, words


def brute(rows: list[tuple]) -> list[str | None]:
    """Marks every shortest run that an earlier text, by id and hash, or an earlier place of the same text without overlap holds."""
    last = 1 << 63
    runs = []
    for _, text, _ in rows:
        some = [" ".join(s.split()) for s in substrings.parts(text or "")[0]]
        n = [len(s.split()) for s in some]
        mine = [(i, j) for i in range(len(some)) for j in range(i + 1, len(some) + 1) if sum(n[i:j]) >= 25 and (sum(n[i : j - 1]) < 25 or sum(n[i + 1 : j]) < 25)]
        runs.append([(i, j, tuple(some[i:j])) for i, j in mine])
    places = {}
    for (d, _, h), mine in zip(rows, runs):
        for i, j, run in mine:
            places.setdefault(run, []).append((last if d is None else d, h, i, j))
    out = []
    for (d, text, h), mine in zip(rows, runs):
        gone = set()
        for i, j, run in mine:
            d0, h0, _, j0 = min(places[run])
            own = min(p for p in places[run] if p[:2] == (last if d is None else d, h))
            if (d0, h0) < (last if d is None else d, h) or i >= own[3]:
                gone |= set(range(i, j))
        out.append("".join(s for k, s in enumerate(substrings.parts(text or "")[0]) if k not in gone).rstrip() if gone else text)
    return out


def test_repeats_within_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = corpus()
    rows += [(d, (t or "") + " " + (t or "")) for d, t in rows[::4]] + [(90, "Same line of a few words.\n" * 30), (91, words(rng, 3) + ". " + "x " * 400)]
    passage = words(rng, 20) + ". " + words(rng, 20) + ". "
    rows += [(None, "A. " + passage), (None, "B. " + passage), (92, "C. " + passage * 2), (92, "D. " + passage)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.hash(F.coalesce("text", F.lit(""))))
    numbered = [tuple(r) for r in table.collect()]
    want = sorted(zip([d for d, _, _ in numbered], brute(numbered)), key=str)
    for hot in (10_000, 3):
        monkeypatch.setattr(shared, "HOT", hot)
        got = substrings.drop_repeats(table.drop("h").repartition(3), within=True).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == want


def test_the_query_removes_repeats_wherever_they_are(spark, tmp_path):
    rng = random.Random(6)
    a, b, c = (words(rng, 20) + ". " + words(rng, 12) + ". " for _ in range(3))
    rows = [(1, "One. " + a + "Between. " + a), (None, "Two. " + b), (None, "Three. " + b), (5, "Four. " + c), (5, "Five. " + c), (6, "Line.\n" * 60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = substrings.op6_substrings(spark, str(tmp_path)).collect()
    assert [r.text for r in got if r.doc_id == 1] == ["One. " + a + "Between."]
    for doc_id, passage in ((None, b), (5, c)):
        texts = [r.text for r in got if r.doc_id == doc_id]
        assert len(texts) == 2 and sum(passage.strip() in t for t in texts) == 1 and sum(len(t.split()) == 1 for t in texts) == 1
    # Of a line repeated 60 times, the first 25 stay.
    assert [r.text.split() for r in got if r.doc_id == 6] == [["Line."] * 25]


def test_the_pipeline_removes_repeats_inside_a_document(spark):
    rng = random.Random(9)
    passage = words(rng, 20) + ". " + words(rng, 12) + ". "
    rows = [(1, "One. " + passage + "Between. " + passage, "en", "s", 0), (None, "Two. Own.", "en", "s", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passage_stage(spark, table, "").collect()}
    assert got == {1: "One. " + passage + "Between.", None: "Two. Own."}
