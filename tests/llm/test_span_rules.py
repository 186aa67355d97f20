"""Repeated spans against brute force over every run of consecutive sentences."""

import random
import zlib

from quarterline.llm import shared, substrings


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def corpus() -> list[tuple]:
    rng = random.Random(13)
    passages = [" ".join(words(rng, rng.randint(2, 40)) + rng.choice([". ", "!\n", "? "]) for _ in range(rng.randint(2, 8))) for _ in range(6)]
    rows = []
    for k in range(40):
        own = [words(rng, rng.randint(1, 60)) + rng.choice([". ", "\n", " "]) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 2)):
            own.insert(rng.randint(0, len(own)), rng.choice(passages))
        rows.append((rng.randint(0, 35), "".join(own)))
    return rows + [(1, None), (2, ""), (3, " \n "), (None, passages[0]), (None, passages[0] + "x"), (50, passages[1]), (50, passages[1])]


def brute(rows: list[tuple]) -> list[str | None]:
    """Marks every run of at least 25 words, of any length, that a document with a smaller id holds."""
    last = 1 << 63
    cut = [substrings.parts(t or "")[0] for _, t in rows]
    runs = []
    for some in cut:
        w = [s.split() for s in some]
        runs.append({(i, j): " ".join(x for u in w[i:j] for x in u) + f"|{j - i}" for i in range(len(w)) for j in range(i + 1, len(w) + 1) if sum(map(len, w[i:j])) >= 25})
    first = {}
    for (d, _), mine in zip(rows, runs):
        for run in mine.values():
            first[run] = min(first.get(run, last), last if d is None else d)
    out = []
    for (d, text), some, mine in zip(rows, cut, runs):
        gone = {k for (i, j), run in mine.items() if first[run] < (last if d is None else d) for k in range(i, j)}
        out.append("".join(s for k, s in enumerate(some) if k not in gone).rstrip() if gone else text)
    return out


def test_every_run_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_sentences int, marks string").repartition(3)
    want = sorted(((d, t) for (d, _), t in zip(rows, brute(rows))), key=str)
    assert sum(t != u for (_, t), u in zip(rows, brute(rows))) > 10
    for hot in (10_000, 3):
        monkeypatch.setattr(shared, "HOT", hot)
        out = substrings.drop_repeats(table)
        assert out.columns == ["doc_id", "text", "marks", "n_sentences", "n_removed"]
        got = out.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
        assert all((r.n_removed > 0) == ((r.doc_id, r.text) not in rows) for r in got)


def test_parts_join_to_the_text_and_hang_on_words_nearby():
    rng = random.Random(3)
    shared = words(rng, 200)
    for text in ("", " ", "a", f"  {shared}\n\n{shared}. x", "word " * 100):
        some, sentence = substrings.parts(text)
        assert "".join(some) == text and len(some) == len(sentence) and all(len(s.split()) <= substrings.LONGEST for s in some)
        assert [s.split() for s in some] == substrings._words_of_parts(text)
    a, b = (set(substrings.parts(words(rng, k) + " " + shared)[0]) for k in (3, 31))
    assert sum(len(s.split()) for s in a & b) > 150
    assert sum(zlib.crc32(w.encode()) % substrings.PICK == 0 for w in shared.split()) > 15


def test_a_document_may_repeat_itself(spark):
    rng = random.Random(8)
    passage = words(rng, 30) + ". " + words(rng, 12) + ". "
    table = spark.createDataFrame([(1, passage * 3), (2, "Own text. " + passage + "More of it. " + passage)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substrings.drop_repeats(table).collect()}
    assert got == {1: passage * 3, 2: "Own text. More of it."}
