"""Repeated passages whose ends fall inside sentences."""

import random

from quarterline.llm import substrings


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))


def test_a_long_sentence_and_sentences_without_spaces_are_found(spark):
    # 12 + 38 + 12 words in common, of which the middle sentence alone is whole.
    shared = f"{words(1, 12)}. {words(2, 38)}. {words(3, 12)}"
    texts = [(k, f"{words(10 + k, 9)} {shared} {words(20 + k, 9)}. {words(30 + k, 9)}.") for k in (1, 2)]
    rng = random.Random(7)
    signs = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = "".join(signs(30) + "。" for _ in range(20))
    texts += [(k, signs(40) + "。" + passage + signs(40) + "。") for k in (3, 4)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.drop_repeats(table).collect()}
    assert [got[k].n_removed for k in (1, 2, 3, 4)] == [0, 1, 0, 20]
    assert words(2, 38) not in got[2].text and words(1, 12) in got[2].text and len(got[4].text) == 82


def test_sentences_join_to_the_text():
    for text in ("a. b! c", "一。二！「三。」四", "x。。 y…\n\nz.", "", "。"):
        assert "".join(substrings.sentences(text)) == text
    assert substrings.sentences("一。二！「三。」四") == ["一。", "二！", "「三。」", "四"]
