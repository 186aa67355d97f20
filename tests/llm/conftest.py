import random

import pytest


def prose(seed: int, sentences: int = 6) -> str:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["an", "the", "re", "on", "st", "éa", "li"], k=rng.randint(1, 4)))
    return " ".join(" ".join(word() for _ in range(rng.randint(6, 14))).capitalize() + "." for _ in range(sentences))


SHARED = prose(99, 8)


def corpus() -> list[tuple]:
    """(doc_id, text, source): plain texts, copies, near copies, a shared passage, and the odd cases."""
    rows = [(k, prose(k), f"src{k % 4}") for k in range(12)]
    rows += [(20, prose(3), "src1"), (21, prose(3).upper(), "src2"), (22, prose(40, 30), "src0"), (23, prose(40, 30).replace("the", "tho", 1), "src3")]
    rows += [(30, prose(50) + "\n" + SHARED + "\n" + prose(51), "src0"), (31, prose(52) + "\n" + SHARED + "\n" + prose(53), "src1")]
    rows += [(40, None, "src0"), (41, "", None), (42, "   \n\t ", "src1"), (43, "Word", "src1"), (44, "a b c d", "src2"), (45, "a b c d", "src2")]
    rows += [(46, "漢字かな交じり文。" * 40, "src2"), (47, "x" * 30_000, "src2"), (48, prose(60, 2500), "src3"), (49, "Released under the MIT License.", None)]
    return rows + [rows[5], (None, prose(5), "src1"), (None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    extra = ", words int, n string, cluster string, text_hash long, marks string, base string, score double, tree int, label string, block int, kept0 int, unit string, size int"
    blank = (None,) * 13
    return spark.createDataFrame([(*r, *blank) for r in corpus()], "doc_id long, text string, source string" + extra).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
