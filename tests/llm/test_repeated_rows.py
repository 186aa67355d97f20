"""Near duplicates among repeated rows, ids with several texts, and copies in many parts."""

import random

from quarterline.llm import jaccard

WORDS = [f"w{k}" for k in range(120)]


def variant(k: int, swaps: int) -> str:
    rng, mine = random.Random(k), WORDS.copy()
    for at in rng.sample(range(120), swaps):
        mine[at] = f"x{k}y{at}"
    return " ".join(mine)


def grams(text: str) -> set:
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_repeated_rows_count_once(spark):
    base = " ".join(WORDS)
    near = base.replace("w60", "other")
    rows = [(22, base), (22, base), (23, near), (24, "a b c d e f"), (24, "a b c d e f")]
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {22: (1, 22), 23: (1, 22), 24: (0, 24)}


def test_copies_and_near_copies_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [variant(k, rng.randint(0, 3)) for k in range(25)]
    rows = [(k, texts[k % 25]) for k in range(60)]
    rng.shuffle(rows)
    # Clashing names are not read.
    table = spark.createDataFrame([(*r, 1, "x") for r in rows + rows[:20]], "doc_id long, text string, class int, cluster string")
    got = {r.doc_id: r for r in jaccard.jaccard_join(table).collect()}
    sets = {k: grams(t) for k, t in rows}
    links = {k: {o for o in sets if o != k and len(sets[k] & sets[o]) / len(sets[k] | sets[o]) >= 0.8} for k in sets}
    reach = {}
    for k in sorted(sets):
        if k not in reach:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in reach:
                    reach[x] = k
                    todo += links[x]
    assert {k: (r.n_links, r.class_id) for k, r in got.items()} == {k: (len(links[k]), reach[k]) for k in sets}
    kept = jaccard.one_of_each(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == set(reach.values())


def test_an_id_with_several_texts_ties_them(spark):
    base, other = " ".join(WORDS), " ".join(f"v{k}" for k in range(50))
    rows = [(5, base), (5, other), (1, base), (2, other), (3, "quite another text of its own here")]
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: (2, 1), 1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_prefixes_are_shortened_by_what_the_data_hold(spark):
    import numpy as np

    def trie(seed: int, changed: int) -> bytes:
        rng = np.random.default_rng(seed)
        values = np.arange(256, dtype=">u2")
        for quarter in range(4):
            values[64 * quarter + rng.permutation(64)[:changed]] = 60_000
        return values.tobytes()

    # Similarities of 0.91, 0.83 and 0.81: eight, seven and six values are shared with a probability of RECALL.
    for changed, want in ((6, 8), (11, 7), (12, 6)):
        tries = spark.createDataFrame([(0, trie(0, 0))] + [(k, trie(k, changed)) for k in range(1, 40)], "class long, trie binary")
        pairs = spark.createDataFrame([(0, k, 8) for k in range(1, 40)], "a long, b long, depth int")
        assert jaccard.matched_depth(pairs, tries, 0.8, 6) == want
        assert jaccard.meets(1 - changed / 64, want) >= jaccard.RECALL > (jaccard.meets(1 - changed / 64, want + 1) if want < 8 else 0)
    assert jaccard.matched_depth(pairs.where("false"), tries, 0.8, 6) == 6
