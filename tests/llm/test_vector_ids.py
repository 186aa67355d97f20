"""Ids with several vectors."""

import numpy as np

from quarterline.llm import vectors


def test_every_vector_of_an_id_is_compared(spark):
    rng = np.random.default_rng(11)
    a, b, c, d = rng.normal(size=(4, 64))
    near = lambda x: x + rng.normal(size=64) * 0.05
    rows = [(1, a, 1), (1, b, 1), (1, c, 2), *[(k, b, 1) for k in range(2, 8)], (10, near(a), 1), (11, near(b), 1), (12, near(c), 2), (13, near(d), 1)]
    # 20 and 21 have one vector each in common, and both meet 22 twice.
    rows += [(20, d, 1), (21, d, 1), (20, e := near(d), 1), (21, e, 1), (22, e, 1), (22, near(d), 1), (30, -a, 1)]
    rows = [(k, x.tolist(), label) for k, x, label in rows]
    want, ids = {k: set() for k, _, _ in rows}, sorted({k for k, _, _ in rows})
    for p, x, s in rows:
        for q, y, t in rows:
            if p != q and s == t and np.dot(x, y) >= 0.93 * np.linalg.norm(x) * np.linalg.norm(y):
                want[p].add(q)
    least = {k: k for k in ids}
    for _ in ids:
        least = {k: min([least[k], *(least[q] for q in want[k])]) for k in ids}
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(k, len(want[k]), least[k], least[k] == k) for k in ids]
    assert least[7] == least[12] == 1 and want[2] == {1, 3, 4, 5, 6, 7, 11}
