"""The risk, its gradient, the prior and the sums over all rows."""

import zlib

import numpy as np

from quarterline.llm import quality
from quarterline.llm.shared import map_texts, read_table, stored
from tests.llm.conftest import prose


def sample(n: int, seed: int, shift: float) -> np.ndarray:
    return np.hstack([np.ones((n, 1)), np.random.default_rng(seed).normal(shift, 1, (n, 4))])


def test_risk_equals_the_loss_over_rows_and_its_slope():
    fp, fu, w, prior = sample(50, 1, 1.0), sample(70, 2, 0.0), np.random.default_rng(3).normal(size=5), 0.4
    loss = lambda f, y, w: np.mean((1 - y * (f @ w)) ** 2) / 4
    direct = lambda w: (prior * loss(fp, 1, w), loss(fu, -1, w) - prior * loss(fp, -1, w))
    p, n, slope_p, slope_n = quality.risk(w, quality.moments(fp), quality.moments(fu), prior)
    assert np.allclose([p, n], direct(w))
    for k in range(5):
        step = np.zeros(5)
        step[k] = 1e-6
        up, down = direct(w + step), direct(w - step)
        assert np.allclose([slope_p[k], slope_n[k]], [(up[0] - down[0]) / 2e-6, (up[1] - down[1]) / 2e-6], atol=1e-6)


def test_the_negative_part_stays_above_zero():
    # Few rows and many columns: the unbiased risk would go far below zero.
    rng = np.random.default_rng(5)
    fp, fu = np.hstack([np.ones((12, 1)), rng.normal(size=(12, 60))]), np.hstack([np.ones((30, 1)), rng.normal(size=(30, 60))])
    p, u = quality.moments(fp), quality.moments(fu)
    free = np.linalg.solve(u[1] + 1e-6 * np.eye(61), 2 * 0.5 * p[0] - u[0])
    assert quality.risk(free, p, u, 0.5)[1] < -0.1
    assert abs(quality.risk(quality.fit_pu(p, u, 0.5), p, u, 0.5)[1]) < 0.01


def test_the_prior_comes_from_positives_and_unlabelled():
    rng = np.random.default_rng(6)
    for prior in (0.3, 0.6, 0.9):
        p, u = rng.normal(3, 1, 4000), np.r_[rng.normal(3, 1, int(8000 * prior)), rng.normal(-1, 1, int(8000 * (1 - prior)))]
        cuts = np.quantile(p, np.linspace(0, 0.99, 200))
        above = lambda x: np.array([(x >= c).mean() for c in cuts])
        assert abs(quality.estimate_prior(above(p), above(u), 4000, 8000) - prior) < 0.05


def test_sums_and_counts_are_over_all_rows(spark):
    texts = [(k, prose(k)) for k in range(60)] + [(None, None), (61, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    made = lambda: lambda some: ([[quality.vector(t) for t in some]], None)
    vectors = stored(map_texts(docs, {"doc_id": "doc_id"}, "text", "x binary", made), "vectors")
    x = quality.matrix([quality.vector(t or "") for _, t in texts])
    net = quality.Net(x)
    n, (mean, second) = quality._sums(vectors, net)
    want = quality.moments(net.basis(x))
    assert n == len(texts) and np.allclose(mean, want[0]) and np.allclose(second, want[1])
    w = np.random.default_rng(1).normal(size=len(net.weights))
    g = net.basis(x) @ w
    cuts = np.unique(np.quantile(g, [0.1, 0.5, 0.9]))
    assert np.allclose(quality._share_above(vectors, net, w, cuts), [(g >= c).mean() for c in cuts])


def test_held_out_documents_of_the_synthetic_table(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    net = quality.train(docs, labels)
    assert abs(net.prior - 0.86) < 0.06
    got = quality.score(docs, net).join(labels.where("quality is not null"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got) and len(got) > 50
    good, bad = ([r for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([r.predicted for r in good]) >= 0.98 and np.mean([r.predicted for r in bad]) <= 0.25
    assert np.mean([a.score > b.score for a in good for b in bad]) > 0.98


def test_odd_columns_and_rows(spark):
    table = spark.createDataFrame([(1, "a b", 5, 0.5, "x"), (None, None, 6, 0.1, "y"), (1, "a b", 5, 0.5, "x")], "doc_id long, text string, id_of_text int, score double, kept_0 string")
    out = quality.score(table, None, keep=("id_of_text", "kept_0"))
    assert out.columns == ["doc_id", "id_of_text", "kept_0", "held_out", "score", "predicted"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 5, "x", False, 0.5, 1), (None, 6, "y", True, 0.5, 1), (1, 5, "x", False, 0.5, 1)], key=str)
