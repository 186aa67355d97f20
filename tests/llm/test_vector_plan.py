"""Buckets that get finer as the vectors get more."""

import numpy as np
import pytest

from quarterline.llm import vectors
from tests.llm.test_pages_and_vectors import cloud, truth


@pytest.mark.parametrize("n", [1_000, 10_000_000, 1_000_000_000])
def test_recall_and_bucket_size_hold_at_every_number(n):
    tables, rotations, probes = vectors.plan(n, 64)
    assert n * vectors.PROBES <= vectors.HELD * 128**rotations
    rng = np.random.default_rng(21)
    a, b = rng.normal(size=(2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (vectors.buckets(v, tables, rotations, probes) for v in (a, b))
    assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.99


@pytest.mark.parametrize("kind", ["float", "double"])
def test_three_rotations_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "HELD", 0.02)
    v = cloud(300, 5).astype(np.float32).astype(float)
    labels = np.arange(len(v)) // 6 % 2
    assert vectors.plan(len(v), 64)[1] == 3
    table = spark.createDataFrame([(k, x.tolist(), int(y)) for k, (x, y) in enumerate(zip(v, labels))], f"vec_id long, embedding array<{kind}>, label int")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(table).collect()}
    linked = truth(v, labels)
    assert all(got[k] <= linked[k].sum() for k in got) and sum(got.values()) >= 0.995 * linked.sum()
