"""HTML extraction and near-duplicate vectors."""

import numpy as np
import pytest

from quarterline.llm import html, vectors

TREE = html.train_tree()


def test_the_tree_fits_its_table():
    table = np.array(html.LABELLED, dtype=float)
    assert ((html.classify(TREE, table[:, :-1]) >= 0.5) == (table[:, -1] == 1)).mean() > 0.9


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<p>", ""),
        ('<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p><b>one\n  two<br><p>three</article><footer>&copy; x</footer></body></html>', "A & B\none two\nthree"),
        ('<article><script>var t="</p>";</script><p>a &lt;b&gt; &amp;amp;</p><!-- <p>no</p> --><div class="ad">buy</div><form><p>mail</p></form><section id="comments"><p>nice</p></section></article>', "a <b> &amp;"),
        ('<main><div class="cookie-notice">ok?</div><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></main><aside>s</aside>', "x\ny\n1\n2"),
    ],
)
def test_pages(page, text):
    assert html.main_text(page, TREE) == text


def test_pages_without_main_markup_keep_their_long_blocks():
    words = lambda n: " ".join(["word"] * n)
    page = f'<body><div id="menu"><a>a</a> <a>b</a></div><div><p>{words(40)}</p><p>{words(60)}</p></div><div class="footer">{words(8)}</div></body>'
    assert html.main_text(page, TREE) == f"{words(40)}\n{words(60)}"


def test_extract_on_odd_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, 5), (2, None, "<article>x</article>", 5), (None, "u", "<article>x</article>", 5), (2, None, "<article>x</article>", 5)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html.extract(rows).collect()), key=str)
    assert got == sorted([(1, "", 0), (2, "x", 1), (None, "x", 1), (2, "x", 1)], key=str)
    assert html.extract(rows.where("false")).count() == 0


def cloud(n: int, seed: int) -> np.ndarray:
    """Vectors in groups whose cosines lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 6, 64))
    return np.repeat(centers, 6, axis=0) + rng.normal(size=(n // 6 * 6, 64)) * np.tile([0.0, 0.12, 0.2, 0.24, 0.27, 0.3], n // 6)[:, None]


def truth(v: np.ndarray, labels: np.ndarray) -> np.ndarray:
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(linked, False)
    return linked


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    v = np.vstack([cloud(300, 1), np.repeat(cloud(6, 2)[:1], 150, axis=0) + np.random.default_rng(3).normal(size=(150, 64)) * 0.05, np.repeat(cloud(6, 4)[:1], 30, axis=0)]).astype(np.float32).astype(float)
    labels = np.arange(len(v)) // 6 % 3
    labels[300:] = 1
    rows = [(k, x.tolist(), int(y), None, None) for k, (x, y) in enumerate(zip(v, labels))]
    n = len(rows)
    odd = [(n, None, 1, None, None), (n + 1, [0.0] * 64, 1, None, None), (n + 2, [float("nan")] * 64, 1, None, None), (n + 3, [None] * 64, 1, None, None), (n + 4, v[0].tolist(), None, None, None), (n + 5, [float("inf")] + [1.0] * 63, 1, None, None), (n + 6, [1.0, 2.0], 1, None, None), (n + 7, [1.0, 2.0], 1, None, None), (n + 8, [], 1, None, None)]
    table = spark.createDataFrame(rows + odd + rows[:2] + [(None, v[0].tolist(), 0, None, None)], "vec_id long, embedding array<float>, label int, n int, bucket int")
    got = {r.vec_id: r for r in vectors.near_duplicates(table).collect()}
    linked = truth(v, labels)
    found, want = sum(got[k].n_links for k in range(n)), int(linked.sum())
    assert found <= want and found >= 0.995 * want
    assert [got[k].n_links for k in range(300, n)] == linked.sum(1)[300:].tolist()
    for k in (*range(n, n + 6), n + 8):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert (got[n + 6].n_links, got[n + 7].component_id, got[n + 7].kept) == (1, n + 6, False)
    assert len(got) == n + 10 and got[None].n_links == 0
    assert vectors.near_duplicates(table.where("false")).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * b
    x, y = vectors.buckets(a), vectors.buckets(b)
    met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() > 0.99


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(vectors.hadamard(x), axis=1), 8 * np.linalg.norm(x, axis=1))
    assert np.allclose(vectors.hadamard(vectors.hadamard(x)), 64 * x)
