"""Owners of copied texts, and ids that are null."""

from quarterline.llm import secrets

BARE, SHARED, COPIED = "zX9kQ2mW7pL4vB8nT3yR", "hJ5dF8sK2wQ9xZ4cV7bM", "qW3eR5tY7uI9oP1aS4dF"


def test_copies_of_a_text_have_one_owner_and_null_ids_are_masked(spark):
    texts = [(1, f"see {BARE} here", "a"), (2, f"see {BARE} here", "b"), (3, f"one {SHARED} x", "a"), (4, f"two {SHARED} y", "b")]
    texts += [(5, f"key {COPIED} here", s) for s in "abc"] + [(None, "password=hunter2hunter2", "a"), (None, "plain", "a")]
    table = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan(table).where("doc_id is not null").collect()}
    assert [("owned:" in got[k].spans, got[k].n_live) for k in (1, 2, 3, 4, 5)] == [(True, 1), (True, 1), (False, 0), (False, 0), (True, 1)]
    clean = sorted((r.doc_id or 0, r.text) for r in secrets.masked(table).collect())
    want = [(0, "password=[secret]"), (0, "plain"), (1, "see [secret] here"), (2, "see [secret] here"), (3, texts[2][1]), (4, texts[3][1]), *[(5, "key [secret] here")] * 3]
    assert clean == want
