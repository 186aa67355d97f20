"""The pipeline's stages on odd rows: nulls, empty texts, repeated rows, extra columns, an empty table; and what run() leaves behind."""

import glob

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarterline.llm import shared
from quarterline.sources.shared import shared_folder
from tests.llm.conftest import prose

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, prose(k, 12), "en", f"s{k % 3}") for k in range(30)]
    rows += [(40, prose(3, 12), "en", "s1"), (41, prose(3, 12).replace("a", "o", 1), "de", "s2"), (42, None, None, None), (43, "", "en", "s1"), (44, "  ", "en", "s1"), (None, prose(70, 12), "en", "s1"), rows[7], (45, "password=hunter2hunter2 " + prose(90, 12), "en", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = {c: F.lit(None).cast("int") for c in ("gone_id", "hit_id", "class_id", "score", "n_sentences", "marks", "cluster", "kept_0")}
    return table.select("*", F.length("text").cast("long").alias("n_chars")).withColumns(extra)


@pytest.mark.parametrize("at", range(5))
def test_each_stage_takes_odd_rows(spark, odd, at):
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, odd, DIR)
    rows = out.collect()
    if at < 4:
        assert out.columns == corpus_pipeline.COLUMNS
    ids = [r.doc_id for r in rows]
    if name == "n-gram Jaccard join":
        assert {40, 41} & set(ids) == set() and {3, 42, 43, 44, None} <= set(ids) and ids.count(7) == 2
    if name == "substring dedup":
        assert {42, 43, None} <= set(ids) and 40 not in ids and all(r.text == prose(r.doc_id, 12) for r in rows if r.doc_id is not None and r.doc_id < 30)
    if name == "secret scans":
        assert len(rows) == odd.count() and [r.text[:17] for r in rows if r.doc_id == 45] == ["password=[secret]"] and [r.text for r in rows if r.doc_id == 42] == [None]
    if name == "packing":
        assert sum(r.start == 0 for r in rows) == odd.count()
    # An empty table gives no rows, with the same columns.
    none = stage(spark, odd.where("false"), DIR)
    assert none.columns == out.columns and none.count() == 0


def test_run_leaves_only_its_result(spark):
    folder = shared_folder(spark).removeprefix("file://")
    before, mark = set(glob.glob(f"{folder}/*")), shared.written()
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 0 and shared.written() == mark
    left = set(glob.glob(f"{folder}/*")) - before
    assert len(left) == 1 and [p.rsplit("/", 1)[1] for p in glob.glob(f"{left.pop()}/*")] == ["4"]
