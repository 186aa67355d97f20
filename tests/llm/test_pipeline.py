"""The corpus pipeline on the smallest table."""

import collections
import re

import corpus_pipeline
from quarterline.llm import jaccard, quality, substrings
from quarterline.llm.shared import read_table

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = read_table(spark, DIR, "documents")
    start = docs.count()
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, DIR)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.count()
        if k == 0:
            labels = read_table(spark, DIR, "labels")
            good = before.join(labels.where("quality = 1"), "doc_id")
            assert good.join(docs, "doc_id", "left_anti").count() <= 0.02 * good.count()
        if k == 1:
            sets = {r.doc_id: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(re.findall(r"\w+", r.text.lower())) for r in docs.collect()}
            counts = collections.Counter()
            holders = collections.defaultdict(list)
            for d, s in sets.items():
                for g in s:
                    counts.update((o, d) for o in holders[g])
                    holders[g].append(d)
            assert all(c / (len(sets[a]) + len(sets[b]) - c) < 0.8 for (a, b), c in counts.items())
        if k == 3:
            assert docs.where("text rlike '[0-9a-f]{32}'").count() == 0
    assert start > kept["quality classifier"] > kept["n-gram Jaccard join"] >= kept["substring dedup"] == kept["secret scans"] <= kept["packing"]


def test_run_gives_the_last_stage(spark):
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, DIR).columns)
    assert (quality.POSITIVES, jaccard.SIMILARITY, substrings.SPAN_WORDS) == (12_000, 0.8, 25)
