import sys
from collections import Counter

import corpus_pipeline
from slopeworks.llm import packing, simhash
from slopeworks.llm.common import materialise
from test_packing import check_layout, plain_ids

sys.path.insert(0, __file__.rpartition("/")[0])


def test_stages_against_plain_versions(spark, sf10):
    docs = spark.read.parquet(f"{sf10}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "simhash_dedup", "mix", "pack"]
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = materialise(stage(spark, given, sf10), "test-stage")
        sizes[name] = docs.count()
        if name != "pack":
            assert docs.columns == given.columns
        if name == "simhash_dedup":
            classes = {r["component_id"] for r in simhash.near_duplicates(given).collect()}
            assert {r["doc_id"] for r in docs.collect()} == classes and docs.count() == len(classes)
        if name == "mix":
            copies = Counter(r["doc_id"] for r in docs.collect())
            assert set(copies) <= {r["doc_id"] for r in given.collect()} and max(copies.values()) <= 3
        if name == "pack":
            texts = [r["text"] for r in given.collect()]
            assert sum(r["length"] for r in docs.collect()) == sum(map(len, plain_ids(texts)))
            check_layout(docs.collect(), packing.CAPACITY)
    assert sizes["quality_rules"] >= sizes["quality_classifier"] >= sizes["simhash_dedup"] > 0
    # Clean documents stay in the filtering stages.
    labels = spark.read.parquet(f"{sf10}/labels.parquet")
    kept = corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{sf10}/documents.parquet"), sf10)
    good = labels.where("quality = 1")
    assert kept.join(good, "doc_id").count() >= 0.97 * good.count()


def test_odd_rows(spark, weird, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, weird, sf)
        assert out.columns == weird.columns, name
        # Whatever the columns are called, a row that stays is the row that came.
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in weird.collect()}, name
        assert stage(spark, weird.where("false"), sf).count() == 0
