import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rpartition("/")[0])

import corpus_pipeline
import plain
from slopeworks.llm import classifier, mixing, queries, toxicity
from test_packing import check_layout, plain_ids
from test_simhash import plain_components, plain_fingerprint


def tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    return docs, {r["doc_id"]: r["quality"] for r in labels if r["quality"] is not None}, {r["doc_id"]: r["toxic"] for r in labels if r["toxic"] is not None}


def calibrating(spark, ids):
    rows = spark.createDataFrame([(d,) for d in ids], "doc_id long").where(F.pmod(F.xxhash64("doc_id"), F.lit(10)) < 2)
    return {r["doc_id"] for r in rows.collect()}


def test_rules_verdict(spark, sf10):
    docs, quality, _ = tables(spark, sf10)
    want = plain.rules_verdict([d[:3] for d in docs], quality)
    got = queries.op5_rules(spark, sf10).collect()
    assert len(got) == len(want)
    for r in got:
        counts, kept = want[r["doc_id"]]
        assert all(r[c] == counts[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) and r["kept"] == kept, r


def test_quality_scores(spark, sf10):
    docs, quality, _ = tables(spark, sf10)
    want = plain.quality_scores(docs, quality, calibrating(spark, [d[0] for d in docs]))
    for r in queries.op6_quality(spark, sf10).collect():
        assert abs(r["score"] - plain.quality_score(want[r["doc_id"]])) < 1e-4, (r, want[r["doc_id"]][:2])


def test_toxicity_scores(spark, sf10):
    docs, _, toxic = tables(spark, sf10)
    known = sorted((d, toxic[d], t) for d, t, *_ in docs if d in toxic and toxic[d] in (0, 1) and plain.open_to_learning(d) and t is not None)
    assert max(Counter(y for _, y, _ in known).values()) <= toxicity.SAMPLE  # all of them are the sample
    model = toxicity.train([toxicity.bag_of(t.encode()) for *_, t in known], [y for _, y, _ in known])
    got = {r["doc_id"]: r["score"] for r in queries.op4_toxicity(spark, sf10).collect()}
    for d, t, *_ in docs[::5]:
        assert abs(got[d] - plain.toxicity_score(t, model)) < 1e-6


def test_pipeline_run(spark, sf10):
    docs, quality, _ = tables(spark, sf10)
    verdict = plain.rules_verdict([d[:3] for d in docs], quality)
    kept = [d for d in docs if verdict[d[0]][1]]
    scores = plain.quality_scores(kept, quality, calibrating(spark, [d[0] for d in kept]))
    kept = [d for d in kept if plain.quality_score(scores[d[0]]) >= 0.5]
    roots = plain_components([plain_fingerprint(d[1]) for d in kept])
    kept = [d for k, d in enumerate(kept) if roots[k] == k]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(kept, columns=["doc_id", "text", "lang", "source"]))
    copies = {d: taken // size for d, size, _, _, taken in con.execute(mixing.op2_sql()).fetchall()}
    want = Counter()
    for (d, *_), ids in zip(kept, plain_ids([d[1] for d in kept]), strict=True):
        for start in range(0, len(ids), 2048):
            own = ids[start : start + 2048]
            want[d, start // 2048, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += copies[d]
    rows = corpus_pipeline.run(spark, sf10).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == +want
    check_layout(rows)


def test_copies_of_equal_rows(spark):
    text = "one two three four five"
    rows = [(None, text, "a")] * 7 + [(1, text + f" {k}", "a") for k in range(40)] + [(k, "word " * k, "b") for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter(tuple(r) for r in mixing.take_copies(docs).collect())
    assert set(taken) <= set(rows)
    words = Counter()
    for (_, t, s), n in taken.items():
        words[s] += n * len(t.split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    goal = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert all(abs(words[s] - goal[s]) <= 30 for s in sizes)
    assert Counter(tuple(r) for r in mixing.take_copies(docs).collect()) == taken
