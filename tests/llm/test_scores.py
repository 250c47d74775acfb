import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, __file__.rpartition("/")[0])

import plain
from slopeworks.llm import classifier, toxicity


def auc(score, label):
    _, where = np.unique(score, return_inverse=True)
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    mean = (np.bincount(where, rank) / np.bincount(where))[where]
    pos = label == 1
    return (mean[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize(("score", "label", "least", "cut", "sf10"), [(toxicity.score_toxicity, "toxic", 0.94, 0.7, "/root/testdata/sf0.1"), (classifier.score_quality, "quality", 0.97, 0.5, "/root/testdata/sf0.01")])
def test_held_out(spark, score, label, least, cut, sf10):
    labels = spark.read.parquet(f"{sf10}/labels.parquet")
    docs = spark.read.parquet(f"{sf10}/documents.parquet")
    rows = score(docs, labels).toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert ((rows.score >= cut) == (rows.predicted == 1)).all()
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in rows.doc_id]).all()
    known = rows.merge(labels.toPandas(), on="doc_id")
    known = known[known.held_out]
    assert auc(known.score.to_numpy(), known[label].to_numpy()) >= least
    # Labels of held-out rows, and of no other use: changing them changes nothing.
    from pyspark.sql import functions as F

    from slopeworks.llm.common import held_out

    turned = labels.withColumn(label, F.when(held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label)))
    again = score(docs, turned).toPandas()
    assert np.allclose(rows.sort_values("doc_id").score, again.sort_values("doc_id").score)


@pytest.mark.parametrize("score", [toxicity.score_toxicity, classifier.score_quality])
def test_odd_rows(weird, weird_labels, no_docs, score):
    for labels in (weird_labels, weird_labels.where("false")):
        rows = score(weird, labels).collect()
        assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (7, 8)}) == 1
        assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
        assert score(no_docs, labels).count() == 0


def test_misspellings_share_vectors():
    rng = np.random.default_rng(0)
    harmless = [bytes(rng.choice(list(b"abcdefghij"), 6).tolist()) for _ in range(200)]
    texts, labels = [], []
    for k in range(600):
        words = [harmless[i] for i in rng.integers(0, 200, 40)]
        if k % 2:
            words[int(rng.integers(0, 40))] = b"zzwoppler"
        texts.append(b" ".join(words))
        labels.append(k % 2)
    model = toxicity.train([toxicity.bag_of(t) for t in texts], labels)
    clean = b" ".join(harmless[:40])
    low, seen, unseen = model.score([clean, clean + b" zzwoppler", clean + b" zzwopplerr"])
    assert low < 0.3 and seen > 0.7 and unseen > 0.7


def test_ngrams_are_of_characters():
    words = ["été".encode(), "漢字".encode(), b"ab", b"x"]
    of, bucket = toxicity.buckets_of(words)
    for k, w in enumerate(words):
        assert sorted(bucket[of == k].tolist()) == sorted(plain.subwords(w))
    # A word and its misspelling share what lies before the wrong character, whatever its bytes.
    one, two = (set(toxicity.buckets_of([w.encode()])[1].tolist()) for w in ("détestable", "détestablé"))
    assert len(one & two) >= len("détestable") * 2


def test_training_against_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 3)
    monkeypatch.setattr(toxicity, "STEPS", 6)
    monkeypatch.setattr(toxicity, "BATCH", 8)
    rng = np.random.default_rng(2)
    texts = [b" ".join([[b"alpha", b"beta", b"gamma", b"delta", "é".encode() * 4, b"rare%d" % k][i] for i in rng.integers(0, 6, 6)] + [b"bad"] * (k % 2)) for k in range(40)]
    labels = [k % 2 for k in range(40)]
    model = toxicity.train([toxicity.bag_of(t) for t in texts], labels)
    value, raw, known, bias = plain.toxicity_training(texts, labels)
    top = max(map(abs, value.values()))
    assert top > 0 and all(abs(float(model.value[b]) - v) < 1e-3 * top for b, v in value.items())
    assert np.count_nonzero(model.value) <= len(value)
    # Scale and offset: no better ones near by.
    loss = lambda a, b: sum(np.log1p(np.exp(-(2 * y - 1) * (a * x + b))) for x, y in zip(raw, known, strict=True)) + 0.005 * ((a - 1) ** 2 + b * b)
    a, b = model.scale, model.offset - model.scale * bias
    assert all(loss(a, b) <= loss(a + d, b + e) + 1e-5 for d in (-0.05, 0, 0.05) for e in (-0.05, 0, 0.05))
    # Rare subwords gone before, with the texts' totals told: the same model.
    held = np.bincount(np.concatenate([toxicity.bag_of(t)[0] for t in texts]), minlength=2 * toxicity.BUCKETS)
    bags = [toxicity.bag_of(t) for t in texts]
    thin = [(i[held[i] >= toxicity.LEAST_TEXTS], n[held[i] >= toxicity.LEAST_TEXTS]) for i, n in bags]
    again = toxicity.train(thin, labels, [int(n.sum()) for _, n in bags])
    assert (again.value == model.value).all() and again.scale == model.scale


def test_isotonic_is_the_rising_fit():
    total, positive = np.array([4, 0, 4, 2, 2.0]), np.array([1, 0, 3, 1, 2.0])
    assert classifier.isotonic(total, positive).tolist() == pytest.approx([0.25, 0.25, 4 / 6, 4 / 6, 1.0])
