"""Toxicity: a bag of character n-gram vectors, averaged, under a linear softmax.

A word is its whole form and its n-grams, hashed into buckets; a text is the mean of their
vectors. Vectors and softmax are trained jointly on a bounded sample of labelled texts. With
two classes a text's log-odds is the mean of one number per bucket, so scoring needs one array
and a cache of words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.common import held_out, materialise, one_label, small_batches

#: Buckets of n-grams (and as many again for whole words), vector size, n-gram lengths.
BUCKETS, DIM, NGRAMS = 1 << 17, 8, (3, 4, 5)
#: Bound of the training sample: labelled texts of each class, drawn by hash.
SAMPLE = 3000
#: At least so many passes and steps; mini-batch, learning rate, seed.
EPOCHS, STEPS, BATCH, RATE, SEED = 10, 600, 64, 0.15, 4
#: Sampled texts that must hold a subword before it is learned.
LEAST_TEXTS = 3
#: What the stored vectors are multiplied by: means over hundreds of subwords are small.
GAIN = 30.0
#: Words kept in a worker's cache.
CACHE_WORDS = 200_000

#: Lower case for A-Z; white space for what is no letter, digit, @, ' or part of a longer character.
_FORM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c in b"@'" or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> set[bytes]:
    """The different lower-case runs of letters, digits, @, ' and anything beyond ASCII.

    A word counts once: a text that repeats a harmless word must not turn into its vector.
    """
    return set(text.translate(_FORM).split())


def buckets_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) pairs: the character n-grams of each word with marked ends, and the word itself."""
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    text = np.frombuffer("".join(marked).encode("utf-32-le", "replace") + bytes(4 * max(NGRAMS)), "<u4").astype(np.uint64)
    long = np.array([len(w) for w in marked], dtype=np.int64)
    of, ends = np.repeat(np.arange(len(words)), long), np.repeat(np.cumsum(long), long)
    place = np.arange(len(of))
    rows, found = [np.arange(len(words))], [BUCKETS + np.array([zlib.crc32(w) % BUCKETS for w in words], dtype=np.int64)]
    for n in NGRAMS:
        at = place[ends - place >= n]
        key = np.full(len(at), n, np.uint64)
        for k in range(n):
            key = (key ^ text[at + k]) * _MIX
        rows.append(of[at])
        found.append((key >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


class SubwordModel:
    """Log-odds of a text: offset + scale * mean over its subwords of ``value``."""

    def __init__(self, value: np.ndarray, offset: float, scale: float) -> None:
        self.value, self.offset, self.scale = value, offset, scale
        self.sums: dict[bytes, float] = {}
        self.counts: dict[bytes, int] = {}

    def score(self, texts: list[bytes]) -> list[float]:
        if len(self.sums) > CACHE_WORDS:
            self.sums.clear()
            self.counts.clear()
        split = [words_of(t) for t in texts]
        new = [w for w in set().union(*split) if w not in self.sums]
        if new:
            of, bucket = buckets_of(new)
            self.sums.update(zip(new, np.bincount(of, self.value[bucket], len(new)).tolist(), strict=True))
            self.counts.update(zip(new, np.bincount(of, minlength=len(new)).tolist(), strict=True))
        total = np.array([sum(map(self.sums.__getitem__, words)) for words in split])
        n = np.array([sum(map(self.counts.__getitem__, words)) for words in split])
        return (1 / (1 + np.exp(-np.clip(self.offset + self.scale * total / np.maximum(n, 1), -50, 50)))).tolist()


def bag_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of a text and how often each stands in it: 2 * BUCKETS at most, however long the text."""
    return np.unique(buckets_of(sorted(words_of(text)))[1], return_counts=True)


def train(found: list[tuple[np.ndarray, np.ndarray]], labels: list[int], totals: list[int] | None = None) -> SubwordModel:
    """Vectors and softmax by Adagrad on mini-batches; scale and offset by a logistic fit on texts kept apart.

    ``totals``: subwords of each text where its rare ones are already gone.
    """
    y_all = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return SubwordModel(np.zeros(2 * BUCKETS, np.float32), 0.0 if not labels else (2.0 if labels[0] else -2.0), 1.0)
    texts_with = np.bincount(np.concatenate([ids for ids, _ in found]), minlength=2 * BUCKETS)
    bags = []
    for (ids, weight), total in zip(found, totals or [int(w.sum()) for _, w in found], strict=True):
        # What few texts hold teaches those texts by heart: its vector stays zero.
        often = texts_with[ids] >= LEAST_TEXTS
        bags.append((ids[often].astype(np.int32), (weight[often] / max(total, 1)).astype(np.float32)))
    rng = np.random.default_rng(SEED)
    shuffled = rng.permutation(len(found))
    apart, learn = shuffled[: len(found) // 5], shuffled[len(found) // 5 :]
    learn = learn if len(learn) else shuffled
    gain = GAIN
    vectors = rng.uniform(-1e-3, 1e-3, (2 * BUCKETS, DIM)).astype(np.float32)
    vectors[texts_with < LEAST_TEXTS] = 0
    softmax, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_v, seen_s = np.full(2 * BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32)
    learn = np.array([k for k in learn if len(bags[k][0])] or [0])
    # Mini-batches are dealt once; what sorts their subwords is kept from pass to pass.
    batches = []
    for at in range(0, len(learn), BATCH):
        part = learn[at : at + BATCH]
        ids, weight = np.concatenate([bags[k][0] for k in part]), np.concatenate([bags[k][1] for k in part])
        long = [len(bags[k][0]) for k in part]
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
        batches.append((y_all[part], ids, weight[:, None], np.cumsum([0, *long])[:-1], np.repeat(np.arange(len(part)), long)[order], weight[order, None], ids[order][first], first))
    epochs = max(EPOCHS, -(-STEPS // len(batches)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in rng.permutation(len(batches)):
            y, ids, weight, starts, of, sorted_weight, own, first = batches[k]
            if not len(ids):
                continue
            mean = gain * np.add.reduceat(vectors[ids] * weight, starts, axis=0)
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            grad_s, grad_m = mean.T @ p / len(y), p @ softmax.T
            bias -= rate * p.mean(axis=0)
            seen_s += grad_s**2
            softmax -= rate * grad_s / np.sqrt(seen_s)
            g = np.add.reduceat(grad_m[of] * sorted_weight, first, axis=0)
            seen_v[own] += (g**2).mean(axis=1)
            vectors[own] -= rate * g / np.sqrt(seen_v[own])[:, None]
    value = gain * vectors @ (softmax[:, 1] - softmax[:, 0])
    raw = np.array([float(value[bags[k][0]] @ bags[k][1]) for k in apart]) + float(bias[1] - bias[0])
    a, b = _logistic(raw, y_all[apart])
    return SubwordModel(value.astype(np.float32), b + a * float(bias[1] - bias[0]), a)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a small penalty; the slope stays positive."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -2, 2), b - np.clip(d[1], -2, 2)
    return max(float(a), 1e-3), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str) -> SubwordModel:
    """Draw at most SAMPLE labelled texts of each class, by hash, and train on them in one task."""
    open_rows = materialise(one_label(labels, label).where("label in (0, 1)").where(~held_out(F.col("doc_id"))), "toxicity-labels")
    chosen = [open_rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(SAMPLE) for k in (0, 1)]
    chosen = materialise(chosen[0].union(chosen[1]), "toxicity-chosen")
    # 2 * SAMPLE rows of two numbers: small whatever the input.
    sample = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).where("text is not null").join(F.broadcast(chosen), "doc_id")

    # Repeated ids: of the rows of one id the first by text hash is learned from.
    sample = sample.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [bag_of(t) for t in b.column("text").to_pylist()]
            held = [pa.array([x[k] for x in own], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *held], names=["doc_id", "label", "ids", "n"])

    # Texts become bags where they lie; what few texts hold is known, and dropped, before the bags meet in one task.
    sample = materialise(sample.mapInArrow(bags, "doc_id long, label int, ids array<int>, n array<int>"), "toxicity-bags")
    often = sample.select(F.explode("ids").alias("id")).groupBy("id").count().where(F.col("count") >= LEAST_TEXTS).select("id")
    known = np.zeros(2 * BUCKETS, bool)
    known[often.toPandas()["id"].to_numpy(np.int64)] = True  # a row per bucket at most
    shared = sample.sparkSession.sparkContext.broadcast(known)

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bag = [[np.asarray(x, dtype="<i4") for x in pair] for pair in zip(b.column("ids").to_pylist(), b.column("n").to_pylist(), strict=True)]
            kept = [shared.value[ids] for ids, _ in bag]
            held = [pa.array([x[k][own].tobytes() for x, own in zip(bag, kept, strict=True)], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *held, pa.array([int(n.sum()) for _, n in bag], pa.int64())], names=["doc_id", "label", "ids", "n", "total"])

    sample = sample.mapInArrow(thinned, "doc_id long, label int, ids binary, n binary, total long")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "label", "ids", "n", "total")), strict=True))
        m = train([(np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], "<i4")) for r in rows], [r[1] for r in rows], [r[4] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([m.value.astype("<f4").tobytes()], pa.binary()), pa.array([m.offset]), pa.array([m.scale])], names=["value", "offset", "scale"])

    counts = {r["label"]: r["count"] for r in open_rows.groupBy("label").count().collect()}
    row = sample.repartition(1).mapInArrow(learn, "value binary, offset double, scale double").first()
    if row is None:  # not one labelled text to learn from
        return SubwordModel(np.zeros(2 * BUCKETS, np.float32), 0.0, 1.0)
    # The sample holds the classes more evenly than the labels do: back to the labels' odds.
    n, drawn = [counts.get(k, 0) for k in (0, 1)], [min(counts.get(k, 0), SAMPLE) for k in (0, 1)]
    odds = np.log(n[1] / n[0]) - np.log(drawn[1] / drawn[0]) if all(n) else 0.0
    return SubwordModel(np.frombuffer(row["value"], "<f4"), row["offset"] + float(odds), row["scale"])


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Null and empty texts get the score of a text without words; a null doc_id is carried and
    not held out; equal texts score alike; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fitted = fit(docs, labels, label)
    value, offset, scale = spark.sparkContext.broadcast(fitted.value), fitted.offset, fitted.scale  # 2 * BUCKETS floats

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = SubwordModel(value.value, offset, scale)
        for b in batches:
            score = m.score([t or b"" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    result = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(scored, "doc_id long, score double")
    return result.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
