"""Quality classifier: ridge regression on random Fourier features of document statistics.

The features approximate a Gaussian kernel over a text's statistics. Every partition adds up
its own part of the normal equations; the parts are summed and solved once. An isotonic fit
on rows the ridge has not seen turns its values into calibrated scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.common import held_out, materialise, one_label, small_batches

#: Random features, width of the kernel (in standard deviations) and ridge penalty per row.
FEATURES, WIDTH, PENALTY, SEED = 192, 2.5, 1e-4, 20
#: Bins of ridge values for the isotonic fit, from -1 to 2.
BINS = 600

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASSES = [np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:'\"-()", b"@/\\_=+~^[]{}")]
_CLASSES.append(np.arange(256) >= 128)
STATISTICS = 16


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a text's form, not its subject; an empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * STATISTICS
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = max(int(bytes_of[~_SPACE].sum()), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    runs = sum(map(bytes.__eq__, words, words[1:]))
    pairs = set(zip(words, words[1:], strict=False))
    stops = sum(map(bytes.endswith, words, [(b".", b"!", b"?")] * n))
    return [
        *(float(bytes_of[c].sum()) / chars for c in _CLASSES),
        np.log1p(n), chars / n, len(set(words)) / n, len(pairs) / max(n - 1, 1), runs / n, stops / n,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), float((bytes_of > 0).sum()) / 100,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t or b"") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


class Projection:
    """Statistics -> cos(Wz + b), of standardised statistics z."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.maximum(deviation, 1e-6)
        self.w = rng.normal(size=(len(mean), FEATURES)) / (WIDTH * np.sqrt(len(mean) / 4))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b)])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, STATISTICS)


def _normal_equations(batches: Iterator[pa.RecordBatch], projection: Projection) -> Iterator[pa.RecordBatch]:
    """One row per row of Z'[Z y n]: a partition's own sums."""
    total = np.zeros((FEATURES + 1, FEATURES + 3))
    for batch in batches:
        if batch.num_rows:
            z, y = projection(_matrix(batch)), batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            total += z.T @ np.column_stack([z, y, np.ones(len(y))])
    yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])


def _sum_rows(parts: pa.Table) -> pa.Table:
    """The sum of the vectors of one row number."""
    v = parts.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(parts.num_rows, -1).sum(axis=0)
    return pa.table({"i": pa.array([parts.column("i")[0].as_py()], pa.int32()), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over ordered bins: a rising rate per bin; empty bins take their left neighbour's."""
    pools: list[list[float]] = []  # [positive, total, bins]
    for p, t in zip(positive, total, strict=True):
        pools.append([float(p), float(t), 1])
        while len(pools) > 1 and (pools[-2][1] == 0 or pools[-1][1] == 0 or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.concatenate([np.full(int(n), p / t if t else 0.5) for p, t, n in pools])


class QualityModel:
    """What scoring needs: a few hundred numbers."""

    def __init__(self, projection: Projection, weights: np.ndarray, rates: np.ndarray) -> None:
        self.projection, self.weights, self.rates = projection, weights, rates

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.projection(x) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        rate = self.rates[bin_of(raw)]
        # Within a pool the ridge value still orders the texts.
        return np.clip(0.98 * rate + 0.02 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(np.int64)


def fit(stats: DataFrame, labels: DataFrame, label: str) -> QualityModel:
    """Fit on all labelled rows of ``stats`` (doc_id, x) that are open to learning; with no such row every score is near 0.5."""
    learn = materialise(
        stats.where(~held_out(F.col("doc_id"))).join(one_label(labels, label), "doc_id").select("doc_id", "x", "label"), "quality-learn"
    )
    moments = stats.select(*[f(F.get("x", F.lit(k))) for k in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    projection = Projection(np.array([m or 0.0 for m in moments[::2]]), np.array([m or 0.0 for m in moments[1::2]]))
    # Of ten rows eight fit the ridge and two the calibration.
    calibrates = F.pmod(F.xxhash64("doc_id"), F.lit(10)) < 2
    parts = learn.where(~calibrates).select("x", "label").mapInArrow(lambda b: _normal_equations(b, projection), "i int, v array<double>")
    # Two steps, so that no task sums the parts of all partitions.
    parts = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("i", "g").applyInArrow(lambda _, t: _sum_rows(t), "i int, v array<double>")
    sums = np.array([r["v"] for r in sorted(parts.groupBy("i").applyInArrow(lambda _, t: _sum_rows(t), "i int, v array<double>").collect())])
    z, rows = sums[:, : FEATURES + 1], max(sums[0, -1], 1.0)
    penalty = np.diag([1e-9] + [PENALTY * rows] * FEATURES)
    weights = np.linalg.solve(z + penalty, sums[:, -2])
    model = QualityModel(projection, weights, np.full(BINS, 0.5))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(bin_of(model.raw(_matrix(b))), pa.int64()), b.column("label")], names=["bin", "label"])

    bins = learn.where(calibrates).select("x", "label").mapInArrow(values, "bin long, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()
    total, positive = np.zeros(BINS), np.zeros(BINS)
    for r in bins:  # at most BINS rows
        total[r["bin"]], positive[r["bin"]] = r["n"], r["p"]
    if total.sum():
        model.rates = isotonic(total, positive)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Null and empty texts score as a text with no words; a null doc_id is carried and not held
    out; equal texts score alike; other columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    stats = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_statistics, "doc_id long, x array<double>")
    stats = materialise(stats, "quality-statistics")
    model = fit(stats, labels, label)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model(_matrix(b)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(scored, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", _predicted(F.col("score"), threshold)
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text the classifier keeps, all columns as they were."""
    spark = docs.sparkSession
    small_batches(spark)
    stats = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_statistics, "doc_id long, x array<double>"), "quality-statistics")
    model = fit(stats, labels, "quality")

    @F.pandas_udf("boolean")
    def good(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(model(np.array([statistics(t or b"") for t in texts]).reshape(len(texts), STATISTICS)) >= threshold)

    return docs.where(good(F.col("text").cast("binary")))


def _predicted(score: Column, threshold: float) -> Column:
    return (score >= threshold).cast("int").alias("predicted")
