"""Whitening of embeddings by block Lanczos, without ever holding their covariance.

Entries are whole numbers x; all that is known of the vectors' covariance is what it does to a
block of directions: one pass over the table, centred before multiplying. The driver keeps the
directions asked so far (the vector's length by some dozens), orthogonal to each other and
reorthogonalised in full. A direction that leads nowhere new is replaced by a random one; the
search ends when the residuals of the wanted components are at the limit of double precision and
a fresh random block brings up nothing larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.common import small_batches

#: Directions asked in one pass, and rows of an Arrow batch.
BLOCK, ROWS = 16, 1024
#: An entry is floor(SCALE * c) + SHIFT; larger ones than LARGEST in size have no exact double.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**52
#: Residuals by the largest eigenvalue: found at once, and found if another pass does not halve them.
FOUND, ENOUGH = 1e-14, 1e-12
#: Components whose eigenvalue is less than this share of the largest have no direction of their own.
LEAST = 1e-11
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable_rows(batch: pa.RecordBatch, d: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and whole-number entries (rows by ``d``) of the vectors of a batch (vec_id, v) that take part."""
    v = batch.column("v")
    long_enough = np.asarray(v.value_lengths().fill_null(-1)) == d
    ids, v = batch.column("vec_id").filter(pa.array(long_enough)), v.filter(pa.array(long_enough))
    c = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    with np.errstate(invalid="ignore", over="ignore"):
        fit = (np.abs(c * SCALE) < LARGEST).all(axis=1)
    return ids.filter(pa.array(fit)), np.floor(SCALE * c[fit]).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Centre:
    """Number of vectors and the exact sums of their entries; a mean is a whole number and a fraction, so that nothing cancels."""

    n: int
    sums: tuple[int, ...]

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """Entries less the whole part of their mean."""
        return x - np.array([s // self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x) - np.array([s % self.n / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over entries of (n x - S)^2, exact."""
        a, rest = self.offsets(x), [s % self.n for s in self.sums]
        most = int(np.abs(a).max(initial=0)) + 1
        kind = np.int64 if (self.n * most) ** 2 * max(1, len(rest)) < 1 << 62 else object
        away = self.n * a.astype(kind) - np.array(rest, kind)
        return [int(s) for s in (away * away).sum(axis=1)]


def _summed(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], width: int) -> np.ndarray:
    """The sum over all partitions of the matrix (some rows by ``width``) that ``task`` yields once for each."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in task(batches):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(m)), pa.int32()), *map(pa.array, np.ascontiguousarray(m.T, np.float64))], names=["row", *(f"c{k}" for k in range(width))])

    columns = [f"c{k}" for k in range(width)]
    parts = rows.mapInArrow(partial, "row int, " + ", ".join(f"{c} double" for c in columns))
    total = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).orderBy("row").collect()  # as many rows as the vectors are long
    return np.array([[r[c] for c in columns] for r in total]).reshape(-1, width)


def _centre(rows: DataFrame, d: int) -> Centre:
    """Exact sums of all entries, and how many vectors there are."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * (d + 1)
        for b in batches:
            _, x = usable_rows(b, d)
            # A batch of large entries is summed in halves that a long holds.
            own = [int(hi) * (1 << 26) + int(lo) for hi, lo in zip((x >> 26).sum(axis=0), (x & (1 << 26) - 1).sum(axis=0), strict=True)]
            sums = [s + t for s, t in zip(sums, [*own, len(x)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([Decimal(s) for s in sums], pa.decimal128(28, 0))], names=["row", "s"])

    total = rows.mapInArrow(task, "row int, s decimal(28,0)").groupBy("row").agg(F.sum("s").alias("s")).orderBy("row").collect()
    *sums, n = [int(r["s"]) for r in total] or [0]
    return Centre(n, tuple(sums))


def _apart(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``block`` less what ``basis`` (orthonormal columns) already spans, twice over."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; eigenvectors as columns) of the ``wanted`` largest of a symmetric operator on ``d`` numbers, known by what it does to a block."""
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    asked, last, probed = np.linalg.qr(rng.normal(size=(d, min(block, d))))[0], np.inf, None
    while True:
        image = apply(asked)
        basis, images = np.hstack([basis, asked]), np.hstack([images, image])
        inner = basis.T @ images
        values, ways = np.linalg.eigh((inner + inner.T) / 2)
        values, ways = values[::-1][:wanted], ways[:, ::-1][:, :wanted]
        vectors = basis @ ways
        top = max(abs(values[0]), np.finfo(float).tiny)
        residual = np.linalg.norm(images @ ways - vectors * values, axis=0).max() / top
        room = d - basis.shape[1]
        if not room:
            break
        settled = len(values) == wanted and (residual <= FOUND or residual <= ENOUGH and residual > last / 2)
        last = residual
        if settled and probed is not None and np.abs(values - probed).max() <= ENOUGH * top:
            break
        probed = values if settled else None
        width = min(block, room)
        fresh = np.zeros((d, 0))
        if not settled:
            left, size, _ = np.linalg.svd(_apart(image, basis), full_matrices=False)
            fresh = left[:, size > ENOUGH * top][:, :width]
        # Breakdown, or a probe: random directions in place of those that lead nowhere new.
        fresh = np.hstack([fresh, rng.normal(size=(d, width - fresh.shape[1]))])
        asked = np.linalg.qr(_apart(np.linalg.qr(_apart(fresh, basis))[0], basis))[0]
    vectors, _ = np.linalg.qr(vectors)
    return values, vectors


def whiten(vectors: DataFrame, components: int = 32, block: int = BLOCK) -> DataFrame:
    """RESULT: every vector of ``vectors`` (vec_id, embedding) on the leading components of the covariance of all.

    Vectors that are null, empty, of another length than most, or that hold a null, non-finite or
    too large entry (2^46 or more in size) take no part. Components without variance are left out,
    so equal vectors alone, or one vector, give no rows; a null vec_id is carried; repeated rows
    count and are returned each; a deviation that no long holds is null; other columns are
    ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, ROWS)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < LARGEST / SCALE, F.lit(False)))
    sizes = rows.where(finite).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], RESULT)
    d = sizes["d"]
    centre = _centre(rows, d)

    def apply(asked: np.ndarray) -> np.ndarray:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            total = np.zeros(asked.shape)
            for b in batches:
                y = centre.centred(usable_rows(b, d)[1])
                total += y.T @ (y @ asked)
            yield total

        return _summed(rows, task, asked.shape[1]) / centre.n

    values, ways = lanczos(apply, d, min(components, d), block)
    kept = values > LEAST * max(values[0], 0.0)
    values, ways = values[kept], ways[:, kept]
    k = len(values)
    if not k:
        return spark.createDataFrame([], RESULT)
    scaled = ways / np.sqrt(values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros((k + 1, k))
        for b in batches:
            _, x = usable_rows(b, d)
            w = centre.centred(x) @ scaled
            total[:k] += w.T @ w
            total[k, 0] += sum(s / centre.n**2 for s in centre.deviations(x))
        yield total

    total = _summed(rows, moments, k) / centre.n
    trace, error = float(total[k, 0]), float(np.abs(total[:k] - np.eye(k)).max())
    shares = values / trace

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = usable_rows(b, d)
            m = len(x)
            far = [s if s < 1 << 63 else None for s in centre.deviations(x)]
            w, at = centre.centred(x) @ scaled, pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n)), pa.array(far, pa.int64()).take(at),
                    pa.array(w.ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
                ],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    return rows.mapInArrow(projected, RESULT)
