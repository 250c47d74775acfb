"""Approximate nearest neighbours: a vantage-point tree per shard.

Vectors are compared on the unit sphere, where distance falls as cosine rises. A branch is
skipped if no point in it can be nearer than the k-th found, by the triangle inequality with
the found radius divided by ``relax``: 1 is exact search, more skips more.

Shards are dealt by the nearest of a bounded sample of vantage points. A query searches its own
vantage point's shards first and then, with the radius found there, only those of the vantage
points whose members may lie within it, by the same relaxed inequality. A shard's tree is built
once and its queries stream past it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.llm.common import materialise

#: Rows of a shard, points of a leaf.
SHARD, LEAF = 8192, 64
#: Most vantage points of shards, a sample of the vectors: what is collected and sent to every task, whatever the input.
PIVOTS = 4096
#: Queries beyond which a shard is searched by several tasks.
ASKED = 1 << 20
#: How far the pruning is relaxed in production: recall is measured in the tests.
RELAX = 1.15
#: Distances near zero are known to some 1e-8.
SLACK = 1e-7


class VantageTree:
    """A tree over distinct unit vectors; nodes are (vantage point, radius, inner, outer) or (None, points)."""

    def __init__(self, points: np.ndarray) -> None:
        self.points, self.visited = points, 0
        self.root = self._build(np.arange(len(points)))

    def _build(self, own: np.ndarray) -> tuple:
        if len(own) <= LEAF:
            return (None, own)
        vantage = own[len(own) // 2]
        d = _distance(self.points[own] @ self.points[vantage])
        radius = float(np.median(d))
        inner, outer = own[d < radius], own[d >= radius]
        if not len(inner) or not len(outer):
            return (None, own)
        return (vantage, radius, self._build(inner), self._build(outer))

    def search(self, queries: np.ndarray, k: int, relax: float, least: np.ndarray | float = -2.0) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, points) of the k best points per query; point -1 where fewer have a cosine above ``least``, -2 if there is no such bound."""
        self.q, self.k, self.relax = queries, k, relax
        self.best, self.at = np.full((len(queries), k), -2.0), np.full((len(queries), k), -1)
        self.best[:] = np.reshape(least, (-1, 1))
        self._visit(self.root, np.arange(len(queries)))
        return self.best, self.at

    def _visit(self, node: tuple, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node[0] is None:
            own = node[1]
            self.visited += len(own) * len(rows)
            s = np.hstack([self.best[rows], self.q[rows] @ self.points[own].T])
            at = np.hstack([self.at[rows], np.broadcast_to(own, (len(rows), len(own)))])
            top = np.argpartition(-s, self.k - 1, axis=1)[:, : self.k]
            self.best[rows], self.at[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(at, top, 1)
            return
        vantage, radius, inner, outer = node
        d = _distance(self.q[rows] @ self.points[vantage])
        near = d < radius
        self._visit(inner, rows[near])
        self._visit(outer, rows[~near])
        reach = _distance(self.best[rows].min(axis=1)) / self.relax + SLACK
        self._visit(outer, rows[near & (d + reach >= radius)])
        self._visit(inner, rows[~near & (d - reach < radius)])


def _distance(cosine: np.ndarray) -> np.ndarray:
    """Distance on the unit sphere; a cosine of -2 (nothing found yet) is farther than any."""
    return np.where(cosine < -1.5, 9.0, np.sqrt(np.maximum(2 - 2 * cosine, 0)))


def _scaled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a column of lists of one length, and their norms.

    Scaled by a power of two, which changes no cosine, so that no square overflows or vanishes.
    """
    vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])
    return vectors, np.sqrt((vectors * vectors).sum(axis=1))


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of lists of whole numbers."""
    flat, ends = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class _Shard:
    """A shard's different vectors, their tree, and of each the k + 1 first of the rows that have it: no other can be among the nearest."""

    def __init__(self, held: pa.Table, k: int) -> None:
        self.k = k
        self.vectors, self.norms = _scaled(held.column("v").combine_chunks())
        self.ids, self.rows = (_lists(held.column(c).combine_chunks()) for c in ("ids", "rows"))
        self.tree = VantageTree(self.vectors / self.norms[:, None])

    def nearest(self, asked: pa.RecordBatch, relax: float) -> pa.RecordBatch:
        """(query_id, query_row, vec_id, row, score) of the k nearest to each query, its own row apart, that may beat its ``least`` score."""
        q, norms = _scaled(asked.column("v"))
        query_ids, query_rows = (asked.column(c).to_numpy() for c in ("vec_id", "row"))
        least = asked.column("least").fill_null(-2.0).to_numpy(zero_copy_only=False)
        _, found = self.tree.search(q / norms[:, None], self.k + 1, relax, np.where(least > -1.5, least - SLACK, -2.0))
        out: list[list[np.ndarray]] = [[np.array([], t)] for t in (np.int64, np.int64, np.int64, np.int64, np.float64)]
        for at, points in enumerate(found):
            points = points[points >= 0]
            if not len(points):
                continue
            score = (self.vectors[points] * q[at]).sum(axis=1) / (self.norms[points] * norms[at])
            ids, rows = (np.concatenate([x[p] for p in points]) for x in (self.ids, self.rows))
            score = np.repeat(score, [len(self.ids[p]) for p in points])
            other = rows != query_rows[at]
            ids, rows, score = ids[other], rows[other], score[other]
            best = np.lexsort((rows, ids, -score))[: self.k]
            best = best[score[best] >= least[at]]
            for column, x in zip(out, (np.full(len(best), query_ids[at]), np.full(len(best), query_rows[at]), ids[best], rows[best], score[best]), strict=True):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "query_row", "vec_id", "row", "score"])


def _search(k: int, relax: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Search of one shard: its vectors come first and are held, queries pass by."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None
        for b in batches:
            is_query = b.column("is_query").to_numpy(zero_copy_only=False)
            own = len(is_query) - int(is_query.sum())
            if is_query[:own].any() or own and shard:
                raise RuntimeError("the vectors of a shard have to come before its queries")
            if own:
                held.append(b.slice(0, own))
            if own < len(is_query) and held:
                shard = shard or _Shard(pa.Table.from_batches(held), k)
                yield shard.nearest(b.slice(own), relax)

    return task


def _scaled_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors scaled by a power of two, so that those which differ by one are the same."""
    for b in batches:
        v, _ = _scaled(b.column("v"))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel() + 0.0))
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("row"), lists], names=["vec_id", "row", "v"])


def _assign(pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every row with its nearest vantage point and the distance to it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 1024) for at in range(0, whole.num_rows, 1024)):
                vectors, norms = _scaled(b.column("v"))
                d = _distance(vectors / norms[:, None] @ pivots.T)
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(d[np.arange(len(own)), own])], names=[*b.schema.names, "pivot", "far"])

    return task


def _onward(pivots: np.ndarray, near: np.ndarray, reach: np.ndarray, relax: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every query with the other vantage points, of members between ``near`` and ``reach``, that may have a vector within the radius found."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 1024) for at in range(0, whole.num_rows, 1024)):
                vectors, norms = _scaled(b.column("v"))
                home, far = b.column("pivot").to_numpy()[:, None], b.column("far").to_numpy()[:, None]
                radius = _distance(b.column("least").fill_null(-2.0).to_numpy(zero_copy_only=False))[:, None] / relax + SLACK
                d = _distance(vectors / norms[:, None] @ pivots.T)
                # A member is no farther from its vantage point than from the query's.
                bound = np.maximum(np.maximum(d - reach, near - d), (d - far) / 2)
                go = (bound <= radius) & (np.arange(len(pivots)) != home) & (reach >= 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(go.sum(axis=1))]), pa.int32()), pa.array(np.nonzero(go)[1], pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("row"), b.column("v"), b.column("least"), lists], names=["vec_id", "row", "v", "least", "pivots"])

    return task


FOUND = "query_id long, query_row long, vec_id long, row long, score double"


def _searched(filed: DataFrame, parts: DataFrame, asked: DataFrame, blocks: int, k: int, relax: float) -> DataFrame:
    """FOUND of ``asked`` (vec_id, row, v, least, pivot) in all shards of their vantage point.

    A vantage point's members are dealt over ``parts`` of a shard's size, however many they are.
    """
    key = ["pivot", "part", "block"]
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    dealt = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
    none = lambda t: F.lit(None).cast(t)
    # A vector is known by the first of its rows.
    first = F.col("rows")[0]
    own = filed.join(F.broadcast(parts), "pivot").select(none("long").alias("vec_id"), none("long").alias("row"), "ids", "rows", "v", none("double").alias("least"), F.lit(False).alias("is_query"), "pivot", dealt(first, F.col("parts")).alias("part"), every(F.lit(blocks)).alias("block"))
    ask = asked.join(F.broadcast(parts), "pivot").select("vec_id", "row", none("array<long>").alias("ids"), none("array<long>").alias("rows"), "v", "least", F.lit(True).alias("is_query"), "pivot", every(F.col("parts")).alias("part"), dealt("row", F.lit(blocks)).alias("block"))
    sorted_ = own.unionByName(ask).repartition(*key).sortWithinPartitions(*key, "is_query")
    return sorted_.groupBy(*key).applyInArrow(_search(k, relax), FOUND)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, relax: float = RELAX) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` (vec_id, embedding) for ids divisible by ``every``.

    Rows with a null id, and vectors that are null, empty, zero, of another length than most
    or that hold a null or non-finite component, take no part. Only a query's own row is no
    candidate of it: rows that repeat an id are candidates, and queries, each for itself; ties go
    to the smaller vec_id; other columns are ignored; no rows give no rows.

    Equal vectors are one vector with its first k + 1 rows before they are dealt, so that a vector
    that many rows have is no large shard.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    usable = (
        vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
        .where("vec_id is not null and v is not null").where(finite).where(F.exists("v", lambda x: x != 0))
    )
    usable = materialise(usable.select("vec_id", F.monotonically_increasing_id().alias("row"), "v"), "nearest-vectors")
    sizes = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = usable.where(F.size("v") == sizes["n"]).mapInArrow(_scaled_down, "vec_id long, row long, v array<double>")
    # Spark keeps k + 1 rows of a vector in every partition before they meet.
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))
    alike = usable.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    members = F.array_sort(F.collect_list(F.struct("vec_id", "row")))
    different = materialise(alike.groupBy("v").agg(members.alias("m")).select("v", F.col("m.vec_id").alias("ids"), F.col("m.row").alias("rows")), "nearest-different")
    known = different.count()
    sample = different.orderBy(F.xxhash64("v"), "v").select("v").limit(min(PIVOTS, math.ceil(known / SHARD))).collect()
    pivots, norms = _scaled(pa.array([r["v"] for r in sample], pa.list_(pa.float64())))
    pivots = np.unique(pivots / norms[:, None], axis=0)
    filed = materialise(different.mapInArrow(_assign(pivots), "v array<double>, ids array<long>, rows array<long>, pivot int, far double"), "nearest-filed")
    ours = usable.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = materialise(ours.mapInArrow(_assign(pivots), "vec_id long, row long, v array<double>, pivot int, far double"), "nearest-queries")
    # A row per vantage point.
    shards = filed.groupBy("pivot").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"), F.min("far").alias("near"), F.max("far").alias("reach")).collect()
    parts = vectors.sparkSession.createDataFrame([(r["pivot"], r["parts"]) for r in shards], "pivot int, parts int")
    blocks = max(1, math.ceil(queries.count() / ASKED))

    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    kept = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = lambda found: kept(found).select("query_id", "rank", "vec_id", "score")
    home = _searched(filed, parts, queries.select("vec_id", "row", "v", F.lit(None).cast("double").alias("least"), "pivot"), blocks, k, relax)
    if len(shards) == 1:
        return ranked(home)
    home = materialise(kept(home).drop("rank"), "nearest-home")
    least = home.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    near, reach = np.zeros(len(pivots)), np.full(len(pivots), -1.0)
    for r in shards:
        near[r["pivot"]], reach[r["pivot"]] = r["near"], r["reach"]
    found = queries.join(least, F.col("row") == F.col("query_row"), "left").select("vec_id", "row", "v", "least", "pivot", "far")
    routed = found.mapInArrow(_onward(pivots, near, reach, relax), "vec_id long, row long, v array<double>, least double, pivots array<int>")
    asked = routed.select("vec_id", "row", "v", "least", F.explode("pivots").alias("pivot"))
    return ranked(home.unionByName(_searched(filed, parts, asked, blocks, k, relax)))
