"""SimHash near-duplicates by anchor-point covering.

The 64 bits are three blocks; fingerprints that differ in at most four bits differ in at most
one bit of some block. Each block, padded to 23 bits, is covered by the perfect Golay code: any
value has one codeword within radius 3. A fingerprint probes at that anchor, and is filed under
every anchor within radius 3 + 1, about five a block, so that each linked pair meets at the
probe's anchor. Full fingerprints are compared per anchor; only a spanning forest of the links
leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.common import materialise, small_batches

SHINGLE, BITS_APART = 4, 4
#: (lowest bit, width) of the blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR, LENGTH, CHECKS = 0xAE3, 23, 11
#: Fingerprints on either side of one comparison task; larger anchors are cut into pairs of chunks.
CHUNK = 8192
#: Parts into which the rows of a frequent key are dealt before a join.
SALTS = 64


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64 bits: set where over half the shingles' hashes have a one; none for a text without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    whole, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    hashes = [hashed(whole[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=False)] or [hashed(whole, 42)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([fingerprint(t or b"") for t in b.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), found], names=["doc_id", "fp"])


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each bit; per syndrome the patterns of weight up to 4 that lead to a codeword, lightest first, with bounds and weights."""
    syndromes = []
    for bit in range(LENGTH):
        rest = 1 << bit
        for k in range(bit, CHECKS - 1, -1):
            if rest >> k & 1:
                rest ^= GENERATOR << (k - CHECKS)
        syndromes.append(rest)
    patterns: list[list[tuple[int, int]]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            s = p = 0
            for b in bits:
                s ^= syndromes[b]
                p |= 1 << b
            patterns[s].append((p, weight))
    bounds = np.cumsum([0] + [len(x) for x in patterns])
    flat = np.array([x for own in patterns for x in own], dtype=np.int64)
    return np.array(syndromes, dtype=np.int64), bounds, flat[:, 0], flat[:, 1]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per fingerprint, block and anchor within radius 4; ``own`` marks the one within radius 3."""
    syndromes, bounds, patterns, weights = golay_tables()
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        for k, (low, wide) in enumerate(BLOCKS):
            value = (fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << wide) - 1)
            s = np.zeros(len(value), np.int64)
            for bit in range(wide):
                s ^= (value >> bit & 1) * syndromes[bit]
            n = bounds[s + 1] - bounds[s]
            row = np.repeat(np.arange(len(fp)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[s], n)
            yield pa.RecordBatch.from_arrays(
                [pa.array((value[row] ^ patterns[at]) * 4 + k, pa.int32()), pa.array(fp[row]), pa.array(weights[at] <= 3)], names=["anchor", "fp", "own"]
            )


def _links(group: pa.Table) -> pa.Table:
    """A spanning forest of the links between the probes and the filed fingerprints of one group, as (fp, root)."""
    fp = group.column("fp").to_numpy().view(np.uint64)
    probe, filed = (np.flatnonzero(group.column(c).to_numpy(zero_copy_only=False)) for c in ("probe", "filed"))
    label, near = np.arange(len(fp)), []
    for at in range(0, len(probe), 512):
        rows = probe[at : at + 512]
        close = np.bitwise_count(fp[rows][:, None] ^ fp[filed][None, :]) <= BITS_APART
        linked = close.sum(axis=1) > (np.isin(rows, filed) if len(filed) else 0)
        if linked.any():
            near.append((rows[linked], close[linked]))
    changed = bool(near)
    while changed:
        before = label.copy()
        for rows, close in near:
            low = np.minimum(np.where(close, label[filed][None, :], len(fp)).min(axis=1), label[rows])
            label[rows] = low
            label[filed] = np.minimum(label[filed], np.where(close, low[:, None], len(fp)).min(axis=0))
        changed = bool((label != before).any())
    at = np.flatnonzero(label != np.arange(len(fp)))
    signed = fp.view(np.int64)
    a, b = signed[at], signed[label[at]]
    return pa.table({"a": pa.array(np.maximum(a, b)[a != b]), "b": pa.array(np.minimum(a, b)[a != b])})


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b), a > b, that connect the distinct fingerprints ``fp`` just as all pairs within reach would."""
    filed = materialise(distinct.select("fp").mapInArrow(_anchored, "anchor int, fp long, own boolean"), "simhash-anchored")
    # Anchors with more than a chunk are few; theirs is the only extra copying.
    large = filed.groupBy("anchor").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    cut = filed.join(large.withColumnRenamed("anchor", "_a"), F.col("anchor") == F.col("_a"), "left").select(
        "anchor", "fp", "own", F.coalesce("chunks", F.lit(1)).alias("chunks")
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # Task (i, j) holds probes of chunk i and filed fingerprints of chunk j.
    as_probe = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(True).alias("probe"), (j == mine).alias("filed")))
    as_filed = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.struct(i.alias("i"), mine.alias("j"), (F.col("own") & (i == mine)).alias("probe"), F.lit(True).alias("filed")))
    both = F.array_distinct(F.when(F.col("own"), F.concat(as_probe, as_filed)).otherwise(as_filed))
    tasks = cut.select("anchor", "fp", F.explode(both).alias("t")).select("anchor", "fp", "t.*")
    return tasks.groupBy("anchor", "i", "j").applyInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for the ends of ``edges`` (a > b): root is the smallest end reachable.

    Alternates large-star and small-star steps until every edge leads to its root; each round
    is written to the shared folder.
    """
    edges, seen = materialise(edges, "simhash-edges"), None
    while True:
        part = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        # A node's smallest neighbour goes to the parts its edges are dealt to: a hub's edges never meet in one task.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.collect_set(part).alias("parts")).select("u", "m", F.explode("parts").alias("part"))
        larger = edges.toDF("v", "u").withColumn("part", part).join(least, ["u", "part"]).select("v", "m").where("v <> m")
        # Smaller neighbours and the node itself go to the smallest neighbour.
        part = F.pmod(F.xxhash64("m"), F.lit(SALTS)).cast("int")
        least = larger.groupBy("v").agg(F.min("m").alias("r"), F.collect_set(part).alias("parts")).select("v", "r", F.explode("parts").alias("part"))
        joined = larger.withColumn("part", part).join(least, ["v", "part"])
        edges = materialise(
            joined.select(F.col("v").alias("a"), F.col("r").alias("b")).union(joined.select(F.col("m").alias("a"), F.col("r").alias("b"))).where("a <> b").distinct(),
            "simhash-edges",
        )
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first()
        if now == seen:
            return edges.toDF("fp", "root")
        seen = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    A text without words, null or empty, has fingerprint zero and links like any other. Equal
    fingerprints are one node, however many rows share it. component_id is the smallest doc_id
    reachable; null ids are ignored for it, and it is null where a component has no other; other
    columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_fingerprints, "doc_id long, fp long")
    # Copies of one fingerprint are dealt over parts; its class goes to those parts alone.
    prints = materialise(found.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "simhash-prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.collect_set("part").alias("parts")), "simhash-distinct")
    rooted = distinct.join(components(links(distinct)), "fp", "left").select("fp", "first", "parts", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted.withColumn("of", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")), "simhash-rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.collect_set("of").alias("of")).select("root", "component_id", F.explode("of").alias("of"))
    classes = rooted.join(smallest, ["root", "of"]).select("fp", "component_id", F.explode("parts").alias("part"))
    return prints.join(classes, ["fp", "part"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component of ``docs`` the document with the smallest doc_id, all columns as they were.

    Rows that share this id stay once per different text. Rows without an id cannot be referred
    to and stay. Only texts of kept documents are compared after the join on the id.
    """
    own = "simhash_" + "_" * max(map(len, docs.columns))  # longer than any column, so none of the same name
    kept = near_duplicates(docs).where("component_id is not null").select(F.col("component_id").alias(own)).distinct()
    kept = materialise(kept, "simhash-kept")
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col(own), "left_semi")
    once = named.withColumn(own, F.xxhash64("text")).dropDuplicates(["doc_id", own]).drop(own)
    return once.unionByName(docs.where("doc_id is null"))


def hex_digits(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a 64-bit number."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
