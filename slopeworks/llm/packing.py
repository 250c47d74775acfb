"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are whole numbers up to the sequence size, so an instance is a histogram of at most
``capacity`` counts whatever the corpus holds. The plan is made on that histogram: item
classes that provably sit together in some best packing are fixed and leave the instance,
the rest is packed best-fit by falling length, whole groups of equal bins at a time. The plan
(ranges of ranks within a length -> ranges of sequences) has a size bounded by the capacity;
documents find their place by their rank among pieces of equal length.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.llm.common import materialise, small_batches, worker_cache

CAPACITY = 2048
#: Words kept per Python worker; beyond it those met first, the frequent ones among them, stay.
CACHE_WORDS = 600_000
#: Letters that the normalizer leaves as they are but for their case, then signs that no letter follows.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ňŊ-žΑ-ΡΤ-Ωα-ωА-Яа-я]+)([!\"#$%&()*+,./:;<=>?@\\[\\\\\\]^_`{|}~-]*)")
#: Bytes as the model's vocabulary shows them: printable ones of Latin-1 as they are, the others from 256 on.
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class _StemIds(dict):
    """Lower-case run of letters -> its token ids: one pre-token, so the tokenizer's model alone decides."""

    def __init__(self, tokenizer) -> None:  # noqa: ANN001
        super().__init__()
        self.model = tokenizer.model

    def __missing__(self, stem: str) -> bytes:
        shown = stem if stem.isascii() else stem.encode().decode("latin-1").translate(_SHOWN)
        self[stem] = ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids


class _WordIds(dict):
    """Word -> its token ids as little-endian bytes.

    The tokenizer drops white space and no pre-token spans it, so a text's ids are its
    white-space separated words' ids, one after the other. Letters with signs behind them, the
    most of all words, are two pre-tokens, and their letters are looked up in lower case; any
    other word goes through the whole tokenizer.
    """

    def __init__(self, tokenizer_file: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.stems, self.signs = _StemIds(self.tokenizer), {"": b""}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text)
        if plain is None:
            ids = self.whole(text)
        else:
            stem, signs = plain.groups()
            ids = self.stems[stem.lower()]
            if signs:
                if signs not in self.signs:
                    self.signs[signs] = self.whole(signs)
                ids += self.signs[signs]
        self[word] = ids
        return ids

    def trim(self) -> None:
        """Keep the words met first, the frequent ones among them, when there are too many."""
        for held, most in ((self, CACHE_WORDS), (self.stems, CACHE_WORDS), (self.signs, CACHE_WORDS // 8)):
            if len(held) > most:
                first = list(islice(held.items(), most // 4))
                held.clear()
                held.update(first)


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer_file: str, capacity: int) -> Iterator[pa.RecordBatch]:
    words_ids: _WordIds = worker_cache(f"pack:{tokenizer_file}", lambda: _WordIds(tokenizer_file))
    part, rank = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
    for batch in batches:
        rows: list[tuple] = []
        texts = [t.split() if t else [] for t in batch.column("text").to_pylist()]
        words_ids.trim()
        for doc_id, words in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
            ids = b"".join([*map(words_ids.__getitem__, words), b"\0\0\0\0"])
            for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                own = ids[4 * start : 4 * (start + capacity)]
                n = len(own) // 4
                rows.append((doc_id, piece, start, n, zlib.crc32(own), part, int(rank[n])))
                rank[n] += 1
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "part_rank"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


class _Plan:
    """Ranges of ranks per length, each laid into a range of equal sequences."""

    def __init__(self, capacity: int, counts: dict[int, int]) -> None:
        self.capacity, self.left, self.given = capacity, dict(counts), defaultdict(int)
        self.sequences, self.rows = 0, []
        self.bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, how many)]

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def lay(self, size: int, n: int, first: int, per_bin: int, offset: int) -> None:
        """The next n items of this size go into sequences from ``first``, per_bin in each."""
        self.rows.append((size, self.given[size], first, per_bin, offset))
        self.given[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]

    def fix(self, sizes: tuple[int, ...], n: int) -> None:
        """n sequences that each hold exactly these sizes and take no further item."""
        first, offset = self.open(n), 0
        for size in dict.fromkeys(sizes):
            k = sizes.count(size)
            self.lay(size, n * k, first, k, offset)
            offset += k * size


def _dominant(size: int, sizes: list[int], left: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """A set with this item that dominates every other feasible set with it, if one of up to three items does.

    A set dominates another if the other's items can be dealt out under its items, each pile
    no longer than the item above it; then some best packing uses the dominating set.
    ``sizes`` ascends and holds what is left, ``size`` included.
    """
    room = capacity - size

    def fits(limit: int, *used: int) -> int | None:
        """The largest size up to limit of which an item is left besides the used ones."""
        k = bisect.bisect_right(sizes, limit)
        while k and left[sizes[k - 1]] <= used.count(sizes[k - 1]):
            k -= 1
        return sizes[k - 1] if k else None

    best = fits(room, size)
    if best is None:
        return (size,)
    if best == room:
        return (size, best)
    smallest: list[int] = []
    for s in sizes:
        smallest += [s] * min(3, left[s] - (s == size))
        if len(smallest) >= 3:
            break
    two = sum(smallest[:2]) if len(smallest) >= 2 else capacity + 1
    if two > room:  # nothing but one more item fits beside it
        return (size, best)
    if len(smallest) >= 3 and sum(smallest[:3]) <= room:
        return None  # sets of four are possible: not decided here
    third = fits(room - best, size, best)
    if third is not None:
        # Of any pair that fits, the larger is under `best`; the smaller must be under `third`.
        return (size, best, third) if third >= (fits(room // 2, size, best) or 0) else None
    # The largest sum of a pair that fits, by two pointers: a pile under `best` if no longer than it.
    lo, hi = 0, len(sizes) - 1
    while lo <= hi:
        a, b = sizes[lo], sizes[hi]
        if left[a] <= (size == a) or (a == b and left[a] <= 1 + (size == a)):
            lo += 1
        elif left[b] <= (size == b) or a + b > room:
            hi -= 1
        elif a + b > best:
            return None
        else:
            lo += 1
    return (size, best)


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> _Plan:
    """Where the items of a histogram {length: how many} go; lengths 1 to capacity."""
    plan = _Plan(capacity, {s: n for s, n in counts.items() if n > 0})
    changed = True
    while changed and plan.left:
        changed = False
        for size in sorted(plan.left, reverse=True):
            while size in plan.left:
                found = _dominant(size, sorted(plan.left), plan.left, capacity)
                if found is None:
                    break
                n = min(plan.left[s] // found.count(s) for s in set(found))
                plan.fix(found, n)
                changed = True
    plan.reduced, plan.rest = plan.sequences, dict(plan.left)
    for size in sorted(plan.left, reverse=True):  # best fit by falling length, groups of equal bins at once
        while size in plan.left:
            room = min((r for r in plan.bins if r >= size and plan.bins[r]), default=None)
            if room is None:
                room, per_bin = capacity, capacity // size
                n_bins = -(-plan.left[size] // per_bin)
                plan.bins[capacity].append((plan.open(n_bins), n_bins))
            first, n_bins = plan.bins[room].pop()
            per_bin = room // size
            full = min(n_bins, plan.left[size] // per_bin)
            if full:
                plan.lay(size, full * per_bin, first, per_bin, capacity - room)
                plan.bins[room - per_bin * size].append((first, full))
                first, n_bins = first + full, n_bins - full
            if n_bins and size in plan.left:  # fewer than per_bin are left: one bin more
                rest = plan.left[size]
                plan.lay(size, rest, first, rest, capacity - room)
                plan.bins[room - rest * size].append((first, 1))
                first, n_bins = first + 1, n_bins - 1
            if n_bins:
                plan.bins[room].append((first, n_bins))
    return plan


def _place(batches: Iterator[pa.RecordBatch], keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        at = rows[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
        nth, per_bin = rank - at[:, 1], np.maximum(at[:, 3], 1) if len(length) else rank
        own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        own += [pa.array(at[:, 2] + nth // per_bin, pa.int64()), pa.array(at[:, 4] + nth % per_bin * length, pa.int64())]
        yield pa.RecordBatch.from_arrays(own, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into few sequences of ``capacity`` tokens.

    A null or empty text is the closing id alone; equal documents and rows are packed each for
    itself; a null doc_id is carried along; other columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    pieces = materialise(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
            lambda batches: _pieces(batches, tokenizer_file, capacity),
            "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long",
        ),
        "pack-pieces",
    )
    # Rank among all pieces of a length: those of earlier partitions, then the own rank there.
    counts = materialise(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    plan = make_plan({r["length"]: r["n"] for r in histogram}, capacity)
    rows = np.array(sorted(plan.rows) or [(0, 0, 0, 1, 0)], dtype=np.int64)
    keys = (rows[:, 0] << 44) + rows[:, 1]
    # A row per partition and length: it grows with the input, so it is merged, not broadcast.
    ranked = pieces.join(offsets.hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("part_rank"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        lambda batches: _place(batches, keys, rows),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
