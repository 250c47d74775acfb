"""Spelling variants: words one inserted, deleted or replaced character apart, each with the far more frequent one it stands for.

The vocabulary is cut into shards, each a trie packed into arrays of bounded size by the task that
holds its words. Shards are broadcast wave by wave, as many as fit a fixed number of bytes; the
distance-one automaton of every word is run against every shard depth-first. A word takes one row
from each wave, its number of neighbours and the best of them, so neighbours are never listed.

Words are of characters up to U+00FF, so a word is one byte a character inside the tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.common import materialise, small_batches

#: Fewest characters and occurrences of a word; how many times more frequent its form is.
LENGTH, OCCURRENCES, TIMES = 6, 5, 5
#: A run of a document is misspelt if this divides its checksum.
MISSPELT = 199
#: Characters of a shard's words (a longer word has a shard of its own); bytes of the shards of one wave, some 13 a node, which a worker opens to some 20 times as many.
SHARD, WAVE = 400_000, 6 << 20
#: Different words that a task counts before it sends their numbers on.
COUNTED = 200_000
_RUN = re.compile(rb"[a-z\xc0-\xff]+")


def runs_of(text: str) -> Counter:
    """The runs of a text, A to Z lower-cased, one byte a character, with their numbers: what is no Latin-1 character is no letter."""
    return Counter(_RUN.findall(text.encode("latin-1", "replace").lower()))


def as_written(run: bytes, doc: bytes) -> bytes:
    """The run as document ``doc`` (``<doc_id>:``) has it: one in 199 lacks a character."""
    h = crc32(doc + (run if run.isascii() else run.decode("latin-1").encode()))
    if h % MISSPELT:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): tasks count before anything is shuffled."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def told() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                doc = f"{'' if doc_id is None else doc_id}:".encode()
                for run, n in runs_of(text or "").items():
                    # A run that is too short stays so: a character can only go.
                    if len(run) >= length and len(word := as_written(run, doc)) >= length:
                        total[word] += n
                if len(total) > COUNTED:
                    yield told()
        yield told()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


@dataclass
class Trie:
    """Sorted words as arrays: a node's children stand side by side in order of their characters.

    ``first`` (one more than nodes) has each node's first child, ``letter`` the character that
    leads to a node, ``n`` a word's number where one ends, else 0.
    """

    first: np.ndarray
    letter: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(words: list[bytes], counts: list[int]) -> Trie:
        """Breadth first: the words that share a prefix lie in one range, level by level."""
        first, letter, n = [], [0], []
        level, at = [(0, len(words))], 0
        while level:
            below = []
            for lo, hi in level:
                ends = lo < hi and len(words[lo]) == at
                n.append(counts[lo] if ends else 0)
                first.append(len(letter))
                lo += ends
                for c, own in groupby(range(lo, hi), key=lambda k: words[k][at]):
                    size = sum(1 for _ in own)
                    letter.append(c)
                    below.append((lo, lo + size))
                    lo += size
            level, at = below, at + 1
        first.append(len(letter))
        return Trie(np.array(first, np.int32), np.array(letter, np.uint8), np.array(n, np.int64))

    def packed(self) -> bytes:
        return len(self.letter).to_bytes(8, "little") + self.first.tobytes() + self.letter.tobytes() + self.n.tobytes()

    @staticmethod
    def unpacked(raw: bytes) -> Trie:
        m = int.from_bytes(raw[:8], "little")
        return Trie(np.frombuffer(raw, np.int32, m + 1, 8), np.frombuffer(raw, np.uint8, m, 12 + 4 * m), np.frombuffer(raw, np.int64, m, 12 + 5 * m))


class Walker:
    """The distance-one automaton of a word against one trie."""

    def __init__(self, trie: Trie) -> None:
        self.n = trie.n.tolist()
        first, letter = trie.first.tolist(), trie.letter.tolist()
        #: Node -> its children by character.
        self.down = [dict(zip(letter[a:b], range(a, b), strict=True)) if b > a else _LEAF for a, b in zip(first, first[1:], strict=False)]

    def _ends(self, node: int, rest: bytes) -> int:
        """The number of the word that ``rest`` leads to from a node, 0 if none: the automaton has spent its one difference."""
        down = self.down
        for c in rest:
            if (node := down[node].get(c, -1)) < 0:
                return 0
        return self.n[node]

    def near(self, word: bytes) -> dict[bytes, int]:
        """Accepted words other than ``word``, with their numbers."""
        down, ends, found = self.down, self._ends, {}
        node = 0
        for i in range(len(word) + 1):
            here, rest = word[i : i + 1], word[i + 1 :]
            # One character more than the word has, or another in the place of its next one. Of a run of equal
            # characters only the end can gain or lose one: elsewhere the word would be the same.
            for c, child in down[node].items():
                if here and c == here[0]:
                    continue
                if n := ends(child, word[i:]):
                    found[word[:i] + bytes([c]) + word[i:]] = n
                if here and (n := ends(child, rest)):
                    found[word[:i] + bytes([c]) + rest] = n
            if not here:
                break
            if rest[:1] != here and (n := ends(node, rest)):
                found[word[:i] + rest] = n
            if (node := down[node].get(here[0], -1)) < 0:
                break
        return found


_LEAF: dict[int, int] = {}


def trie_shards(words: DataFrame) -> DataFrame:
    """(trie binary) of ``words`` (word, n): ranges of the sorted words, each packed by the task that holds them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, size = [], [], 0

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([Trie.of(own, counts).packed()], pa.binary())], names=["trie"])
            own.clear()
            counts.clear()
            return out

        for b in batches:
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                if own and size + len(word) > SHARD:
                    yield told()
                    size = 0
                own.append(word.encode("latin-1"))
                counts.append(n)
                size += len(word)
        if own:
            yield told()

    # Order by UTF-8 bytes is that of code points, and so that of Latin-1 bytes.
    return words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(cut, "trie binary")


def _waves(shards: DataFrame, most: int) -> Iterator[list[bytes]]:
    """The shards, as many at a time as fit ``most`` bytes (one at least); only sizes and one wave are on the driver at once."""
    wave, size = [], 0
    for row in shards.toLocalIterator():
        raw = bytes(row["trie"])
        if wave and size + len(raw) > most:
            yield wave
            wave, size = [], 0
        wave.append(raw)
        size += len(raw)
    if wave:
        yield wave


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best struct<n, word>) of ``words`` (word, n): how many words are one difference away, and the most frequent of them (of equal ones the first); no row for words without any."""
    spark = words.sparkSession
    shards = materialise(trie_shards(words), "spelling-shards")
    found = None
    for tries in _waves(shards, WAVE):
        sent = spark.sparkContext.broadcast(tries)

        def walk(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            walkers = [Walker(Trie.unpacked(t)) for t in sent.value]
            for b in batches:
                rows = []
                for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                    near: dict[bytes, int] = {}
                    for w in walkers:
                        near |= w.near(word.encode("latin-1"))
                    if near:
                        best = min(near, key=lambda x: (-near[x], x))
                        rows.append((word, n, len(near), near[best], best.decode("latin-1")))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n", "n_near", "best_n", "best_word"])

        one = materialise(words.select("word", "n").mapInArrow(walk, "word string, n long, n_near long, best_n long, best_word string"), "spelling-near")
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "word string, n long, n_near long, best struct<n: long, word: string>")
    # The largest number first; of equal ones the smallest word.
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best_word").alias("word")))
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), first.alias("b")).select("word", "n", "n_near", F.struct((-F.col("b.less")).alias("n"), "b.word").alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last word that forms lead to. Forms grow at each step, so doubled jumps end after a few rounds."""
    jumps = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialise(jumps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        jumps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return jumps


def spelling_variants(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs`` (doc_id, text) with at least ``length`` characters and ``occurrences``.

    A form is the most frequent near word (of equal ones the first), if it occurs ``times`` as
    often as the word. Null and empty texts have no words; a null doc_id counts as an empty one;
    repeated rows count each; other columns are ignored; no rows give no rows.
    """
    words = materialise(word_counts(docs, length, occurrences), "spelling-words")
    near = near_words(words).select("word", "n_near", "best")
    frequent: Column = F.col("best.n") >= times * F.col("n")
    known = materialise(
        words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, F.col("best.n")).alias("form_n")),
        "spelling-forms",
    )
    roots = followed(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
