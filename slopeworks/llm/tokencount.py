"""Token counts by a two-tier lookup on the map side; no pre-token is shuffled.

The tokenizer merges nothing across the start of a run of spaces, so a text's count is the sum
over its pre-tokens (spaces and the other characters up to the next space). Lengths of the
corpus's frequent pre-tokens are broadcast as one small table; any other pre-token is encoded
where it occurs and kept in a cache of that worker.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.common import materialise, small_batches, worker_cache

#: Entries of the broadcast table; entries of a worker's cache before it starts anew.
FREQUENT, CACHE = 8192, 300_000
#: Summaries that one task merges.
FAN_IN = 64
#: The tokenizer's own space character counts as a space.
_SPACE = "▁".encode()
_PRE_TOKEN = re.compile(rb"(?: |\xe2\x96\x81)*(?:(?!\xe2\x96\x81)[^ ])+|(?: |\xe2\x96\x81)+")


def pre_tokens(text: bytes) -> list[bytes]:
    """The pre-tokens of a text, each without the one space in front that the tokenizer adds by itself."""
    if not text:
        return []
    if b"  " not in text and _SPACE not in text and text[0] != 32 and text[-1] != 32:
        return text.split(b" ")
    return [p[1:] if p[0] == 32 else p[3:] for p in _PRE_TOKEN.findall(b" " + text)]


def _trim(counts: Counter, keep: int) -> Counter:
    """Misra-Gries: at most ``keep`` counts, all less the largest that must go."""
    if len(counts) <= keep:
        return counts
    top = counts.most_common(keep + 1)
    return Counter({w: n - top[-1][1] for w, n in top[:-1] if n > top[-1][1]})


def _summary(counts: Counter) -> pa.RecordBatch:
    words = sorted(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array([words], pa.list_(pa.binary())), pa.array([[counts[w] for w in words]], pa.list_(pa.int64()))], names=["words", "counts"]
    )


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches:
        for t in b.column("text").to_pylist():
            counts.update(pre_tokens(t or b""))
        if len(counts) > 16 * FREQUENT:
            counts = _trim(counts, 4 * FREQUENT)
    yield _summary(_trim(counts, FREQUENT))


def _merged(key: tuple, parts: pa.Table) -> pa.Table:
    counts: Counter = Counter()
    for words, n in zip(parts.column("words").to_pylist(), parts.column("counts").to_pylist(), strict=True):
        for w, k in zip(words, n, strict=True):
            counts[w] += k
        counts = _trim(counts, 4 * FREQUENT)
    return pa.Table.from_batches([_summary(_trim(counts, FREQUENT))]).add_column(0, "g", pa.array([key[0].as_py()], pa.int64()))


def frequent_pre_tokens(docs: DataFrame) -> list[bytes]:
    """At most FREQUENT frequent pre-tokens of all texts: a summary per partition, merged FAN_IN at a time until one is left."""
    kind = "words array<binary>, counts array<bigint>"
    parts = docs.select(F.col("text").cast("binary")).mapInArrow(_summaries, kind)
    parts = materialise(parts.withColumn("g", F.spark_partition_id().cast("long")), "tokens-summaries")
    last = parts.agg(F.max("g")).first()[0]
    while last:
        last //= FAN_IN
        parts = materialise(parts.withColumn("g", F.floor(F.col("g") / FAN_IN)).groupBy("g").applyInArrow(_merged, f"g long, {kind}"), "tokens-summaries")
    row = parts.first()
    return [bytes(w) for w in row["words"]] if row else []


class _Lengths(dict):
    """Pre-token -> number of tokens: the broadcast table, then this worker's cache."""

    def __init__(self, model_file: str) -> None:
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)

    def add(self, words: set[bytes], frequent: dict[bytes, int]) -> None:
        if len(self) > CACHE:
            self.clear()
        if not self:
            self.update(frequent)
            self[b""] = 1  # a space that no other character follows
        new = [w for w in words if w not in self]
        encoded = self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
        self.update(zip(new, map(len, encoded), strict=True))


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    Null and empty texts have no bytes and no tokens; a null doc_id is carried; repeated rows
    are counted each; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    frequent = frequent_pre_tokens(docs)
    lengths = _Lengths(model_file)
    lengths.add(set(frequent), {})
    table = spark.sparkContext.broadcast(dict(lengths))  # FREQUENT entries at most

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Lengths = worker_cache(f"count:{model_file}", lambda: _Lengths(model_file))
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            split = [pre_tokens(t) for t in texts]
            known.add(set().union(*split), table.value)
            n = [sum(map(known.__getitem__, words)) for words in split]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
