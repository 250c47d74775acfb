"""Encoding and decoding with a merge-type sentencepiece vocabulary.

An agenda holds the adjacent pairs of symbols that make a piece, best score first, leftmost of
equal ones; the top pair becomes one symbol and its new neighbours join the agenda. Short rows of
characters are merged side by side in numpy. Characters that no piece holds fall back to their bytes. If no piece runs on across the start of a run of
spaces, as here, a text is the row of its pre-tokens, and each different one is encoded once a
worker. In every Arrow batch the library encodes the same rows as well, and the two are compared.
"""

from __future__ import annotations

import codecs
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.common import small_batches, worker_cache
from slopeworks.llm.tokencount import pre_tokens

#: Pre-tokens kept by a worker (twice so many for a while), and the longest of them in bytes; longer ones are encoded where they occur.
CACHE, CACHED_BYTES = 150_000, 256
#: Characters up to which rows are merged side by side, and how many at once.
SHORT, SIDE = 48, 4096
_SPACE, _LINE = "▁", b"\xff"
#: More than all symbols; no agenda's entry; bits of a place in a short row.
_STRIDE, _NONE, _PLACE = 1 << 22, 1 << 62, 6

codecs.register_error("slopeworks_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class MergeCodec:
    """Encoder and decoder of one vocabulary, read off the library's model (scores and kinds of its pieces; it has no pieces of the user's own)."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(m.get_piece_size())
        special = {i for i in ids if m.is_control(i) or m.is_unknown(i) or m.is_byte(i)}
        pieces = {m.id_to_piece(i): i for i in ids if i not in special}
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        self.end, self.unknown = array("i", [m.eos_id()]).tobytes(), m.unk_id()
        self.splits = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.breaks = not any("\n" in p for p in pieces)
        byte_of = {i: bytes([b]) for b, i in self.byte.items()}
        plain = lambda i: b"" if m.is_control(i) else " ⁇ ".encode() if i == self.unknown else m.id_to_piece(i).replace(_SPACE, " ").encode()
        self.bytes = [byte_of[i] if i in byte_of else plain(i) for i in ids]
        self.spaced = {i for p, i in pieces.items() if p[0] == _SPACE}
        #: A symbol is a piece's id, or, of a character that is no piece, its code point above all ids.
        self.symbol = {p: i for p, i in pieces.items() if len(p) == 1}
        self.above = len(ids)
        self.bits = self.above.bit_length()
        #: A pair of symbols -> the rank of the score of the piece they make, best first, and the piece below it.
        self.pair: dict[int, int] = {}
        scores = sorted({m.get_score(i) for i in pieces.values()}, reverse=True)
        rank = dict(zip(scores, range(len(scores)), strict=True))
        for p, i in pieces.items():
            for k in range(1, len(p)):
                left, right = self._symbol(p[:k], pieces), self._symbol(p[k:], pieces)
                if left is not None and right is not None:
                    self.pair[left * _STRIDE + right] = rank[m.get_score(i)] << self.bits | i
        #: The same as arrays, with room for a place between rank and piece.
        self.pairs = np.array(sorted(self.pair), np.int64)
        made = np.array([self.pair[k] for k in self.pairs.tolist()], np.int64)
        self.made = made >> self.bits << self.bits + _PLACE | made & (1 << self.bits) - 1
        self.symbols = np.arange(self.above, self.above + 0x110000, dtype=np.int64)
        for c, i in self.symbol.items():
            self.symbols[ord(c)] = i
        #: Pre-token -> its ids as bytes of 32-bit integers; when full, it becomes the old one, of which what is met again is kept.
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        #: Rows of characters encoded since ``checked`` was last called, with their ids.
        self.fresh: list[tuple[str, bytes]] = []
        self.long: list[bytes] = []

    def _symbol(self, p: str, pieces: dict[str, int]) -> int | None:
        return pieces.get(p, self.above + ord(p) if len(p) == 1 else None)

    def _ids(self, symbols: list[int]) -> bytes:
        """Ids of merged symbols: a character that is no piece is its bytes."""
        found = array("i")
        for s in symbols:
            if s < self.above:
                found.append(s)
            elif self.byte:
                found.extend(self.byte[b] for b in chr(s - self.above).encode())
            else:
                found.append(self.unknown)
        return found.tobytes()

    def merged(self, rows: list[str]) -> list[bytes]:
        """Ids of rows of characters, spaces already written as the vocabulary writes them: short ones side by side, rows of like length together."""
        found = [b""] * len(rows)
        order = sorted(range(len(rows)), key=lambda k: len(rows[k]))
        short = [k for k in order if 0 < len(rows[k]) <= SHORT]
        for at in range(0, len(short), SIDE):
            own = short[at : at + SIDE]
            for k, ids in zip(own, self._side_by_side([rows[k] for k in own]), strict=True):
                found[k] = ids
        for k in order[len(order) - sum(len(r) > SHORT for r in rows) :]:
            found[k] = self._ids(self._one(rows[k]))
        return found

    def _entry(self, left: np.ndarray, right: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """Agenda entries of pairs at their places: rank, place, piece, so that the least is the best, and the leftmost of equal rank; a symbol of -1 makes no pair."""
        key = left * _STRIDE + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at] | place << self.bits, _NONE)

    def _side_by_side(self, rows: list[str]) -> list[bytes]:
        """Rows merged together, each by its own agenda: in a step every row takes its top pair; a row without one is done."""
        sizes = np.array([len(r) for r in rows])
        n, width = len(rows), int(sizes.max())
        column = np.arange(width)
        # The last column stands for both ends of a row.
        symbols = np.full((n, width + 1), -1, np.int64)
        symbols[:, :width][column < sizes[:, None]] = self.symbols[np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)]
        after, before = np.tile(np.arange(1, width + 2), (n, 1)), np.tile(np.arange(-1, width), (n, 1))
        after[np.arange(n), sizes - 1] = width
        agenda = self._entry(symbols[:, :width], symbols[:, 1:], column)
        active = np.arange(n)
        while True:
            i = agenda[active].argmin(axis=1)
            top = agenda[active, i]
            on = top < _NONE
            active, i, top = active[on], i[on], top[on]
            if not len(active):
                break
            piece, j = top & (1 << self.bits) - 1, after[active, i]
            k, h = after[active, j], before[active, i]
            symbols[active, i], symbols[active, j], agenda[active, j] = piece, -1, _NONE
            after[active, i], before[active, k] = k, i
            agenda[active, i] = self._entry(piece, symbols[active, k], i)
            inner = h >= 0
            at, h, piece = active[inner], h[inner], piece[inner]
            agenda[at, h] = self._entry(symbols[at, h], piece, h)
        alive = symbols >= 0
        flat, ends = symbols[alive], [0, *np.cumsum(alive.sum(axis=1)).tolist()]
        raw = flat.astype(np.int32).tobytes()
        found = [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]
        for k in np.flatnonzero((symbols >= self.above).any(axis=1)).tolist():
            found[k] = self._ids(flat[ends[k] : ends[k + 1]].tolist())
        return found

    def _one(self, text: str) -> list[int]:
        """Symbols of one row, however long: its agenda is a heap, where a pair that has changed since stays until it comes up."""
        get, bits, mask = self.pair.get, self.bits, (1 << self.bits) - 1
        symbols, n = self.symbols[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tolist(), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(x >> bits, i, x) for i in range(n - 1) if (x := get(symbols[i] * _STRIDE + symbols[i + 1]))]
        heapify(agenda)
        while agenda:
            _, i, made = heappop(agenda)
            j = after[i]
            if symbols[i] < 0 or j >= n or get(symbols[i] * _STRIDE + symbols[j]) != made:
                continue
            symbols[i], symbols[j] = made & mask, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if x := get(symbols[i] * _STRIDE + symbols[k]):
                    heappush(agenda, (x >> bits, i, x))
            if (h := before[i]) >= 0 and (x := get(symbols[h] * _STRIDE + symbols[i])):
                heappush(agenda, (x >> bits, h, x))
        return [s for s in symbols if s >= 0]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts, as bytes of 32-bit integers, each with the end id after them."""
        split = list(map(self._rows, texts))
        self._learn(set().union(*split))
        known, end = self.known, self.end
        out = [b"".join([known[w] for w in words]) + end for words in split]
        for w in self.long:
            del known[w]
        return out

    def _rows(self, text: bytes) -> list[bytes]:
        """Pre-tokens of a text. No piece holds a line end, so each starts a pre-token of its own, marked by a byte that no text has, behind a space of its own."""
        if not self.splits:
            return [text] if text else []
        if self.breaks and b"\n" in text:
            if _LINE in text:
                text = text.decode("utf-8", "replace").encode()
            text = text.replace(b"\n", b" " + _LINE)
        return pre_tokens(text)

    def _learn(self, words: set[bytes]) -> None:
        """Have all ``words`` in ``known``; those too long to keep are in ``long``."""
        if len(self.known) > CACHE:
            self.old = dict(self.known)
            self.known.clear()
        known, old = self.known, self.old
        new = [w for w in words if w not in known]
        known.update([(w, old[w]) for w in new if w in old])
        # Spaces before a line end: the last of them is not the text's own.
        mixed = [w for w in new if _LINE in w[1:]]
        parts = {w: [w[: w.index(_LINE) - 1], w[w.index(_LINE) :]] for w in mixed}
        rows = [w for w in {*new, *chain(*parts.values())}.difference(mixed) if w not in known]
        texts = [_SPACE + w.decode("utf-8", "replace") if w[:1] != _LINE else "\n" + w[1:].decode("utf-8", "replace") for w in rows]
        texts = [t.replace(" ", _SPACE) if " " in t else t for t in texts]
        ids = self.merged(texts)
        known.update(zip(rows, ids, strict=True))
        self.fresh += zip(texts, ids, strict=True)
        known.update([(w, b"".join([known[k] for k in keys])) for w, keys in parts.items()])
        self.long = [w for w in {*words, *rows} if len(w) > CACHED_BYTES]

    def checked(self) -> int:
        """How many of the rows encoded since the last call the library encodes differently; it puts a space in front by itself, and before a line end."""
        fresh, self.fresh = self.fresh, []
        told = self.model.encode([t.removeprefix(_SPACE) for t, _ in fresh], num_threads=1) if fresh else []
        alone = self.merged([_SPACE])[0]
        return sum(array("i", lib).tobytes() != (alone + ids if text[0] == "\n" else ids) for (text, ids), lib in zip(fresh, told, strict=True) if text != _SPACE)

    def decode(self, ids: list[int] | array) -> str:
        """The text of a row of ids: the space that the encoder put in front goes, bytes that are no character are replaced one by one."""
        pieces = [self.bytes[i] for i in ids]
        first = next((k for k, p in enumerate(pieces) if p), None)
        if first is not None and ids[first] in self.spaced:
            pieces[first] = pieces[first][1:]
        return b"".join(pieces).decode("utf-8", "slopeworks_each_byte")


def encode_documents(docs: DataFrame, model_file: str, whole_check: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, decoded) for every row of ``docs`` (doc_id, text).

    ``ids`` ends with the end id; ``decoded`` is the text they give again. In every Arrow batch the
    library encodes the rows of characters that the worker had not met before, or, with
    ``whole_check``, encodes and decodes all texts; a difference is an error. Null and empty texts
    have the end id alone and decode to an empty text; a null doc_id is carried; repeated rows are
    encoded each; other columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec: MergeCodec = worker_cache(f"pieces:{model_file}", lambda: MergeCodec(model_file))
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            raw = codec.encode(texts)
            ids = [array("i", r) for r in raw]
            decoded = [codec.decode(i) for i in ids]
            if not whole_check:
                differ = codec.checked()
            else:
                codec.fresh.clear()
                told = codec.model.encode([t.decode("utf-8", "replace") for t in texts], add_eos=True, num_threads=1)
                differ = sum(own.tolist() != lib or text != codec.model.decode(lib) for own, lib, text in zip(ids, told, decoded, strict=True))
            if differ:
                raise ValueError(f"{differ} rows of a batch differ from the library's ids: {model_file} is no vocabulary that this encoder knows")
            ends = [0, *accumulate(map(len, ids))]
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(raw))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(encoded, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_documents``: SHA-256 of the decimal ids joined by one space, and of the decoded text."""
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
