import hashlib
import random

import sentencepiece

from slopeworks.llm import pieces
from slopeworks.llm.queries import op13_pieces, tokenizer_file

FILE = tokenizer_file("piece_bpe_32k.model")
ODD = ["a", "The", " ", "  ", "    ", "\n", "▁", "é", "<s>", "</s>", "<unk>", "<0x0A>", "\t", "1", "日本", ".", "\x00", "𝄞", "ﬁ", "é", "🚴‍♀️", "ing", "inter", "national", " ", "ÀÉ"]


def _texts(n: int) -> list[str]:
    rng = random.Random(13)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_agenda_equals_library():
    codec, lib = pieces.MergeCodec(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    assert codec.splits and codec.breaks
    texts = [*_texts(4000), "x" * 5000, "ab" * 3000 + " " * 500, "", " ", "\n", "日" * 2000, " " * 47, " " * 48 + "\n" * 3]
    for text, raw in zip(texts, codec.encode([t.encode() for t in texts]), strict=True):
        ids = list(memoryview(raw).cast("i"))
        assert ids == lib.encode(text, add_eos=True), repr(text)
        assert codec.decode(ids) == lib.decode(ids), repr(text)
    assert codec.checked() == 0 and not codec.fresh


def test_rows_side_by_side_equal_rows_alone():
    codec = pieces.MergeCodec(FILE)
    rows = [t[:48] for t in _texts(1000) if t]
    assert codec._side_by_side(rows) == [codec._ids(codec._one(r)) for r in rows]


def test_whole_rows_equal_split_rows():
    codec = pieces.MergeCodec(FILE)
    split = codec.encode([t.encode() for t in _texts(500)])
    codec.splits = codec.breaks = False
    codec.known.clear()
    codec.old.clear()
    assert codec.encode([(" " + t if t else "").encode()[1:] for t in _texts(500)]) == split


def test_decoder_equals_library_on_any_ids():
    codec, lib = pieces.MergeCodec(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    rng = random.Random(5)
    for _ in range(3000):
        # The unknown id and broken bytes included; control ids only behind, as the encoder puts them.
        ids = [rng.choice([rng.randrange(3, 259), 259, 260, 28705, rng.randrange(259, 32000), 0]) for _ in range(rng.randint(0, 12))] + [2]
        assert codec.decode(ids) == lib.decode(ids), ids


def test_query_equals_library(spark, sf):
    lib = sentencepiece.SentencePieceProcessor(model_file=FILE)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op13_pieces(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r["doc_id"]], add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))


def test_odd_rows(weird, no_docs, monkeypatch):
    lib = sentencepiece.SentencePieceProcessor(model_file=FILE)
    want = sorted((r["doc_id"] or -1, lib.encode(r["text"] or "", add_eos=True)) for r in weird.collect())
    got = pieces.encode_documents(weird, FILE).collect()
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == want
    assert {r["decoded"] for r in got if r["doc_id"] in (2, 3)} == {""} and all(r["ids"] == [2] for r in got if r["doc_id"] in (2, 3))
    got = pieces.encode_documents(weird, FILE, whole_check=True).collect()
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == want
    assert pieces.digests(pieces.encode_documents(no_docs, FILE)).count() == 0


def test_small_cache_changes_nothing(monkeypatch):
    codec = pieces.MergeCodec(FILE)
    texts = [t.encode() for t in _texts(300)]
    want = codec.encode(texts)
    monkeypatch.setattr(pieces, "CACHE", 3)
    monkeypatch.setattr(pieces, "CACHED_BYTES", 4)
    monkeypatch.setattr(pieces, "SHORT", 5)
    codec = pieces.MergeCodec(FILE)
    assert [codec.encode([t])[0] for t in texts] == want and max(map(len, codec.known)) <= 4


def test_differences_are_told():
    codec = pieces.MergeCodec(FILE)
    codec.encode([b"some words\nand lines"])
    assert codec.fresh and codec.checked() == 0 and not codec.fresh
    codec.made[:] = codec.made[::-1].copy()
    codec.encode([b"other words\nother lines"])
    assert codec.checked() == 2
