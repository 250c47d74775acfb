import random

import sentencepiece

from slopeworks.llm import tokencount
from slopeworks.llm.queries import op7_tokens, tokenizer_file

FILE = tokenizer_file("piece_bpe_32k.model")


def test_equals_library(spark, sf):
    model = sentencepiece.SentencePieceProcessor(model_file=FILE)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_tokens(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(model.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


def test_odd_rows(weird, no_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=FILE)
    want = sorted((len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in weird.collect())
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in tokencount.count_tokens(weird, FILE).collect()) == want
    assert tokencount.count_tokens(no_docs, FILE).count() == 0


def test_pre_tokens_add_up():
    model = sentencepiece.SentencePieceProcessor(model_file=FILE)
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "The", " ", "  ", "\n", "▁", "é", "<s>", "</s>", "<unk>", "\t", "1", "日本", ".", " ", "\x00"]) for _ in range(rng.randint(0, 14)))
        parts = [p.decode() for p in tokencount.pre_tokens(text.encode())]
        assert sum(len(x) if p else 1 for p, x in zip(parts, model.encode(parts), strict=True)) == len(model.encode(text)), repr(text)


def test_summary_keeps_what_is_frequent():
    from collections import Counter

    counts = Counter({b"a": 50, b"b": 30, b"c": 1, b"d": 1})
    assert tokencount._trim(counts, 2) == Counter({b"a": 49, b"b": 29})


def test_summaries_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "FAN_IN", 2)
    docs = spark.createDataFrame([(k, f"often w{k} often") for k in range(60)], "doc_id long, text string").repartition(7)
    found = tokencount.frequent_pre_tokens(docs)
    assert b"often" in found and len(found) == 61
