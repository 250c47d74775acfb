import random
import re
import zlib
from collections import Counter

import pytest

from slopeworks.llm import spelling
from slopeworks.llm.queries import op11_spelling

COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def _one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _plain(docs, length=6, occurrences=5, times=5):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= occurrences}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if x != w and _one_apart(w, x)] for w in words}
    form = {}
    for w, own in near.items():
        if own:
            best = min(own, key=lambda x: (-words[x], x))
            if words[best] >= times * words[w]:
                form[w] = best
    rows = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root))
    return rows


def _found(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert _found(op11_spelling(spark, sf)) == _plain(docs)


@pytest.mark.parametrize("wave,shard", [(1, 40), (1 << 20, 200)])
def test_shards_and_waves_change_nothing(spark, monkeypatch, wave, shard):
    """A tiny alphabet, so that neighbours, ties and chains of forms abound; many shards, one or all in a wave."""
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "WAVE", wave)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    rng = random.Random(2)
    words = ["".join(rng.choice("aÀÿ×b") for _ in range(rng.randint(3, 6))) for _ in range(60)]
    docs = [(k if k % 9 else None, " ".join(rng.choice(words) + rng.choice(["", "", "日", "1", "É"]) for _ in range(int(rng.paretovariate(0.7)) % 300))) for k in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = _found(spelling.spelling_variants(df, length=3, occurrences=2, times=2))
    assert got == _plain(docs, 3, 2, 2)
    assert any(r[3] and r[3] != r[5] for r in got)


def test_automaton_equals_edits():
    rng = random.Random(4)
    words = sorted({bytes(rng.choice(b"abc\xe9") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    walker = spelling.Walker(spelling.Trie.unpacked(spelling.Trie.of(words, list(range(1, len(words) + 1))).packed()))
    for w in [*words, b"", b"abcabcabc", b"zzz"]:
        want = {x: k for k, x in enumerate(words, 1) if x != w and _one_apart(w.decode("latin-1"), x.decode("latin-1"))}
        assert walker.near(w) == want


def test_odd_rows(weird, no_docs, spark):
    docs = [(r["doc_id"], r["text"]) for r in weird.collect()]
    assert _found(spelling.spelling_variants(weird, length=2, occurrences=1)) == _plain(docs, 2, 1)
    assert spelling.spelling_variants(no_docs).count() == 0
    long_word = spark.createDataFrame([(k, "a" * 30000 + " " + "a" * 30001) for k in range(6)], "doc_id long, text string")
    assert _found(spelling.spelling_variants(long_word)) == _plain([(k, "a" * 30000 + " " + "a" * 30001) for k in range(6)])
