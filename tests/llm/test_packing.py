import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from slopeworks.llm import packing
from slopeworks.llm.queries import op1_pack, tokenizer_file

FILE = tokenizer_file("word_bpe_49k.json")


def plain_ids(texts):
    tok = Tokenizer.from_file(FILE)
    return [e.ids + [0] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_layout(rows, capacity=2048):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def optimum(lengths, capacity):
    @lru_cache(None)
    def need(items, room):
        if not items:
            return 0
        best = 99
        for k, n in enumerate(items):
            if k and items[k - 1] == n:
                continue
            rest = items[:k] + items[k + 1 :]
            best = min(best, need(rest, room - n) if n <= room else 1 + need(rest, capacity - n))
        return best

    return need(tuple(sorted(lengths, reverse=True)), 0)


def lay_out(plan, counts, capacity):
    """Every rank's place under the plan."""
    rows = []
    starts = sorted(plan.rows)
    for size, n in counts.items():
        for rank in range(n):
            own = [x for x in starts if x[0] == size and x[1] <= rank][-1]
            nth = rank - own[1]
            rows.append({"sequence_id": own[2] + nth // own[3], "offset": own[4] + nth % own[3] * size, "length": size})
    return check_layout(rows, capacity)


def test_plan_is_valid_and_reduction_keeps_an_optimum():
    rng = random.Random(3)
    exact = 0
    for _ in range(120):
        capacity = rng.choice([7, 10, 12, 16])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.make_plan(counts, capacity)
        used = lay_out(plan, counts, capacity)
        best = optimum(lengths, capacity)
        assert best <= used <= best_fit_decreasing(lengths, capacity)
        # What the reduction fixed leaves the rest's optimum at the whole's less the fixed sequences.
        rest = [n for n, k in plan.rest.items() for _ in range(k)]
        assert plan.reduced + (optimum(rest, capacity) if rest else 0) == best
        exact += used == best
    assert exact > 110
    assert not packing.make_plan({}, 10).rows


def test_plan_stays_small_and_near_the_bound():
    rng = np.random.default_rng(0)
    counts = {int(n): int(c) for n, c in zip(*np.unique(np.clip(rng.lognormal(6, 1, 10**6), 1, 2048).astype(int), return_counts=True), strict=True)}
    plan = packing.make_plan(counts)
    bound = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert bound <= plan.sequences <= 1.02 * bound
    assert len(plan.rows) < 20000 and plan.reduced > 0


def test_ids_and_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    want = {d: ids for d, ids in zip(docs.doc_id, plain_ids(docs.text), strict=True)}
    rows = op1_pack(spark, sf).collect()
    got = defaultdict(int)
    for r in rows:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["piece"] == r["start"] // 2048 and len(ids) == r["length"] == min(2048, len(want[r["doc_id"]]) - r["start"])
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        got[r["doc_id"]] += r["length"]
    assert got == {d: len(ids) for d, ids in want.items()}
    assert check_layout(rows) <= best_fit_decreasing([r["length"] for r in rows], 2048)


def test_word_ids_equal_the_library():
    rng = random.Random(11)
    letters = "abcXYZéÉßñÑ'’.,;:!?|<>-_/\\[]()#&123½²İıŉſΣσςΑωЖжDždžﬁ日本語🚴\u0301\u200d▁\xa0\x1c^`~@\"$%+=*{}"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(20000)]
    words += ["it's", "IT'S.", "we'll,", "<|endoftext|>", "x<|endoftext|>.", "ΟΔΟΣ.", "İstanbul", "a" * 3000, "word." * 500]
    own, tok = packing._WordIds(FILE), Tokenizer.from_file(FILE)
    texts = [" ".join(words[k : k + 7]) for k in range(0, len(words), 7)]
    for text, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(b"".join(own[w] for w in text.encode().split()), "<u4").tolist() == e.ids, text


def test_odd_rows(spark, weird, no_docs):
    rows = packing.pack_documents(weird, FILE).collect()
    check_layout(rows)
    texts = weird.select("doc_id", "text").collect()
    want = sorted((-1 if t["doc_id"] is None else t["doc_id"], len(ids), zlib.crc32(np.array(ids[:2048], "<u4").tobytes())) for t, ids in zip(texts, plain_ids([t["text"] for t in texts]), strict=True))
    first = [r for r in rows if r["piece"] == 0]
    total = {}
    for r in rows:
        total[r["doc_id"]] = max(total.get(r["doc_id"], 0), r["start"] + r["length"])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], total[r["doc_id"]], r["ids_crc32"]) for r in first) == want
    assert packing.pack_documents(no_docs, FILE).count() == 0
