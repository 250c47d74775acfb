import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from slopeworks.llm import simhash
from slopeworks.llm.queries import op9_simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable, by comparing all pairs."""
    ids = list(range(len(prints)))
    fp = np.array(prints, np.uint64)

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 4) + i + 1:
            a, b = root(i), root(int(j))
            ids[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fp))]


def test_equals_all_pairs(spark, sf10):
    docs = sorted(spark.read.parquet(f"{sf10}/documents.parquet").select("doc_id", "text").collect())
    prints = [plain_fingerprint(r["text"]) for r in docs]
    roots = plain_components(prints)
    want = {r["doc_id"]: (f"{p:016x}", docs[k]["doc_id"]) for r, p, k in zip(docs, prints, roots, strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op9_simhash(spark, sf10).collect()}
    assert got == want
    assert len(set(roots)) < len(set(prints))


def test_every_value_is_covered():
    _, bounds, patterns, weights = simhash.golay_tables()
    assert all((weights[a:b] <= 3).sum() == 1 for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    assert len(patterns) == 1 + 23 + 253 + 1771 + 8855


def test_links_of_planted_chains_and_large_anchors(spark, monkeypatch):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(40):  # chains: each four bits from the last
        p = rng.getrandbits(64)
        for _ in range(9):
            for b in rng.sample(range(64), 4):
                p ^= 1 << b
            prints.append(p)
    for _ in range(300):  # a crowd at the same anchors
        p = prints[0]
        for b in rng.sample(range(64), rng.randint(1, 3)):
            p ^= 1 << b
        prints.append(p)
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = plain_components(prints)
    for chunk in (simhash.CHUNK, 50):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        roots = {r["fp"]: r["root"] for r in simhash.components(simhash.links(distinct)).collect()}
        groups = {}
        for k, p in enumerate(signed):
            groups.setdefault(roots.get(p, p), set()).add(want[k])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_long_path_and_star(spark):
    edges = [(k + 1, k) for k in range(200)] + [(1000 + k, 999) for k in range(300)]
    found = {r["fp"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 201)} | {1000 + k: 999 for k in range(300)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, weird, no_docs):
    rows = simhash.near_duplicates(weird).withColumn("x", simhash.hex_digits(F.col("fp"))).collect()
    by = {r["doc_id"]: (r["x"], r["component_id"]) for r in rows}
    texts = {r["doc_id"]: r["text"] for r in weird.collect()}
    assert len(rows) == 12 and all(by[d][0] == f"{plain_fingerprint(t):016x}" for d, t in texts.items())
    assert by[8][1] == 7 and by[3][1] == 2 and by[4][1] == 2 and by[None][1] is None
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(weird)
    assert kept.columns == weird.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 5, 6, 7, 9, 10]
