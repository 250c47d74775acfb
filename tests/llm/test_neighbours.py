import math

import numpy as np

from slopeworks.llm import neighbours
from slopeworks.llm.queries import op10_nearest


def brute(rows, every=50, k=5):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (v * v[q]).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((v[q] * v[q]).sum()))
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in own}) for q, own in want.items()) / sum(map(len, want.values()))


def test_exact_at_factor_one_and_recall_in_production(spark, sf10, monkeypatch):
    df = spark.read.parquet(f"{sf10}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    monkeypatch.setattr(neighbours, "LEAF", 8)
    exact = found(neighbours.nearest(df, relax=1.0))
    assert {q: [i for i, _ in own] for q, own in exact.items()} == {q: [i for i, _ in own] for q, own in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(exact[q], want[q], strict=True))
    monkeypatch.setattr(neighbours, "SHARD", 100)
    monkeypatch.setattr(neighbours, "ASKED", 4)
    assert recall(found(op10_nearest(spark, sf10)), want) >= 0.9


def test_relaxing_visits_less():
    rng = np.random.default_rng(1)
    points = np.repeat(rng.normal(size=(20, 16)), 100, axis=0) + 0.1 * rng.normal(size=(2000, 16))
    points /= np.linalg.norm(points, axis=1)[:, None]
    tree = neighbours.VantageTree(points)
    visited = []
    for relax in (1.0, 1.5, 4.0):
        tree.visited = 0
        tree.search(points[::50], 6, relax)
        visited.append(tree.visited)
    assert visited[0] > visited[1] > visited[2] and visited[0] < 0.7 * 40 * 2000


def test_odd_rows(spark):
    nan, inf = float("nan"), math.inf
    rows = [(k, [float(k % 7 + 1), float(k % 3), 1.0]) for k in range(120)]
    rows += [(200, None), (250, [0.0, 0.0, 0.0]), (300, [1.0, nan, 0.0]), (350, [inf, 0.0, 0.0]), (400, [1.0, None, 0.0]), (None, [1.0, 2.0, 3.0]), (450, []), (3, [4.0, 0.0, 1.0]), (500, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 7, 1.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    clean = [*rows[:120], (3, [4.0, 0.0, 1.0])]
    assert {q: [i for i, _ in own] for q, own in found(neighbours.nearest(df, relax=1.0)).items()} == {q: [i for i, _ in own] for q, own in brute(clean).items()}
    assert neighbours.nearest(df.where("false")).count() == 0
    assert neighbours.nearest(df.where("vec_id = 50")).count() == 0
    assert len(found(neighbours.nearest(df.where("vec_id in (50, 51, 52)")))[50]) == 2


def test_extreme_lengths_and_production_recall(spark, sf10):
    rows = [(k, [float(k % 7 + 1), float(k % 3), 1.0 + k]) for k in range(120)]
    scaled = [(k, [x * 2.0 ** (0, 660, -660)[k % 3] for x in v]) for k, v in rows]
    of = lambda r: found(neighbours.nearest(spark.createDataFrame(r, "vec_id long, embedding array<double>"), relax=1.0))
    plain, odd = of(rows), of(scaled)
    assert plain == odd and len(plain) == 3
    df = spark.read.parquet(f"{sf10}/embeddings.parquet")
    assert recall(found(op10_nearest(spark, sf10)), brute([(r["vec_id"], r["embedding"]) for r in df.collect()])) >= 0.9


def test_many_shards_are_exact_at_factor_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    v = centres[np.arange(900) % 12] + 0.05 * rng.normal(size=(900, 8))
    v[300:600] = v[300]  # a third are copies: more than a shard holds
    rows = [(int(k), [float(x) for x in own]) for k, own in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "SHARD", 60)
    monkeypatch.setattr(neighbours, "LEAF", 8)
    want = brute(rows, every=20)
    for asked in (1 << 20, 7):
        monkeypatch.setattr(neighbours, "ASKED", asked)
        got = found(neighbours.nearest(df, every=20, relax=1.0))
        assert {q: [i for i, _ in own] for q, own in got.items()} == {q: [i for i, _ in own] for q, own in want.items()}
        assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_far_vantage_points_are_left_out():
    pivots = np.eye(6)
    batch = neighbours.pa.RecordBatch.from_pydict({
        "vec_id": [0, 20], "row": [0, 1], "v": [[1.0, 0.05, 0, 0, 0, 0], [1.0, 0.9, 0, 0, 0, 0]], "least": [0.99, None],
        "pivot": neighbours.pa.array([0, 0], neighbours.pa.int32()), "far": [0.05, 0.6],
    })
    near, reach = np.zeros(6), np.array([0.9, 0.9, 0.9, 0.2, -1.0, 0.9])
    (out,) = neighbours._onward(pivots, near, reach, 1.0)([batch])
    assert out.column("pivots").to_pylist() == [[], [1, 2, 3, 5]]  # within a radius of 0.14 none reaches; without one all that have members


def test_rows_that_repeat_an_id_are_candidates(spark):
    rows = [(3, [1.0, 0.1])] * 3 + [(50, [1.0, 0.1]), (50, [1.0, 0.1]), (50, [0.0, 1.0]), (7, [1.0, 0.2]), (8, [0.1, 1.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), relax=1.0).collect())
    # Twice the twin's own neighbours: three rows of id 3, the other row of id 50, then 7; and once those of the third row.
    twin = [3, 3, 3, 50, 7]
    assert got == sorted([(50, k + 1, v) for _ in range(2) for k, v in enumerate(twin)] + [(50, k + 1, v) for k, v in enumerate([8, 7, 3, 3, 3])])


def test_a_hot_vector_is_one_row_of_a_shard(spark, monkeypatch):
    """Half of all rows have one vector: what is filed, and the parts that queries are copied to, do not grow with them."""
    rng = np.random.default_rng(5)
    rows = [(k, [1.0, 2.0, 3.0, 4.0] if k % 2 else [float(x) for x in rng.normal(size=4)]) for k in range(1200)]
    monkeypatch.setattr(neighbours, "SHARD", 100)
    parts, copies = [], []
    searched = neighbours._searched

    def watched(filed, shards, asked, *rest):
        parts.append(sum(r["parts"] for r in shards.collect()))
        copies.append((filed.count(), asked.join(shards, "pivot").agg({"parts": "sum"}).first()[0]))
        return searched(filed, shards, asked, *rest)

    monkeypatch.setattr(neighbours, "_searched", watched)
    got = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=15, relax=1.0))
    want = brute(rows, every=15)
    assert {q: [i for i, _ in own] for q, own in got.items()} == {q: [i for i, _ in own] for q, own in want.items()}
    assert copies[0][0] == 601 and max(parts) <= 16 and copies[0][1] <= 80 * 3
