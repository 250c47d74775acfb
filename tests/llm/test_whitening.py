import math

import numpy as np
import pytest

from slopeworks.llm import whitening
from slopeworks.llm.queries import op12_whiten


def _plain(vectors):
    """(n, sums, whole-number rows, eigenvalues, eigenvectors) by a dense decomposition."""
    x = [[math.floor(64 * c) + 1_000_000 for c in map(float, v)] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    away = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    values, ways = np.linalg.eigh(away.T @ away / n)
    return n, sums, x, away, values[::-1], ways[:, ::-1]


def _check(rows, ids, vectors, most=32):
    n, sums, x, away, values, ways = _plain(vectors)
    k = min(most, int((values > whitening.LEAST * values[0]).sum()))
    assert len(rows) == n * k and {r["n"] for r in rows} == {n}
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    for vec, row, y in zip(ids, x, away, strict=True):
        own = got[vec]
        assert sorted(own) == list(range(1, k + 1))
        assert {r["deviation"] for r in own.values()} == {sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))}
    for c in range(k):
        w = np.array([got[v][c + 1]["whitened"] for v in ids])
        want = away @ ways[:, c] / math.sqrt(values[c])
        gap = min(abs(values[c] - values[j]) for j in range(len(values)) if j != c) if len(values) > 1 else values[c]
        assert np.abs(w * np.sign(w @ want) - want).max() < 1e-11 * values[0] / gap + 1e-9
        assert got[ids[0]][c + 1]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-8


def test_equals_dense_decomposition(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    _check(op12_whiten(spark, sf).collect(), [r["vec_id"] for r in table], [r["embedding"] for r in table])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(c) for c in rng.normal(size=5)]) for k in range(40)]
    odd = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [1.0, math.nan, 1.0, 1.0, 1.0]), (94, [math.inf] * 5), (95, [1.0, 2.0]), (96, [1e30] * 5)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in good + odd], "vec_id long, embedding array<double>, n string, component int").repartition(3)
    _check(whitening.whiten(docs).collect(), [r[0] for r in good], [r[1] for r in good])
    # Repeated rows count each, a null id is carried.
    twice = docs.where("vec_id < 40").unionByName(docs.where("vec_id = 7")).unionByName(docs.where("vec_id = 8").selectExpr("cast(null as bigint) as vec_id", "embedding", "n", "component"))
    rows = whitening.whiten(twice).collect()
    assert len(rows) == 42 * 5 and sum(r["vec_id"] == 7 for r in rows) == 10 and sum(r["vec_id"] is None for r in rows) == 5


@pytest.mark.parametrize("kind", ["none", "one", "equal", "flat"])
def test_without_variance(spark, kind):
    rows = {"none": [], "one": [(1, [1.0, 2.0])], "equal": [(k, [1.0, 2.0]) for k in range(9)], "flat": [(k, [float(k), 2.0]) for k in range(9)]}[kind]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(found) == (9 if kind == "flat" else 0)
    if kind == "flat":
        assert all(abs(r["explained"] - 1) < 1e-12 for r in found) and found[0]["identity_error"] < 1e-12


def test_large_entries_stay_exact():
    x = np.array([[1 << 40, 5], [3, 7], [-(1 << 51), 9]])
    centre = whitening.Centre(3, tuple(int(s) for s in x.sum(axis=0)))
    assert centre.deviations(x) == [sum((3 * int(a) - s) ** 2 for a, s in zip(r, centre.sums, strict=True)) for r in x]


@pytest.mark.parametrize("seed", range(6))
def test_lanczos_on_hard_spectra(seed):
    """Many equal eigenvalues (more than a block), a gap of 1e-6, a rank below what is wanted."""
    rng = np.random.default_rng(seed)
    d = 90
    spectra = [[5.0] * 30 + [1.0] * 60, [3.0, 3.0 - 3e-6, *np.linspace(2, 0.1, 88)], [4.0, 2.0, 1.0] + [0.0] * 87, list(2.0 ** -np.arange(90)), [1.0] * 90, list(np.linspace(1, 0.9, 90))]
    values = np.array(sorted(spectra[seed], reverse=True))
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    a = q @ np.diag(values) @ q.T
    passes = []
    found, ways = whitening.lanczos(lambda v: passes.append(v.shape[1]) or a @ v, d, 32, block=8)
    assert np.abs(found - values[:32]).max() < 1e-12 * values[0]
    assert np.abs(a @ ways - ways * found).max() < 1e-11 * values[0] and np.abs(ways.T @ ways - np.eye(32)).max() < 1e-12
    assert sum(passes) <= d


def test_few_passes_where_few_directions_matter():
    rng = np.random.default_rng(1)
    d, q = 400, np.linalg.qr(rng.normal(size=(400, 400)))[0]
    values = np.concatenate([np.linspace(50, 10, 32), 0.01 * rng.random(368)])
    a = q @ np.diag(values) @ q.T
    passes = []
    found, _ = whitening.lanczos(lambda v: passes.append(v.shape[1]) or a @ v, d, 32)
    assert np.abs(np.sort(found) - np.sort(values[:32])).max() < 1e-11 * 50 and len(passes) < 15
