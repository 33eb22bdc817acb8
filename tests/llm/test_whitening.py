"""Operator 13 against a dense eigendecomposition."""

import numpy as np
import pytest

from millwright.llm import queries, whitening
from millwright.llm.common import table

SMALL = "/root/testdata/sf0.001"


def fine(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v)


def brute(rows, k=8):
    """(n, {vec_id: deviation}, {vec_id: whitened}, explained) with numpy's own eigenvectors."""
    kept = [(i, [int(np.floor(1024 * float(c))) + 100_000 for c in v]) for i, v in rows if fine(v)]
    x, n = np.array([v for _, v in kept], float), len(kept)
    sums = [sum(col) for col in zip(*(v for _, v in kept))]
    deviation = [(i, sum((n * c - s) ** 2 for c, s in zip(v, sums))) for i, v in kept]
    y = x - np.array([s / n for s in sums])
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, deviation, [(i, w) for (i, _), w in zip(kept, y @ q / np.sqrt(e))], e / np.trace(v)


def check(got, rows, k=8):
    n, deviation, white, explained = brute(rows, k)
    assert {r.n for r in got} == {n} and all(r.identity_error <= 1e-4 for r in got)
    assert sorted(((r.vec_id, r.deviation) for r in got if r.component == 1), key=str) == sorted(deviation, key=str)
    for c in range(k):
        own = [r for r in got if r.component == c + 1]
        assert np.allclose([r.explained for r in own], explained[c], rtol=1e-9)
        a = np.array([r.whitened for r in sorted(own, key=lambda r: (str(r.vec_id), abs(r.whitened)))])
        b = np.array([w[c] for i, w in sorted(white, key=lambda x: (str(x[0]), abs(x[1][c])))])
        assert len(a) == len(b) and min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    return own


def test_small_table(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "embeddings").select("vec_id", "embedding").collect()]
    check(queries.op13_whitening(spark, SMALL).collect(), rows)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "w", 0.5) for i, v in rows], "vec_id long, embedding array<float>, n int, w string, whitened double")


def test_awkward_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(k, (rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5]).astype(np.float32).tolist()) for k in range(300)]
    rows += [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan"), *[0.0] * 5]), (904, [float("inf"), *[0.0] * 5]), (5, rows[5][1]), (None, rows[6][1]), (7, rows[8][1])]
    short = [(950, [1.0, 2.0])]
    check(whitening.whiten(vectors(spark, rows + short)).collect(), rows, 6)


def test_few_or_equal_rows(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)]):
        assert whitening.whiten(vectors(spark, rows)).count() == 0
    line = [(k, [float(k), 2.0 * k, 1.0]) for k in range(5)]  # one direction only
    got = whitening.whiten(vectors(spark, line)).collect()
    assert {r.component for r in got} == {1} and got[0].identity_error < 1e-9


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(k % 7) * 1e9, float(k * k % 11), float(k)]) for k in range(60)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, rows), 1).collect()}
    want = dict(brute(rows, 1)[1])
    assert got == {i: d if d < 2**63 else None for i, d in want.items()} and None in got.values()


def random_symmetric(rng, values):
    q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0]
    v = (q * values) @ q.T
    return (v + v.T) / 2


CASES = {
    "one": [4.0], "zero": [0.0] * 5, "equal": [3.0] * 12, "clusters": [5.0] * 7 + [2.0] * 8 + [1.0], "near": [9, 9 - 1e-9, 9 - 2e-9, *[1.0] * 20], "graded": list(10.0 ** -np.arange(25)),
    "rank": [3.0, 2.0, 1.0] + [0.0] * 20, "spread": list(np.linspace(1, 2, 70)),
}


@pytest.mark.parametrize("name", CASES)
def test_eigenvectors(name):
    v = random_symmetric(np.random.default_rng(8), np.array(CASES[name], float))
    e, q = whitening.eigen(v)
    scale = np.linalg.norm(v) or 1.0
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() <= 1e-13 * scale
    assert np.linalg.norm(v @ q - q * e) <= 1e-12 * scale and np.abs(q.T @ q - np.eye(len(v))).max() < 1e-13


def test_polar_factor():
    rng = np.random.default_rng(9)
    for low in (1.0, 1e-3, 1e-10):
        a = random_symmetric(rng, np.array([1.0, 0.5, low, -low, -0.7]))
        w, q = np.linalg.eigh(a)
        assert np.abs(whitening.polar(a) - (q * np.sign(w)) @ q.T).max() < 1e-13 / low
