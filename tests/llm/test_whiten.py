import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellium.llm import spectrum, whiten
from trellium.llm.queries import QUERIES


def brute(rows, components=4):
    """(n, deviation, whitened, explained) by full decomposition, from (id, list) rows."""
    whole = [(i, tuple(int(np.floor(256.0 * c)) for c in v)) for i, v in rows]
    x = np.array(sorted({v for _, v in whole}), dtype=float)
    n, mean = len(x), x.mean(axis=0)
    sums = [int(s) for s in x.sum(axis=0)]
    v = (x - mean).T @ (x - mean) / n
    values, vectors = np.linalg.eigh(v)
    out = {}
    for i, vec in whole:
        deviation = sum((n * a - s) ** 2 for a, s in zip(vec, sums))
        for k in range(components):
            e = values[-1 - k]
            out.setdefault((i, k + 1), []).append((n, deviation, (np.array(vec) - mean) @ vectors[:, -1 - k] / e**0.5, e / np.trace(v)))
    return out


def agrees(got, expected):
    assert len(got) == sum(len(v) for v in expected.values())
    signs = {}
    for r in got:
        n, deviation, whitened, explained = expected[r.vec_id, r.component][0]
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-9) and r.identity_error < 1e-9
        if abs(whitened) > 1e-6:
            sign = signs.setdefault(r.component, np.sign(whitened * r.whitened))
            assert r.whitened * sign == pytest.approx(whitened, rel=1e-6, abs=1e-8)


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    agrees(QUERIES["op11_whiten"](spark, sf).collect(), brute(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 30, 90])
def test_slices_find_all_eigenpairs(n):
    rng = np.random.default_rng(n)
    for kind in ("spread", "close", "equal", "short rank"):
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        values = {
            "spread": rng.uniform(0, 1000, n), "close": 5 + 1e-7 * rng.uniform(0, 1, n), "equal": rng.choice([1.0, 2.0, 3.0], n),
            "short rank": np.where(np.arange(n) < 2, 4.0 + np.arange(n), 0.0),
        }[kind]
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        k = min(n, 6)
        pairs = spectrum.leading_pairs(a, k)
        assert np.allclose([p.value for p in pairs], np.sort(values)[::-1][:k], rtol=0, atol=1e-11 * 1000)
        vectors = np.array([p.vector for p in pairs])
        assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-10)
        assert all(np.linalg.norm(a @ p.vector - p.value * p.vector) < 1e-12 * 1000 * n for p in pairs)


def test_factors_count_and_solve():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 20):
        for _ in range(20):
            a = rng.integers(-3, 4, (n, n)).astype(float)
            a = a + a.T
            values = np.linalg.eigvalsh(a)
            shift = float(rng.uniform(values[0] - 1, values[-1] + 1))
            f = spectrum.Factors(a, shift)
            assert f.above() == (values > shift).sum()
            b = rng.standard_normal(n)
            assert np.allclose((a - shift * np.eye(n)) @ f.solve(b), b, atol=1e-6)


def test_large_numbers_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1e9, 3e12, 5.5, -7e11]) * rng.random() for _ in range(3)]) for i in range(40)]
    got = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()
    whole = {i: [int(np.floor(256.0 * c)) for c in v] for i, v in rows}
    sums = [sum(v[d] for v in whole.values()) for d in range(3)]
    for r in got:
        deviation = sum((40 * a - s) ** 2 for a, s in zip(whole[r.vec_id], sums))
        assert (None if r.deviation is None else int(r.deviation)) == (deviation if deviation < 10**38 else None)
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-9


def test_covariance_has_no_cancellation():
    from trellium.llm.whiten import _exact_product

    y = np.array([[2**40, -(2**41)], [3, 2**45]])
    assert _exact_product(y).tolist() == [[2**80 + 9, -(2**81) + 3 * 2**45], [-(2**81) + 3 * 2**45, 2**82 + 2**90]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0], 3, "n"), (2, [0.25, -1.0], None, None), (2, [0.25, -1.0], 1, "x"), (None, [1.5, 2.0], 1, ""), (4, None, 1, "n"),
            (5, [None, 1.0], 1, "n"), (6, [nan, 1.0], 1, "n"), (7, [1.0, -inf], 1, "n"), (8, [1.0], 1, "n"), (9, [], 1, "n"), (10, [-0.0, 0.001], 1, "n")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, x string").withColumn("id", F.lit(1)).withColumn("component", F.lit("c"))
    got = whiten.whiten(frame, 4).collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 0, 1, 1, 2, 2, 2, 2, 10, 10] and {r.n for r in got} == {4}
    keep = [(i, v) for i, v, *_ in rows if i in (None, 1, 2, 10)]
    agrees(got, brute(keep, 2))
    assert whiten.whiten(frame.limit(0), 4).count() == 0
    same = whiten.whiten(frame.where("vec_id = 2"), 4).collect()
    assert len(same) == 4 and {(r.n, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in same} == {(1, None, None, None, 0)}
    line = whiten.whiten(frame.where("vec_id in (1, 2)"), 4).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True} and line[0].identity_error < 1e-9
