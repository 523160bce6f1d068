"""Whitening against numpy's eigenvectors and exact integer sums."""

import math
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import queries as Q, whitening as W

SMALL = "/root/testdata/sf0.001"


def spectrum(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        [1.0], [3, 2, 1], [5, 5, 5, 5], [1e6, 1e6, 1, 1e-6, 0, 0], list(range(40, 0, -1)), [1, 1 - 1e-12, 1 - 1e-6, 0.5],
        list(np.geomspace(1e8, 1e-8, 32)), [2] * 20 + [1] * 20, [0, 0, 0], [1, 0, -1], [7, 3, 3, 3, 3, 0, 0, 0],
    ],
)
def test_components(values):
    a = spectrum(np.random.default_rng(3), np.array(values, float))
    size = max(np.linalg.norm(a), 1e-300)
    for count in (None, 1, 4):
        e, v = W.components(a, count)
        want = np.sort(np.linalg.eigvalsh(a))[::-1][:count]
        assert np.abs(e - want).max() <= 1e-13 * size
        assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13
        assert np.linalg.norm(a @ v - v * e) <= 1e-13 * size * len(values)


def test_polar():
    rng = np.random.default_rng(5)
    for cond in (1, 1e3, 1e12):
        q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
        r, _ = np.linalg.qr(rng.standard_normal((12, 12)))
        u = W.polar(q @ np.diag(np.geomspace(1, 1 / cond, 12)) @ r)
        assert np.linalg.norm(u - q @ r) < 1e-14 * cond + 1e-13
        assert np.linalg.norm(u.T @ u - np.eye(12)) < 1e-13
    assert W.polar(np.zeros((3, 3)) + 1.0) is None


def expected(rows, count=4, grid=256):
    """{id: (deviation, centred vector)}, n, covariance of the distinct vectors."""
    kept = [(i, [math.floor(grid * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * x - t, n)) for x, t in zip(v, s)] for v in fit])
    dev = [(i, sum((n * x - t) ** 2 for x, t in zip(v, s)), np.array([float(Fraction(n * x - t, n)) for x, t in zip(v, s)])) for i, v in kept]
    return dev, n, centred.T @ centred / n


def agree(got, rows, count=4):
    dev, n, cov = expected(rows)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:count], v[:, ::-1][:, :count]
    by = {}
    for r in got:
        by.setdefault(r[0], {})[r.component] = r
    assert len(got) == len(dev) * len(e)
    sign = {}
    for i, d, c in dev:
        for k in range(len(e)):
            r = by[i][k + 1]
            want = c @ v[:, k] / math.sqrt(e[k])
            if abs(want) > 1e-3:
                sign.setdefault(k, 1 if want * r.whitened > 0 else -1)
            assert (r.n, r.deviation) == (n, d)
            assert abs(abs(r.whitened) - abs(want)) < 1e-8 and (abs(want) < 1e-3 or want * sign[k] * r.whitened > 0)
            assert abs(r.explained - e[k] / np.trace(cov)) < 1e-9
            assert r.identity_error < 1e-9


def test_op12(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    agree(Q.op12_whitening(spark, SMALL).collect(), rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(5) * [9, 5, 3, 2, 1] + 1000]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # copies count once
    odd = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [1.0, float("nan"), 1.0, 1.0, 1.0]), (203, [float("inf")] * 5), (204, []), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows + odd], "id long, vec array<double>, n int")
    agree(W.whiten(df, id_column="id", vector_column="vec").collect(), rows)
    same = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert W.whiten(same).count() == 0
    assert W.whiten(same.limit(0)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(10)], "vec_id long, embedding array<float>")
    assert {r.component for r in W.whiten(flat).collect()} == {1}
    line = spark.createDataFrame([(i, [float(i % 7)]) for i in range(10)], "vec_id long, embedding array<float>")
    assert W.whiten(line).count() == 10


def test_deviations_beyond_a_long():
    x = np.array([[2**40, 0], [3, 1]])
    assert W._deviations(x, 2, [2, 2]) == [None, 16]
    assert W._deviations(x, 2**30, [0, 0]) == [None, None]
    assert W._deviations(x[1:], 10, [5, -5]) == [25**2 + 15**2]
