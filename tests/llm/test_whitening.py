"""Whitening against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest

from tracewright.llm import whitening


def reference(vectors, scale=64, shift=1_000_000):
    x = np.floor(scale * np.array(vectors, float)).astype(np.int64) + shift
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, centred, values[::-1], turn[:, ::-1]


@pytest.mark.parametrize(("width", "wanted"), [(5, 3), (40, 32), (300, 32), (150, 4)])
def test_lobpcg(width, wanted):
    rng = np.random.default_rng(width)
    rows = rng.normal(size=(700, width)) * np.linspace(5, 0.2, width)
    v = np.cov(rows.T, bias=True)
    calls = []
    values, vectors, residual = whitening.lobpcg(lambda b: calls.append(b.shape) or v @ b, width, wanted)
    want, turn = np.linalg.eigh(v)
    assert np.allclose(values, want[::-1][:wanted], rtol=1e-10) and residual <= whitening.ACCEPTED
    assert np.allclose(np.abs((vectors * turn[:, ::-1][:, :wanted]).sum(axis=0)), 1, atol=1e-10)
    assert all(m <= 2 * (wanted + whitening.GUARD) for _, m in calls)


def test_lobpcg_of_tied_values_and_low_rank():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    v = (q * np.repeat([9.0, 4.0, 1.0, 0.0], 15)) @ q.T
    values, vectors, _ = whitening.lobpcg(lambda b: v @ b, 60, 20)
    assert np.allclose(values, [9.0] * 15 + [4.0] * 5, rtol=1e-11)
    assert np.allclose(vectors.T @ vectors, np.eye(20), atol=1e-12) and np.allclose(v @ vectors, vectors * values, atol=1e-9)


def test_whiten(spark):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))).astype("float32").tolist()
    good = [*base, *base[:40], *base[:1] * 100]
    data = [(i if i % 9 else None, v, "x") for i, v in enumerate(good)]
    bad = [(1, None, ""), (2, [1.0, None, 1.0, 1.0, 1.0, 1.0], ""), (3, [float("nan")] * 6, ""), (4, [float("inf")] * 6, ""), (5, [1.0], ""), (6, [], "")]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>, whitened string").repartition(4)
    rows, found = whitening.whiten(df, components=4)
    x, n, sums, centred, values, turn = reference(good)
    assert found.n == n and np.array_equal(found.sums, sums)
    assert np.allclose(found.values, values[:4], rtol=1e-12) and np.isclose(found.trace, values.sum(), rtol=1e-12)
    assert found.identity_error < 1e-9
    sign = np.sign((found.vectors * turn[:, :4]).sum(axis=0))
    want = centred @ turn[:, :4] * sign / np.sqrt(values[:4])
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.deviation, *r.whitened) for r in rows.collect()))
    exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    expected = sorted((i is None, i or 0, int(d), *w) for (i, _, _), d, w in zip(data, exact, want.tolist(), strict=True))
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert np.allclose([g[3:] for g in got], [e[3:] for e in expected], atol=1e-9)


def test_few_rows_and_none(spark, tmp_path):
    schema = "vec_id long, embedding array<double>"
    for name, data, count in (("none", [], 0), ("one", [(1, [1.0, 2.0])], 0), ("equal", [(i, [1.0, 2.0]) for i in range(5)], 0), ("line", [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], 5), ("null", [(1, None)], 0)):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        out = whitening.op12_whitening(spark, f"{tmp_path}/{name}").collect()
        assert len(out) == count
    assert all(r.component == 1 and np.isclose(r.explained, 1) and r.identity_error < 1e-9 for r in whitening.op12_whitening(spark, f"{tmp_path}/line").collect())
    rows, _ = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema))
    assert [tuple(r) for r in rows.collect()] == [(1, 0, [])]


def test_deviations_are_exact():
    found = whitening.Whitening(3, 2, np.array([2**40, 5]), np.zeros(0), np.zeros((2, 0)), 1.0)
    x = np.array([[2**39, -7], [3, 2**20]])
    with pytest.raises(OverflowError):
        found.deviations(x)
    small = whitening.Whitening(10**6, 2, np.array([10**12, 0]), np.zeros(0), np.zeros((2, 0)), 1.0)
    assert small.deviations(np.array([[10**6 + 1000, 2000]])).tolist() == [10**18 + 4 * 10**18]
