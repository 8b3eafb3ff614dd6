"""Spectrum slicing against numpy's eigenvalues; whitening against exact integers."""

import math

import numpy as np
import pytest

from fieldweave.llm import whitening as W


def brute(rows, components=32):
    """{vec_id: [(deviation, [|whitened|], explained)]} of (vec_id, vector) rows."""
    ok = [(i, v) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v in ok]
    size = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    ok = [(i, v) for i, v in ok if len(v) == size]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in ok], object)
    n, s = len(ok), x.sum(axis=0)
    far = n * x - s
    v = ((far.T @ far) / n**3).astype(float)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    with np.errstate(all="ignore"):
        white = (far / n).astype(float) @ axes / np.sqrt(values)
    return ok, n, (far**2).sum(axis=1).tolist(), np.abs(white), values / v.trace() if v.trace() else values


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return (df.selectExpr("*", "1 AS n", "2D AS whitened", "'x' AS component") if extra else df).repartition(4)


def test_components_equal_brute_force(spark):
    r = np.random.default_rng(5)
    mix = r.standard_normal((40, 40))
    rows = [(i, [float(np.float32(x)) for x in r.standard_normal(40) @ mix]) for i in range(300)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (7, rows[5][1]), (400, None), (401, [None] * 40), (402, [*rows[0][1][:39], None]), (403, [*rows[0][1][:39], math.nan]), (404, [*rows[0][1][:39], -math.inf]), (405, []), (406, [1.0] * 39), (407, [99.0] * 40)]
    ok, n, deviation, white, explained = brute(rows)
    got = W.whiten(table(spark, rows, extra=True)).collect()
    assert len(got) == len(ok) * 32
    assert {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    want = sorted((i is None, i or 0, k, d, round(float(w[k]), 6), round(float(explained[k]), 9)) for (i, _), d, w in zip(ok, deviation, white) for k in range(32))
    have = sorted((r.vec_id is None, r.vec_id or 0, r.component - 1, r.deviation, round(abs(r.whitened), 6), round(r.explained, 9)) for r in got)
    for a, b in zip(have, want):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], abs=3e-6)


def test_odd_tables(spark):
    assert W.whiten(table(spark, [])).collect() == []
    assert W.whiten(table(spark, [(1, None), (2, [math.nan])])).collect() == []
    one = W.whiten(table(spark, [(1, [0.5, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    flat = W.whiten(table(spark, [(k, [float(k), 1.0, float(k)]) for k in range(10)])).collect()  # rank one
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True), (3, True)}
    assert flat[0].identity_error < 1e-9
    huge = W.whiten(table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    assert {r.deviation for r in huge} == {None}


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [3, 3, 3, 1, 0], [1 + 1e-9, 1, 1 - 1e-9, 1e-3, 0], [1e12, 1, 1e-3, 0, 0], list(range(60, 0, -1))])
def test_slices_find_all_eigenvalues(values):
    r = np.random.default_rng(2)
    q = np.linalg.qr(r.standard_normal((len(values), len(values))))[0]
    v = (q * np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    found, rows = W.leading(v, len(values))
    assert found == pytest.approx(np.array(values, float), abs=1e-12 * max(values) * len(values))
    assert rows @ rows.T == pytest.approx(np.eye(len(values)), abs=1e-6)
    assert np.abs(v @ rows.T - rows.T * found).max() < 1e-11 * max(values)
    for shift in (0.5, 2.5, -1.0):
        assert W.above(v, shift) == sum(x > shift for x in values)
