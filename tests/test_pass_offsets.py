"""Offsets of passes against plain loops, and against the offsets that were put in."""

import random

import numpy as np
from pyspark.sql import functions as F

from fieldweave.operators import passes, relief


def field(ds, passes, seed, length=14):
    r = random.Random(seed)
    put = {p: r.choice([-0.4, 0.0, 0.3]) for p in range(passes)}
    return put, [(ds, p * length + k, p * 9.0, k * 4.0, p, 700 + 0.01 * p * 9 + 0.02 * k * 4 + put[p] + r.gauss(0, 0.02)) for p in range(passes) for k in range(length)]


def by_loops(rows, radius, rounds=3):
    ids = sorted({r[4] for r in rows})
    near = [[s for s in rows if s[4] != r[4] and (s[2] - r[2]) ** 2 + (s[3] - r[3]) ** 2 <= radius**2] for r in rows]
    even = [bool(n) and np.hypot(np.mean([s[2] for s in n]) - r[2], np.mean([s[3] for s in n]) - r[3]) < 0.3 * radius for r, n in zip(rows, near)]
    a = np.eye(len(ids))
    for p in ids:
        own = [n for r, n, e in zip(rows, near, even) if e and r[4] == p]
        for n in own:
            for s in n:
                a[p, s[4]] -= 1 / len(n) / len(own)
    use = [p for p in ids if any(e and r[4] == p for r, e in zip(rows, even))]
    a, off, lam = a[use], np.zeros(len(ids)), None
    for _ in range(rounds):
        q = {p: [] for p in use}
        for r, n, e in zip(rows, near, even):
            if e:
                q[r[4]].append(r[5] - off[r[4]] - np.mean([s[5] - off[s[4]] for s in n]))
        b = np.array([np.median(q[p]) for p in use])
        if lam is None:  # the two variances by EM, with the posterior covariance itself
            so, se = max(np.var(b), 1e-8), 0.1 * max(np.var(b), 1e-8)
            for _ in range(30):
                cov = np.linalg.inv(a.T @ a / se + np.eye(len(ids)) / so)
                mean = cov @ a.T @ b / se
                so, se = (mean @ mean + np.trace(cov)) / len(ids), (((b - a @ mean) ** 2).sum() + np.trace(a @ cov @ a.T)) / len(b)
            lam = min(max(se / so, 1e-4), 10)
        step = np.linalg.solve(a.T @ a + lam * np.eye(len(ids)), a.T @ b)
        off = off + step - step.mean()  # passes of one length
    return dict(zip(ids, off))


def test_offsets(spark, monkeypatch):
    put, one = field(1, 50, 3)
    _, two = field(2, 9, 4)
    _, many = field(3, 60, 5)
    alone = [(4, k, 0.0, k * 4.0, 0, 700.0) for k in range(5)]
    apart = [(5, k, (k % 2) * 900.0, k * 4.0, k % 2, 700.0) for k in range(6)]
    monkeypatch.setattr(relief, "MAX_PASSES", 50)
    df = spark.createDataFrame(one + two + many + alone + apart, "ds long, seq long, x double, y double, pass_id long, elev_m double")
    got = {}
    for r in relief.pass_offsets(df, 13.5).collect():
        got.setdefault(r.ds, {})[r.pass_id] = r.offset
    assert set(got) == {1, 2, 5}  # too many passes, and only one, have no offsets
    assert set(got[5].values()) == {0.0}
    for ds, rows in ((1, one), (2, two)):
        want = by_loops(rows, 13.5)
        assert max(abs(got[ds][p] - want[p]) for p in want) < 1e-6
    # the jumps from pass to pass are found, up to what a tilt of the ground explains
    jumps = [(got[1][p + 1] - got[1][p]) - (put[p + 1] - put[p]) for p in range(2, 47)]
    assert np.std(jumps) < 0.1 < np.std([put[p + 1] - put[p] for p in range(2, 47)])
    flat = relief.detrend_passes(df, 13.5)
    assert flat.count() == df.count()
    same = flat.join(df.select("ds", "seq", F.col("elev_m").alias("was")), ["ds", "seq"]).where("ds in (3, 4) and elev_m <> was")
    assert same.count() == 0


def test_long_fields_are_solved_block_by_block(spark, monkeypatch):
    put, one = field(1, 50, 3)
    df = spark.createDataFrame(one + field(2, 9, 4)[1], "ds long, seq long, x double, y double, pass_id long, elev_m double")
    monkeypatch.setattr(relief, "DENSE_PASSES", 10)
    got = {(r.ds, r.pass_id): r.offset for r in relief.pass_offsets(df, 13.5).collect()}
    want = by_loops(one, 13.5)
    assert len(got) == 59 and max(abs(got[1, p] - want[p]) for p in want) < 1e-6


def test_no_field_has_too_many_passes(spark):
    put, rows = field(7, 2100, 6, length=2)
    df = spark.createDataFrame(rows, "ds long, seq long, x double, y double, pass_id long, elev_m double")
    got = {r.pass_id: r.offset for r in relief.pass_offsets(df, 13.5).collect()}
    assert len(got) == 2100
    jumps = [(got[p + 1] - got[p]) - (put[p + 1] - put[p]) for p in range(2, 2097)]
    assert np.std(jumps) < 0.15 < np.std([put[p + 1] - put[p] for p in range(2, 2097)])


def test_blocks_equal_a_dense_matrix():
    r = np.random.default_rng(2)
    for n, hub, gap in ((90, False, False), (300, True, False), (120, False, True)):
        beside = {p: {q for q in (p - 1, p + 1, p + int(r.integers(2, 6))) if 0 <= q < n} for p in range(n)}
        if hub:  # a headland: one pass lies beside most others
            beside = {p: near | {0} - {p} for p, near in beside.items()} | {0: set(range(1, n, 2))}
        if gap:  # parts that nothing joins, and passes without evidence
            beside = {p: {q for q in near if q // 30 == p // 30} for p, near in beside.items() if p % 9}
        i, j = (np.array(k) for k in zip(*[(p, q) for p, near in beside.items() for q in sorted(near)]))
        w, used = r.random(len(i)) / 4, np.unique(i)
        a, b = np.eye(n), r.normal(size=len(used))
        a[i, j] -= w
        a = a[used]
        solve = passes.system(n, used, i, j, w, b)
        for lam in (1e-4, 0.3, 10.0):
            x, left, trace = solve(lam)
            inverse = np.linalg.inv(a.T @ a + lam * np.eye(n))
            assert np.allclose(x, inverse @ a.T @ b, atol=1e-8) and np.allclose(left, b - a @ x, atol=1e-8)
            assert abs(trace / np.trace(inverse) - 1) < 1e-8
        assert abs(relief._ridge_by_blocks(solve, b) / relief._ridge(a.T @ a, a.T @ b, b) - 1) < 1e-6
