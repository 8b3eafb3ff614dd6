"""Rings about features: against plain loops, in few tables, and without a table that grows on the driver."""

import random

import numpy as np
import pytest

from fieldweave.operators import graph


def by_loops(z, patch, sign):
    """The level at which the rings stop falling, one ring after another."""
    level, k = None, 1
    rows, cols = [r for r, _ in z], [c for _, c in z]
    while True:
        far = lambda c: min(max(abs(c[0] - p[0]), abs(c[1] - p[1])) for p in patch)
        ring = [h for c, h in z.items() if c not in patch and far(c) == k]
        if not ring:
            return level
        now = sign * np.percentile([sign * h for h in ring], 75)
        if level is not None and not sign * now < sign * level:
            return level
        level, k = now, k + 1


def field(ds, seed):
    r = random.Random(seed)
    z = {(a, b): -0.3 * max(abs(a), abs(b)) * r.choice([1, 1, 1.2]) + r.random() * 0.2 for a in range(-20, 21) for b in range(-13, 14) if r.random() < 0.8}
    patches = {}
    for label in range(4):
        a, b = (0, 0) if label < 2 else r.choice(sorted(z))
        patches[2**60 + label] = {c for c in z if max(abs(c[0] - a), abs(c[1] - b)) <= label and (label < 2 or r.random() < 0.6)} or {min(z)}
    return z, patches


@pytest.mark.parametrize("sign", [1, -1])
def test_levels(spark, sign):
    cells, marks, want = [], [], {}
    for ds in (1, 2, 3):
        z, patches = field(ds, ds)
        cells += [(ds, *c, sign * h) for c, h in z.items()]
        marks += [(ds, label, *c) for label, p in patches.items() for c in p]
        want |= {(ds, label): level for label, p in patches.items() if (level := by_loops({c: sign * h for c, h in z.items()}, p, sign)) is not None}
    got = graph.grow_rings(spark.createDataFrame(marks, "ds long, label long, row long, col long"), spark.createDataFrame(cells, "ds long, row long, col long, z double"), sign > 0)
    assert {(r.ds, r.label): pytest.approx(r.level) for r in got.collect()} == want


def test_a_long_flank_takes_few_tables_and_no_broadcast(spark, monkeypatch):
    import contextlib
    import io

    plans = []

    def cut(df, f=graph.cut):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        plans.append(out.getvalue())
        return f(df)

    cells = spark.createDataFrame([(1, r, c, -1.0 * max(abs(r), abs(c))) for r in range(-24, 25) for c in range(-24, 25)], "ds long, row long, col long, z double")
    patch = spark.createDataFrame([(1, 0, 0, 7)], "ds long, row long, col long, label long")
    monkeypatch.setattr(graph, "cut", cut)
    assert graph.grow_rings(patch, cells).first().level == -24.0
    assert len(plans) <= 6
    assert not any("BroadcastHashJoin" in p for p in plans)
