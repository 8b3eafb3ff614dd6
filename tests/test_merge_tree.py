"""Saddles, feature findings, drainage lines and blocks against plain loops on small fields."""

import random

import pytest
from pyspark.sql import functions as F

from fieldweave.functions.lineage import cut
from fieldweave.operators import graph, hydro, merge_tree

NEAR = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def islands(z, level):
    """The 8-connected islands of cells above a level."""
    left = {c for c, h in z.items() if h >= level}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            seen.add((r, c))
            for a, b in NEAR:
                if (r + a, c + b) in left:
                    left.discard((r + a, c + b))
                    todo.append((r + a, c + b))
        yield seen


def by_levels(z, patches, stops):
    """{label: saddle} by trying every height of the field as a level."""
    out = {}
    for label, cells in patches.items():
        top = max(sorted(cells), key=lambda c: z[c])
        others = {c for k, x in patches.items() if k != label for c in x} | stops
        near = {(r + a, c + b) for r, c in others for a, b in NEAR}
        for level in sorted({h for h in z.values() if h <= z[top]}, reverse=True):
            if any(top in i and i & near for i in islands(z, level)):
                out[label] = level
                break
    return out


@pytest.mark.parametrize(("tile", "step", "high"), [(64, 8, True), (4, 2, True), (3, 2, False)])
def test_saddles(spark, monkeypatch, tile, step, high):
    monkeypatch.setattr(merge_tree, "TILE", tile)
    monkeypatch.setattr(merge_tree, "STEP", step)
    r = random.Random(tile)
    rows, patch, want, stops = [], [], {}, []
    for ds in range(4):
        z = {(a, b): r.choice([r.random(), 0.5, 0.25]) for a in range(-9, 10) for b in range(-4, 16) if r.random() < 0.85}
        if ds == 3:  # two parts that no path joins
            z = {c: h for c, h in z.items() if c[1] not in (5, 6)}
        seeds = r.sample(sorted(z), 5 if ds else 1)
        marks = {2**61 + 10 * i + ds: {c for c in z if max(abs(c[0] - s[0]), abs(c[1] - s[1])) <= 1 and not any(max(abs(c[0] - t[0]), abs(c[1] - t[1])) <= 3 for t in seeds[:i])} for i, s in enumerate(seeds)}
        marks = {k: v for k, v in marks.items() if v}
        other = {c for c in r.sample(sorted(z), 4) if not any(c in v for v in marks.values())} if ds == 2 else set()
        rows += [(ds, *c, h) for c, h in z.items()]
        patch += [(ds, *c, k) for k, v in marks.items() for c in v]
        stops += [(ds, *c) for c in other]
        up = {c: h if high else -h for c, h in z.items()}
        want |= {(ds, k): (h if high else -h) for k, h in by_levels(up, marks, other).items()}
    cells = spark.createDataFrame(rows, "ds long, row long, col long, z double")
    got = merge_tree.saddles(cells, spark.createDataFrame(patch, "ds long, row long, col long, label long"), spark.createDataFrame(stops, "ds long, row long, col long"), high)
    assert {(r.ds, r.label): r.level for r in got.collect()} == want


def test_drainage_lines(spark):
    r = random.Random(4)
    codes, acc, to = [], [], {}
    for a in range(12):
        for b in range(12):
            code = r.choice([0, 1, 2])  # east, south-east, south: no cycle
            dr, dc = hydro.D8[code]
            out = a + dr > 11 or b + dc > 11
            codes.append((1, a, b, -1 if out else code))
            acc.append((1, a, b, 1.0))
            to[a, b] = None if out else (a + dr, b + dc)
    heads = sorted(set(to) - set(to.values()))

    def path(c):
        out = [c]
        while to[out[-1]]:
            out.append(to[out[-1]])
        return out

    done, want = set(), {}
    for h in sorted(heads, key=lambda h: -len(path(h))):
        for k, c in enumerate(path(h)):
            if c in done:
                break
            done.add(c)
            if to[c]:
                want[c] = (h, k)
    df = lambda rows, c: spark.createDataFrame(rows, f"ds long, row long, col long, {c}")
    got = hydro.channel_lines(df(codes, "code int"), df(acc, "acc double"), 2.0, 0.0).withColumn("of", F.col("line")).collect()
    number = {(r * 2**31 + c + 2**30 * (2**31 + 1)): (r, c) for r, c in heads}
    assert {(r.row, r.col): (number[r.line], r.k) for r in got} == want
    for line in {r.line for r in got}:
        own = [r for r in got if r.line == line]
        assert own[0].line_m == pytest.approx(sum(2 * ((r.row - r.row2) ** 2 + (r.col - r.col2) ** 2) ** 0.5 for r in own))


def test_blocks_and_findings(spark):
    square = lambda ds, r0, c0, n: [(ds, r, c) for r in range(r0, r0 + n) for c in range(c0, c0 + n)]
    cells = spark.createDataFrame(square(1, 0, 0, 20) + square(1, 0, 40, 10) + square(1, 50, 0, 2) + square(2, 0, 0, 5) + square(3, 0, 0, 20) + square(3, 30, 30, 5), "ds long, row long, col long")
    got = {r.ds: r for r in merge_tree.blocks(cells, 10.0).collect()}
    assert (got[1].blocks, got[1].largest_ha, got[1].second_ha, got[1].separate) == (2, 4.0, 1.0, True)
    assert got[1].apart_m == pytest.approx(((100 - 450) ** 2 + (100 - 50) ** 2) ** 0.5)
    assert (got[2].second_ha, got[2].separate, got[3].separate) == (None, False, False)
    sizes = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 30.0)], "ds long, cell double")
    assert {r.ds: r.separate for r in merge_tree.blocks(cells, sizes).collect()} == {1: True, 2: False, 3: True}
    found = spark.createDataFrame([(1, "hill", k, 5.0 - k) for k in range(1, 5)] + [(1, "valley", 1, 2.0)], "ds long, shape string, rank int, height_m double")
    offsets = spark.createDataFrame([(1, 0, 0.5), (1, 1, -0.5), (2, 0, 0.1), (2, 1, -0.1)], "ds long, pass_id long, offset double")
    rows = {(r.ds, r.code, r["rank"]): r.metric for r in merge_tree.feature_findings(found, cells, offsets, most=3).collect()}
    assert rows == {(1, "hill", 1): 4.0, (1, "hill", 2): 3.0, (1, "hill", 3): 2.0, (1, "valley", 1): 2.0, (1, "more_hills", None): 1.0, (2, "no_features", None): 0.0, (3, "no_features", None): 0.0, (1, "pass_offsets", None): 0.5}


def test_rings_cross_holes(spark):
    """The ring walk goes on beyond a row without cells, as far as the ground falls."""
    cells = spark.createDataFrame([(1, r, c, 100.0 - max(abs(r), abs(c))) for r in range(-6, 7) for c in range(-6, 7) if r != 3], "ds long, row long, col long, z double")
    patch = spark.createDataFrame([(1, 0, 0, 7)], "ds long, row long, col long, label long")
    level = graph.grow_rings(patch, cut(cells)).first().level
    assert level == 94.0


def test_hull_and_direction_of_many_points(spark):
    """All points of logs of any shape, against hull edges found by trying every pair."""
    import math

    from fieldweave.operators import design

    r = random.Random(8)
    rows = []
    for ds, turn in ((1, 0.3), (2, 1.9), (3, 0.0)):
        for _ in range(300):
            u, v = r.uniform(0, 90), r.uniform(0, 40)
            rows.append((ds, u * math.cos(turn) - v * math.sin(turn), u * math.sin(turn) + v * math.cos(turn)))
        rows += rows[-5:]
    rows += [(4, 1.0, 1.0), (4, 3.0, 3.0), (4, 2.0, 2.0), (5, 7.0, 7.0), (6, None, 1.0)] + [(7, float(a), float(b)) for a in range(5) for b in range(3)]
    df = spark.createDataFrame(rows, "ds long, x double, y double").repartition(6)
    corners = {}
    for row in design.hull(df).orderBy("ds", "k").collect():
        corners.setdefault(row.ds, []).append((row.x, row.y))
    left = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    for ds in (1, 2, 3, 7):
        p = sorted({(x, y) for d, x, y in rows if d == ds})
        edges = {(a, b) for a in p for b in p if a != b and all(left(a, b, q) > 0 or (left(a, b, q) == 0 and min(a, b) <= q <= max(a, b)) for q in p)}
        c = corners[ds]
        assert set(zip(c, c[1:] + c[:1])) == edges
    assert corners[4] == [(1.0, 1.0), (3.0, 3.0)] and corners[5] == [(7.0, 7.0)] and 6 not in corners
    got = {row.ds: row for row in design.direction(df).collect()}
    assert got[7].angle == 0 and (got[7].long_m, got[7].short_m) == (4.0, 2.0)
    assert abs(got[1].angle - math.degrees(0.3)) < 3 and abs(got[2].angle - math.degrees(1.9)) < 3
    assert got[4].angle == pytest.approx(45) and 5 not in got
