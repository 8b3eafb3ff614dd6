"""Derivatives, smoothing, hydrology and graphs against analytic surfaces and brute force."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldweave.operators import graph, grid, hydro


def surface(spark, f, rows=20, cols=20, skip=lambda r, c: False):
    data = [(1, r, c, float(f(r, c))) for r in range(rows) for c in range(cols) if not skip(r, c)]
    return spark.createDataFrame(data, "ds long, row long, col long, z double")


def test_plane(spark):
    p = surface(spark, lambda r, c: 100 + 0.05 * c * 5 - 0.02 * r * 5)  # rises 5 % east, 2 % north
    d = grid.derivatives(p, 5.0).where("row between 1 and 18 and col between 1 and 18").collect()
    assert all(x["slope_pct"] == pytest.approx(100 * math.hypot(0.05, 0.02)) for x in d)
    want = math.degrees(math.atan2(-0.05, -0.02)) % 360
    assert all(abs(x["aspect"] - want) < 1e-3 and abs(x["curvature"]) < 1e-9 for x in d)
    t = grid.plane_trend(p, 5.0).first()
    assert t["r2"] == pytest.approx(1) and t["gradient_pct"] == pytest.approx(100 * math.hypot(0.05, 0.02)) and abs(t["bearing"] - want) < 1e-3
    assert grid.residual_relief(p, 5.0).first()["relief_m"] == pytest.approx(0, abs=1e-9)
    s = grid.smooth(p, 1.0).join(p.withColumnRenamed("z", "z0"), ["ds", "row", "col"]).where("row between 4 and 15 and col between 4 and 15")
    assert s.where(F.abs(F.col("z") - F.col("z0")) > 1e-9).count() == 0
    pts = spark.createDataFrame([(1, 1, 33.3, -41.7)], "ds long, id long, x double, y double")
    assert grid.sample_bilinear(pts, p, 5.0).first()["z"] == pytest.approx(100 + 0.05 * (33.3 - 2.5) - 0.02 * (41.7 - 2.5))


def test_flat_ground(spark):
    d = grid.derivatives(surface(spark, lambda r, c: 7), 5.0)
    assert d.where("aspect is not null or slope_pct > 0 or profile <> 0 or sector <> -1").count() == 0
    assert grid.standardise(grid.tpi(surface(spark, lambda r, c: 7), 2)).where("tpi_std <> 0").count() == 0


@pytest.mark.parametrize("radius", [0.5, 1, 2.3, 4])
def test_disc_mean_with_holes(spark, radius):
    r = random.Random(2)
    cells = surface(spark, lambda a, b: r.random(), 12, 14, lambda a, b: (a * 7 + b) % 4 == 0)
    z = {(x["row"], x["col"]): x["z"] for x in cells.collect()}
    got = {(x["row"], x["col"]): x["mean"] for x in grid.disc_mean(cells, radius).collect()}
    for (a, b) in z:
        near = [v for (p, q), v in z.items() if ((p - a) ** 2 + (q - b) ** 2 <= radius * radius if radius >= 1 else abs(p - a) <= 1 and abs(q - b) <= 1)]
        assert got[(a, b)] == pytest.approx(sum(near) / len(near))


def brute_fill(z, eps=1e-9):
    edge = [k for k in z if any((k[0] + a, k[1] + b) not in z for a in (-1, 0, 1) for b in (-1, 0, 1))]
    level = {k: z[k] for k in edge}
    heap = [(v, k) for k, v in level.items()]
    heapq.heapify(heap)
    done = set()
    while heap:
        v, k = heapq.heappop(heap)
        if k in done:
            continue
        done.add(k)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                n = (k[0] + a, k[1] + b)
                if n in z and n not in done and max(z[n], v + eps) < level.get(n, math.inf):
                    level[n] = max(z[n], v + eps)
                    heapq.heappush(heap, (level[n], n))
    return level


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_fill_sinks(spark, tile):
    r = random.Random(9)
    cells = surface(spark, lambda a, b: r.random() * 3, 17, 15, lambda a, b: (a, b) == (8, 8))
    z = {(x["row"], x["col"]): x["z"] for x in cells.collect()}
    want = brute_fill(z)
    got = {(x["row"], x["col"]): x["filled"] for x in hydro.fill_sinks(cells, tile).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_bowl_volume_and_flow(spark):
    bowl = surface(spark, lambda r, c: 0.05 * ((r - 10) ** 2 + (c - 10) ** 2) if (r - 10) ** 2 + (c - 10) ** 2 <= 36 else 1.8 - 0.001 * r, 21, 21)
    f = hydro.fill_sinks(bowl, 8)
    b = hydro.basins(f, 5.0).collect()
    assert len(b) == 1 and (b[0]["row"], b[0]["col"]) == (10, 10) and abs(b[0]["max_depth"] - 1.78) < 0.03
    codes = hydro.d8(f, 5.0).checkpoint()
    acc = hydro.flow_accumulation(codes)
    total = acc.join(codes, ["ds", "row", "col"]).where("code = -1").agg(F.sum("acc")).first()[0]
    assert total == 21 * 21
    seg = hydro.channels(codes, acc, 5.0, 0.05)
    assert seg.where("acc < 20").count() == 0 and seg.where("head").count() >= 1


def test_components_of_a_snake(spark):
    snake = [(1, r, c) for r in range(0, 20, 2) for c in range(20)] + [(1, r, 19 if r % 4 == 1 else 0) for r in range(1, 19, 2)] + [(2, 0, 0), (2, 5, 5), (2, 6, 6)]
    got = graph.cell_components(spark.createDataFrame(snake, "ds long, row long, col long"))
    assert {(r["ds"], r["cells"]) for r in got.collect()} == {(1, len(snake) - 3), (2, 1), (2, 2)}


@pytest.mark.parametrize("tile", [128, 7, 2])
def test_components_are_the_same_however_cut(spark, tile):
    r = random.Random(tile)
    cells = {(ds, a, b) for ds in ("a", "b") for a in range(-20, 20) for b in range(-15, 15) if r.random() < 0.35}
    want, left = {}, set(cells)
    for first in sorted(cells):
        if first in left:
            island, open_ = [], [first]
            left.discard(first)
            while open_:
                ds, a, b = open_.pop()
                island.append((ds, a, b))
                near = {(ds, a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                open_ += near
            want |= {c: ((first[1] + 2**30) * 2**31 + first[2] + 2**30, len(island)) for c in island}
    df = spark.createDataFrame(sorted(cells), "ds string, row long, col long")
    for least in (1, 4):
        got = {(x["ds"], x["row"], x["col"]): (x["label"], x["cells"]) for x in graph.cell_components(df, least, tile=tile).collect()}
        assert got == {c: v for c, v in want.items() if v[1] >= least}


def test_rounds_follow_tiles_not_cells(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_ROUNDS", 2)
    field = spark.range(300 * 90).select(F.lit(1).alias("ds"), F.floor(F.col("id") / 300).alias("row"), (F.col("id") % 300).alias("col"))
    assert {(r["label"], r["cells"]) for r in graph.cell_components(field).select("label", "cells").distinct().collect()} == {(2**30 * 2**31 + 2**30, 27000)}


def test_contours_of_a_plane_are_straight(spark):
    p = surface(spark, lambda r, c: 0.3 * c + 0.01)
    s = grid.contour_segments(p, 1.0, 5.0).collect()
    assert len(s) == 19 * 5 and all(abs(x["x1"] - x["x2"]) < 1e-9 for x in s)
    assert {x["level"] for x in s if x["major"]} == {5.0}


def test_rings_stop_at_the_foot(spark):
    hill = surface(spark, lambda r, c: max(0.0, 5 - math.hypot(r - 10, c - 10)), 21, 21)
    top = hill.where("z > 4").withColumn("label", F.lit(1).cast("long"))
    assert graph.grow_rings(top, hill).first()["level"] == pytest.approx(0, abs=0.3)


def test_fill_values_and_steps(spark):
    pts = spark.createDataFrame([(1, i, 700.0 + i % 7) for i in range(60)] + [(1, 60, 0.0), (1, 61, -9999.0)], "ds long, seq long, elev_m double")
    assert grid.drop_fill_values(pts).count() == 60
    assert grid.value_step(pts.where("seq < 60")).first()["step"] == 1.0


def test_landform_table(spark):
    rows = [(2.0, 2.0, 1.0, 1), (0.0, 2.0, 1.0, 2), (-2.0, 2.0, 1.0, 2), (2.0, 0.0, 1.0, 2), (0.0, 0.0, 1.0, 4), (0.0, 0.0, 3.0, 3), (-2.0, 0.0, 3.0, 5), (2.0, -2.0, 1.0, 5), (-2.0, -2.0, 1.0, 6), (None, 0.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "s double, l double, p double, want int").withColumn("got", grid.landform(F.col("s"), F.col("l"), F.col("p")))
    assert df.where("got <> want").count() == 0


def test_pass_offsets_are_found(spark):
    from fieldweave.operators import relief

    r = random.Random(4)
    rows = [(1, p * 100 + k, p, p * 9.0, k * 3.0, 700 + 0.01 * k + (0.6 if p == 5 else 0.0) + r.gauss(0, 0.02)) for p in range(12) for k in range(60)]
    df = spark.createDataFrame(rows, "ds long, seq long, pass_id long, x double, y double, elev_m double")
    off = {x["pass_id"]: x["offset"] for x in relief.pass_offsets(df, 13.5).collect()}
    assert off[5] - sorted(off.values())[len(off) // 2] > 0.4
    assert 0.005 < relief.point_noise(df.where("pass_id <> 5")).first()["noise"] < 0.06
    spiky = df.withColumn("elev_m", F.when(F.col("seq") == 333, 720.0).otherwise(F.col("elev_m")))
    assert 333 in {x["id"] for x in relief.altitude_spikes(spiky).collect()}


def test_saddle_between_two_hills(spark):
    from fieldweave.operators import relief

    two = surface(spark, lambda r, c: max(5 - abs(c - 5), 6 - abs(c - 14), 0.0) - 0.01 * abs(r - 5), 11, 20)
    top = spark.createDataFrame([(1, 1, 5, 5)], "ds long, label long, row long, col long")
    stop = spark.createDataFrame([(1, 5, 14)], "ds long, row long, col long")
    assert relief.saddle_level(top, two, stop, 6).first()["level"] == pytest.approx(1.0, abs=0.01)


def test_hill_features(spark):
    from fieldweave.operators import relief

    hill = surface(spark, lambda r, c: max(0.0, 5 - math.hypot(r - 10, c - 10)), 21, 21)
    s = grid.derivatives(hill, 5.0).select("ds", "row", "col", "z", "slope_pct").join(grid.standardise(grid.tpi(hill, 4)), ["ds", "row", "col"])
    f = relief.features(s, 5.0).collect()
    assert len(f) == 1 and (f[0]["row"], f[0]["col"]) == (10, 10) and abs(f[0]["height_m"] - 5) < 0.5 and f[0]["elongation"] < 1.2


def test_a_long_flank_is_followed_to_its_foot(spark):
    # a ridge of three rows that falls for 58 cells on either side, then rises again
    z = lambda c: 100.0 - min(abs(c - 65), 58) + max(0, abs(c - 65) - 60)
    cells = spark.createDataFrame([(1, r, c, z(c)) for r in range(3) for c in range(131)], "ds long, row long, col long, z double")
    feature = cells.where("col between 64 and 66").select("ds", F.lit(7).alias("label"), "row", "col")
    assert [tuple(r) for r in graph.grow_rings(feature, cells).collect()] == [(1, 7, 42.0)]


def test_a_flood_over_many_tiles_is_that_of_one(spark):
    cells = surface(spark, lambda a, b: ((a * 7919 + b * 104729) % 997) / 300, 40, 33).withColumn("source", (F.col("row") == 0) & (F.col("col") == 0))
    one = {(x["row"], x["col"]): x["level"] for x in graph.minimax(cells, 64).collect()}
    for tile in (5, 16):
        many = {(x["row"], x["col"]): x["level"] for x in graph.minimax(cells, tile).collect()}
        assert many == one and len(one) == 40 * 33
