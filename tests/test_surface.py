"""Each field on its own cells: geometry, gaps, the edge band, tables in place of one cell size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.operators import grid, hydro, relief, surface
from fieldweave.functions.lineage import cut
from fieldweave.plans import survey_queries


def passes(ds, swath, n, length, step, z, skip=()):
    return [(ds, float(p * swath), float(k * step), swath, p, float(z(p * swath, k * step))) for p in range(n) if p not in skip for k in range(length)]


@pytest.fixture(scope="module")
def fields(spark):
    plane = lambda x, y: 500 + 0.02 * x + 0.05 * y
    rows = passes(1, 9.0, 30, 60, 4.0, plane, skip=(12,)) + passes(2, 24.0, 12, 40, 7.0, plane, skip=(3, 4, 5, 6)) + passes(3, 9.0, 2, 3, 4.0, plane)
    rows += [(4, 0.0, 0.0, None, 0, 1.0), (4, 90_000.0, 40.0, -1.0, 0, 2.0), (5, None, 1.0, 9.0, 0, 3.0), (6, 1.0, 1.0, 9.0, 0, None)]
    return cut(spark.createDataFrame(rows, "ds long, x double, y double, swath_m double, pass_id long, elev_m double"))


def by_hand(x, y, swath, max_cells=surface.MAX_CELLS):
    cell, edge = round(max(5.0, swath / 2) * 2) / 2, swath / 2
    while True:
        x0, y0 = math.floor((min(x) - edge) / cell) * cell, math.ceil((max(y) + edge) / cell) * cell
        rows, cols = math.ceil((y0 - (min(y) - edge)) / cell), math.ceil((max(x) + edge - x0) / cell)
        if max(rows, 1) * max(cols, 1) <= max_cells:
            return cell, x0, y0, rows, cols
        cell += 0.5


@pytest.mark.parametrize("most", [surface.MAX_CELLS, 500, 40])
def test_geometry_grows_until_it_fits(fields, most):
    got = {r.ds: r for r in surface.geometry(fields, max_cells=most).collect()}
    assert set(got) == {1, 2, 3, 4}  # fields without a reading have no grid
    for ds, swath in ((1, 9.0), (2, 24.0), (3, 9.0), (4, 10.0)):
        p = [(r.x, r.y) for r in fields.where(F.col("ds") == ds).collect()]
        r = got[ds]
        assert (r.cell, r.x0, r.y0, r.rows, r.cols) == by_hand(*zip(*p), swath, most)
        assert (r.swath_m, r.edge, r.gap) == (swath, swath / 2, max(1.5 * swath, 3 * r.cell))


def test_surface_of_a_plane_is_the_plane(fields):
    geo = cut(surface.geometry(fields))
    s = cut(surface.surface(fields, geo).join(geo.select("ds", "cell", "edge"), "ds"))
    off = F.col("z") - (500 + 0.02 * (F.col("col") + 0.5) * F.col("cell") + 0.05 * -(F.col("row") + 0.5) * F.col("cell"))
    # means of readings stand off the centre of a cell by half a cell's fall at most; gaps and the edge continue them
    assert s.where("kind = 'read' and ds < 4").where(F.abs(off) > 0.07 * F.col("cell") / 2 + 1e-9).count() == 0
    assert s.where("ds < 3").where(F.abs(off) > 0.07 * F.col("cell") * 4).count() == 0
    one = s.where("ds = 1")
    kinds = {r.kind: r.n for r in one.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds["edge"] > 0
    # the pass left out is bridged; four passes left out are wider than the gap and stay open
    assert one.where("col = cast(12 * 9 / 5 as int) and row = -20").count() == 1
    assert s.where("ds = 2 and kind <> 'edge' and col * cell > 4 * 24 and (col + 1) * cell < 6 * 24").count() == 0
    # the edge reaches half a swath beyond the outermost track, and no further
    far = one.where("kind = 'edge'").agg(F.max((F.col("col") + 0.5) * F.col("cell"))).first()[0]
    assert 29 * 9 < far <= 29 * 9 + 4.5


def test_one_job_equals_a_job_for_each_field(fields):
    both = fields.where("ds in (1, 2)")
    layers, geo = surface.analyse(both)
    layers, geo = cut(layers), cut(geo)
    for ds, size in ((1, 5.0), (2, 12.0)):
        own = cut(layers.where(F.col("ds") == ds))
        want = grid.derivatives(own.select("ds", "row", "col", "z"), size)
        j = own.join(want.select("ds", "row", "col", F.col("slope_pct").alias("w")), ["ds", "row", "col"])
        assert j.count() == own.count() and j.where("abs(slope_pct - w) > 1e-9").count() == 0
        cells = own.select("ds", "row", "col", "z")
        pairs = [
            (grid.plane_trend(layers, geo).where(F.col("ds") == ds), grid.plane_trend(cells, size)),
            (grid.residual_relief(layers, geo).where(F.col("ds") == ds), grid.residual_relief(cells, size)),
            (relief.terrain_summary(layers, geo).where(F.col("ds") == ds), relief.terrain_summary(own, size)),
            (grid.class_areas(layers, "landform", [1, 3], geo).where(F.col("ds") == ds), grid.class_areas(own, "landform", [1, 3], size)),
            (hydro.basins(layers.where("row % 3 = 0").selectExpr("ds", "row", "col", "z", "z as filled", "0.2 as depth"), geo).where(F.col("ds") == ds), hydro.basins(own.where("row % 3 = 0").selectExpr("ds", "row", "col", "z", "z as filled", "0.2 as depth"), size)),
            (grid.contour_segments(layers, 1.0, geo).where(F.col("ds") == ds), grid.contour_segments(cells, 1.0, size)),
        ]
        for a, b in pairs:
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_smoothing_differs_by_field(spark, fields):
    geo = cut(surface.geometry(fields.where("ds in (1, 2)")))
    cells = cut(surface.surface(fields.where("ds in (1, 2)"), geo).drop("kind"))
    sigma = spark.createDataFrame([(1, 0.0), (2, 1.5)], "ds long, sigma double")
    got = cut(grid.smooth(cells, sigma))
    one = got.where("ds = 1").join(cells.withColumnRenamed("z", "w"), ["ds", "row", "col"])
    assert one.where("z <> w").count() == 0 and one.count() == cells.where("ds = 1").count()
    two = got.where("ds = 2").join(grid.smooth(cells.where("ds = 2"), 1.5).withColumnRenamed("z", "w"), ["ds", "row", "col"])
    assert two.where("abs(z - w) > 1e-9").count() == 0


def test_tiles_do_not_show(spark, monkeypatch):
    """A surface is the same however it is cut into tiles, and its plan joins nothing by cell."""
    rows = [(1, 10.0 * p + 0.3 * (k % 3), 4.0 * k, 100 + 0.1 * p * p - 0.05 * k, 10.0) for p in range(9) for k in range(30) if p != 4 and not (p < 3 and 10 < k < 20)]
    pts = spark.createDataFrame(rows, "ds long, x double, y double, elev_m double, swath_m double")
    geo = surface.geometry(pts).localCheckpoint()
    got = []
    for tile in (128, 5):
        monkeypatch.setattr(surface, "TILE", tile)
        s = surface.surface(pts, geo)
        assert s._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the geometry
        got.append(sorted((r["row"], r["col"], round(r["z"], 9), r["kind"]) for r in s.collect()))
    assert got[0] == got[1] and {k for *_, k in got[0]} == {"read", "filled", "edge"}


def _ragged(spark):
    """Two fields with holes, steps in height and a stray cell far off."""
    rows = [(ds, r, c, 300 + ds + math.sin(r / 3) * 2 + (c * c % 17) * 0.1) for ds in (1, 2) for r in range(-20, 12) for c in range(5, 45) if (r * 5 + c * 11 + ds) % 7 > 1 and not (ds == 2 and 10 < c < 25 and r < 0)]
    return spark.createDataFrame(rows + [(2, 3, 160, 301.0)], "ds long, row long, col long, z double")


@pytest.mark.parametrize("radii", [(1.5, 8.25), (0.5, 3.0)])
def test_layers_of_a_field_equal_those_by_cell(spark, radii):
    cells = cut(_ragged(spark))
    got = {}
    for ds in (1, 2):
        mine = cells.where(F.col("ds") == ds).toPandas()
        for r, c, *v in zip(mine["row"], mine["col"], *surface._relief(mine["row"].to_numpy(), mine["col"].to_numpy(), mine["z"].to_numpy(), radii)):
            got[ds, r, c] = v
    d = {(x["ds"], x["row"], x["col"]): x["slope_pct"] for x in grid.derivatives(cells, 1.0).collect()}
    assert {k: math.hypot(*v[:2]) * 100 for k, v in got.items()} == pytest.approx(d, abs=1e-9)
    for i, radius in enumerate(radii):
        t = {(x["ds"], x["row"], x["col"]): x["tpi_std"] for x in grid.standardise(grid.tpi(cells, radius)).collect()}
        assert {k: v[2 + i] for k, v in got.items()} == pytest.approx(t, abs=1e-9)
    level = np.arange(12)
    assert all((v == 0).all() for v in surface._relief(level // 4, level % 4, np.full(12, 700.1), radii))


def test_cells_are_shuffled_once_for_all_layers(fields):
    """Nothing is sent from cell to cell: neither discs nor neighbours."""
    layers, _ = surface.analyse(fields.where("ds in (1, 2)"))
    plan = layers._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") <= 2  # cells and radii


def test_a_report_writes_what_it_reads(spark, monkeypatch):
    written = []
    monkeypatch.setattr(survey_queries, "cut", lambda df: (written.append(df.columns), cut(df))[1])
    assert survey_queries.QUERIES["ter_report"](spark, "/root/testdata/sf0.001").count() > 0
    assert written == [["ds", "x", "y", "swath_m", "elev_m"], ["ds", "z", "slope_pct", "landform"]]
