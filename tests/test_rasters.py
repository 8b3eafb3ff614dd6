"""Rasters of any reference system against plain loops and planes."""

import math

import pytest
from pyspark.sql import functions as F

from fieldweave.sources import rasters

META = "ds string, epsg int, unit int, a double, b double, c double, d double, e double, f double, rows long, cols long, bands int, dtype string, nodata double"
CELL = "ds string, row long, col long, z double"


def described(ds, epsg, a, e, c, f, rows, cols, unit=None, b=0.0, d=0.0, bands=1, dtype="float32", nodata=None):
    return (ds, epsg, unit, a, b, c, d, e, f, rows, cols, bands, dtype, nodata)


def heights(ds, rows, cols, z):
    return [(ds, r, k, z(r, k)) for r in range(rows) for k in range(cols)]


def bilinear(z, u, v):
    """The mean of the readings about a place, weighed by nearness."""
    r, k = math.floor(v - 0.5), math.floor(u - 0.5)
    fv, fu = v - 0.5 - r, u - 0.5 - k
    own = [((fv if i else 1 - fv) * (fu if j else 1 - fu), z.get((r + i, k + j))) for i in (0, 1) for j in (0, 1)]
    own = [(w, x) for w, x in own if x is not None]
    total = sum(w for w, _ in own)
    return sum(w * x for w, x in own) / total if total > 1e-6 else None


def test_units_of_reference_systems(spark):
    meta = spark.createDataFrame([described("utm", 32613, 5.0, -5.0, 0.0, 100.0, 4, 4), described("feet", 2232, 10.0, -10.0, 0.0, 100.0, 4, 4, unit=9003), described("deg", 4326, 1e-3, -1e-3, -105.0, 60.002, 4, 4), described("web", 3857, 10.0, -10.0, 0.0, rasters.crs.A * math.asinh(math.tan(math.radians(60))) + 20, 4, 4), described("none", None, 1.0, -1.0, 0.0, 0.0, 4, 4)], META)
    g = {r["ds"]: r for r in rasters.ground(meta).collect()}
    assert g["utm"]["metric"] and g["utm"]["reason"] is None and g["utm"]["cell_x_m"] == 5
    assert not g["feet"]["metric"] and g["feet"]["cell_y_m"] == pytest.approx(10 * 1200 / 3937)
    assert g["deg"]["cell_x_m"] == pytest.approx(55.66) and g["deg"]["cell_y_m"] == pytest.approx(111.32) and g["deg"]["reason"] == "degrees"
    assert g["web"]["cell_x_m"] == pytest.approx(5.0) and g["web"]["kind"] == "mercator" and not g["none"]["metric"]


def test_refused_rasters(spark):
    meta = spark.createDataFrame([
        described("ok", 32613, 5.0, -5.0, 0.0, 100.0, 1, 2), described("photo", 32613, 5.0, -5.0, 0.0, 100.0, 1, 1, bands=3, dtype="uint8"), described("lost", None, 5.0, -5.0, 0.0, 100.0, 1, 1),
        described("flat", 32613, 0.0, -5.0, 0.0, 100.0, 1, 1), described("void", 32613, 5.0, -5.0, 0.0, 100.0, 1, 2, nodata=7.0), described("empty", 32613, 5.0, -5.0, 0.0, 100.0, 0, 0),
    ], META)
    cells = spark.createDataFrame([("ok", 0, 0, 1.0), ("ok", 0, 1, None), ("photo", 0, 0, 1.0), ("lost", 0, 0, 1.0), ("flat", 0, 0, 1.0), ("void", 0, 0, 7.0), ("void", 0, 1, float("nan")), ("orphan", 0, 0, 1.0)], CELL)
    why = {r["ds"]: r["reason"] for r in rasters.refusals(meta, cells).collect()}
    assert why == {"photo": "an image, not heights", "lost": "no reference system", "flat": "cells without an area", "void": "no cell with a height", "empty": "no cell with a height", "orphan": "no description"}
    _, out = rasters.regrid(cells, meta)
    assert [tuple(r) for r in out.collect()] == [("ok", 0, 0, 1.0)]
    assert rasters.regrid(cells.limit(0), meta)[1].count() == 0
    with pytest.raises(ValueError):
        rasters.grids(meta, target=0)


def test_bilinear_against_a_loop(spark):
    z = {(r, k): math.sin(r) + 0.3 * k * k for r in range(9) for k in range(7) if (r, k) not in ((0, 0), (4, 4), (4, 5), (5, 4), (5, 5))}
    meta = spark.createDataFrame([described("t", 32613, 8.0, -8.0, 1000.3, 2000.7, 9, 7, b=3.0, d=3.0)], META)
    cells = spark.createDataFrame([("t", r, k, v) for (r, k), v in z.items()], CELL)
    grids, out = rasters.regrid(cells, meta, target=4.0)
    g = grids.collect()[0]
    got = {(r["row"], r["col"]): r["z"] for r in out.collect()}
    want = {}
    for r in range(g["rows_out"]):
        for k in range(g["cols_out"]):
            x, y = g["x0"] + (k + 0.5) * 4 - 1000.3, g["y0"] - (r + 0.5) * 4 - 2000.7
            det = 8 * -8 - 3 * 3
            u, v = (-8 * x - 3 * y) / det, (8 * y - 3 * x) / det
            h = bilinear(z, u, v) if 0 <= u <= 7 and 0 <= v <= 9 else None
            if h is not None:
                want[r, k] = h
    assert g["method"] == "bilinear" and g["x0"] % 4 == 0 and g["y0"] % 4 == 0
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_degrees_and_map_metres_keep_a_plane(spark):
    """A slope laid over ground metres is the same slope after regridding, whatever system the raster came in."""
    A, lat0, lon0 = rasters.crs.A, 50.45, -104.6
    my = A * math.asinh(math.tan(math.radians(lat0)))
    meta = spark.createDataFrame([described("deg", 4326, 1e-4, -1e-4, lon0, lat0, 30, 40), described("web", 3857, 11.0, -11.0, A * math.radians(lon0), my, 30, 40)], META)
    place = spark.createDataFrame(heights("deg", 30, 40, lambda r, k: 0.0) + heights("web", 30, 40, lambda r, k: 0.0), CELL)
    frame = rasters.grids(meta).select("ds", "kind", "epsg_out", "unit_m", "a", "b", "c", "d", "e", "f", "x0", "y0", "cell", "cell_in", "method")
    at = rasters.outward(place.join(frame, "ds"), F.col("col") + 0.5, F.col("row") + 0.5)
    slope = lambda x, y: 0.02 * (x - 500_000) - 0.03 * (y - 5_500_000)
    cells = at.select("ds", "row", "col", slope(F.col("X"), F.col("Y")).alias("z"))
    grids, out = rasters.regrid(cells, meta)
    g = {r["ds"]: r for r in grids.collect()}
    assert all(r["epsg_out"] == 32613 and r["method"] == "bilinear" for r in g.values()) and g["web"]["cell_in"] == pytest.approx(11 * math.cos(math.radians(lat0)), rel=1e-3)
    n = 0
    for r in out.collect():
        o = g[r["ds"]]
        want = slope(o["x0"] + (r["col"] + 0.5) * o["cell"], o["y0"] - (r["row"] + 0.5) * o["cell"])
        # half a cell within the rim the readings on one side alone decide
        if 2 <= r["row"] < o["rows_out"] - 2 and 2 <= r["col"] < o["cols_out"] - 2:
            assert r["z"] == pytest.approx(want, abs=0.02)
            n += 1
    assert n > 1000


def test_a_large_raster_is_coarsened_by_means(spark):
    meta = spark.createDataFrame([described("t", 32613, 5.0, -5.0, 1000.0, 2000.0, 20, 20)], META)
    cells = spark.createDataFrame(heights("t", 20, 20, lambda r, k: float(r * 20 + k)), CELL)
    grids, out = rasters.regrid(cells, meta, most=200)
    g, got = grids.collect()[0], {(r["row"], r["col"]): r["z"] for r in out.collect()}
    assert g["coarsened"] and g["cell"] == 10.0 and g["method"] == "average" and len(got) == 100
    assert got[0, 0] == (0 + 1 + 20 + 21) / 4
    native = rasters.regrid(cells, meta)[1]
    assert native.exceptAll(cells).count() == 0 and native.count() == 400
