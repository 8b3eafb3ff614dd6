"""Elevation rasters onto square cells of ground metres, many rasters in one job (SRC18, SRC20).

A raster is a row that describes it - (ds, epsg, unit, a, b, c, d, e, f, rows, cols, bands, dtype, nodata) - and
cells (ds, row, col, z), row 0 first.  The corner of cell (row, col) is at x = a*col + b*row + c,
y = d*col + e*row + f in the raster's reference system; unit is the code of its linear unit (null: metres).
A descriptor is unique by ds and a cell by (ds, row, col); cells of no descriptor go with the refused rasters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions import crs
from fieldweave.functions.lineage import cut
from fieldweave.sources.files import undeclared_nodata

# Codes of projected systems whose metre is not one on the ground; metres of a degree; most cells of a
# grid; metres of the linear units by code (metre, foot, US survey foot, Clarke's foot, kilometre).
PSEUDO_MERCATOR = (3857, 3785, 900913)
METRES_A_DEGREE = 111_320.0
MOST_CELLS = 4_000_000
UNITS = {9001: 1.0, 9002: 0.3048, 9003: 1200 / 3937, 9005: 0.3047972654, 9036: 1000.0}
#: Points between the corners of an edge, as its image in another system is curved.
DENSE = 21
#: From this many native cells on, a cell takes the mean of what falls into it.
AVERAGE_FROM = 1.5


def ground(meta: DataFrame) -> DataFrame:
    """SRC20: the descriptors with kind, unit_m, centre, cell_x_m, cell_y_m, metric and the reason where not.

    Kind is ``geographic`` (codes of 4000 to 4999), ``mercator`` or ``projected``.  Sizes are metres on the
    ground at the raster's centre: a degree of longitude shrinks with the latitude, as a pseudo-Mercator metre does.
    """
    code, c = F.col("epsg"), F.col
    kind = F.when(code.between(4000, 4999), "geographic").when(code.isin(*PSEUDO_MERCATOR), "mercator").when(code.isNotNull(), "projected")
    table = F.create_map(*[F.lit(v) for kv in UNITS.items() for v in kv])
    m = meta.withColumns({
        "kind": kind, "unit_m": F.coalesce(F.try_element_at(table, c("unit").cast("int")), F.lit(1.0)),
        "_x": c("a") * c("cols") / 2 + c("b") * c("rows") / 2 + c("c"), "_y": c("d") * c("cols") / 2 + c("e") * c("rows") / 2 + c("f"),
    })
    lon, lat = to_lonlat(c("_x"), c("_y"))
    m = m.withColumns({"lon_c": lon, "lat_c": lat})
    shrink = F.cos(F.radians("lat_c"))
    fx = F.when(c("kind") == "geographic", METRES_A_DEGREE * shrink).when(c("kind") == "mercator", shrink).otherwise(c("unit_m"))
    fy = F.when(c("kind") == "geographic", METRES_A_DEGREE).when(c("kind") == "mercator", shrink).otherwise(c("unit_m"))
    why = F.when(c("kind") == "geographic", "degrees").when(c("kind") == "mercator", "metres of the map, not of the ground").when(F.abs(c("unit_m") - 1) > 1e-9, "another unit than metres")
    return m.withColumns({
        "cell_x_m": F.hypot("a", "d") * fx, "cell_y_m": F.hypot("b", "e") * fy, "reason": why, "metric": c("kind").isNotNull() & why.isNull(),
    }).drop("_x", "_y")


def to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Position of a geographic or pseudo-Mercator raster's coordinates; null for another kind."""
    kind = F.col("kind")
    lon = F.when(kind == "geographic", x).when(kind == "mercator", F.degrees(x / crs.A))
    return lon, F.when(kind == "geographic", y).when(kind == "mercator", F.degrees(F.atan(F.sinh(y / crs.A))))


def refusals(meta: DataFrame, cells: DataFrame) -> DataFrame:
    """(ds, reason) of the rasters that cannot be placed or hold no heights."""
    has = valid(cells, meta).groupBy("ds").agg(F.count(F.lit(1)).alias("_n"))
    flat = F.col("a") * F.col("e") - F.col("b") * F.col("d")
    why = (
        F.when(F.coalesce("bands", F.lit(1)) < 1, "no band")
        .when((F.col("bands") >= 3) & (F.col("dtype") == "uint8"), "an image, not heights")
        .when(F.col("epsg").isNull(), "no reference system")
        .when(F.coalesce(flat, F.lit(0.0)) == 0, "cells without an area")
        .when(F.col("_n").isNull(), "no cell with a height")
    )
    known = meta.join(has, "ds", "left").select("ds", why.alias("reason")).where("reason is not null")
    lone = cells.select("ds").distinct().join(meta, "ds", "left_anti").select("ds", F.lit("no description").alias("reason"))
    return known.unionByName(lone)


def valid(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Cells with a height: neither null, NaN, infinite nor the fill value, declared or not (SRC17)."""
    c = cells.select("ds", "row", "col", F.col("z").cast("double").alias("z")).where("z is not null and not isnan(z) and abs(z) < double('Infinity')")
    fill = meta.select("ds", F.col("nodata").cast("double").alias("_said")).join(undeclared_nodata(c), "ds", "left")
    fill = fill.select("ds", F.coalesce("_said", "nodata").alias("_fill")).where("_fill is not null")
    return c.join(fill, "ds", "left").where("_fill is null or z <> _fill").drop("_fill")


def nice_cell(size: Column) -> Column:
    """A derived cell to tenths below 2 m, halves below 10, wholes below 50, fives from there."""
    step = F.when(size < 2, 0.1).when(size < 10, 0.5).when(size < 50, 1.0).otherwise(5.0)
    return F.greatest(step, F.floor(size / step + 0.5) * step)


def grids(meta: DataFrame, target: float | None = None, most: int = MOST_CELLS) -> DataFrame:
    """SRC18: for each raster that has a system, the grid it goes to.

    (ds, epsg_out, x0, y0, cell, rows_out, cols_out, method, coarsened) beside what ``ground`` gives.  Metric
    rasters keep their system; degrees and pseudo-Mercator go to the UTM zone of the centre; other units are
    scaled to metres within their own frame (epsg_out null), as their projection is not known here.
    The origin is a multiple of the cell, so grids of one cell line up; a grid of more than ``most`` cells is
    coarsened by a whole factor.  method: ``native`` (cells as they are), ``bilinear`` or ``average``.
    """
    if target is not None and not target > 0:
        raise ValueError("the target cell has to be a positive number of metres")
    c = F.col
    m = ground(meta).where("kind is not null and a * e - b * d <> 0")
    warp = c("kind") != "projected"
    m = m.withColumns({"epsg_out": F.when(warp, crs.epsg(c("lon_c"), c("lat_c"))).when(c("metric"), c("epsg")), "cell_in": F.sqrt(c("cell_x_m") * c("cell_y_m"))})
    t = F.explode(F.sequence(F.lit(0), F.lit(DENSE + 1)))
    rim = m.select("*", t.alias("_k")).withColumn("_t", c("_k") / (DENSE + 1))
    ends = [(c("_t"), F.lit(0.0)), (c("_t"), F.lit(1.0)), (F.lit(0.0), c("_t")), (F.lit(1.0), c("_t"))]
    rim = rim.select("*", F.explode(F.array(*[F.struct((u * c("cols")).alias("u"), (v * c("rows")).alias("v")) for u, v in ends])).alias("_p"))
    rim = outward(rim, c("_p.u"), c("_p.v"))
    box = rim.groupBy("ds").agg(F.min("X").alias("west"), F.max("X").alias("east"), F.min("Y").alias("south"), F.max("Y").alias("north"))
    square = (c("b") == 0) & (c("d") == 0) & (c("a") > 0) & (c("e") < 0) & (F.abs(c("a") + c("e")) <= 1e-9 * c("a"))
    few = c("rows") * c("cols") <= most
    own = F.lit(True) if target is None else F.abs(c("a") - target) <= 1e-9 * target
    first = F.lit(float(target)) if target is not None else F.when(c("metric") & square, c("a")).otherwise(nice_cell(c("cell_in")))
    m = m.join(box, "ds").withColumns({"_native": c("metric") & square & few & own, "_cell": first})
    n = F.ceil((c("east") - c("west")) / c("_cell") + 1) * F.ceil((c("north") - c("south")) / c("_cell") + 1)
    factor = F.when((n > most) & ~c("_native"), F.greatest(F.lit(2), F.ceil(F.sqrt(n / most)))).otherwise(1)
    m = m.withColumn("_factor", factor.cast("long"))
    m = m.withColumns({"cell": c("_cell") * c("_factor"), "coarsened": c("_factor") > 1})
    m = m.withColumns({"x0": F.when(c("_native"), c("c")).otherwise(F.floor(c("west") / c("cell")) * c("cell")), "y0": F.when(c("_native"), c("f")).otherwise(F.ceil(c("north") / c("cell")) * c("cell"))})
    return m.withColumns({
        "cols_out": F.when(c("_native"), c("cols")).otherwise(F.greatest(F.lit(1), F.ceil((c("east") - c("x0")) / c("cell")))).cast("long"),
        "rows_out": F.when(c("_native"), c("rows")).otherwise(F.greatest(F.lit(1), F.ceil((c("y0") - c("south")) / c("cell")))).cast("long"),
        "method": F.when(c("_native"), "native").when(c("cell") >= AVERAGE_FROM * c("cell_in"), "average").otherwise("bilinear"),
    }).drop("_native", "_cell", "_factor", "west", "east", "south", "north")


def outward(rows: DataFrame, u: Column, v: Column) -> DataFrame:
    """X and Y, in metres of the grid's system, of the raster's places (u columns, v rows from its corner)."""
    c = F.col
    rows = rows.withColumns({"_x": c("a") * u + c("b") * v + c("c"), "_y": c("d") * u + c("e") * v + c("f")})
    lon, lat = to_lonlat(c("_x"), c("_y"))
    rows = rows.withColumns({"_lon": lon, "_lat": lat})
    x, y = crs.forward(c("_lon"), c("_lat"), F.pmod("epsg_out", F.lit(100)), c("epsg_out") >= 32700)
    # without a position the series is null; a branch would keep its common parts from being shared
    return rows.withColumns({"X": F.coalesce(x, c("_x") * c("unit_m")), "Y": F.coalesce(y, c("_y") * c("unit_m"))}).drop("_x", "_y", "_lon", "_lat")


def inward(rows: DataFrame) -> DataFrame:
    """u and v, in columns and rows from the raster's corner, of X and Y."""
    c = F.col
    lon, lat = crs.inverse(c("X"), c("Y"), F.pmod("epsg_out", F.lit(100)), c("epsg_out") >= 32700)
    rows = rows.withColumns({"_lon": lon, "_lat": lat})
    mx, my = crs.A * F.radians("_lon"), crs.A * F.asinh(F.tan(F.radians("_lat")))
    of = lambda own, degrees, map_: F.when(c("kind") == "geographic", degrees).when(c("kind") == "mercator", map_).otherwise(own / c("unit_m"))
    rows = rows.withColumns({"_x": of(c("X"), c("_lon"), mx) - c("c"), "_y": of(c("Y"), c("_lat"), my) - c("f"), "_det": c("a") * c("e") - c("b") * c("d")})
    return rows.withColumns({"u": (c("e") * c("_x") - c("b") * c("_y")) / c("_det"), "v": (c("a") * c("_y") - c("d") * c("_x")) / c("_det")}).drop("_lon", "_lat", "_x", "_y", "_det")


def regrid(cells: DataFrame, meta: DataFrame, target: float | None = None, most: int = MOST_CELLS) -> tuple[DataFrame, DataFrame]:
    """SRC18: (grids, cells) of all rasters that are not refused.

    Bilinear cells weigh those of the four readings about their centre that have a height; a centre off the
    raster, or with no reading about it, has no cell.  Averaged cells take the readings whose centre is in them.
    """
    c = F.col
    g = cut(grids(meta, target, most).join(refusals(meta, cells), "ds", "left_anti"))
    z = cut(valid(cells, meta))
    frame = g.select("ds", "kind", "epsg_out", "unit_m", "a", "b", "c", "d", "e", "f", "rows", "cols", "x0", "y0", "cell", "rows_out", "cols_out", "method")
    own = z.join(frame.where("method = 'native'").select("ds"), "ds")

    into = outward(z.join(frame.where("method = 'average'"), "ds"), c("col") + 0.5, c("row") + 0.5)
    into = into.select("ds", F.floor((c("y0") - c("Y")) / c("cell")).alias("row"), F.floor((c("X") - c("x0")) / c("cell")).alias("col"), "z")
    mean = into.groupBy("ds", "row", "col").agg(F.avg("z").alias("z"))

    # each reading is a corner of four squares; a target looks up the square about its centre
    two = frame.where("method = 'bilinear'")
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (c("row") - i // 2).alias("r"), (c("col") - i % 2).alias("k")) for i in range(4)]))
    quads = z.join(two.select("ds"), "ds").select("ds", "z", corner.alias("q")).groupBy("ds", c("q.r").alias("_r"), c("q.k").alias("_k")).agg(*[F.max(F.when(c("q.i") == i, c("z"))).alias(f"_z{i}") for i in range(4)])
    # the rows of one grid are spread before their cells are made
    at = two.select("*", F.explode(F.sequence(F.lit(0), c("rows_out") - 1)).alias("row")).repartition("ds", "row")
    at = at.select("*", F.explode(F.sequence(F.lit(0), c("cols_out") - 1)).alias("col"))
    at = inward(at.withColumns({"X": c("x0") + (c("col") + 0.5) * c("cell"), "Y": c("y0") - (c("row") + 0.5) * c("cell")}))
    # one row each: the join's own filters stop at a generator, where they would repeat the series otherwise
    at = at.select("ds", "row", "col", "rows", "cols", F.explode(F.array(F.struct("u", "v"))).alias("_p")).select("ds", "row", "col", "rows", "cols", "_p.*")
    at = at.withColumns({"_r": F.floor(c("v") - 0.5), "_k": F.floor(c("u") - 0.5)})
    at = at.withColumns({"_fv": c("v") - 0.5 - c("_r"), "_fu": c("u") - 0.5 - c("_k")}).join(quads, ["ds", "_r", "_k"])
    weight = lambda i: (c("_fv") if i // 2 else 1 - c("_fv")) * (c("_fu") if i % 2 else 1 - c("_fu"))
    # judged with the weights: a filter on u and v alone would move below the series and repeat them
    on = c("u").between(0, c("cols")) & c("v").between(0, c("rows"))
    total = sum((F.when(c(f"_z{i}").isNotNull(), weight(i)).otherwise(0.0) for i in range(4)), F.lit(0.0))
    height = sum((F.coalesce(weight(i) * c(f"_z{i}"), F.lit(0.0)) for i in range(4)), F.lit(0.0))
    drawn = at.withColumn("_w", F.when(on, total)).where("_w > 1e-6").select("ds", "row", "col", (height / c("_w")).alias("z"))
    return g, own.unionByName(mean).unionByName(drawn)
