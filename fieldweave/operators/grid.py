"""Raster cells as rows (ds, row, col, z): row 0 is the north edge, rows grow southwards.

Wherever an operator takes a cell size, it is one number for all fields or a table (ds, cell), as
``surface.geometry`` makes it; radii and scales are numbers or tables alike.

A missing cell is an absent row.  Neighbourhoods are equi-joins or aggregations on cell keys:
each cell sends its value to the cells that need it, the partial aggregation runs before the
shuffle, and no window spans a whole field.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.columns import cell
from fieldweave.functions.lineage import keyed

KEY = ["row", "col"]
#: Stencil names by (row offset, column offset).
NAMES = {(-1, -1): "nw", (-1, 0): "n", (-1, 1): "ne", (0, -1): "w", (0, 0): "z", (0, 1): "e", (1, -1): "sw", (1, 0): "s", (1, 1): "se"}


def width(df: DataFrame, size: float | DataFrame, ds: str = "ds", column: str = "cell") -> tuple[DataFrame, float | Column]:
    """df and the width of its cells: the number given, or a column joined from a table of one row a field."""
    if isinstance(size, DataFrame):
        name = f"_{column}"
        return df.join(size.select(ds, F.col(column).cast("double").alias(name)), ds), F.col(name)
    return df, size


def bin_points(points: DataFrame, size: float, value: str = "elev_m", ds: str = "ds") -> DataFrame:
    """TER6's binning: mean value of the points of each cell, from the absolute origin."""
    v = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(value).isNotNull())
    return v.groupBy(ds, (-cell("y", size) - 1).alias("row"), cell("x", size).alias("col")).agg(F.avg(value).alias("z"))


def auto_cell(points: DataFrame, ds: str = "ds", max_cells: float = 400_000) -> DataFrame:
    """TER6, TER15: cell = max(5, half the swath) within 2 to 25 m to the half metre, grown until it fits max_cells."""
    good = F.when(F.col("swath_m") > 0, F.col("swath_m"))
    a = points.groupBy(ds).agg(F.percentile(good, F.lit(0.5)).alias("med"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    swath = F.when(F.col("med").isNull(), 10.0).otherwise(F.least(F.greatest(F.col("med"), F.lit(1.0)), F.lit(60.0)))
    a = a.withColumn("swath_m", swath).withColumn("cell", F.bround(F.least(F.greatest(F.lit(5.0), F.col("swath_m") / 2, F.lit(2.0)), F.lit(25.0)) * 2, 0) / 2)
    fits = F.ceil(F.sqrt(F.col("w") * F.col("h") / F.lit(max_cells)) * 2) / 2
    return a.select(ds, "swath_m", F.greatest("cell", fits).alias("cell"))


def spread(cells: DataFrame, offsets: list[tuple[int, int]], *cols: str, ds: str = "ds") -> DataFrame:
    """Each cell's columns once for every target (row - dr, col - dc), with dr and dc."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets]))
    s = cells.select(ds, "row", "col", *cols, o.alias("o"))
    return s.select(ds, (F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), *cols, F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"))


BLOCK = list(NAMES)


def ghosts(cells: DataFrame, ds: str = "ds") -> DataFrame:
    """TER10: the missing neighbours of valid cells, with the value of the nearest valid cell (ties by row, col)."""
    near = spread(cells, [o for o in BLOCK if o != (0, 0)], "z", ds=ds)
    pick = F.min(F.struct((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d2"), (F.col("row") + F.col("dr")).alias("r"), (F.col("col") + F.col("dc")).alias("c"), F.col("z").alias("z"))).alias("p")
    return near.join(keyed(cells.select(ds, *KEY)), [ds, *KEY], "left_anti").groupBy(ds, *KEY).agg(pick).select(ds, *KEY, F.col("p.z").alias("z"))


def stencil(cells: DataFrame, ds: str = "ds", fill: bool = True) -> DataFrame:
    """Each valid cell with its eight neighbours as nw .. se; missing ones nearest-filled, or null.

    One aggregation by cell: cells (and ghosts) send their value to nine targets.
    """
    real = cells.select(ds, *KEY, "z", F.lit(True).alias("real"))
    full = real.unionByName(ghosts(cells, ds).withColumn("real", F.lit(False))) if fill else real
    s = spread(full, BLOCK, "z", "real", ds=ds)
    at = lambda o: (F.col("dr") == o[0]) & (F.col("dc") == o[1])
    a = s.groupBy(ds, *KEY).agg(*[F.max(F.when(at(o), F.col("z"))).alias(n) for o, n in NAMES.items()], F.max(F.when(at((0, 0)), F.col("real"))).alias("real"))
    return a.where(F.coalesce("real", F.lit(False))).drop("real")


def gradient(size: float | Column) -> tuple[Column, Column]:
    """Horn's dz/dx (east) and dz/dy (north)."""
    c = F.col
    dx = ((c("ne") + 2.0 * c("e") + c("se")) - (c("nw") + 2.0 * c("w") + c("sw"))) / (8.0 * size)
    dy = ((c("nw") + 2.0 * c("n") + c("ne")) - (c("sw") + 2.0 * c("s") + c("se"))) / (8.0 * size)
    return dx, dy


def aspect(dx: Column, dy: Column, flat_pct: float = 0.5) -> Column:
    """DER2: downhill bearing, null where the slope is below flat_pct."""
    return F.when(100 * F.hypot(dx, dy) >= flat_pct, F.pmod(F.bround(F.degrees(F.atan2(-dx, -dy)), 4), F.lit(360.0)))


def derivatives(cells: DataFrame, size: float | DataFrame, flat_pct: float = 0.5, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0, ds: str = "ds") -> DataFrame:
    """DER1-5, DER8, DER9 in one stencil: slope, aspect and sector, curvatures, hillshade, roughness, TRI."""
    s, size = width(stencil(cells, ds), size, ds)
    dx, dy = gradient(size)
    s = s.withColumns({"dzdx": dx, "dzdy": dy}).withColumn("grad", F.hypot("dzdx", "dzdy"))
    c = F.col
    d, e = ((c("w") + c("e")) / 2 - c("z")) / size**2, ((c("n") + c("s")) / 2 - c("z")) / size**2
    f, g, h = (-c("nw") + c("ne") + c("sw") - c("se")) / (4 * size**2), (c("e") - c("w")) / (2 * size), (c("n") - c("s")) / (2 * size)
    s = s.withColumns({"d_": d, "e_": e, "f_": f, "g_": g, "h_": h}).withColumn("g2", c("g_") * c("g_") + c("h_") * c("h_"))
    flat = c("g2") < 1e-12
    safe = F.when(flat, 1.0).otherwise(c("g2"))
    profile = -2.0 * (c("d_") * c("g_") * c("g_") + c("e_") * c("h_") * c("h_") + c("f_") * c("g_") * c("h_")) / safe
    plan = -2.0 * (c("d_") * c("h_") * c("h_") + c("e_") * c("g_") * c("g_") - c("f_") * c("g_") * c("h_")) / safe
    az, alt = math.radians(azimuth), math.radians(altitude)
    gx, gy = c("dzdx") * z_factor, c("dzdy") * z_factor
    shade = (math.sin(alt) - math.cos(alt) * (gx * math.sin(az) + gy * math.cos(az))) / F.sqrt(1 + gx * gx + gy * gy)
    nb = [c(n) for o, n in NAMES.items() if o != (0, 0)]
    s = s.withColumn("aspect", aspect(c("dzdx"), c("dzdy"), flat_pct))
    tri = sum((F.abs(c("z") - n) for n in nb[1:]), F.abs(c("z") - nb[0])) / 8.0
    return s.select(
        ds, *KEY, "z", (100 * c("grad")).alias("slope_pct"), F.degrees(F.atan("grad")).alias("slope_deg"), "aspect",
        F.when(c("aspect").isNotNull(), F.pmod(F.floor(F.pmod(c("aspect") + 22.5, F.lit(360.0)) / 45).cast("int"), F.lit(8))).otherwise(-1).alias("sector"),
        F.when(flat, 0.0).otherwise(profile).alias("profile"), F.when(flat, 0.0).otherwise(plan).alias("plan"), (-2.0 * (c("d_") + c("e_"))).alias("curvature"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade)).alias("hillshade"),
        (F.greatest(c("z"), *nb) - F.least(c("z"), *nb)).alias("roughness"), tri.alias("tri"),
    )


def disc_mean(cells: DataFrame, radius: float | DataFrame, ds: str = "ds") -> DataFrame:
    """Mean over the valid cells within radius (in cells) of each cell; below 1 the 3 x 3 block.

    radius: a number, or a table (ds, radius).  Running sums along each row turn a disc into two
    look-ups per row of it, so the work grows with the radius and not with its square.
    """
    own, radius = width(cells, radius, ds, "radius")
    radius = radius if isinstance(radius, Column) else F.lit(float(radius))
    reach = F.when(radius < 1, F.lit(1)).otherwise(F.floor(radius)).cast("int")
    half = lambda dy: F.when(radius < 1, F.lit(1)).otherwise(F.floor(F.sqrt(F.greatest(radius * radius - dy * dy, F.lit(0.0))))).cast("int")
    arms = F.explode(F.transform(F.sequence(-reach, reach), lambda dy: F.struct(dy.alias("dy"), half(dy).alias("h"))))
    ext = cells.groupBy(ds, "row").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    dense = ext.select(ds, "row", F.explode(F.sequence(F.col("c0") - 1, F.col("c1"))).alias("col")).join(keyed(cells.select(ds, *KEY, "z")), [ds, *KEY], "left")
    w = Window.partitionBy(ds, "row").orderBy("col")
    prefix = dense.select(ds, F.col("row").alias("prow"), F.col("col").alias("pcol"), F.coalesce(F.sum("z").over(w), F.lit(0.0)).alias("s"), F.count("z").over(w).alias("n"))
    t = own.select(ds, *KEY, arms.alias("a")).withColumn("prow", F.col("row") + F.col("a.dy"))
    t = t.join(keyed(ext.withColumnRenamed("row", "prow")), [ds, "prow"])
    hi, lo = F.least(F.col("col") + F.col("a.h"), F.col("c1")), F.greatest(F.col("col") - F.col("a.h") - 1, F.col("c0") - 1)
    t = t.withColumns({"hi": hi, "lo": lo}).where("hi > lo")
    ends = t.select(ds, *KEY, "prow", F.explode(F.array(F.struct(F.col("hi").alias("pcol"), F.lit(1.0).alias("sign")), F.struct(F.col("lo").alias("pcol"), F.lit(-1.0).alias("sign")))).alias("e"))
    ends = ends.select(ds, *KEY, "prow", "e.pcol", "e.sign").join(keyed(prefix), [ds, "prow", "pcol"])
    a = ends.groupBy(ds, *KEY).agg(F.sum(F.col("sign") * F.col("s")).alias("s"), F.sum(F.col("sign") * F.col("n")).alias("n"))
    return a.select(ds, *KEY, (F.col("s") / F.col("n")).alias("mean"))


def tpi(cells: DataFrame, radius: float | DataFrame, ds: str = "ds") -> DataFrame:
    """DER6: height above the mean of the disc."""
    return cells.select(ds, *KEY, "z").join(keyed(disc_mean(cells, radius, ds)), [ds, *KEY]).select(ds, *KEY, (F.col("z") - F.col("mean")).alias("tpi"))


def standardise(t: DataFrame, column: str = "tpi", min_height: float = 0.0, ds: str = "ds") -> DataFrame:
    """DER7: (t - mean) / sd of the population, 0 without spread; small heights count as 0."""
    m = t.groupBy(ds).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(column) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).otherwise(0.0)
    return t.join(keyed(m), ds).withColumn(f"{column}_std", F.when(F.abs(column) < 0.1 * min_height, 0.0).otherwise(z)).drop("_m", "_s")


def landform(small: Column, large: Column, slope: Column, flat_pct: float = 2.0) -> Column:
    """LF1: 1 hilltop, 2 upper slope, 3 mid slope, 4 flat, 5 lower slope, 6 valley; 0 where an input is missing."""
    lh, ll, sh, sl = large > 1, large < -1, small > 1, small < -1
    code = F.when(lh & sh, 1).when(lh, 2).when(ll & sl, 6).when(ll, 5).when(sh, 2).when(sl, 5).when(slope < flat_pct, 4).otherwise(3)
    return F.when(small.isNull() | large.isNull() | slope.isNull(), 0).otherwise(code)


def plane_trend(cells: DataFrame, size: float | DataFrame, ds: str = "ds") -> DataFrame:
    """DER10: least-squares plane: gradient in %, downhill bearing, drop across the field along it, R2."""
    cells, size = width(cells, size, ds)
    x, y = F.col("col") * size, -F.col("row") * size
    p = cells.select(ds, x.alias("x"), y.alias("y"), "z")
    a = p.groupBy(ds).agg(
        F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"), F.var_pop("z").alias("zz")
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a = a.withColumns({"b": F.try_divide(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det), "c": F.try_divide(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), det)})
    a = a.withColumns({"g": F.hypot("b", "c"), "r2": F.try_divide(F.col("b") * F.col("xz") + F.col("c") * F.col("yz"), F.col("zz"))})
    along = p.join(keyed(a.select(ds, "b", "c", "g")), ds).groupBy(ds).agg((F.max(F.col("x") * F.col("b") + F.col("y") * F.col("c")) - F.min(F.col("x") * F.col("b") + F.col("y") * F.col("c"))).alias("drop_m"))
    return a.join(along, ds).select(ds, (100 * F.col("g")).alias("gradient_pct"), F.pmod(F.bround(F.degrees(F.atan2(-F.col("b"), -F.col("c"))), 4), F.lit(360.0)).alias("bearing"), "drop_m", "r2")


def residual_relief(cells: DataFrame, size: float | DataFrame, ds: str = "ds") -> DataFrame:
    """DER11: p95 - p5 of what the plane leaves."""
    cells, size = width(cells, size, ds)
    x, y = F.col("col") * size, -F.col("row") * size
    p = cells.select(ds, x.alias("x"), y.alias("y"), "z")
    m = p.groupBy(ds).agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz")
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    m = m.withColumns({"b": F.try_divide(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det), "c": F.try_divide(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), det)})
    res = F.col("z") - F.col("mz") - F.col("b") * (F.col("x") - F.col("mx")) - F.col("c") * (F.col("y") - F.col("my"))
    q = F.percentile("res", F.array(F.lit(0.05), F.lit(0.95)))
    return p.join(keyed(m), ds).withColumn("res", res).groupBy(ds).agg(q.alias("q")).select(ds, (F.col("q")[1] - F.col("q")[0]).alias("relief_m"))


def is_level(relief: DataFrame, noise: DataFrame, ds: str = "ds") -> DataFrame:
    """DER11: relief (ds, relief_m) with level: below 5 cm, twice the noise and the step of the values (ds, noise, step), whichever is most."""
    j = relief.join(noise.select(ds, "noise", "step"), ds, "left")
    most = F.greatest(F.lit(0.05), 2 * F.coalesce("noise", F.lit(0.0)), F.coalesce("step", F.lit(0.0)))
    return j.select(ds, "relief_m", (F.col("relief_m") < most).alias("level"))


def smooth(cells: DataFrame, sigma: float | DataFrame, ds: str = "ds") -> DataFrame:
    """TER8: Gaussian mean of the valid cells, cut at 3 sigma, by columns and then rows; masked as before.

    sigma: in cells, a number or a table (ds, sigma); fields of sigma 0 stay as they are.
    """

    def along(df: DataFrame, axis: str) -> DataFrame:
        df, s = width(df, sigma, ds, "sigma")
        s = s if isinstance(s, Column) else F.lit(float(s))
        reach = F.coalesce(F.ceil(3 * s), F.lit(0)).cast("int")
        sent = df.select(ds, *KEY, "z", "w", s.alias("s"), F.explode(F.sequence(-reach, reach)).alias("d"))
        weight = F.when(F.col("d") == 0, 1.0).otherwise(F.exp(-(F.col("d") * F.col("d")).cast("double") / (2.0 * F.col("s") * F.col("s"))))
        sent = sent.select(ds, *[(F.col(k) - F.col("d")).alias(k) if k == axis else k for k in KEY], (weight * F.col("z")).alias("z"), (weight * F.col("w")).alias("w"))
        return sent.groupBy(ds, *KEY).agg(F.sum("z").alias("z"), F.sum("w").alias("w"))

    b = along(along(cells.select(ds, *KEY, "z", F.lit(1.0).alias("w")), "col"), "row")
    return cells.select(ds, *KEY).join(keyed(b), [ds, *KEY]).select(ds, *KEY, (F.col("z") / F.col("w")).alias("z"))


def coarsen(cells: DataFrame, factor: int, ds: str = "ds") -> DataFrame:
    """TER11: mean of the valid cells of each factor x factor block."""
    return cells.groupBy(ds, F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg("z").alias("z"))


def idw_fill(cells: DataFrame, gap: float, ds: str = "ds") -> DataFrame:
    """TER6: cells within gap (in cells) of occupied ones, filled by inverse squared distance; occupied ones stay."""
    r = int(math.floor(gap))
    disc = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if 0 < a * a + b * b <= gap * gap]
    d2 = (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double")
    near = spread(cells, disc, "z", ds=ds).join(keyed(cells.select(ds, *KEY)), [ds, *KEY], "left_anti")
    new = near.groupBy(ds, *KEY).agg((F.sum(F.col("z") / d2) / F.sum(1 / d2)).alias("z"))
    return cells.select(ds, *KEY, "z", F.lit(False).alias("filled")).unionByName(new.withColumn("filled", F.lit(True)))


def value_step(points: DataFrame, column: str = "elev_m", ds: str = "ds") -> DataFrame:
    """TER3: the first of 1, 0.5 and 0.1 on whose lattice all values lie (to a thousandth), from 50 values; else 0."""
    on = {s: F.every(F.abs(F.col(column) / s - F.rint(F.col(column) / s)) * s <= 1e-3).alias(f"s{i}") for i, s in enumerate((1.0, 0.5, 0.1))}
    a = points.where(F.col(column).isNotNull()).groupBy(ds).agg(F.count(F.lit(1)).alias("n"), *on.values())
    return a.select(ds, F.when((F.col("n") >= 50) & F.col("s0"), 1.0).when((F.col("n") >= 50) & F.col("s1"), 0.5).when((F.col("n") >= 50) & F.col("s2"), 0.1).otherwise(0.0).alias("step"))


FILL_VALUES = (0.0, -9999.0, -32768.0)


def drop_fill_values(points: DataFrame, column: str = "elev_m", ds: str = "ds") -> DataFrame:
    """TER1: exact fill values go where they lie further from the median than max(30 m, 10 MAD)."""
    m = points.groupBy(ds).agg(F.percentile(column, F.lit(0.5)).alias("_m"))
    p = points.join(m, ds)
    mad = p.groupBy(ds).agg(F.percentile(F.abs(F.col(column) - F.col("_m")), F.lit(0.5)).alias("_mad"))
    bad = F.col(column).isin(*FILL_VALUES) & (F.abs(F.col(column) - F.col("_m")) > F.greatest(F.lit(30.0), 10 * F.col("_mad")))
    return p.join(mad, ds).where(~F.coalesce(bad, F.lit(False))).drop("_m", "_mad")


def stray_passes(points: DataFrame, column: str = "elev_m", ds: str = "ds") -> DataFrame:
    """TER2: passes whose median lies further than max(30 m, 10 MAD) from the median of the other passes' medians."""
    m = points.where(F.col(column).isNotNull()).groupBy(ds, "pass_id").agg(F.percentile(column, F.lit(0.5)).alias("m"))
    o = m.select(ds, F.col("pass_id").alias("other"), F.col("m").alias("om"))
    pair = m.join(o, ds).where("pass_id <> other")
    a = pair.groupBy(ds, "pass_id", "m").agg(F.percentile("om", F.lit(0.5)).alias("med"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    mad = a.join(keyed(pair.select(ds, "pass_id", "om")), [ds, "pass_id"]).groupBy(ds, "pass_id", "m", "med").agg(F.percentile(F.abs(F.col("om") - F.col("med")), F.lit(0.5)).alias("mad"))
    return mad.where(F.abs(F.col("m") - F.col("med")) > F.greatest(F.lit(30.0), 10 * F.col("mad"))).select(ds, "pass_id")


def sample_nearest(points: DataFrame, cells: DataFrame, size: float | DataFrame, column: str = "z", ds: str = "ds") -> DataFrame:
    """JN7 for class layers: the value of the cell that holds each point."""
    p, size = width(points, size, ds)
    p = p.withColumns({"row": -cell("y", size) - 1, "col": cell("x", size)})
    return p.join(keyed(cells.select(ds, *KEY, column)), [ds, *KEY], "left").drop(*KEY, "_cell")


def sample_bilinear(points: DataFrame, cells: DataFrame, size: float | DataFrame, ds: str = "ds") -> DataFrame:
    """JN7 for continuous layers: bilinear between cell centres on the nearest-filled layer; null off the field.

    points have an id; returns (ds, id, z).
    """
    full = cells.select(ds, *KEY, "z").unionByName(ghosts(cells, ds).select(ds, *KEY, "z"))
    points, size = width(points, size, ds)
    p = points.select(ds, "id", (F.col("x") / size - 0.5).alias("fx"), (F.col("y") / size - 0.5).alias("fy"), (-cell("y", size) - 1).alias("row"), cell("x", size).alias("col"))
    p = p.join(keyed(cells.select(ds, *KEY)), [ds, *KEY], "left_semi")
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("k")
    q = p.select(ds, "id", "fx", "fy", corner).withColumns({"cx": F.floor("fx") + F.col("k.a"), "cy": F.floor("fy") + F.col("k.b")})
    q = q.withColumn("w", (1 - F.abs(F.col("fx") - F.col("cx"))) * (1 - F.abs(F.col("fy") - F.col("cy")))).select(ds, "id", "w", (-F.col("cy") - 1).alias("row"), F.col("cx").alias("col"))
    return q.join(keyed(full), [ds, *KEY]).groupBy(ds, "id").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"))


def class_areas(cells: DataFrame, column: str, classes: list[int], size: float | DataFrame, ds: str = "ds") -> DataFrame:
    """LF2: cells, hectares and share of each class, empty ones too."""
    n = cells.groupBy(ds, F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("cells"))
    total = cells.groupBy(ds).agg(F.count(F.lit(1)).alias("total"))
    dim = total.select(ds, "total", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    k = F.coalesce("cells", F.lit(0))
    dim, size = width(dim, size, ds)
    return dim.join(keyed(n), [ds, "class"], "left").select(ds, "class", k.alias("cells"), (k * size * size / 1e4).alias("area_ha"), (100.0 * k / F.col("total")).alias("pct"))


def character(relief: Column, mean_slope: Column) -> Column:
    """LF3."""
    return F.when((mean_slope < 1) & (relief < 2), "flat").when(mean_slope < 3, "gently_undulating").when(mean_slope < 8, "rolling").otherwise("hilly")


def position_word(fx: Column, fy: Column) -> Column:
    """LF4: thirds of the extent, fx and fy from 0 (west, south) to 1."""
    ew = F.when(fx < 1 / 3, "west").when(fx > 2 / 3, "east").otherwise("")
    ns = F.when(fy < 1 / 3, "south").when(fy > 2 / 3, "north").otherwise("")
    return F.when((ns != "") & (ew != ""), F.concat(ns, F.lit("-"), ew, F.lit(" part"))).when(ns != "", F.concat(ns, F.lit("ern part"))).when(ew != "", F.concat(ew, F.lit("ern part"))).otherwise("centre")


def equal_count_bands(cells: DataFrame, bands: int, column: str = "z", ds: str = "ds") -> DataFrame:
    """ZON1, YR2: each cell's band of equal counts (edges unique to 6 decimals), from 1."""
    e = cells.groupBy(ds).agg(F.array_distinct(F.transform(F.percentile(column, F.array(*[F.lit(i / bands) for i in range(1, bands)])), lambda v: F.bround(v, 6))).alias("_e"))
    return cells.join(e, ds).withColumn("band", F.size(F.filter("_e", lambda v: v < F.col(column))) + 1).drop("_e")


def contour_segments(cells: DataFrame, interval: float, size: float | DataFrame, ds: str = "ds") -> DataFrame:
    """CON2: marching squares over blocks of four cell centres: (ds, level, x1, y1, x2, y2), major every fifth level.

    A saddle is split by the mean of its corners.
    """
    s = spread(cells, [(0, 0), (0, 1), (1, 0), (1, 1)], "z", ds=ds)
    at = lambda a, b, n: F.max(F.when((F.col("dr") == a) & (F.col("dc") == b), F.col("z"))).alias(n)
    q = s.groupBy(ds, *KEY).agg(at(0, 0, "nw"), at(0, 1, "ne"), at(1, 0, "sw"), at(1, 1, "se")).where("nw is not null and ne is not null and sw is not null and se is not null")
    lo, hi = F.least("nw", "ne", "sw", "se"), F.greatest("nw", "ne", "sw", "se")
    k0, k1 = F.floor(lo / interval).cast("long") + 1, F.ceil(hi / interval).cast("long") - 1
    q = q.withColumns({"k0": k0, "k1": k1}).where("k0 <= k1").withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumn("v", F.col("k") * interval)
    up = lambda n: (F.col(n) > F.col("v"))
    q, size = width(q, size, ds)
    frac = lambda a, b: (F.col("v") - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0.0))
    x0, y0 = (F.col("col") + 0.5) * size, -(F.col("row") + 0.5) * size
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    top, bottom = pt(x0 + frac("nw", "ne") * size, y0), pt(x0 + frac("sw", "se") * size, y0 - size)
    left, right = pt(x0, y0 - frac("nw", "sw") * size), pt(x0 + size, y0 - frac("ne", "se") * size)
    case = up("nw").cast("int") * 8 + up("ne").cast("int") * 4 + up("se").cast("int") * 2 + up("sw").cast("int")
    seg = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    high = (F.col("nw") + F.col("ne") + F.col("sw") + F.col("se")) / 4 > F.col("v")
    c = F.col("case")
    lines = (
        F.when(c.isin(1, 14), F.array(seg(left, bottom))).when(c.isin(2, 13), F.array(seg(bottom, right))).when(c.isin(3, 12), F.array(seg(left, right)))
        .when(c.isin(4, 11), F.array(seg(top, right))).when(c.isin(6, 9), F.array(seg(top, bottom))).when(c.isin(7, 8), F.array(seg(left, top)))
        .when(c == 5, F.when(high, F.array(seg(left, top), seg(bottom, right))).otherwise(F.array(seg(left, bottom), seg(top, right))))
        .when(c == 10, F.when(high, F.array(seg(left, bottom), seg(top, right))).otherwise(F.array(seg(left, top), seg(bottom, right))))
    )
    q = q.withColumn("case", case).withColumn("line", F.explode(lines))
    return q.select(ds, *KEY, F.col("v").alias("level"), (F.col("k") % 5 == 0).alias("major"), F.col("line.a.x").alias("x1"), F.col("line.a.y").alias("y1"), F.col("line.b.x").alias("x2"), F.col("line.b.y").alias("y2"))


LADDER = (0.1, 0.2, 0.25, 0.5, 1.0, 2.0, 2.5, 5.0, 10.0, 20.0, 25.0, 50.0)


def choose_interval(cells: DataFrame, ds: str = "ds") -> DataFrame:
    """CON1: the step that gives 3 to 40 contours and comes closest to 12; the finer of two."""
    r = cells.groupBy(ds).agg((F.max("z") - F.min("z")).alias("relief"))
    o = F.array(*[F.struct(F.abs(F.col("relief") / s - 12).alias("d"), F.lit(s).alias("s")) for s in LADDER])
    fit = F.filter(o, lambda x: (F.col("relief") / x["s"]).between(3, 40))
    return r.select(ds, "relief", F.array_min(fit)["s"].alias("interval"))
