"""Water over raster cells: filled sinks, flow directions, accumulation, wetness, basins, channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.lineage import cut, keyed
from fieldweave.operators import graph, grid
from fieldweave.operators.grid import width

#: D8 codes clockwise from east, as (row, column) offsets.
D8 = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def fill_sinks(cells: DataFrame, tile: int = 64, ds: str = "ds") -> DataFrame:
    """HYD1, HYD2: (ds, row, col, z, filled, depth); the field's edge drains."""
    nb = grid.stencil(cells, ds, fill=False)
    edge = nb.select(ds, "row", "col", "z", F.greatest(*[F.col(n).isNull() for o, n in grid.NAMES.items() if o != (0, 0)]).alias("source"))
    m = graph.minimax(edge, tile, ds=ds)
    return m.select(ds, "row", "col", "z", F.col("level").alias("filled"), F.greatest(F.col("level") - F.col("z"), F.lit(0.0)).alias("depth"))


def d8(filled: DataFrame, size: float, ds: str = "ds") -> DataFrame:
    """HYD4: (ds, row, col, code), the steepest way down; -1 where it leaves the field or there is none.

    A missing neighbour lies where the slope from its opposite would go on; the first code wins a tie.
    """
    s = grid.stencil(filled.select(ds, "row", "col", F.col("filled").alias("z")), ds, fill=False)
    z, options = F.col("z"), []
    for code, (dr, dc) in enumerate(D8):
        n, opp = F.col(grid.NAMES[(dr, dc)]), F.col(grid.NAMES[(-dr, -dc)])
        out = n.isNull() & opp.isNotNull()
        fall = (z - F.when(out, 2 * z - opp).otherwise(n)) / (size * (2**0.5 if dr and dc else 1.0))
        options.append(F.when(fall > 0, F.struct((-fall).alias("k"), F.lit(code).alias("i"), F.when(out, F.lit(-1)).otherwise(code).alias("code"))))
    return s.select(ds, "row", "col", F.coalesce(F.least(*options)["code"], F.lit(-1)).alias("code"))


def receivers(codes: DataFrame, ds: str = "ds") -> DataFrame:
    """HYD5: (ds, id, ptr): where each cell's water goes; null at an outlet."""
    dr = F.element_at(F.array(*[F.lit(o[0]) for o in D8]), F.greatest(F.col("code"), F.lit(0)) + 1)
    dc = F.element_at(F.array(*[F.lit(o[1]) for o in D8]), F.greatest(F.col("code"), F.lit(0)) + 1)
    c = codes.withColumns({"id": graph.cell_id(), "r2": F.col("row") + dr, "c2": F.col("col") + dc})
    return c.select(ds, "row", "col", "id", F.when(F.col("code") >= 0, graph.cell_id("r2", "c2")).alias("ptr"))


def flow_accumulation(codes: DataFrame, ds: str = "ds") -> DataFrame:
    """HYD6: (ds, row, col, acc), cells that drain through each cell, itself included."""
    r = receivers(codes, ds)
    acc = graph.accumulate(r.withColumn("w", F.lit(1.0)), ds)
    return r.select(ds, "row", "col", "id").join(keyed(acc), [ds, "id"]).select(ds, "row", "col", "acc")


def wetness(acc: DataFrame, slopes: DataFrame, size: float | DataFrame, ds: str = "ds") -> DataFrame:
    """HYD7: ln(acc * cell / max(slope, 0.001))."""
    j, size = width(acc.join(keyed(slopes.select(ds, "row", "col", "slope_pct")), [ds, "row", "col"]), size, ds)
    return j.withColumn("twi", F.log(F.col("acc") * size / F.greatest(F.col("slope_pct") / 100, F.lit(0.001)))).drop("_cell")


def wet_cells(twi: DataFrame, depth: DataFrame, ds: str = "ds") -> DataFrame:
    """HYD8: wet where ponded deeper than 5 cm, or where the index reaches max(its p90, 8)."""
    t = twi.groupBy(ds).agg(F.greatest(F.percentile("twi", F.lit(0.9)), F.lit(8.0)).alias("threshold"))
    j = twi.join(keyed(depth.select(ds, "row", "col", "depth")), [ds, "row", "col"]).join(t, ds)
    return j.withColumn("wet", (F.col("depth") > 0.05) | (F.col("twi") >= F.col("threshold")))


def guarded_wet(twi: DataFrame, depth: DataFrame, noise_slope_pct: float, ds: str = "ds") -> DataFrame:
    """HYD9: only cells steeper than the noise, or ponded, are ranked; none where they are under 2 % of the field."""
    j = twi.join(keyed(depth.select(ds, "row", "col", "depth")), [ds, "row", "col"])
    j = j.withColumn("candidate", (F.col("slope_pct") >= noise_slope_pct) | (F.col("depth") > 0.05))
    a = j.groupBy(ds).agg(F.percentile(F.when(F.col("candidate"), F.col("twi")), F.lit(0.9)).alias("t"), F.avg(F.col("candidate").cast("double")).alias("share"))
    wet = (F.col("share") >= 0.02) & F.col("candidate") & ((F.col("depth") > 0.05) | (F.col("twi") >= F.greatest(F.col("t"), F.lit(8.0))))
    return j.join(a, ds).withColumn("wet", F.coalesce(wet, F.lit(False))).drop("t", "share")


def basins(filled: DataFrame, size: float | DataFrame, min_area_m2: float = 0.0, min_depth: float = 0.05, ds: str = "ds") -> DataFrame:
    """HYD3, HYD11: patches deeper than min_depth, grown to the lake that holds them, ranked by volume."""
    core = graph.cell_components(filled.where(F.col("depth") > min_depth), 1, ds)
    lake = graph.cell_components(filled.where(F.col("depth") > 1e-4), 1, ds)
    held = core.join(keyed(lake.select(ds, "row", "col", F.col("label").alias("lake"))), [ds, "row", "col"]).select(ds, "lake").distinct()
    c = lake.withColumnRenamed("label", "lake").join(keyed(held), [ds, "lake"]).join(keyed(filled), [ds, "row", "col"])
    c, size = width(c, size, ds)
    size = F.first(size) if isinstance(size, Column) else size
    a = c.groupBy(ds, F.col("lake").alias("basin")).agg(
        F.count(F.lit(1)).alias("n"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"), (F.sum("depth") * size * size).alias("volume_m3"),
        F.max("filled").alias("spill"), F.min("z").alias("bottom"), F.min(F.struct((-F.col("depth")).alias("d"), "row", "col")).alias("deepest"), (F.count(F.lit(1)) * size * size).alias("area_m2"),
    ).where(F.col("area_m2") >= min_area_m2)
    rank = F.row_number().over(Window.partitionBy(ds).orderBy(F.desc("volume_m3"), "basin"))
    return a.select(ds, "basin", "area_m2", "max_depth", "mean_depth", "volume_m3", "spill", "bottom", F.col("deepest.row").alias("row"), F.col("deepest.col").alias("col"), rank.alias("rank"))


def unlisted(filled: DataFrame, size: float | DataFrame, floor_m2: float, ds: str = "ds") -> DataFrame:
    """HYD11: (ds, listed, unlisted): basins of floor_m2 or more, and how many smaller ones are not listed."""
    a = basins(filled, size, ds=ds)
    return a.groupBy(ds).agg(F.count_if(F.col("area_m2") >= floor_m2).alias("listed"), F.count_if(F.col("area_m2") < floor_m2).alias("unlisted"))


def channels(codes: DataFrame, acc: DataFrame, size: float | DataFrame, min_ha: float, ds: str = "ds") -> DataFrame:
    """HYD10: channel segments: cells that drain min_ha, joined to the cell they drain to, with length and a head flag."""
    drains, cell = width(acc, size, ds)
    net = drains.where(F.col("acc") * cell * cell / 1e4 >= min_ha).select(ds, "row", "col", "acc")
    r = receivers(codes, ds).join(keyed(net), [ds, "row", "col"])
    to = r.select(ds, F.col("id").alias("ptr"), F.col("row").alias("row2"), F.col("col").alias("col2"))
    seg, cell = width(r.join(keyed(to), [ds, "ptr"]), size, ds)
    fed = seg.select(ds, F.col("ptr").alias("id")).distinct().withColumn("fed", F.lit(True))
    length = cell * F.sqrt(F.pow(F.col("row") - F.col("row2"), 2) + F.pow(F.col("col") - F.col("col2"), 2))
    return seg.join(keyed(fed), [ds, "id"], "left").select(ds, "row", "col", "row2", "col2", "acc", length.alias("length_m"), F.col("fed").isNull().alias("head"))


def channel_lines(codes: DataFrame, acc: DataFrame, size: float | DataFrame, min_ha: float, ds: str = "ds") -> DataFrame:
    """HYD10: the channel segments, each on one line: (ds, line, k, row, col, row2, col2, acc, length_m, line_m).

    A line runs from a head to the outlet or to the first cell of a longer one; line is the number of its
    head's cell, k counts its segments.  Of the heads above a cell the farthest dominates it (the first by
    row and column of two), which pointer doubling finds: after k rounds a cell knows the farthest of
    2^k steps, so the rounds are the logarithm of the longest channel.
    """
    seg = cut(channels(codes, acc, size, min_ha, ds).withColumns({"id": graph.cell_id(), "ptr": graph.cell_id("row2", "col2")}))
    ends = seg.select(ds, F.col("ptr").alias("id")).join(keyed(seg.select(ds, "id")), [ds, "id"], "left_anti").distinct()
    far = F.when(F.col("head"), F.struct(F.lit(0).cast("long").alias("k"), (-F.col("id")).alias("h")))
    cur = cut(seg.select(ds, "id", "ptr", far.alias("far")).unionByName(ends.select(ds, "id", F.lit(None).cast("long").alias("ptr"), F.lit(None).cast("struct<k:bigint,h:bigint>").alias("far"))))
    for round_ in range(64):
        if cur.where("ptr is not null").isEmpty():
            break
        sent = cur.where("ptr is not null and far is not null").groupBy(ds, F.col("ptr").alias("id")).agg(F.max(F.struct((F.col("far.k") + 2**round_).alias("k"), F.col("far.h").alias("h"))).alias("more"))
        nxt = cur.select(ds, F.col("id").alias("ptr"), F.col("ptr").alias("next"))
        cur = cut(cur.join(keyed(sent), [ds, "id"], "left").join(keyed(nxt), [ds, "ptr"], "left").select(ds, "id", F.col("next").alias("ptr"), F.greatest("far", "more").alias("far")))
    out = seg.join(keyed(cur.select(ds, "id", (-F.col("far.h")).alias("line"), F.col("far.k").alias("k"))), [ds, "id"])
    total = out.groupBy(ds, "line").agg(F.sum("length_m").alias("line_m"))
    return out.join(keyed(total), [ds, "line"]).select(ds, "line", "k", "row", "col", "row2", "col2", "acc", "length_m", "line_m")


def summary(filled: DataFrame, wet: DataFrame, size: float | DataFrame, ds: str = "ds") -> DataFrame:
    """HYD12: ponded cells, volume and wet cells of each field."""
    filled, size = width(filled, size, ds)
    size = F.first(size) if isinstance(size, Column) else size
    a = filled.groupBy(ds).agg(F.count_if(F.col("depth") > 0.05).alias("ponded"), (F.sum("depth") * size * size).alias("volume_m3"))
    return a.join(wet.groupBy(ds).agg(F.count_if("wet").alias("wet")), ds)
