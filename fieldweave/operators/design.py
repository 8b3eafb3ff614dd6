"""Randomised strip trials laid out on the cells or points of many fields at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.lineage import cut


def guards(fields: DataFrame, rates: list[float], blocks: int, width: float, ds: str = "ds") -> DataFrame:
    """DSN7: (ds, reason) of the fields that cannot take the trial; fields have vertices and extent across the strips."""
    strips = F.floor(F.col("extent") / width)
    reason = (
        F.when(F.lit(len(set(rates)) < 3), "fewer than 3 rates").when(F.col("vertices") < 3, "fewer than 3 vertices").when(F.lit(blocks < 1), "no block").when(strips < len(rates), "fewer strips than rates")
    )
    return fields.select(ds, reason.alias("reason")).where("reason is not null")


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points, anticlockwise from the least; points on an edge are none."""
    order = np.lexsort((y, x))
    p = np.unique(np.stack([x[order], y[order]], axis=1), axis=0)
    if len(p) < 3:
        return p
    chains = []
    for way in (p.tolist(), p[::-1].tolist()):
        chain = []
        for a in way:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (a[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (a[0] - chain[-2][0]):
                chain.pop()
            chain.append(a)
        chains += chain[:-1]
    return np.array(chains)


#: Groups a log's partial hulls are dealt to before they become one.
PARTS = 64


def hull(points: DataFrame, ds: str = "ds") -> DataFrame:
    """DSN6: (ds, k, x, y): the corners of the convex hull of each log's points, in order.

    A hull of hulls is the hull: each task reduces its batches, groups of partial hulls reduce those,
    and a log's last group holds the corners of ``PARTS`` hulls, whatever the number of its points.
    """
    kind = dict(points.dtypes)[ds]
    out = f"{ds} {kind}, part long, k long, x double, y double"

    def reduce(pdf: pd.DataFrame, part: int) -> pd.DataFrame:
        made = []
        for key, g in pdf.groupby(ds, sort=False):
            h = _hull(g["x"].to_numpy(), g["y"].to_numpy())
            made.append(pd.DataFrame({ds: key, "part": part, "k": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]}))
        return pd.concat(made) if made else pd.DataFrame({ds: [], "part": [], "k": [], "x": [], "y": []})

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId()
        for pdf in frames:
            yield reduce(pdf, at % PARTS)

    p = points.select(ds, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(f"{ds} is not null and x is not null and y is not null")
    p = p.mapInPandas(batches, out).groupBy(ds, "part").applyInPandas(lambda pdf: reduce(pdf, pdf["part"].iloc[0]), out)
    return p.groupBy(ds).applyInPandas(lambda pdf: reduce(pdf, 0), out).drop("part")


def direction(points: DataFrame, ds: str = "ds") -> DataFrame:
    """DSN1: the bearing (degrees from the x axis, 0 to 180) of the long side of the least rectangle about points, and its sides.

    That rectangle has a side along an edge of the hull, so the edges' angles are tried on its corners:
    points may be a boundary's vertices or all positions of a log.
    """
    v = cut(hull(points, ds))
    n = v.groupBy(ds).agg(F.count(F.lit(1)).alias("n"))
    to = v.select(ds, F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    edge = v.join(n, ds).withColumn("k2", (F.col("k") + 1) % F.col("n")).join(to, [ds, "k2"]).where("k <> k2")
    ang = edge.select(ds, F.bround(F.pmod(F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x")), F.lit(3.141592653589793)), 9).alias("a")).distinct()
    r = ang.join(v.select(ds, F.col("x").alias("px"), F.col("y").alias("py")), ds)
    u, w = F.col("px") * F.cos("a") + F.col("py") * F.sin("a"), F.col("py") * F.cos("a") - F.col("px") * F.sin("a")
    b = r.groupBy(ds, "a").agg((F.max(u) - F.min(u)).alias("l"), (F.max(w) - F.min(w)).alias("h"))
    best = b.groupBy(ds).agg(F.min(F.struct(F.bround(F.col("l") * F.col("h"), 6).alias("area"), "a", "l", "h")).alias("m"))
    return best.select(ds, F.pmod(F.degrees(F.col("m.a")) + F.when(F.col("m.l") >= F.col("m.h"), 0.0).otherwise(90.0), F.lit(180.0)).alias("angle"), F.greatest("m.l", "m.h").alias("long_m"), F.least("m.l", "m.h").alias("short_m"))


def order_key(seed: int, *cols: Column) -> Column:
    """A number in [0, 1000003) from integers by modular arithmetic that any engine repeats."""
    out = F.lit(seed % 1_000_003).cast("long")
    for c in cols:
        out = F.pmod((out * 7919 + c.cast("long") + 12_345) * 104_729, F.lit(1_000_003))
    return out


def assign_strips(cells: DataFrame, rates: list[float], width: float, blocks: int = 4, angle_deg: float = 0.0, seed: int = 42, ds: str = "ds") -> DataFrame:
    """DSN2, DSN3: strip, block and rate of each cell or point (x, y).

    The field is turned by the angle about its centre, strips count from its low side; each
    block is one random order of all rates (seeded).  Cells beyond the complete blocks, and
    fields that take fewer strips than rates, get none.
    """
    k = len(rates)
    a = F.radians(F.lit(float(angle_deg)))
    c = cells.groupBy(ds).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    p = cells.join(c, ds).withColumn("_v", (F.col("y") - F.col("_cy")) * F.cos(a) - (F.col("x") - F.col("_cx")) * F.sin(a))
    e = p.groupBy(ds).agg(F.min("_v").alias("_v0"), F.max("_v").alias("_v1")).withColumn("_strips", F.floor((F.col("_v1") - F.col("_v0")) / width))
    e = e.withColumn("_blocks", F.least(F.lit(blocks), F.floor(F.col("_strips") / k))).where("_blocks >= 1")
    plan = e.select(ds, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks").cast("long") - 1)).alias("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    w = Window.partitionBy(ds, "block").orderBy(order_key(seed, F.col(ds), F.col("block"), F.col("i")), "i")
    plan = plan.withColumn("strip", F.col("block") * k + F.row_number().over(w) - 1).withColumn("rate", F.element_at(F.array(*[F.lit(float(r)) for r in rates]), F.col("i") + 1)).drop("i")
    out = p.join(e.select(ds, "_v0"), ds).withColumn("strip", F.floor((F.col("_v") - F.col("_v0")) / width).cast("long"))
    return out.join(plan, [ds, "strip"]).drop("_cx", "_cy", "_v", "_v0")


def layout_summary(assigned: DataFrame, cell_area: float, min_area: float = 0.0, ds: str = "ds") -> DataFrame:
    """DSN4, DSN5: strips and hectares by rate, without strips below min_area (m2)."""
    s = assigned.groupBy(ds, "strip", "rate").agg((F.count(F.lit(1)) * cell_area).alias("area")).where(F.col("area") >= min_area)
    return s.groupBy(ds, "rate").agg(F.count(F.lit(1)).alias("reps"), (F.sum("area") / 1e4).alias("area_ha"))


def layout_warnings(summary: DataFrame, blocks: int, ds: str = "ds") -> DataFrame:
    """DSN4: (ds, code) of layouts (ds, rate, reps) with fewer complete blocks than asked for, or with one only."""
    n = summary.groupBy(ds).agg(F.min("reps").alias("n"))
    codes = F.array(F.when(F.col("n") < blocks, F.lit("fewer_blocks")), F.when(F.col("n") == 1, F.lit("single_block")))
    return n.select(ds, F.explode(F.array_compact(codes)).alias("code"))


def footprint(points: DataFrame, size: float, ds: str = "ds") -> DataFrame:
    """DSN6: the cells that hold a point, as the field where no boundary is declared."""
    return points.where("x is not null and y is not null").select(ds, F.floor(F.col("y") / size).alias("row"), F.floor(F.col("x") / size).alias("col")).distinct()


def overlay(cells: DataFrame, edges: DataFrame, size: float, samples: int = 3, ds: str = "ds") -> DataFrame:
    """JN8: (ds, row, col, feature): the polygon that covers more than half of a cell, by samples x samples points a cell.

    edges: (ds, feature, x1, y1, x2, y2).  A point meets only the edges of its own row of
    cells: an edge is sent to the rows that it crosses, then rays are counted.
    """
    r0, r1 = F.floor(F.least("y1", "y2") / size).cast("long"), F.floor(F.greatest("y1", "y2") / size).cast("long")
    e = edges.withColumn("row", F.explode(F.sequence(r0, r1))).withColumnRenamed(ds, "_ds").withColumnRenamed("row", "_row")
    k = F.sequence(F.lit(0), F.lit(samples - 1))
    p = cells.select(ds, "row", "col").withColumn("i", F.explode(k)).withColumn("j", F.explode(k))
    p = p.withColumns({"px": (F.col("col") + (F.col("i") + 0.5) / samples) * size, "py": (F.col("row") + (F.col("j") + 0.5) / samples) * size})
    cross = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < F.col("x1") + (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)))
    hit = p.join(e, (F.col(ds) == F.col("_ds")) & (F.col("row") == F.col("_row"))).where(cross).groupBy(ds, "row", "col", "i", "j", "feature").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1")
    share = hit.groupBy(ds, "row", "col", "feature").agg((F.count(F.lit(1)) / float(samples * samples)).alias("share"))
    w = Window.partitionBy(ds, "row", "col").orderBy(F.desc("share"), "feature")
    return share.withColumn("_k", F.row_number().over(w)).where("_k = 1 and share > 0.5").drop("_k")
