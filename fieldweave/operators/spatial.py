"""Spatial joins as equi-joins on grid cells.

A join by distance would be a nested loop; here every point carries the key of its cell and
looks at the cells around, so Spark sees an equi-join on (ds, col, row).  Cells are sized by
the distance asked for, so a point meets a bounded number of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.columns import cell
from fieldweave.functions.lineage import cut, keyed


def around(df: DataFrame, rings: int | Column = 1) -> DataFrame:
    """Each row once for every cell of the (2 rings + 1) squared block about its (row, col), as (nrow, ncol)."""
    r = rings if isinstance(rings, Column) else F.lit(rings)
    seq = F.sequence(-r, r)
    out = df.withColumn("_dr", F.explode(seq)).withColumn("_dc", F.explode(seq))
    return out.withColumns({"nrow": F.col("row") + F.col("_dr"), "ncol": F.col("col") + F.col("_dc")}).drop("_dr", "_dc")


def within(left: DataFrame, right: DataFrame, radius: float, ds: str = "ds") -> DataFrame:
    """Pairs of points at most radius apart: the columns of left, those of right as other_*, and dist."""
    a = around(left.withColumns({"row": cell("y", radius), "col": cell("x", radius)}))
    b = right.select(F.col(ds).alias("_ds"), *[F.col(c).alias(f"other_{c}") for c in right.columns if c != ds], cell("y", radius).alias("_row"), cell("x", radius).alias("_col"))
    on = (F.col(ds) == F.col("_ds")) & (F.col("nrow") == F.col("_row")) & (F.col("ncol") == F.col("_col"))
    dist = F.hypot(F.col("x") - F.col("other_x"), F.col("y") - F.col("other_y"))
    return a.join(keyed(b), on).withColumn("dist", dist).where(F.col("dist") <= radius).drop("_ds", "_row", "_col", "nrow", "ncol", "row", "col")


#: Points that a cell of the first round holds, in neighbours asked for: few enough to rank, enough that most settle.
CELL_SHARE = 0.7


def knn(points: DataFrame, k: int, ds: str = "ds") -> DataFrame:
    """JN4: the k nearest other points of each point (ds, id, x, y, ...), ties by id.

    Returns the point's columns, the neighbours' as other_*, d2 and rank.  A point looks at the nine cells about
    it and ranks what is nearer than the edge of that block; with k of those (or the whole log in the block) it is
    settled.  The others look again on a grid of coarser cells, nine at a time however far away they lie.  The first
    cell follows the spread of the middle nine tenths, so stray fixes do not widen it, and the last holds the log.
    In the first round, which settles most points, the neighbours are sent to the cells about them and the points
    stay in theirs, so that candidates meet where they are ranked, without a shuffle.  A point without a
    position, and the only one of its log, has no row.
    """
    placed = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    q = lambda c: F.percentile_approx(c, F.array(F.lit(0.05), F.lit(0.95)), 1000)
    box = placed.groupBy(ds).agg(F.count(F.lit(1)).alias("_n"), F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"), q("x").alias("_qx"), q("y").alias("_qy"))
    w, h, each = (F.col("_qx")[1] - F.col("_qx")[0]) / 0.9, (F.col("_qy")[1] - F.col("_qy")[0]) / 0.9, CELL_SHARE * k / F.col("_n")
    span = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    # a log along a line has no area
    box = box.select(ds, "_n", "_x0", "_y0", span.alias("_span"), F.greatest(F.sqrt(w * h * each), F.greatest(w, h) * each, span / 2**20, F.lit(1e-6)).alias("_size"))
    # one row a log
    p = cut(placed.join(keyed(box), ds))
    cols = [c for c in points.columns if c != ds]
    open_, done, step = p.where("_n > 1"), None, 0
    while True:
        size = F.col("_size") * F.lit(float(1 if step == 0 else 2 ** (2 * step - 1)))
        celled = lambda d: d.withColumns({"row": cell("y", size, F.col("_y0")), "col": cell("x", size, F.col("_x0"))})
        u, v = F.col("x") - F.col("_x0") - F.col("col") * size, F.col("y") - F.col("_y0") - F.col("row") * size
        edge = (F.least(u, size - u, v, size - v) + size) * (1 - 1e-9)
        a = celled(open_).withColumns({"_all": F.floor(F.col("_span") / size) <= 1, "_edge2": edge * edge})
        b = celled(p)
        if step == 0:
            a, b = a.withColumns({"nrow": F.col("row"), "ncol": F.col("col")}), around(b)
        else:
            a, b = around(a), b.withColumns({"nrow": F.col("row"), "ncol": F.col("col")})
        b = b.select(F.col(ds).alias("_ds"), *[F.col(c).alias(f"other_{c}") for c in cols], F.col("nrow").alias("_row"), F.col("ncol").alias("_col"))
        home = [ds, "nrow", "ncol", "id"] if step == 0 else [ds, "id"]
        d2 = (F.col("x") - F.col("other_x")) * (F.col("x") - F.col("other_x")) + (F.col("y") - F.col("other_y")) * (F.col("y") - F.col("other_y"))
        on = (F.col(ds) == F.col("_ds")) & (F.col("nrow") == F.col("_row")) & (F.col("ncol") == F.col("_col")) & (F.col("id") != F.col("other_id")) & (F.col("_all") | (d2 < F.col("_edge2")))
        near = a.join(keyed(b), on).withColumn("d2", d2).withColumn("rank", F.row_number().over(Window.partitionBy(*home).orderBy("d2", "other_id"))).where(F.col("rank") <= k)
        near = near.withColumn("_ok", F.col("_all") | (F.count(F.lit(1)).over(Window.partitionBy(*home)) >= F.least(F.lit(k), F.col("_n") - 1)))
        out = cut(near.where("_ok").select(ds, *cols, *[f"other_{c}" for c in cols], "d2", "rank"))
        done = out if done is None else done.unionByName(out)
        open_ = cut(open_.join(keyed(out.where("rank = 1").select(ds, "id")), [ds, "id"], "left_anti"))
        if open_.isEmpty():
            return done
        step += 1


def pairs_across_passes(points: DataFrame, radius: float, ds: str = "ds", max_pairs: float | None = None) -> DataFrame:
    """JN5: pairs of points of different passes (pass_id < other_pass_id) at most radius apart.

    With max_pairs, points are sampled so that about so many pairs are left, after an estimate
    from the counts by cell.
    """
    if max_pairs is not None:
        c = points.groupBy(ds, cell("y", radius).alias("row"), cell("x", radius).alias("col")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        expected = c.agg(F.sum(F.col("n") * F.col("n") * 4.5)).first()[0] or 0.0
        if expected > max_pairs:
            points = points.sample(fraction=(max_pairs / expected) ** 0.5, seed=1)
    return within(points, points, radius, ds).where("pass_id < other_pass_id")


def corridor_mean(stations: DataFrame, readings: DataFrame, radius: float, ds: str = "ds") -> DataFrame:
    """JN6: (ds, station, value, n): mean reading within radius of each station; null where there is none."""
    near = within(stations, readings.select(ds, "x", "y", "value"), radius, ds)
    agg = near.groupBy(ds, "station").agg(F.avg("other_value").alias("value"), F.count("other_value").alias("n"))
    return stations.select(ds, "station").join(keyed(agg), [ds, "station"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def drop_strip_edges(points: DataFrame, margin: float = 6.0, ds: str = "ds") -> DataFrame:
    """JN3: drop records with a record of another rate level within twice the margin.

    A log with fewer than 10 usable records or 2 levels, or that would lose 90 % of them, is
    kept whole, records without place or level included; else those go too.
    """
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("level").isNotNull()
    usable = points.where(ok)
    r = 2.0 * margin
    hit = within(usable.select(ds, "seq", "x", "y", "level"), usable.select(ds, "x", "y", "level"), r, ds).where((F.col("dist") < r) & (F.col("level") != F.col("other_level"))).select(ds, "seq").distinct()
    n = usable.groupBy(ds).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("level").alias("_l"))
    gone = hit.groupBy(ds).agg(F.count(F.lit(1)).alias("_g"))
    trim = n.join(gone, ds, "left").where((F.col("_n") >= 10) & (F.col("_l") >= 2) & (F.coalesce("_g", F.lit(0)) < 0.9 * F.col("_n"))).select(ds, F.lit(True).alias("_trim"))
    out = points.join(trim, ds, "left").join(keyed(hit.withColumn("_hit", F.lit(True))), [ds, "seq"], "left")
    return out.where(F.col("_trim").isNull() | (F.col("_hit").isNull() & ok)).drop("_trim", "_hit")
