"""Rate levels, grid cells and the join of layers from different machines.

Every layer is aggregated to cells before it meets another, so joins are between small cell
tables on (ds, col, row); the partial aggregation runs before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.columns import cell


def rate_levels(points: DataFrame, rate: str = "applied_rate", max_levels: int = 12, valley: float = 0.02, min_mass: float = 0.03, ds: str = "ds") -> DataFrame:
    """AGG12: (ds, level), the treatment levels of each log.

    Up to max_levels distinct rates (3 decimals) are the levels.  Otherwise they are the
    medians of runs of occupied bins of the rate's histogram (a bin is occupied above the
    larger of 1 and a share of the fullest), where the run holds enough of the records and 2
    to max_levels such runs exist; else midpoints of equal-count bins.
    """
    v = points.where(F.col(rate).isNotNull()).select(ds, F.col(rate).cast("double").alias("r"))
    few = v.groupBy(ds).agg(F.collect_set(F.bround("r", 3)).alias("_unused"), F.countDistinct(F.bround("r", 3)).alias("k"), F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).drop("_unused")
    exact = v.join(few.where(F.col("k") <= max_levels).select(ds), ds, "left_semi").select(ds, F.bround("r", 3).alias("level")).distinct()
    many = few.where(F.col("k") > max_levels).withColumn("bins", F.greatest(F.lit(60), F.least(F.lit(400), F.floor(F.col("n") / 20).cast("int"))))
    b = v.join(many, ds).withColumn("bin", F.least(F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")).cast("int"), F.col("bins") - 1))
    counts = b.groupBy(ds, "n", "bin").agg(F.count(F.lit(1)).alias("c"))
    peak = F.max("c").over(Window.partitionBy(ds))
    occupied = counts.withColumn("peak", peak).where(F.col("c") > F.greatest(F.lit(1.0), F.col("peak") * valley))
    # gaps and islands: consecutive occupied bins share bin - row_number
    occupied = occupied.withColumn("run", F.col("bin") - F.row_number().over(Window.partitionBy(ds).orderBy("bin")))
    runs = occupied.groupBy(ds, "n", "run").agg(F.sum("c").alias("mass"), F.min("bin").alias("b0"), F.max("bin").alias("b1"))
    all_runs = F.count(F.lit(1)).over(Window.partitionBy(ds))
    heavy = runs.withColumn("all_runs", all_runs).where((F.col("mass") >= F.col("n") * min_mass) & (F.col("all_runs") >= 2))
    heavy = heavy.withColumn("kept", F.count(F.lit(1)).over(Window.partitionBy(ds))).where(F.col("kept").between(2, max_levels))
    inside = b.join(heavy.select(ds, "run", "b0", "b1"), ds).where(F.col("bin").between(F.col("b0"), F.col("b1")))
    dense = inside.groupBy(ds, "run").agg(F.percentile("r", F.lit(0.5)).alias("level")).select(ds, "level")
    rest = v.join(many.select(ds), ds, "left_semi").join(dense.select(ds).distinct(), ds, "left_anti")
    edges = rest.groupBy(ds).agg(F.array_distinct(F.percentile("r", F.array(*[F.lit(i / max_levels) for i in range(max_levels + 1)]))).alias("e"))
    mid = edges.select(ds, F.explode(F.expr("transform(sequence(0, size(e) - 2), i -> (e[i] + e[i + 1]) / 2)")).alias("level"))
    return exact.unionByName(dense).unionByName(mid)


def nearest_level(points: DataFrame, levels: DataFrame, rate: str = "applied_rate", ds: str = "ds") -> DataFrame:
    """JN9: each point's nearest level; the lower of two equally near.

    A log's levels are at most a dozen numbers: they come as one array a log.
    """
    arrays = levels.groupBy(ds).agg(F.sort_array(F.collect_set("level")).alias("_levels"))
    best = F.array_min(F.transform("_levels", lambda v: F.struct(F.abs(F.col(rate) - v).alias("d"), v.alias("v"))))
    return points.join(arrays, ds, "left").withColumn("level", F.when(F.col(rate).isNotNull(), best["v"])).drop("_levels")


def aggregate_cells(points: DataFrame, cell_m: float = 20.0, group: tuple[str, ...] = (), min_points: int = 3, ds: str = "ds") -> DataFrame:
    """AGG13: mean yield by (cell, level[, group]) from the absolute origin; at least min_points records."""
    v = points.where("x is not null and y is not null and level is not null and value is not null")
    a = v.groupBy(ds, cell("x", cell_m).alias("col"), cell("y", cell_m).alias("row"), F.col("level").alias("rate"), *group).agg(
        F.avg("value").alias("yield"), F.stddev_samp("value").alias("yield_sd"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")
    )
    return a.where(F.col("n") >= min_points)


def cell_means(layer: DataFrame, column: str, cell_m: float, origin: DataFrame, min_points: int = 1, ds: str = "ds") -> DataFrame:
    """AGG8: mean, sd, n and centroid of a continuous layer by cell from the origin (ds, ox, oy)."""
    v = layer.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(column).isNotNull()).join(origin, ds)
    a = v.groupBy(ds, cell("x", cell_m, F.col("ox")).alias("col"), cell("y", cell_m, F.col("oy")).alias("row")).agg(
        F.avg(column).alias("value"), F.stddev_samp(column).alias("sd"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")
    )
    return a.where(F.col("n") >= min_points)


def cell_levels(layer: DataFrame, column: str, cell_m: float, origin: DataFrame, min_points: int = 1, ds: str = "ds") -> DataFrame:
    """AGG9: the level that most records of a cell carry (the lower on a tie), its mean, n and purity.

    The layer has its level (JN9) in column ``level``.
    """
    v = layer.where("x is not null and y is not null and level is not null").join(origin, ds)
    a = v.groupBy(ds, cell("x", cell_m, F.col("ox")).alias("col"), cell("y", cell_m, F.col("oy")).alias("row"), "level").agg(F.avg(column).alias("measured"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(ds, "col", "row")
    a = a.withColumns({"total": F.sum("n").over(w), "_k": F.row_number().over(w.orderBy(F.desc("n"), "level"))})
    return a.where((F.col("_k") == 1) & (F.col("total") >= min_points)).withColumn("purity", F.col("n") / F.col("total")).drop("_k", "total")


def origin_of(yields: DataFrame, ds: str = "ds") -> DataFrame:
    """The grid's origin: the yield layer's least x and y."""
    return yields.where("x is not null and y is not null").groupBy(ds).agg(F.min("x").alias("ox"), F.min("y").alias("oy"))


def majority_label(points: DataFrame, label: str, cell_m: float, origin: DataFrame, ds: str = "ds") -> DataFrame:
    """JN2: the most frequent label of each cell, the smallest on a tie."""
    n = points.where(F.col(label).isNotNull()).join(origin, ds).groupBy(ds, cell("x", cell_m, F.col("ox")).alias("col"), cell("y", cell_m, F.col("oy")).alias("row"), label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(ds, "col", "row").orderBy(F.desc("n"), label)
    return n.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "n")


def join_layers(yields: DataFrame, rates: DataFrame, cell_m: float, min_points: int = 1, min_purity: float = 0.8, carry: str | None = None, ds: str = "ds") -> DataFrame:
    """JN1, AGG10: yield and rate layers on one grid; cells of mixed rates go; a label may be carried (JN2)."""
    origin = origin_of(yields, ds)
    y = cell_means(yields, "value", cell_m, origin, min_points, ds).select(ds, "col", "row", F.col("value").alias("yield"), F.col("n").alias("yield_n"), "x", "y")
    r = cell_levels(rates, "applied_rate", cell_m, origin, min_points, ds).select(ds, "col", "row", F.col("level").alias("rate"), "measured", F.col("n").alias("rate_n"), "purity")
    out = y.join(r, [ds, "col", "row"]).where(F.col("purity") >= min_purity)
    return out.join(majority_label(yields, carry, cell_m, origin, ds), [ds, "col", "row"], "left") if carry else out


def overlap_report(layers: dict[str, DataFrame], ds: str = "ds") -> DataFrame:
    """AGG10: cells of each layer, cells that all layers share, and the share kept; under half is flagged."""
    keys = {k: v.select(ds, "col", "row").distinct() for k, v in layers.items()}
    common = reduce(lambda a, b: a.join(b, [ds, "col", "row"]), keys.values()).groupBy(ds).agg(F.count(F.lit(1)).alias("common"))
    per = reduce(DataFrame.unionByName, [k.groupBy(ds).agg(F.count(F.lit(1)).alias("cells")).withColumn("layer", F.lit(n)) for n, k in keys.items()])
    out = per.join(common, ds, "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return out.withColumn("kept_pct", 100.0 * F.col("common") / F.col("cells")).withColumn("low", F.col("kept_pct") < 50)


def plan_deviation(cells: DataFrame, ds: str = "ds") -> DataFrame:
    """JN10: median absolute and relative deviation of the applied from the planned rate; over 15 % is flagged."""
    d = F.abs(F.col("applied") - F.col("plan"))
    a = cells.groupBy(ds).agg(F.percentile(d, F.lit(0.5)).alias("median_abs"), F.percentile(F.try_divide(d, F.col("plan")), F.lit(0.5)).alias("median_rel"))
    return a.withColumn("off_plan", F.coalesce(F.col("median_rel") > 0.15, F.lit(False)))


LADDER = (5, 10, 15, 20, 25, 30, 40, 50)


def suggest_cell(densities: DataFrame, ds: str = "ds") -> DataFrame:
    """AGG11: from (ds, role, density per ha) the cell that gives the sparsest layer but the plan about 8 records."""
    d = densities.where((F.col("role") != "plan") & (F.col("density") > 0)).groupBy(ds).agg(F.min("density").alias("d"))
    need = F.sqrt(F.lit(80_000.0) / F.col("d"))
    step = F.lit(60.0)
    for s in reversed(LADDER):
        step = F.when(need <= s, F.lit(float(s))).otherwise(step)
    return d.select(ds, step.alias("cell_m"))


def summary_by_rate(cells: DataFrame, price: float, cost: float, ds: str = "ds") -> DataFrame:
    """AGG14: cells, mean yield, sd and profit by rate."""
    a = cells.groupBy(ds, "rate").agg(F.count(F.lit(1)).alias("cells"), F.avg("yield").alias("yield"), F.stddev_samp("yield").alias("sd"))
    return a.withColumn("profit", F.col("yield") * price - F.col("rate") * cost)
