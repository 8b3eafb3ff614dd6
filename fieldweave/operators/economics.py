"""ECO10: from points with a rate and a yield to the rate that pays best, for all logs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.lineage import cut
from fieldweave.operators import layers, response, spatial


def analyze(points: DataFrame, price: float, cost: float, cell_m: float = 20.0, margin_m: float = 6.0, rate_max: float = 400.0, zone: str | None = None, models: tuple[str, ...] = response.MODELS, ds: str = "ds") -> dict[str, DataFrame]:
    """Levels, strip edges trimmed, cells, best fits, optimum, profit curve and summary by rate; by zone too if one is named."""
    levelled = layers.nearest_level(points, layers.rate_levels(points, ds=ds), ds=ds)
    trimmed = spatial.drop_strip_edges(levelled, margin_m, ds) if margin_m > 0 else levelled
    cells = cut(layers.aggregate_cells(trimmed, cell_m, (zone,) if zone else (), ds=ds))
    fits = cut(response.fit_best(cells, [ds], models))
    out = {
        "cells": cells,
        "fits": fits,
        "optimum": response.optimum(fits, [ds], price, cost, 0.0, rate_max),
        "curve": response.profit_curve(fits, [ds], price, cost, 0.0, rate_max),
        "by_rate": layers.summary_by_rate(cells, price, cost, ds),
    }
    if zone:
        by_zone = cut(response.fit_best(cells, [ds, zone], models))
        out["zone_optimum"] = response.optimum(by_zone, [ds, zone], price, cost, 0.0, rate_max)
        out["zone_gain"] = response.uniform_or_variable(cells, price, cost, rate_max, zone, ds, models)
    return out


def sampled_cells(cells: DataFrame, most: int = 8000, ds: str = "ds") -> DataFrame:
    """ECO11: at most so many cells of each log, chosen by hash."""
    name = F.md5(F.concat_ws("|", F.col("col"), F.col("row"), F.round(F.col("rate") * 1000).cast("long")).cast("binary"))
    w = Window.partitionBy(ds).orderBy(name, "col", "row", "rate")
    return cells.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")
