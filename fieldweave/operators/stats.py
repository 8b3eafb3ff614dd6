"""Descriptive statistics per log: one aggregate each, exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.columns import pearson, ratio


def describe(df: DataFrame, column: str = "value", *keys: str) -> DataFrame:
    """AGG1: n, mean, sd (0 for one value), cv, min, percentiles, max, bias-corrected skew (0 up to two values)."""
    c, n = F.col(column), F.count(column)
    ps = F.percentile(c, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    a = df.groupBy(*keys).agg(
        n.alias("n"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd"), F.min(c).alias("min"), F.max(c).alias("max"), ps.alias("_p"),
        F.stddev_pop(c).alias("_sp"), F.when(F.stddev_pop(c) > 0, F.skewness(c)).alias("_g"),
    ).where("n > 0")
    nd = F.col("n").cast("double")
    skew = F.when((F.col("n") > 2) & (F.col("_sp") > 0), F.col("_g") * F.sqrt(nd * (nd - 1)) / F.nullif(nd - 2, F.lit(0.0))).otherwise(0.0)
    named = {k: F.col("_p")[i] for i, k in enumerate(("p05", "q1", "median", "q3", "p95"))}
    return a.withColumns(named | {"cv_pct": F.abs(ratio("sd", "mean")) * 100, "skew": skew}).drop("_p", "_sp", "_g")


def worked_area(df: DataFrame, ds: str = "ds") -> DataFrame:
    """AGG2: hectares worked, swath times distance."""
    return df.groupBy(ds).agg((F.sum(F.col("swath_m") * F.col("distance_m")) / 1e4).alias("area_ha"))


def ring_area(ring: Column) -> Column:
    """AGG2 for polygons: square metres of a ring (array of struct x, y) by the shoelace formula."""
    n = F.size(ring)
    term = lambda i: ring[i]["x"] * ring[F.pmod(i + 1, n)]["y"] - ring[F.pmod(i + 1, n)]["x"] * ring[i]["y"]
    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0.0), lambda a, x: a + x)
    return F.when(n >= 3, F.abs(total) / 2).otherwise(0.0)


def bounds(df: DataFrame, ds: str = "ds", x: str = "x", y: str = "y") -> DataFrame:
    """AGG3."""
    return df.groupBy(ds).agg(F.min(x).alias("x_min"), F.min(y).alias("y_min"), F.max(x).alias("x_max"), F.max(y).alias("y_max"))


def histogram(df: DataFrame, column: str = "value", bins: int = 30, ds: str = "ds") -> DataFrame:
    """AGG4: equal-width bins (the last one closed), empty bins listed with 0; a constant gets a box of width 1 about it."""
    v = df.where(F.col(column).isNotNull())
    r = v.groupBy(ds).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    r = r.select(ds, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    n = v.join(r, ds).groupBy(ds, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = r.select(ds, "lo", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(n, [ds, "bin"], "left").select(ds, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def rate_classes(df: DataFrame, driver: str, value: str, classes: int = 6, ds: str = "ds") -> DataFrame:
    """AGG15: value statistics by equal-count class of driver (right-closed; equal edges merge)."""
    v = df.where(F.col(driver).isNotNull() & F.col(value).isNotNull())
    edges = v.groupBy(ds).agg(F.array_distinct(F.percentile(driver, F.array(*[F.lit(i / classes) for i in range(classes + 1)]))).alias("edges"), F.count(F.lit(1)).alias("total")).where("total >= 10")
    k = F.greatest(F.size(F.filter("edges", lambda e: e < F.col(driver))), F.lit(1))
    return v.join(edges, ds).groupBy(ds, k.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(driver).alias("low"), F.max(driver).alias("high"))


def rate_reading(df: DataFrame, driver: str, value: str, classes: int = 6, ds: str = "ds") -> DataFrame:
    """AGG15: correlation, spread between class means (% of their mean) and its reading."""
    by = rate_classes(df, driver, value, classes, ds)
    spread = by.groupBy(ds).agg((F.try_divide(F.max("mean") - F.min("mean"), F.avg("mean")) * 100).alias("spread_pct"))
    r = df.groupBy(ds).agg(pearson(driver, value).alias("r"))
    word = F.when(F.col("spread_pct") < 5, "flat").when(F.col("r") < -0.3, "compensating").when(F.col("r") > 0.3, "reinforcing").otherwise("weak")
    return spread.join(r, ds).withColumn("reading", word)


def group_stats(df: DataFrame, value: str, *keys: str, ds: str = "ds") -> DataFrame:
    """AGG16: a group's statistics and its distance from the log's mean in percent."""
    field = df.groupBy(ds).agg(F.avg(value).alias("_mean"))
    a = df.groupBy(ds, *keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.25)).alias("p25"), F.percentile(value, F.lit(0.75)).alias("p75"), F.stddev_samp(value).alias("sd")
    )
    return a.join(field, ds).withColumn("delta_pct", ratio(F.col("mean") - F.col("_mean"), "_mean") * 100).drop("_mean")


def relations(df: DataFrame, value: str, drivers: list[str], ds: str = "ds") -> DataFrame:
    """AGG17: correlation of value with each driver, and the strongest by size."""
    a = df.groupBy(ds).agg(*[pearson(value, d).alias(d) for d in drivers])
    best = F.array_sort(F.filter(F.array(*[F.struct((-F.abs(F.col(d))).alias("k"), F.lit(d).alias("name"), F.col(d).alias("r")) for d in drivers]), lambda s: s["k"].isNotNull()))
    return a.withColumn("strongest", F.try_element_at(best, F.lit(1))["name"]).withColumnsRenamed({d: f"r_{d}" for d in drivers})


#: Speed limits in km/h and swath in m where a log cannot tell, by kind of machine.
MACHINE_DEFAULTS = {"harvest": (9.0, 2.0, 9.0), "application": (24.0, 5.0, 25.0), "planting": (12.0, 3.0, 14.0)}


def suggest_machine(df: DataFrame, kind: str = "harvest", ds: str = "ds") -> DataFrame:
    """AGG18: median positive swath (2 decimals) and p2 / p98 of speed to the outer half km/h, defaults below 20 speeds."""
    swath, low, high = MACHINE_DEFAULTS.get(kind, MACHINE_DEFAULTS["harvest"])
    good = lambda c: F.when(F.col(c) > 0, F.col(c))
    a = df.groupBy(ds).agg(
        F.percentile(good("swath_m"), F.lit(0.5)).alias("s"), F.percentile(good("speed_kmh"), F.lit(0.02)).alias("lo"), F.percentile(good("speed_kmh"), F.lit(0.98)).alias("hi"), F.count(good("speed_kmh")).alias("n")
    )
    enough = F.col("n") >= 20
    return a.select(
        ds,
        F.coalesce(F.bround("s", 2), F.lit(swath)).alias("swath_m"),
        F.when(enough, F.floor(F.col("lo") * 2) / 2).otherwise(low).alias("speed_min"),
        F.when(enough, F.ceil(F.col("hi") * 2) / 2).otherwise(high).alias("speed_max"),
    )


def map_scale(df: DataFrame, column: str = "value", ds: str = "ds", diverging: bool = False) -> DataFrame:
    """AGG19, AGG20: p2 and p98 with the extremes; a diverging layer is centred on 0."""
    p = F.percentile(column, F.array(F.lit(0.02), F.lit(0.98)))
    a = df.groupBy(ds).agg(p.alias("_p"), F.min(column).alias("min"), F.max(column).alias("max"))
    lo, hi = F.col("_p")[0], F.col("_p")[1]
    if diverging:
        top = F.greatest(F.abs(lo), F.abs(hi))
        lo, hi = -top, top
    return a.select(ds, lo.alias("low"), hi.alias("high"), "min", "max")


def systematic_sample(df: DataFrame, most: int = 60_000, ds: str = "ds") -> DataFrame:
    """Every ceil(n / most)-th row of each log in order of seq (§2.15)."""
    w = Window.partitionBy(ds)
    step = F.ceil(F.count(F.lit(1)).over(w) / F.lit(most))
    return df.withColumns({"_step": step, "_rn": F.row_number().over(w.orderBy("seq")) - 1}).where("_rn % _step = 0").drop("_step", "_rn")
