"""Data-quality checks: one aggregate per log and check, findings as (ds, code, level, metrics)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.functions import units

# Plausible yields by crop, rates, and typical medians of speed and width by unit.
YIELD_RANGE = {
    "canola": (800, 6000), "wheat": (1000, 9000), "barley": (1000, 9000), "oats": (800, 7000), "peas": (800, 6000), "lentils": (500, 4000), "flax": (500, 3500),
    "rye": (800, 7000), "corn": (3000, 20000), "soybean": (1000, 7000), "sorghum": (1000, 12000), "rice": (2000, 12000), "sunflower": (800, 5000),
}
DEFAULT_YIELD_RANGE, RATE_RANGE = (500, 20000), (5.0, 600.0)
SPEED_HINTS = {"km/h": (3.0, 25.0), "mph": (2.0, 16.0), "m/s": (0.8, 7.0)}
LENGTH_HINTS = {"m": (2.0, 30.0), "ft": (8.0, 130.0)}
LEVELS = {"ok": 0, "warning": 1, "alert": 2}


def findings(df: DataFrame, ds: str, *checks: tuple[str, Column, dict[str, Column]]) -> DataFrame:
    """(ds, code, level, metrics) of each check (code, level, metrics) on one row per log; a null level is no finding."""
    rows = [F.struct(F.lit(code).alias("code"), level.alias("level"), F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v.cast("double"))]).alias("metrics")) for code, level, m in checks]
    return df.select(ds, F.explode(F.array(*rows)).alias("f")).select(ds, "f.*").where("level is not null")


def coverage(points: DataFrame, ds: str = "ds") -> DataFrame:
    """DQ1: density below 5 points a hectare; a box far larger than the area worked."""
    a = points.groupBy(ds).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("swath_m") * F.col("distance_m")) / 1e4).alias("area"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) / 1e4).alias("box"))
    d = F.try_divide(F.col("n"), F.col("area"))
    return findings(a, ds, ("density", F.when(d < 5, "warning").otherwise("ok"), {"per_ha": d, "area_ha": F.col("area")}), ("scattered", F.when((F.col("box") > 6 * F.col("area")) & (F.col("box") > 20), "warning"), {"box_ha": F.col("box")}))


def time_gaps(points: DataFrame, ds: str = "ds", gap_s: float = 1800.0) -> DataFrame:
    """DQ2: first and last stamp, duration, median interval, gaps over half an hour and the longest."""
    w = Window.partitionBy(ds).orderBy("timestamp", "seq")
    t = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6
    p = points.where("timestamp is not null").withColumn("_t", t).withColumn("_d", F.col("_t") - F.lag("_t").over(w))
    return p.groupBy(ds).agg(
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), ((F.max("_t") - F.min("_t")) / 3600).alias("hours"), F.percentile("_d", F.lit(0.5)).alias("median_s"),
        F.count_if(F.col("_d") > gap_s).alias("gaps"), F.max(F.when(F.col("_d") > gap_s, F.col("_d"))).alias("longest_s"),
    )


def sessions(points: DataFrame, gap: str = "30 minutes", ds: str = "ds") -> DataFrame:
    """DQ2 as session windows; the same on a stream with a watermark."""
    return points.groupBy(ds, F.session_window(F.col("timestamp").cast("timestamp"), gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(ds, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def columns_present(points: DataFrame, ds: str = "ds", wanted: tuple[str, ...] = ("value", "speed_kmh", "swath_m")) -> DataFrame:
    """DQ3: columns without a single value; the main variable is an alert, the others warnings; an elevation spread over 1000 m warns."""
    has = [F.count(F.col(c) if c in points.columns else F.lit(None)).alias(c) for c in wanted]
    spread = (F.max("elev_m") - F.min("elev_m")) if "elev_m" in points.columns else F.lit(None).cast("double")
    a = points.groupBy(ds).agg(*has, spread.alias("spread"))
    checks = [(f"no_{c}", F.when(F.col(c) == 0, "alert" if c == "value" else "warning"), {"n": F.col(c)}) for c in wanted]
    none_missing = reduce(Column.__and__, [F.col(c) > 0 for c in wanted])
    return findings(a, ds, *checks, ("columns", F.when(none_missing, "ok"), {"n": F.lit(len(wanted))}), ("relief", F.when(F.col("spread") > 1000, "warning"), {"spread_m": F.col("spread")}))


def value_quality(points: DataFrame, ds: str = "ds") -> DataFrame:
    """DQ4: shares of null, zero and negative values, repeated places (2 decimals), speeds outside 1 to 30."""
    v, s = F.col("value"), F.col("speed_kmh")
    place = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct(F.bround("x", 2), F.bround("y", 2)))
    n = F.count(F.lit(1))
    a = points.groupBy(ds).agg(
        (100.0 * F.count_if(v.isNull()) / n).alias("null_pct"), (100.0 * F.count_if(v == 0) / n).alias("zero_pct"), (100.0 * F.count_if(v < 0) / n).alias("negative_pct"),
        (100.0 * (F.count(place) - F.countDistinct(place)) / n).alias("duplicate_pct"), (100.0 * F.count_if((s < 1) | (s > 30)) / n).alias("speed_outside_pct"),
    )
    bad = F.col("null_pct") + F.col("zero_pct") + F.col("negative_pct")
    return a.withColumns({"values_level": F.when(bad > 25, "warning").otherwise("ok"), "places_level": F.when(F.col("duplicate_pct") > 5, "warning").otherwise("ok"), "speed_level": F.when(F.col("speed_outside_pct") > 20, "warning").otherwise("ok")})


def _only(median: Column, hints: dict) -> Column:
    """The one unit whose band holds the median, if just one does."""
    fit = F.filter(F.array(*[F.when(median.between(lo, hi), F.lit(u)) for u, (lo, hi) in hints.items()]), lambda u: u.isNotNull())
    return F.when(F.size(fit) == 1, fit[0])


def unit_candidates(points: DataFrame, crop: str | None = None, operation: str = "harvest", default_unit: str | None = None, ds: str = "ds") -> DataFrame:
    """DQ5: logs whose median value is implausible, and the declared unit that would explain it, best first.

    Ranked by the maker's usual unit, then by agreement with imperial speed or width, then by
    distance to the middle of the plausible range.
    """
    lo, hi = YIELD_RANGE.get(crop or "", DEFAULT_YIELD_RANGE) if operation == "harvest" else RATE_RANGE
    med = lambda c: F.when(F.count(F.when(F.col(c) > 0, 1)) >= 20, F.percentile(F.when(F.col(c) > 0, F.col(c)), F.lit(0.5)))
    m = points.groupBy(ds).agg(med("value").alias("median"), med("speed_kmh").alias("_v"), med("swath_m").alias("_w")).where("median is not null")
    imperial = F.coalesce((_only(F.col("_v"), SPEED_HINTS) == "mph") | (_only(F.col("_w"), LENGTH_HINTS) == "ft"), F.lit(False))
    rows = [(u, units.factor("rate_mass", u, crop), u == default_unit, u in ("bu/ac", "lb/ac", "kg/ac", "t/ac")) for u in units.UNITS["rate_mass"] if u != "kg/ha"]
    c = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(f).alias("f"), F.lit(d).alias("usual"), F.lit(i).alias("imp")) for u, f, d, i in rows])).alias("c")
    x = m.where(~F.col("median").between(lo, hi)).withColumn("imperial", imperial).select(ds, "median", "imperial", c).select(ds, "median", "imperial", "c.*")
    x = x.withColumn("kg_ha", F.col("median") * F.col("f")).where(F.col("kg_ha").between(lo, hi))
    order = Window.partitionBy(ds).orderBy(F.desc("usual"), F.desc(F.col("imperial") & F.col("imp")), F.abs(F.bround("kg_ha", 1) - (lo + hi) / 2), "unit")
    return x.withColumn("rank", F.row_number().over(order)).select(ds, "median", "unit", "kg_ha", "rank")


def verdict(found: DataFrame, ds: str = "ds") -> DataFrame:
    """DQ6: the worst level of each log and the step to take next."""
    rank = F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))])[F.col("level")]
    worst = found.groupBy(ds).agg(F.max(rank).alias("r"))
    return worst.select(ds, F.element_at(F.array(*[F.lit(k) for k in LEVELS]), F.col("r") + 1).alias("level"), F.when(F.col("r") == 2, "fix_input").when(F.col("r") == 1, "review").otherwise("clean").alias("next_step"))


def prescription_checks(rates: DataFrame, ds: str = "ds") -> DataFrame:
    """DQ7: feature count, coordinate range, null, negative and zero rates, rates over a million."""
    r, n = F.col("rate"), F.count(F.lit(1))
    a = rates.groupBy(ds).agg(
        n.alias("n"), F.count_if((F.abs("lon") > 180) | (F.abs("lat") > 90)).alias("off"), F.count_if(r.isNull()).alias("nulls"), F.count_if(r < 0).alias("negative"), F.count_if(r == 0).alias("zero"), F.max(r).alias("top")
    )
    lev = lambda c, word: F.when(c, F.lit(word))
    return findings(
        a, ds, ("too_many", lev(F.col("n") > 20_000, "warning"), {"n": F.col("n")}), ("off_globe", lev(F.col("off") > 0, "alert"), {"n": F.col("off")}), ("null_rates", lev(F.col("nulls") > 0, "alert"), {"n": F.col("nulls")}),
        ("negative_rates", lev(F.col("negative") > 0, "alert"), {"n": F.col("negative")}), ("all_zero", lev(F.col("zero") == F.col("n"), "alert"), {"n": F.col("zero")}), ("huge_rate", lev(F.col("top") > 1e6, "warning"), {"rate": F.col("top")}),
    )


def grid_checks(cells: DataFrame, shape: DataFrame, ds: str = "ds") -> DataFrame:
    """DQ8: cells against rows x cols of shape (ds, rows, cols), any positive rate, over two million cells."""
    a = cells.groupBy(ds).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rate") > 0).alias("pos")).join(shape, ds)
    return findings(
        a, ds, ("cell_count", F.when(F.col("n") != F.col("rows") * F.col("cols"), "alert"), {"n": F.col("n")}), ("no_rate", F.when(F.col("pos") == 0, "alert"), {"n": F.col("pos")}), ("large", F.when(F.col("n") > 2_000_000, "warning"), {"n": F.col("n")})
    )


def altitude_checks(points: DataFrame, column: str = "elev_m", ds: str = "ds") -> DataFrame:
    """DQ9: missing and non-numeric altitudes, fewer than 30 usable, coordinates that look swapped."""
    raw = F.col(column).cast("string")
    num = raw.try_cast("double")
    n = F.count(F.lit(1))
    a = points.groupBy(ds).agg(n.alias("n"), F.count_if(raw.isNull()).alias("missing"), F.count_if(raw.isNotNull() & num.isNull()).alias("text"), F.count(num).alias("usable"), (F.count_if(F.abs("lat") > 90) / n).alias("swap"))
    return findings(
        a, ds, ("altitude", F.when(F.col("usable") < 30, "alert").otherwise("ok"), {"usable": F.col("usable"), "missing": F.col("missing"), "text": F.col("text")}), ("swapped", F.when(F.col("swap") > 0.5, "alert"), {"share": F.col("swap")})
    )


def dimension(spark: SparkSession) -> DataFrame:
    """The plausible yield ranges as a table."""
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in YIELD_RANGE.items()], "crop string, low double, high double")
