"""The thirteen cleaning steps, their presets and reports.

Every step is a flag over all rows; a row keeps the first reason in step order.  Only the
short-pass, global and local outlier steps look at the rows still alive, so the plan has one
windowed pass for the others and a stage for each of these.  A step without its columns is
skipped.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.lineage import cut, keyed
from fieldweave.operators import spatial, track

#: Step order.
STEPS = [
    "null_value", "position", "value_range", "moisture", "speed_range", "speed_change", "swath_partial",
    "short_pass", "pass_ends", "overlap", "boundary", "global_outlier", "local_outlier",
]
DEFAULTS: dict[str, dict[str, Any]] = {
    "null_value": {"drop_zero": True, "drop_negative": True},
    "position": {"max_jump_m": 25.0, "drop_duplicates": True},
    "value_range": {"min": None, "max": None},
    "moisture": {"min": 5.0, "max": 40.0},
    "speed_range": {"min": 1.5, "max": 20.0},
    "speed_change": {"max_change_pct": 25.0},
    "swath_partial": {"min_fraction": 0.5},
    "short_pass": {"min_points": 8},
    "pass_ends": {"start_m": 6.0, "end_m": 6.0},
    "overlap": {"max_overlap_pct": 40.0},
    "boundary": {"buffer_m": 0.0},
    "global_outlier": {"method": "std", "k": 3.0, "lower_pct": 1.0, "upper_pct": 99.0},
    "local_outlier": {"k_neighbors": 12, "threshold": 3.5},
}

# The starting configuration of each operation.  A step that is not named is off.
PRESETS: dict[str, dict[str, Any]] = {
    "harvest": {
        "flow_delay_s": 12.0, "null_value": {}, "position": {"max_jump_m": 25.0}, "moisture": {}, "speed_range": {}, "speed_change": {}, "swath_partial": {"min_fraction": 0.5},
        "short_pass": {"min_points": 8}, "pass_ends": {"start_m": 6.0, "end_m": 6.0}, "overlap": {"max_overlap_pct": 40.0}, "global_outlier": {"k": 3.0}, "local_outlier": {"threshold": 3.5},
    },
    "application": {
        "flow_delay_s": 0.0, "null_value": {"drop_zero": False}, "position": {"max_jump_m": 30.0}, "speed_range": {"min": 1.0, "max": 30.0}, "swath_partial": {"min_fraction": 0.3},
        "short_pass": {"min_points": 5}, "pass_ends": {"start_m": 3.0, "end_m": 3.0}, "overlap": {"max_overlap_pct": 50.0}, "global_outlier": {"method": "percentile", "lower_pct": 0.5, "upper_pct": 99.5},
    },
    "planting": {
        "flow_delay_s": 0.0, "null_value": {}, "position": {"max_jump_m": 25.0}, "speed_range": {"min": 2.0, "max": 15.0}, "speed_change": {"max_change_pct": 30.0}, "swath_partial": {"min_fraction": 0.5},
        "short_pass": {"min_points": 8}, "pass_ends": {"start_m": 4.0, "end_m": 4.0}, "overlap": {"max_overlap_pct": 40.0}, "global_outlier": {"k": 3.5}, "local_outlier": {"threshold": 4.0},
    },
    "vigor": {
        "flow_delay_s": 0.0, "null_value": {"drop_zero": False}, "position": {"max_jump_m": 30.0}, "speed_range": {"min": 0.5, "max": 30.0},
        "global_outlier": {"method": "percentile", "lower_pct": 0.5, "upper_pct": 99.5},
    },
    "minimal": {"flow_delay_s": 0.0, "null_value": {}, "position": {"max_jump_m": 50.0}},
}


def preset_for(operation: str | None) -> str:
    """CLN14: the preset of an operation; an unknown one is cleaned minimally."""
    return operation if operation in PRESETS else "minimal"


def _params(step: str, given: dict) -> dict:
    """Given parameters over the defaults; None means the default, but for the two open bounds."""
    return DEFAULTS[step] | {k: v for k, v in given.items() if v is not None or k in ("min", "max")}


def _outside(c: Column, lo, hi) -> Column:
    out = F.lit(False)
    if lo is not None:
        out = out | (c < F.lit(float(lo)))
    if hi is not None:
        out = out | (c > F.lit(float(hi)))
    return F.coalesce(out, F.lit(False))


def null_value(p: dict) -> Column:
    """CLN1."""
    v = F.col("value")
    bad = v.isNull()
    if p["drop_negative"]:
        bad = bad | (v < 0)
    if p["drop_zero"]:
        bad = bad | (v == 0)
    return F.coalesce(bad, F.lit(True))


def position(p: dict, ds: str = "ds") -> Column:
    """CLN2: no place, a place that an earlier row has (to 3 decimals), or a jump."""
    missing = F.col("x").isNull() | F.col("y").isNull()
    bad = missing
    if p["drop_duplicates"]:
        same = Window.partitionBy(ds, F.bround("x", 3), F.bround("y", 3)).orderBy("rn")
        bad = bad | (~missing & (F.row_number().over(same) > 1))
    if p["max_jump_m"]:
        w = track.in_order(ds)
        bad = bad | F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) > F.lit(float(p["max_jump_m"])), F.lit(False))
    return bad


def value_range(p: dict) -> Column:
    """CLN3."""
    return _outside(F.col("value"), p["min"], p["max"])


def moisture(p: dict) -> Column:
    """CLN4: a missing moisture stays."""
    return _outside(F.col("moisture_pct"), p["min"], p["max"])


def speed_range(p: dict) -> Column:
    """CLN5: a missing speed goes.  0 and None are no bound."""
    return F.col("speed_kmh").isNull() | _outside(F.col("speed_kmh"), p["min"] or None, p["max"] or None)


def speed_change(p: dict, ds: str = "ds") -> Column:
    """CLN6: relative change to the previous row, across passes."""
    before = F.lag("speed_kmh").over(track.in_order(ds))
    change = F.when(before > 0, F.abs(F.col("speed_kmh") - before) / before)
    return F.coalesce(change * 100 > F.lit(float(p["max_change_pct"])), F.lit(False))


def swath_partial(df: DataFrame, p: dict, ds: str = "ds") -> DataFrame:
    """CLN7: narrower than a share of the log's 90th percentile; skipped below 10 valid widths.

    The percentile is one value per log, joined back (logs are far fewer than rows).
    """
    good = F.when(F.col("swath_m") > 0, F.col("swath_m"))
    ref = df.groupBy(ds).agg(F.percentile(good, F.lit(0.9)).alias("_p90"), F.count(good).alias("_n"))
    bad = (F.col("_n") >= 10) & F.coalesce((F.col("swath_m") <= 0) | (F.col("swath_m") < F.lit(float(p["min_fraction"])) * F.col("_p90")), F.lit(True))
    return df.join(keyed(ref), ds).withColumn("f_swath_partial", bad).drop("_p90", "_n")


def pass_ends(p: dict, ds: str = "ds") -> Column:
    """CLN9: the first and last metres of each pass by distance travelled, over all rows."""
    w = Window.partitionBy(ds, "pass_id")
    d = F.coalesce("distance_m", F.lit(0.0))
    upto = F.sum(d).over(w.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(d).over(w)
    start, end = float(p["start_m"] or 0), float(p["end_m"] or 0)
    bad = F.lit(False)
    if start > 0:
        bad = bad | (upto < start)
    if end > 0:
        bad = bad | (total - upto < end)
    return bad


def _box(df: DataFrame, ds: str, max_cells: float = 24e6) -> tuple[DataFrame, DataFrame]:
    """The rows with a place and a width, and for each log of ten of them (ds, cell, samples, ox, oy).

    The cell is an eighth of the median swath within 0.5 to 2 m, enlarged by halves until the
    log's box has at most max_cells.
    """
    valid = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("swath_m") > 0)
    v = df.where(valid)
    box = v.groupBy(ds).agg(
        F.percentile("swath_m", F.lit(0.5)).alias("med"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")
    )
    box = box.where("n >= 10").withColumn("cell", F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("med") / 8)))
    cells = ((F.col("x1") - F.col("x0") + 2 * F.col("med")) / F.col("cell") + 1) * ((F.col("y1") - F.col("y0") + 2 * F.col("med")) / F.col("cell") + 1)
    grow = F.greatest(F.lit(0), F.ceil(F.log(cells / F.lit(max_cells)) / F.log(F.lit(2.25)))).cast("double")
    box = box.withColumn("cell", F.when(cells > max_cells, F.col("cell") * F.pow(F.lit(1.5), grow)).otherwise(F.col("cell")))
    box = box.withColumn("samples", F.greatest(F.lit(3), F.ceil(F.col("med") / F.col("cell")) + 1).cast("int"))
    return v, box.select(ds, "cell", "samples", (F.col("x0") - F.col("med")).alias("ox"), (F.col("y0") - F.col("med")).alias("oy"))


def _at(c: str, origin: str, off: Column | None = None) -> Column:
    """The cell of a coordinate, moved by off, from its log's origin."""
    place = F.col(c) if off is None else F.col(c) + off
    return F.floor((place - F.col(origin)) / F.col("cell")).cast("long")


def _sample(c: str, origin: str, part: Column, k: Column) -> Column:
    """The cell of the k-th place across a row's swath."""
    return _at(c, origin, part * (F.col("swath_m") * (k / (F.col("samples") - 1) - 0.5)))


def coverage(df: DataFrame, ds: str = "ds", max_cells: float = 24e6) -> DataFrame:
    """CLN10's samples: (ds, rn, k, cell, row, col) of each place across each row's swath."""
    v, box = _box(df, ds, max_cells)
    j = v.join(keyed(box), ds).select(ds, "rn", "x", "y", "swath_m", F.radians(F.coalesce("heading_deg", F.lit(0.0))).alias("h"), "cell", "samples", "ox", "oy", F.explode(F.expr("sequence(0, samples - 1)")).alias("k"))
    return j.select(ds, "rn", "k", "cell", _sample("y", "oy", -F.sin("h"), F.col("k")).alias("row"), _sample("x", "ox", F.cos("h"), F.col("k")).alias("col"))


def overlap(df: DataFrame, p: dict, ds: str = "ds") -> DataFrame:
    """CLN10: (ds, rn, covered share) where a row's swath lies on ground that an earlier row covered."""
    s = coverage(df, ds)
    first = F.min("rn").over(Window.partitionBy(ds, "row", "col"))
    return s.withColumn("before", (first < F.col("rn")).cast("double")).groupBy(ds, "rn").agg(F.avg("before").alias("overlap"))


def boundary(df: DataFrame, p: dict, ds: str = "ds") -> DataFrame:
    """CLN11: (ds, rn) of rows nearer than buffer_m to ground that no row covered.

    A disc is one look-up for each row of cells that it meets: whether the cells from lo to col are all
    covered.  Each record sends its samples and its look-ups along once, and a running window over each
    row of cells keeps the last covered cell and where its run began.
    """
    v, box = _box(df, ds)
    h, reach = F.radians(F.coalesce("heading_deg", F.lit(0.0))), float(p["buffer_m"])
    near = lambda dr, dc: F.hypot(dr, dc) * F.col("cell") < reach
    r = F.ceil(F.lit(reach) / F.col("cell")).cast("int")
    # the columns that a disc has in each of its rows, one array a log
    arms = F.filter(F.transform(F.sequence(-r, r), lambda dr: F.struct(dr.alias("dr"), (F.size(F.filter(F.sequence(F.lit(0), r), lambda dc: near(dr, dc))) - 1).alias("w"))), lambda a: a["w"] >= 0)
    j = v.join(keyed(box.withColumn("arms", arms)), ds).withColumns({"h": h, "mr": _at("y", "oy"), "mc": _at("x", "ox")})
    none = F.lit(None).cast("long")
    samples = F.transform(F.sequence(F.lit(0), F.col("samples") - 1), lambda k: F.struct(_sample("y", "oy", -F.sin("h"), k).alias("row"), _sample("x", "ox", F.cos("h"), k).alias("col"), none.alias("lo"), none.alias("rn")))
    looks = F.transform("arms", lambda a: F.struct((F.col("mr") + a["dr"]).alias("row"), (F.col("mc") + a["w"]).alias("col"), (F.col("mc") - a["w"]).alias("lo"), F.col("rn").cast("long").alias("rn")))
    # dealt out by row of cells: a log's own task would sort all that it sends
    c = j.select(ds, F.explode(F.concat(samples, looks)).alias("c")).select(ds, "c.*").repartition(ds, "row")
    # nulls first: of the rows of a cell samples come before look-ups
    w = Window.partitionBy(ds, "row").orderBy("col", F.col("lo").asc_nulls_first())
    covered = F.when(F.col("lo").isNull(), F.col("col"))
    c = c.withColumns({"_before": F.last(covered, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_last": F.last(covered, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    begins = F.when(F.col("lo").isNull() & (F.col("_before").isNull() | (F.col("_before") < F.col("col") - 1)), F.col("col"))
    c = c.withColumn("_run", F.last(begins, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.coalesce((F.col("_last") == F.col("col")) & (F.col("_run") <= F.col("lo")), F.lit(False))
    return c.where(F.col("lo").isNotNull() & ~whole).select(ds, F.col("rn").cast(dict(df.dtypes)["rn"]).alias("rn")).distinct()


def global_outlier(alive: DataFrame, p: dict, ds: str = "ds") -> DataFrame:
    """CLN12: (ds, lo, hi) of the values still alive; logs of fewer than 20 have no limits."""
    if p["method"] == "std":
        k = float(p["k"])
        lo, hi = F.avg("value") - k * F.stddev_samp("value"), F.avg("value") + k * F.stddev_samp("value")
    else:
        lo, hi = (F.percentile("value", F.lit(float(p[x]) / 100)) for x in ("lower_pct", "upper_pct"))
    return alive.groupBy(ds).agg(lo.alias("lo"), hi.alias("hi"), F.count("value").alias("n")).where("n >= 20").select(ds, "lo", "hi")


def local_outlier(alive: DataFrame, p: dict, ds: str = "ds") -> DataFrame:
    """CLN13: (ds, rn, score) against the median and MAD of the nearest neighbours alive."""
    pts = alive.where("x is not null and y is not null").select(ds, F.col("rn").alias("id"), "x", "y", "value")
    k = int(p["k_neighbors"])
    enough = pts.groupBy(ds).agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.5)).alias("med")).where(F.col("n") >= k + 1)
    pts = pts.join(keyed(enough), ds)
    floor = pts.groupBy(ds).agg((F.percentile(F.abs(F.col("value") - F.col("med")), F.lit(0.5)) * 1.4826 * 0.1).alias("floor"))
    near = spatial.knn(cut(pts.select(ds, "id", "x", "y", "value")), k, ds).select(ds, "id", F.col("value").alias("own"), F.col("other_value").alias("v"))
    med = near.groupBy(ds, "id").agg(F.first("own").alias("own"), F.percentile("v", F.lit(0.5)).alias("m"), F.collect_list("v").alias("vs"))
    # k neighbours at most: their deviations are a short array
    dev = F.array_sort(F.transform("vs", lambda v: F.abs(v - F.col("m"))))
    n = F.size("dev")
    mid = (F.element_at("dev", F.floor((n + 1) / 2).cast("int")) + F.element_at("dev", F.floor(n / 2).cast("int") + 1)) / 2
    scored = med.withColumn("dev", dev).withColumn("mad", mid).join(keyed(floor), ds)
    scale = F.greatest(F.col("mad") * 1.4826, F.col("floor"))
    return scored.select(ds, F.col("id").alias("rn"), F.try_divide(F.abs(F.col("own") - F.col("m")), scale).alias("score"))


def run(points: DataFrame, preset: str | dict = "harvest", ds: str = "ds") -> DataFrame:
    """CLN15: the points with removal_reason (null: kept), all steps of the preset in order."""
    cfg = PRESETS[preset] if isinstance(preset, str) else preset
    df = track.derive(points, ds)
    if cfg.get("flow_delay_s"):
        df = track.flow_delay(df, cfg["flow_delay_s"], ds)
    on = {s: _params(s, cfg[s]) for s in STEPS if s in cfg}
    has = set(df.columns)
    flags: dict[str, Column] = {}
    if "null_value" in on and "value" in has:
        flags["null_value"] = null_value(on["null_value"])
    if "position" in on and {"x", "y"} <= has:
        flags["position"] = position(on["position"], ds)
    if "value_range" in on and "value" in has:
        flags["value_range"] = value_range(on["value_range"])
    if "moisture" in on and "moisture_pct" in has:
        flags["moisture"] = moisture(on["moisture"])
    if "speed_range" in on:
        flags["speed_range"] = speed_range(on["speed_range"])
    if "speed_change" in on:
        flags["speed_change"] = speed_change(on["speed_change"], ds)
    if "pass_ends" in on and "pass_id" in has:
        flags["pass_ends"] = pass_ends(on["pass_ends"], ds)
    df = df.withColumns({f"f_{k}": v for k, v in flags.items()})
    if "swath_partial" in on:
        df = swath_partial(df, on["swath_partial"], ds)
        flags["swath_partial"] = F.col("f_swath_partial")
    first = [s for s in STEPS[:7] if s in flags]
    reason = F.coalesce(*[F.when(F.col(f"f_{s}"), F.lit(s)) for s in first], F.lit(None).cast("string"))
    df = df.withColumn("removal_reason", reason)
    if "short_pass" in on and "pass_id" in has:
        alive = F.sum(F.col("removal_reason").isNull().cast("long")).over(Window.partitionBy(ds, "pass_id"))
        df = df.withColumn("_alive", alive)
        df = df.withColumn("removal_reason", F.coalesce("removal_reason", F.when(F.col("_alive") < int(on["short_pass"]["min_points"]), F.lit("short_pass")))).drop("_alive")
    if "pass_ends" in flags:
        df = df.withColumn("removal_reason", F.coalesce("removal_reason", F.when(F.col("f_pass_ends"), F.lit("pass_ends"))))
    df = df.drop(*[f"f_{s}" for s in flags])
    if "overlap" in on and {"x", "y"} <= has:
        limit = float(on["overlap"]["max_overlap_pct"]) / 100
        over = overlap(df, on["overlap"], ds).where(F.col("overlap") > limit).select(ds, "rn", F.lit("overlap").alias("_r"))
        df = df.join(keyed(over), [ds, "rn"], "left").withColumn("removal_reason", F.coalesce("removal_reason", "_r")).drop("_r")
    if "boundary" in on and float(on["boundary"]["buffer_m"] or 0) > 0:
        edge = boundary(df, on["boundary"], ds).select(ds, "rn", F.lit("boundary").alias("_r"))
        df = df.join(keyed(edge), [ds, "rn"], "left").withColumn("removal_reason", F.coalesce("removal_reason", "_r")).drop("_r")
    if "global_outlier" in on or "local_outlier" in on:
        df = cut(df)  # the survivors: what follows reads them several times
    if "global_outlier" in on:
        lim = global_outlier(df.where("removal_reason is null"), on["global_outlier"], ds)
        bad = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
        df = df.join(keyed(lim), ds, "left").withColumn("removal_reason", F.coalesce("removal_reason", F.when(bad, F.lit("global_outlier")))).drop("lo", "hi")
    if "local_outlier" in on:
        df = cut(df)
        score = local_outlier(df.where("removal_reason is null"), on["local_outlier"], ds)
        far = score.where(F.col("score") > float(on["local_outlier"]["threshold"])).select(ds, "rn", F.lit("local_outlier").alias("_r"))
        df = df.join(keyed(far), [ds, "rn"], "left").withColumn("removal_reason", F.coalesce("removal_reason", "_r")).drop("_r")
    return df


def removal_by_reason(cleaned: DataFrame, ds: str = "ds") -> DataFrame:
    """AGG5: rows and share of the log by reason."""
    by = cleaned.groupBy(ds, "removal_reason").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(ds))
    return by.withColumn("pct", 100.0 * F.col("n") / total).where("removal_reason is not null")


def step_report(cleaned: DataFrame, ds: str = "ds") -> DataFrame:
    """AGG6: removed and remaining after each step, in step order; steps that removed nothing too."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step")) for i, s in enumerate(STEPS, 1)])).alias("s")
    by = cleaned.groupBy(ds).pivot("removal_reason", STEPS).count().select(ds, *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in STEPS])
    total = cleaned.groupBy(ds).agg(F.count(F.lit(1)).alias("total"))
    long = by.join(total, ds).select(ds, "total", F.create_map(*[x for s in STEPS for x in (F.lit(s), F.col(s))]).alias("m"), steps)
    long = long.select(ds, "s.step_no", "s.step", "total", F.col("m")[F.col("s.step")].alias("removed"))
    upto = F.sum("removed").over(Window.partitionBy(ds).orderBy("step_no"))
    return long.select(ds, "step_no", "step", "removed", (F.col("total") - upto).alias("remaining"))


def assess(cleaned: DataFrame, ds: str = "ds") -> DataFrame:
    """AGG7: codes for what the cleaning did to a log: share removed, change of CV, shift of the mean."""
    kept = F.when(F.col("removal_reason").isNull(), F.col("value"))
    a = cleaned.groupBy(ds).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("removal_reason").isNotNull().cast("long")).alias("removed"),
        F.avg("value").alias("m0"), F.stddev_samp("value").alias("s0"), F.avg(kept).alias("m1"), F.stddev_samp(kept).alias("s1"),
    )
    pct = 100.0 * F.col("removed") / F.col("n")
    cv = F.try_divide(F.col("s1"), F.col("m1")) * 100 - F.try_divide(F.col("s0"), F.col("m0")) * 100
    shift = F.try_divide(F.col("m1") - F.col("m0"), F.col("m0")) * 100
    a = a.withColumns({"removed_pct": pct, "cv_delta": cv, "mean_shift_pct": shift})
    return a.select(
        ds, "removed_pct", "cv_delta", "mean_shift_pct",
        F.when(F.col("removed_pct") > 45, "alert").when((F.col("removed_pct") > 25) | (F.col("removed_pct") < 2), "warning").otherwise("ok").alias("removed_level"),
        F.when(F.col("cv_delta") > 2, "alert").when(F.col("cv_delta") < -3, "ok").otherwise("none").alias("cv_level"),
        F.when(F.abs("mean_shift_pct") > 8, "alert").otherwise("ok").alias("shift_level"),
    )
