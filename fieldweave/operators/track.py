"""Ordered track derivation, one log (``ds``) at a time.

All windows partition by ``ds`` and order by time, then ``seq``; a missing time comes last.
A log is the unit of parallelism here: sequential operators shuffle once by ``ds``, and each
later window reuses that partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fieldweave.functions.columns import turn
from fieldweave.functions.lineage import keyed

#: Swath width where a log has none, in metres.
DEFAULT_SWATH = 9.0
MAX_GAP_S, PASS_TURN_DEG, DAMPING = 60.0, 35.0, 0.15
#: Rows that the native pass detection folds at a time.
FOLD_BLOCK = 256


def in_order(ds: str = "ds") -> WindowSpec:
    return Window.partitionBy(ds).orderBy("rn")


def sort_by_time(df: DataFrame, ds: str = "ds") -> DataFrame:
    """TRK1: row number ``rn`` in time order (timestamp, else elapsed_s, else seq); ties by seq."""
    key = next((c for c in ("timestamp", "elapsed_s") if c in df.columns), "seq")
    w = Window.partitionBy(ds).orderBy(F.col(key).asc_nulls_last(), "seq")
    return df.withColumn("rn", F.row_number().over(w))


def _first_as_second(c: Column, w: WindowSpec) -> Column:
    """A difference to the previous row, where the first row takes the second's."""
    return F.when(F.col("rn") == 1, F.lead(c).over(w)).otherwise(c)


def steps(df: DataFrame, ds: str = "ds") -> DataFrame:
    """TRK2, TRK3: distance_m and heading_deg from x and y where the log has none."""
    w = in_order(ds)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    df = df.withColumns({"_step": F.hypot(dx, dy), "_head": F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))})
    out = {}
    if "distance_m" not in df.columns:
        out["distance_m"] = _first_as_second(F.col("_step"), w)
    if "heading_deg" not in df.columns:
        out["heading_deg"] = _first_as_second(F.col("_head"), w)
    return (df.withColumns(out) if out else df).drop("_step", "_head")


def seconds(df: DataFrame, ds: str = "ds") -> DataFrame:
    """TRK4: dt_s to the previous record; 0 or less, or over a minute, is missing."""
    w = in_order(ds)
    if "timestamp" in df.columns:
        t = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6
    elif "elapsed_s" in df.columns:
        t = F.col("elapsed_s")
    else:
        return df.withColumn("dt_s", F.lit(None).cast("double"))
    df = df.withColumn("_t", t).withColumn("_dt", F.col("_t") - F.lag("_t").over(w))
    dt = _first_as_second(F.col("_dt"), w)
    return df.withColumn("dt_s", dt).withColumn("dt_s", F.when((F.col("dt_s") > 0) & (F.col("dt_s") <= MAX_GAP_S), F.col("dt_s"))).drop("_t", "_dt")


def speed(df: DataFrame, ds: str = "ds") -> DataFrame:
    """TRK5: speed_kmh from distance and dt, filled forward, then backward."""
    if "speed_kmh" in df.columns:
        return df
    w = in_order(ds)
    raw = F.try_divide(F.col("distance_m"), F.col("dt_s")) * 3.6
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_v", raw)
    return df.withColumn("speed_kmh", F.coalesce(F.last("_v", True).over(before), F.first("_v", True).over(after))).drop("_v")


def default_swath(df: DataFrame, swath: float = DEFAULT_SWATH) -> DataFrame:
    """TRK6: the given width where the log has none."""
    own = F.col("swath_m") if "swath_m" in df.columns else F.lit(None).cast("double")
    return df.withColumn("swath_m", F.coalesce(own, F.lit(swath)))


def detect_passes(df: DataFrame, tolerance: float = PASS_TURN_DEG, ds: str = "ds") -> DataFrame:
    """TRK7: pass_id from heading_deg.

    A new pass begins where the heading leaves a damped circular reference by more than the
    tolerance; a missing heading keeps the pass.  The reference depends on every row before,
    so this is a fold over one log, on an Arrow batch of that log's numbers only.
    """
    schema = f"{ds} {dict(df.dtypes)[ds]}, rn int, pass_id long"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["rn"].to_numpy(), kind="stable")
        head = pdf["heading_deg"].to_numpy(float)[order]
        new = np.zeros(len(head), np.int64)
        ref = 0.0 if head[0] != head[0] else head[0]
        # rows without a heading change nothing
        for i in (np.flatnonzero(head[1:] == head[1:]) + 1).tolist():
            off = (head[i] - ref + 180.0) % 360.0 - 180.0
            if abs(off) > tolerance:
                new[i], ref = 1, head[i]
            else:
                ref = (ref + DAMPING * off) % 360.0
        return pd.DataFrame({ds: pdf[ds], "rn": pdf["rn"].to_numpy()[order], "pass_id": np.cumsum(new)})

    passes = df.select(ds, "rn", "heading_deg").groupBy(ds).applyInPandas(fold, schema)
    return df.drop("pass_id").join(keyed(passes), [ds, "rn"])


def detect_passes_native(df: DataFrame, tolerance: float = PASS_TURN_DEG, ds: str = "ds") -> DataFrame:
    """TRK7 without Python: the same fold as higher-order functions over one log's headings.

    A first fold goes from block to block of ``FOLD_BLOCK`` rows and keeps the state in which each
    block begins; then the blocks, as rows of their own, number their records.  So an array
    that grows while it is folded has a block's length at most.  Returns (ds, rn, pass_id).
    """
    off = "(pmod(x.h - s.ref + 180D, 360D) - 180D)"

    def step(ids: str) -> str:
        more = lambda now: f", concat(s.ids, array({now})) as ids" if ids else ""
        return f"""
      case when s.ref is null then struct(coalesce(x.h, 0D) as ref, s.now as now{more("s.now")})
           when x.h is null then struct(s.ref as ref, s.now as now{more("s.now")})
           when abs({off}) > {tolerance}D then struct(x.h as ref, s.now + 1 as now{more("s.now + 1")})
           else struct(pmod(s.ref + {DAMPING}D * {off}, 360D) as ref, s.now as now{more("s.now")}) end"""

    logs = df.groupBy(ds).agg(F.sort_array(F.collect_list(F.struct("rn", F.col("heading_deg").alias("h")))).alias("rows"))
    blocks = logs.select(ds, F.expr(f"transform(sequence(1, size(rows), {FOLD_BLOCK}), i -> slice(rows, i, {FOLD_BLOCK}))").alias("blocks"))
    begin = "named_struct('ref', cast(null as double), 'now', 0L, 'seen', cast(array() as array<struct<ref: double, now: bigint>>))"
    seen = f"""aggregate(blocks, {begin},
      (b, rows) -> aggregate(rows, named_struct('ref', b.ref, 'now', b.now), (s, x) -> {step("")},
        s -> named_struct('ref', s.ref, 'now', s.now, 'seen', concat(b.seen, array(named_struct('ref', b.ref, 'now', b.now))))),
      b -> b.seen)"""
    each = blocks.select(ds, F.explode(F.arrays_zip("blocks", F.expr(seen).alias("seen"))).alias("b")).select(ds, F.col("b.blocks").alias("rows"), F.col("b.seen").alias("seen"))
    start = "named_struct('ref', seen.ref, 'now', seen.now, 'ids', cast(array() as array<bigint>))"
    ids = each.select(ds, F.expr(f"aggregate(rows, {start}, (s, x) -> {step('ids')}, s -> zip_with(rows.rn, s.ids, (r, p) -> struct(r as rn, p as pass_id)))").alias("z"))
    return ids.select(ds, F.explode("z").alias("z")).select(ds, "z.rn", "z.pass_id")


def flow_delay(df: DataFrame, delay_s: float, ds: str = "ds") -> DataFrame:
    """TRK8: each row takes the value measured delay_s later.

    k = round_half_even(delay / median dt) rows, over the whole log; the tail becomes missing.
    Nothing shifts where k is 0 or less, or where no interval is known.  The shift is an
    equi-join on (ds, rn + k), as a lead takes no offset from a column.
    """
    k = df.groupBy(ds).agg(F.coalesce(F.bround(F.try_divide(F.lit(float(delay_s)), F.percentile("dt_s", F.lit(0.5))), 0), F.lit(0)).cast("int").alias("_k"))
    df = df.join(k, ds)
    later = df.select(F.col(ds).alias("_ds"), (F.col("rn") - F.col("_k")).alias("_rn"), F.col("value").alias("_later"))
    on = (F.col(ds) == F.col("_ds")) & (F.col("rn") == F.col("_rn"))
    out = df.join(keyed(later), on, "left").withColumn("value", F.when(F.col("_k") > 0, F.col("_later")).otherwise(F.col("value")))
    return out.drop("_k", "_ds", "_rn", "_later")


def derive(df: DataFrame, ds: str = "ds", operation: str | None = None) -> DataFrame:
    """TRK1-7: everything a track lacks.  TRK9: an elevation layer is no track and stays as it is."""
    df = sort_by_time(df, ds)
    if operation == "elevation":
        return df
    df = default_swath(speed(seconds(steps(df, ds), ds), ds))
    return df if "pass_id" in df.columns else detect_passes(df, ds=ds)


def circular_difference(a: str, b: str) -> Column:
    """The absolute angle between two headings, 0 to 180."""
    return F.abs(turn(F.col(a) - F.col(b)))
