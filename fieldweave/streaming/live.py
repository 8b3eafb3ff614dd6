"""The row-local steps on a stream of points, late data and per-machine sessions included.

Every function takes and returns a DataFrame, streaming or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.operators import clean


def flag_rows(points: DataFrame, preset: str = "harvest") -> DataFrame:
    """CLN1, CLN3-5 of a preset: removal_reason of what a single row shows."""
    cfg = clean.PRESETS[clean.preset_for(preset)]
    own = {"null_value": clean.null_value, "value_range": clean.value_range, "moisture": clean.moisture, "speed_range": clean.speed_range}
    needs = {"null_value": "value", "value_range": "value", "moisture": "moisture_pct", "speed_range": "speed_kmh"}
    flags = [F.when(own[s](clean._params(s, cfg[s])), F.lit(s)) for s in clean.STEPS if s in own and s in cfg and needs[s] in points.columns]
    return points.withColumn("removal_reason", F.coalesce(*flags, F.lit(None).cast("string")))


def rolling_rates(points: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes", ds: str = "ds") -> DataFrame:
    """Mean value and records kept by log and window; rows later than the watermark are dropped."""
    p = points.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", watermark)
    a = p.where("removal_reason is null").groupBy(F.window("event_time", window), ds).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
    return a.select(ds, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "value")


def sessions(points: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour", ds: str = "ds") -> DataFrame:
    """DQ2 on a stream: work sessions divided by half an hour without a record."""
    p = points.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", watermark)
    return p.groupBy(ds, F.session_window("event_time", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(ds, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
