"""Writers of distributed results: every one a plan that ends in Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_position_first(df: DataFrame) -> DataFrame:
    first = [c for c in ("lon", "lat") if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def write_csv(df: DataFrame, path: str) -> None:
    """SNK1: lon and lat first."""
    with_position_first(df).write.option("header", True).csv(path)


def as_features(df: DataFrame, *properties: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """SNK2: one GeoJSON feature a line, a point or a ring of (lon, lat); keep names columns that stay beside it."""
    if "ring" in df.columns:
        closed = F.concat(F.col("ring"), F.slice("ring", 1, 1))
        geometry = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")))
    else:
        geometry = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    props = F.to_json(F.struct(*properties))
    return df.select(*keep, F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), props, F.lit("}")).alias("value"))


def write_geojson(df: DataFrame, path: str, *properties: str) -> None:
    as_features(df, *properties).write.text(path)


def prescription_rows(df: DataFrame, *keep: str) -> DataFrame:
    """SNK3: centroids with eight decimals, rate and area."""
    return df.select(*keep, F.format_string("%.8f", "lon").alias("lon"), F.format_string("%.8f", "lat").alias("lat"), "rate", "area_ha")


def integer_grid(cells: DataFrame, scale: float, ds: str = "ds") -> DataFrame:
    """SNK6: (ds, row, values): rates as integers from the south row by row, missing cells 0; every row has the grid's full width."""
    box = cells.groupBy(ds).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    full = box.select(ds, F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1").select(ds, "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    v = F.rint(F.least(F.greatest(F.coalesce("rate", F.lit(0.0)) * scale, F.lit(0.0)), F.lit(2147483647.0))).cast("long")
    j = full.join(cells.select(ds, "row", "col", "rate"), [ds, "row", "col"], "left")
    return j.groupBy(ds, "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", v.alias("v")))), lambda s: s["v"]).alias("values"))


def write_cleaned(cleaned: DataFrame, path: str, ds: str = "ds") -> None:
    """SNK7: kept and removed records, partitioned by log."""
    cleaned.withColumn("kept", F.col("removal_reason").isNull()).write.partitionBy("kept", ds).parquet(path)


def write_terrain(path: str, **tables: DataFrame) -> None:
    """SNK8: one Parquet table each of cells, features, contour segments and drainage."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
