"""Unit conversion: factors to the internal metric units, as columns and as a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A pound in kg, an acre and an alqueire in ha, a US gallon in litres.
LB, AC, ALQ, GAL = 0.45359237, 0.40468564224, 2.42, 3.785411784
# Kg of a bushel by crop.
BUSHEL_KG = {
    "corn": 25.4012, "soybean": 27.2155, "wheat": 27.2155, "barley": 21.7724, "oats": 14.5150, "canola": 22.6796, "sorghum": 25.4012,
    "rice": 20.4117, "sunflower": 12.7006, "peas": 27.2155, "lentils": 27.2155, "flax": 25.4012, "rye": 25.4012,
}
DEFAULT_BUSHEL_KG = 25.4012
# Factor to the group's internal unit; None depends on the crop.
UNITS: dict[str, dict[str, float | None]] = {
    "rate_mass": {"kg/ha": 1.0, "t/ha": 1000.0, "sc/ha": 60.0, "lb/ac": LB / AC, "bu/ac": None, "g/m2": 10.0, "kg/ac": 1 / AC, "t/ac": 1000 / AC, "sc/alq": 60 / ALQ, "kg/alq": 1 / ALQ},
    "rate_volume": {"L/ha": 1.0, "gal/ac": GAL / AC, "gal/ha": GAL, "L/ac": 1 / AC, "mL/m2": 10.0},
    "rate_count": {"seeds/ha": 1.0, "seeds/ac": 1 / AC, "kseeds/ha": 1000.0, "kseeds/ac": 1000 / AC, "seeds/m2": 10_000.0},
    "area": {"ha": 1.0, "ac": AC, "alq": ALQ, "m2": 1e-4, "km2": 100.0},
    "mass": {"kg": 1.0, "t": 1000.0, "lb": LB, "sc": 60.0, "g": 0.001, "bu": None},
    "speed": {"km/h": 1.0, "mph": 1.609344, "m/s": 3.6, "kn": 1.852},
    "length": {"m": 1.0, "ft": 0.3048, "in": 0.0254, "cm": 0.01, "yd": 0.9144},
}
#: Which group converts which column.
GROUP_OF = {
    "value": "rate_mass", "target_rate": "rate_mass", "applied_rate": "rate_mass", "speed_kmh": "speed", "swath_m": "length", "distance_m": "length", "elev_m": "length",
}


def factor(group: str, unit: str, crop: str | None = None) -> float | None:
    """Factor to the internal unit; None for an unknown unit."""
    f = UNITS.get(group, {}).get(unit, 0.0)
    if f is None:
        kg = BUSHEL_KG.get((crop or "").lower(), DEFAULT_BUSHEL_KG)
        f = kg if group == "mass" else kg / AC
    return f or None


def table(spark: SparkSession) -> DataFrame:
    """(group, unit, crop, factor) of every unit; crop is null unless the unit depends on it."""
    rows = []
    for g, us in UNITS.items():
        for u, f in us.items():
            rows += [(g, u, None, factor(g, u))] if f is not None else [(g, u, c, factor(g, u, c)) for c in (None, *BUSHEL_KG)]
    return spark.createDataFrame(rows, "group string, unit string, crop string, factor double")


def apply_source_units(points: DataFrame, declared: DataFrame, ds: str = "ds") -> DataFrame:
    """PRJ4, PRJ9: multiply columns by the factors of the units declared by log.

    declared: (ds, column, unit, crop).  The factors of a log become one map, so the points
    join one narrow row; unknown units and columns stay as they are.
    """
    dim = table(points.sparkSession)
    groups = F.create_map(*[x for c, g in GROUP_OF.items() for x in (F.lit(c), F.lit(g))])
    d = declared.withColumn("group", groups[F.col("column")]).alias("d").join(dim.alias("u"), (F.col("d.group") == F.col("u.group")) & (F.col("d.unit") == F.col("u.unit")) & F.col("u.crop").eqNullSafe(F.when(F.col("u.crop").isNotNull(), F.lower("d.crop"))))
    best = d.groupBy(f"d.{ds}", "d.column").agg(F.max_by("u.factor", F.col("u.crop").isNotNull()).alias("f"))
    m = best.groupBy(ds).agg(F.map_from_entries(F.collect_list(F.struct("column", "f"))).alias("_f"))
    out = points.join(m, ds, "left")
    conv = {c: F.col(c) * F.coalesce(F.try_element_at("_f", F.lit(c)), F.lit(1.0)) for c in GROUP_OF if c in points.columns}
    return out.withColumns(conv).drop("_f")


def yield_unit(unit: str | Column, crop: str | Column | None = None) -> Column:
    """PRJ5: factor of a ``mass/area`` unit string to kg/ha; null for unknown parts."""
    unit = F.col(unit) if isinstance(unit, str) else unit
    parts = F.split(F.lower(F.trim(unit)), "/")
    kg = F.create_map(*[x for c, v in BUSHEL_KG.items() for x in (F.lit(c), F.lit(v))])
    bushel = F.coalesce(F.try_element_at(kg, F.lower(F.col(crop) if isinstance(crop, str) else crop)), F.lit(DEFAULT_BUSHEL_KG)) if crop is not None else F.lit(DEFAULT_BUSHEL_KG)
    mass = F.create_map(*[x for u, f in UNITS["mass"].items() if f for x in (F.lit(u), F.lit(f))])
    area = F.create_map(*[x for u, f in UNITS["area"].items() for x in (F.lit(u), F.lit(f))])
    top = F.when(parts[0] == "bu", bushel).otherwise(F.try_element_at(mass, parts[0]))
    return F.when(F.size(parts) == 2, top / F.try_element_at(area, F.try_element_at(parts, F.lit(2))))


def guess_speed_unit(points: DataFrame, ds: str = "ds") -> DataFrame:
    """PRJ6: m/s where the median of the positive speeds is under 4, else km/h."""
    m = points.groupBy(ds).agg(F.percentile(F.when(F.col("speed_kmh") > 0, F.col("speed_kmh")), F.lit(0.5)).alias("median"))
    return m.withColumn("unit", F.when(F.col("median") < 4, "m/s").otherwise("km/h"))


def elevation_unit_doubt(points: DataFrame, low: float = 2.0, high: float = 30.0, ds: str = "ds") -> DataFrame:
    """PRJ10: the median swath (from 20 values) is no width in metres, but is one in feet."""
    good = F.when(F.col("swath_m") > 0, F.col("swath_m"))
    m = points.groupBy(ds).agg(F.percentile(good, F.lit(0.5)).alias("median"), F.count(good).alias("n"))
    feet = F.col("median") * 0.3048
    return m.select(ds, "median", F.coalesce((F.col("n") >= 20) & ~F.col("median").between(low, high) & feet.between(low, high), F.lit(False)).alias("doubt"))


def to_unit(c: str | Column, group: str, unit: str, crop: str | None = None, digits: int | None = None) -> Column:
    """SNK5: from the internal unit to another."""
    c = (F.col(c) if isinstance(c, str) else c) / F.lit(factor(group, unit, crop) or 1.0)
    return F.bround(c, digits) if digits is not None else c
