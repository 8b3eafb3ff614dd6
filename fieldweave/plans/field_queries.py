"""Registered queries: units, projection, data quality and trial design over the machine log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions import crs, units
from fieldweave.operators import design, quality, stats
from fieldweave.plans.log_queries import r4
from fieldweave.sources.bench_log import bench_log, sql

QUERIES, SQL = {}, {}


def register(name: str, query: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if query:
            SQL[name] = sql(query)
        return f

    return keep


def _declared(log: DataFrame) -> DataFrame:
    d = log.select("ds").distinct()
    row = lambda c, u, crop=None: F.struct(F.lit(c).alias("column"), F.lit(u).alias("unit"), F.lit(crop).cast("string").alias("crop"))
    odd = F.array(row("value", "bu/ac", "Canola"), row("speed_kmh", "mph"), row("swath_m", "ft"))
    even = F.array(row("value", "bu/ac"), row("speed_kmh", "furlong"), row("elev_m", "ft"))
    return d.select("ds", F.explode(F.when(F.col("ds") % 2 == 1, odd).otherwise(even)).alias("u")).select("ds", "u.*")


@register("prj_units", "SELECT ds, seq, round(value * CASE WHEN ds % 2 = 1 THEN 22.6796e0 ELSE 25.4012e0 END / 0.40468564224e0, 4) + 0e0 AS value, round(CASE WHEN ds % 2 = 1 THEN speed_kmh * 1.609344e0 ELSE speed_kmh END, 6) AS speed_kmh, round(CASE WHEN ds % 2 = 1 THEN swath_m * 0.3048e0 ELSE swath_m END, 6) AS swath_m, round(CASE WHEN ds % 2 = 0 THEN elev_m * 0.3048e0 ELSE elev_m END, 6) AS elev_m FROM log")
def prj_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ4, PRJ9: declared units by log, crop-aware; an unknown unit changes nothing."""
    log = bench_log(spark, sf_dir)
    out = units.apply_source_units(log, _declared(log))
    return out.select("ds", "seq", (F.round("value", 4) + F.lit(0.0)).alias("value"), *[F.round(c, 6).alias(c) for c in ("speed_kmh", "swath_m", "elev_m")])


@register("prj_yield_unit", "SELECT ds, seq, round(value / CASE seq % 4 WHEN 0 THEN 60e0 WHEN 1 THEN 0.45359237e0 / 0.40468564224e0 WHEN 2 THEN 22.6796e0 / 0.40468564224e0 ELSE 1000e0 END, 6) + 0e0 AS value FROM log")
def prj_yield_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ5, SNK5: yields in the unit that each row names."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("sc/ha", "lb/ac", "bu/ac", "t/ha")]), (F.col("seq") % 4 + 1).cast("int"))
    return bench_log(spark, sf_dir).select("ds", "seq", (F.round(F.col("value") / units.yield_unit(unit, F.lit("canola")), 6) + F.lit(0.0)).alias("value"))


@register("prj_speed_unit", "SELECT ds, median(v) AS median, CASE WHEN median(v) < 4 THEN 'm/s' ELSE 'km/h' END AS unit FROM (SELECT ds, CASE WHEN ds % 2 = 0 THEN speed_kmh / 4 ELSE speed_kmh END AS v FROM log) WHERE v > 0 GROUP BY ds")
def prj_speed_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ6."""
    log = bench_log(spark, sf_dir)
    return units.guess_speed_unit(log.withColumn("speed_kmh", F.when(F.col("ds") % 2 == 0, F.col("speed_kmh") / 4).otherwise(F.col("speed_kmh"))))


@register("prj_elevation_doubt", "SELECT ds, median(w) AS median, count(w) >= 20 AND NOT median(w) BETWEEN 2 AND 30 AND median(w) * 0.3048e0 BETWEEN 2 AND 30 AS doubt FROM (SELECT ds, CASE WHEN ds % 2 = 0 THEN swath_m * 5 ELSE swath_m END AS w FROM log) GROUP BY ds")
def prj_elevation_doubt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ10."""
    log = bench_log(spark, sf_dir)
    return units.elevation_unit_doubt(log.withColumn("swath_m", F.when(F.col("ds") % 2 == 0, F.col("swath_m") * 5).otherwise(F.col("swath_m"))))


def _lonlat(log: DataFrame) -> DataFrame:
    """The log placed on the globe, a field for each ds."""
    return log.withColumns({"lon": F.lit(-105.8340) + F.col("ds") % 40 * 7 + F.col("x") / 70_000, "lat": F.when(F.col("ds") % 3 == 0, -1.0).otherwise(1.0) * (F.lit(50.4520) + F.col("y") / 111_000)})


_SERIES = lambda f, g: " + ".join(f"{a!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(crs._alpha, 1))


@register("prj_utm", f"""
p AS (SELECT ds, seq, -105.834e0 + ds % 40 * 7 + x / 70000 AS lon, CASE WHEN ds % 3 = 0 THEN -1e0 ELSE 1e0 END * (50.452e0 + y / 111000) AS lat FROM log),
m AS (SELECT ds, CAST(floor((median(lon) + 180) / 6) AS BIGINT) % 60 + 1 AS z, median(lat) < 0 AS south FROM p GROUP BY ds),
t AS (SELECT p.*, z, south, radians(lon - (z * 6 - 183)) AS lam, sinh(atanh(sin(radians(lat))) - {crs._E!r} * atanh({crs._E!r} * sin(radians(lat)))) AS t FROM p JOIN m ON m.ds = p.ds),
u AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t*t + cos(lam)*cos(lam))) AS eta FROM t)
SELECT ds, seq, CASE WHEN south THEN 32700 ELSE 32600 END + z AS epsg, round({crs.FALSE_EAST} + {crs.K0 * crs._R!r} * (eta + {_SERIES('cos', 'sinh')}), 3) AS x, round({crs.K0 * crs._R!r} * (xi + {_SERIES('sin', 'cosh')}) + CASE WHEN south THEN {crs.FALSE_NORTH} ELSE 0e0 END, 3) AS y, true AS same FROM u""")
def prj_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ2, PRJ3: into the field's UTM zone and back (tests compare with published coordinates)."""
    p = _lonlat(bench_log(spark, sf_dir)).select("ds", "seq", "lon", "lat")
    back = crs.to_lonlat(crs.project(p).withColumnsRenamed({"lon": "lon0", "lat": "lat0"}))
    return back.select("ds", "seq", F.col("epsg").cast("long").alias("epsg"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), (F.abs(F.col("lon") - F.col("lon0")) + F.abs(F.col("lat") - F.col("lat0")) < 1e-9).alias("same"))


@register("yr_align")
def yr_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YR5: every other record delivered in the next zone, and brought into the field's own."""
    p = crs.project(_lonlat(bench_log(spark, sf_dir)).select("ds", "seq", "lon", "lat"))
    z, south = F.pmod("epsg", F.lit(100)), F.col("epsg") >= 32700
    x, y = crs.forward(F.col("lon"), F.col("lat"), z + 1, south)
    odd = F.col("seq") % 2 == 1
    p = p.withColumns({"x1": x, "y1": y})
    mixed = p.select("ds", "seq", F.when(odd, F.col("x1")).otherwise(F.col("x")).alias("x"), F.when(odd, F.col("y1")).otherwise(F.col("y")).alias("y"), F.when(odd, F.col("epsg") + 1).otherwise(F.col("epsg")).alias("epsg"))
    a = crs.align(mixed, p.select("ds", "epsg").distinct()).join(p.select("ds", "seq", F.col("x").alias("x0"), F.col("y").alias("y0")), ["ds", "seq"])
    close = F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")) < 0.001
    return a.select("ds", "seq", F.col("epsg").cast("long").alias("epsg"), F.round("x0", 3).alias("x"), F.round("y0", 3).alias("y"), close.alias("close"))


SQL["yr_align"] = f"SELECT ds, seq, epsg, x, y, true AS close FROM ({SQL['prj_utm']})"


@register("prj_coercion", "SELECT event_id, try_cast(trim(json_extract_string(props, '$.k')) AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS bad FROM events".replace("SELECT", "SELECT", 1))
def prj_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1: text to numbers, what is none becomes null."""
    from fieldweave.functions.columns import number

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", number(F.get_json_object("props", "$.k")).alias("k"), number("event_type").alias("bad"))


@register("dq_coverage", "a AS (SELECT ds, count(*) AS n, sum(swath_m*distance_m)/1e4 AS area, (max(x)-min(x))*(max(y)-min(y))/1e4 AS box FROM log GROUP BY ds) SELECT ds, 'density' AS code, CASE WHEN n/area < 5 THEN 'warning' ELSE 'ok' END AS level, round(n/area, 4) AS metric FROM a UNION ALL SELECT ds, 'scattered', 'warning', round(box, 4) FROM a WHERE box > 6*area AND box > 20")
def dq_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ1."""
    f = quality.coverage(bench_log(spark, sf_dir))
    return r4(f.select("ds", "code", "level", F.coalesce(F.col("metrics")["per_ha"], F.col("metrics")["box_ha"]).alias("metric")))


@register("dq_time", "d AS (SELECT ds, timestamp, epoch(timestamp) AS t, epoch(timestamp) - lag(epoch(timestamp)) OVER (PARTITION BY ds ORDER BY timestamp, seq) AS d FROM log) SELECT ds, min(timestamp) AS start, max(timestamp) AS \"end\", round((max(t)-min(t))/3600, 4) AS hours, round(median(d), 4) AS median_s, count(CASE WHEN d > 1800 THEN 1 END) AS gaps, round(max(CASE WHEN d > 1800 THEN d END), 4) AS longest_s FROM d GROUP BY ds")
def dq_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ2."""
    return r4(quality.time_gaps(bench_log(spark, sf_dir)))


@register("dq_columns", "a AS (SELECT ds, count(CASE WHEN ds <> 3 THEN value END) AS v, count(CASE WHEN ds <> 4 THEN swath_m END) AS w FROM log GROUP BY ds) SELECT ds, 'no_value' AS code, 'alert' AS level FROM a WHERE v = 0 UNION ALL SELECT ds, 'no_swath_m', 'warning' FROM a WHERE w = 0 UNION ALL SELECT ds, 'columns', 'ok' FROM a WHERE v > 0 AND w > 0")
def dq_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ3."""
    log = bench_log(spark, sf_dir).withColumns({"value": F.when(F.col("ds") != 3, F.col("value")), "swath_m": F.when(F.col("ds") != 4, F.col("swath_m"))})
    return quality.columns_present(log).select("ds", "code", "level")


@register("dq_values", """
a AS (SELECT ds, 100e0*count(CASE WHEN value IS NULL THEN 1 END)/count(*) AS null_pct, 100e0*count(CASE WHEN value = 0 THEN 1 END)/count(*) AS zero_pct, 100e0*count(CASE WHEN value < 0 THEN 1 END)/count(*) AS negative_pct,
  100e0*(count(*)-count(DISTINCT (round(x,2), round(y,2))))/count(*) AS duplicate_pct, 100e0*count(CASE WHEN speed_kmh < 1 OR speed_kmh > 30 THEN 1 END)/count(*) AS speed_outside_pct FROM log GROUP BY ds)
SELECT ds, round(null_pct,4) AS null_pct, round(zero_pct,4) AS zero_pct, round(negative_pct,4) AS negative_pct, round(duplicate_pct,4) AS duplicate_pct, round(speed_outside_pct,4) AS speed_outside_pct,
  CASE WHEN null_pct+zero_pct+negative_pct > 25 THEN 'warning' ELSE 'ok' END AS values_level, CASE WHEN duplicate_pct > 5 THEN 'warning' ELSE 'ok' END AS places_level, CASE WHEN speed_outside_pct > 20 THEN 'warning' ELSE 'ok' END AS speed_level FROM a""")
def dq_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ4."""
    return r4(quality.value_quality(bench_log(spark, sf_dir)))


@register("dq_units", """
m AS (SELECT ds, median(CASE WHEN value > 0 THEN value / 10 END) AS median FROM log GROUP BY ds),
u AS (SELECT * FROM (VALUES ('t/ha', 1000e0, false), ('sc/ha', 60e0, false), ('lb/ac', 0.45359237e0/0.40468564224e0, false), ('bu/ac', 22.6796e0/0.40468564224e0, true), ('g/m2', 10e0, false), ('kg/ac', 1/0.40468564224e0, false), ('t/ac', 1000/0.40468564224e0, false), ('sc/alq', 60/2.42e0, false), ('kg/alq', 1/2.42e0, false)) AS u(unit, f, usual))
SELECT ds, round(median, 4) AS median, unit, round(median*f, 4) AS kg_ha, row_number() OVER (PARTITION BY ds ORDER BY usual DESC, abs(round(median*f, 1) - 3400), unit) AS rank FROM m, u WHERE NOT median BETWEEN 800 AND 6000 AND median*f BETWEEN 800 AND 6000""")
def dq_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ5: a canola log that reads like bushels."""
    log = bench_log(spark, sf_dir).withColumn("value", F.col("value") / 10)
    return r4(quality.unit_candidates(log, "canola", default_unit="bu/ac"))


@register("dq_verdict", "a AS (SELECT ds, CASE WHEN count(*) / (sum(swath_m*distance_m)/1e4) < 5 THEN 1 WHEN (max(x)-min(x))*(max(y)-min(y))/1e4 > greatest(6*sum(swath_m*distance_m)/1e4, 20) THEN 1 ELSE 0 END AS r FROM log GROUP BY ds) SELECT ds, ['ok', 'warning', 'alert'][r + 1] AS level, CASE WHEN r = 1 THEN 'review' ELSE 'clean' END AS next_step FROM a")
def dq_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ6."""
    log = bench_log(spark, sf_dir)
    return quality.verdict(quality.coverage(log).unionByName(quality.columns_present(log)))


@register("dq_prescription", "r AS (SELECT ds, applied_rate AS rate FROM log) SELECT ds, 'all_zero' AS code, 'alert' AS level FROM r GROUP BY ds HAVING count(CASE WHEN rate = 0 THEN 1 END) = count(*) UNION ALL SELECT ds, 'too_many', 'warning' FROM r GROUP BY ds HAVING count(*) > 20000 UNION ALL SELECT ds, 'negative_rates', 'alert' FROM log WHERE value < 0 GROUP BY ds")
def dq_prescription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ7: the values of the log taken as rates."""
    p = _lonlat(bench_log(spark, sf_dir)).withColumn("rate", F.col("value"))
    return quality.prescription_checks(p).select("ds", "code", "level")


@register("dq_altitude", "SELECT ds, 'altitude' AS code, CASE WHEN count(*) < 30 THEN 'alert' ELSE 'ok' END AS level, CAST(count(*) AS DOUBLE) AS usable FROM log WHERE seq % 9 <> 0 GROUP BY ds")
def dq_altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ9: one altitude in nine is text."""
    log = _lonlat(bench_log(spark, sf_dir)).withColumn("elev_m", F.when(F.col("seq") % 9 == 0, F.lit("n/a")).otherwise(F.col("elev_m").cast("string")))
    return quality.altitude_checks(log).select("ds", "code", "level", F.col("metrics")["usable"].alias("usable"))


@register("dsn_direction", "b AS (SELECT ds, max(x) - min(x) AS w, max(y) - min(y) AS h FROM log GROUP BY ds) SELECT ds, CASE WHEN w >= h THEN 0e0 ELSE 90e0 END AS angle, round(greatest(w, h), 4) AS long_m, round(least(w, h), 4) AS short_m FROM b")
def dsn_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DSN1: on the corners of each field's box."""
    b = stats.bounds(bench_log(spark, sf_dir))
    v = b.select("ds", F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("x_min", "x_max") for y in ("y_min", "y_max")])).alias("v")).select("ds", "v.*")
    return r4(design.direction(v))


_KEY = "(((((({s} * 7919 + ds + 12345) * 104729) % 1000003) * 7919 + block + 12345) * 104729) % 1000003 * 7919 + i + 12345) * 104729 % 1000003"


_STRIPS = """
fp AS (SELECT DISTINCT ds, CAST(floor(y / 9) AS BIGINT) AS row, CAST(floor(x / 9) AS BIGINT) AS col FROM log),
c AS (SELECT ds, row, col, (row + 0.5e0) * 9 AS v FROM fp),
e AS (SELECT ds, min(v) AS v0, least(2, floor(floor((max(v) - min(v)) / 18) / 3)) AS blocks FROM c GROUP BY ds),
pl AS (SELECT ds, block, i, block * 3 + row_number() OVER (PARTITION BY ds, block ORDER BY """ + _KEY.format(s=42) + """, i) - 1 AS strip FROM (SELECT ds, unnest(range(0, CAST(blocks AS BIGINT))) AS block FROM e WHERE blocks >= 1), (SELECT unnest(range(0, 3)) AS i)),
s AS (SELECT c.ds, CAST(floor((v - v0) / 18) AS BIGINT) AS strip FROM c JOIN e ON e.ds = c.ds)"""


@register("dsn_strips", _STRIPS + """
SELECT s.ds, s.strip, pl.block, [0e0, 60e0, 120e0][i + 1] AS rate, count(*) AS cells FROM s JOIN pl ON pl.ds = s.ds AND pl.strip = s.strip GROUP BY ALL""")
def dsn_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DSN2, DSN3, DSN6."""
    fp = design.footprint(bench_log(spark, sf_dir), 9.0).withColumns({"x": (F.col("col") + 0.5) * 9.0, "y": (F.col("row") + 0.5) * 9.0})
    a = design.assign_strips(fp, [0.0, 60.0, 120.0], 18.0, blocks=2)
    return r4(a.groupBy("ds", "strip", "block", "rate").agg(F.count(F.lit(1)).alias("cells")), "rate")


@register("dsn_summary", _STRIPS + ", u AS (SELECT s.ds, s.strip, [0e0, 60e0, 120e0][i + 1] AS rate, count(*) * 81e0 AS area FROM s JOIN pl ON pl.ds = s.ds AND pl.strip = s.strip GROUP BY ALL HAVING count(*) * 81e0 >= 500) SELECT ds, rate, count(*) AS reps, round(sum(area) / 1e4, 4) AS area_ha FROM u GROUP BY ds, rate")
def dsn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DSN4, DSN5."""
    fp = design.footprint(bench_log(spark, sf_dir), 9.0).withColumns({"x": (F.col("col") + 0.5) * 9.0, "y": (F.col("row") + 0.5) * 9.0})
    return r4(design.layout_summary(design.assign_strips(fp, [0.0, 60.0, 120.0], 18.0, blocks=2), 81.0, 500.0))


@register("dsn_warnings", _STRIPS + ", u AS (SELECT s.ds, s.strip, i AS rate, count(*) * 81e0 AS area FROM s JOIN pl ON pl.ds = s.ds AND pl.strip = s.strip GROUP BY ALL HAVING count(*) * 81e0 >= 500), r AS (SELECT ds, rate, count(*) AS reps FROM u GROUP BY ds, rate), n AS (SELECT ds, min(reps) AS n FROM r GROUP BY ds) SELECT ds, 'fewer_blocks' AS code FROM n WHERE n < 3 UNION ALL SELECT ds, 'single_block' FROM n WHERE n = 1")
def dsn_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DSN4: layouts with fewer blocks than three."""
    fp = design.footprint(bench_log(spark, sf_dir), 9.0).withColumns({"x": (F.col("col") + 0.5) * 9.0, "y": (F.col("row") + 0.5) * 9.0})
    return design.layout_warnings(design.layout_summary(design.assign_strips(fp, [0.0, 60.0, 120.0], 18.0, blocks=2), 81.0, 500.0), 3)


@register("dsn_guards", "SELECT ds, 'fewer strips than rates' AS reason FROM log GROUP BY ds HAVING floor((max(x) - min(x)) / 60) < 5")
def dsn_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DSN7."""
    f = bench_log(spark, sf_dir).groupBy("ds").agg((F.max("x") - F.min("x")).alias("extent")).withColumn("vertices", F.lit(4))
    return design.guards(f, [0.0, 45.0, 90.0, 135.0, 180.0], 2, 60.0)


@register("jn_overlay", """
fp AS (SELECT DISTINCT ds, CAST(floor(y / 9) AS BIGINT) AS row, CAST(floor(x / 9) AS BIGINT) AS col FROM log),
g AS (SELECT ds, row, col, f.f AS feature, count(*) / 9e0 AS share FROM fp, (SELECT unnest([0, 1, 2]) AS i) a, (SELECT unnest([0, 1, 2]) AS j) b, (SELECT unnest([0, 1, 2, 3]) AS f) f
  WHERE (col + (i + 0.5e0) / 3) * 9 > f.f * 40 + 1 AND (col + (i + 0.5e0) / 3) * 9 <= f.f * 40 + 35 AND (row + (j + 0.5e0) / 3) * 9 > 5 AND (row + (j + 0.5e0) / 3) * 9 <= 100 GROUP BY ALL)
SELECT ds, row, col, CAST(feature AS BIGINT) AS feature, round(share, 4) AS share FROM g WHERE share > 0.5""")
def jn_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN8: rectangles over the cells of each field."""
    fp = design.footprint(bench_log(spark, sf_dir), 9.0)
    f = fp.select("ds").distinct().withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(3))))
    x0, x1, y0, y1 = F.col("feature") * 40 + 1.0, F.col("feature") * 40 + 35.0, F.lit(5.0), F.lit(100.0)
    side = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    edges = f.withColumn("e", F.explode(F.array(side(x0, y0, x1, y0), side(x1, y0, x1, y1), side(x1, y1, x0, y1), side(x0, y1, x0, y0)))).select("ds", "feature", "e.*")
    return r4(design.overlay(fp, edges, 9.0))
