"""Registered queries over readers and writers: the machine log is written to files and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions.lineage import cut, scratch
from fieldweave.operators import grid
from fieldweave.plans.log_queries import r4
from fieldweave.sources import files, makers, sinks
from fieldweave.sources.bench_log import bench_log, sql

QUERIES, SQL = {}, {}


def register(name: str, query: str | None = None, over_log: bool = True):
    def keep(f):
        QUERIES[name] = f
        if query:
            SQL[name] = sql(query) if over_log else query
        return f

    return keep


LON, LAT = "(-105e0 + x * 1e-5)", "(50e0 + y * 1e-5)"
GEO = f"g AS (SELECT *, {LON} AS lon, {LAT} AS lat, strftime(date_trunc('second', timestamp), '%Y-%m-%d %H:%M:%S') AS stamp FROM log)"


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = bench_log(spark, sf_dir)
    return log.withColumns({"lon": F.expr(LON), "lat": F.expr(LAT), "stamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")})


def write_lines(lines: DataFrame, path: str, ds: str = "ds", at: str = "at") -> None:
    """One text file for each log, its lines (ds, at, value) in order.

    Dealt by a hash of the log: Spark leaves out a repartition by the log itself where the lines are a union of
    tables that lie by log already, and then packs each table's partitions by itself, so heads and lines part.
    """
    lines.repartition(F.xxhash64(ds)).sortWithinPartitions(ds, at).select(ds, "value").write.partitionBy(ds).text(path)


def log_of(file: Column) -> Column:
    return F.regexp_extract(file, r"ds=(-?\d+)", 1).cast("long")


#: Per third of the logs: delimiter, header, line of units, and columns.
FORMATS = [
    (",", "Longitude,Latitude,Zeitstempel,VRYIELDVOL,Speed (km/h),Swath_Width", None, ("lon", "lat", "stamp", "value", "speed_kmh", "swath_m")),
    (";", "GPS_Lat;GPS_Long;Time;Saatmenge;Fahrgeschwindigkeit;Arbeitsbreite (m)", "deg;deg;;kg/ha;km/h;m", ("lat", "lon", "stamp", "value", "speed_kmh", "swath_m")),
    ("\t", "Date_Time\tBoom Width\tX\tY\tApplied_Rate\tGround Speed\tCrop", None, ("stamp", "swath_m", "lon", "lat", "value", "speed_kmh", "crop")),
]


def _tabular_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of logs in three formats: other delimiters, columns in another order, decimal commas, a row of units."""
    g = _geo(spark, sf_dir).withColumn("crop", F.concat(F.lit("crop "), F.col("ds")))
    parts = []
    for k, (sep, header, unit_line, columns) in enumerate(FORMATS):
        own = g.where(F.col("ds") % 3 == k)
        text = [F.col(c).cast("string") for c in columns]
        if sep == ";":
            text = [F.replace(t, F.lit("."), F.lit(",")) for t in text]
        parts.append(own.select("ds", F.col("seq").alias("at"), F.concat_ws(sep, *[F.coalesce(t, F.lit("")) for t in text]).alias("value")))
        for at, line in ((-2, header), (-1, unit_line)):
            if line:
                parts.append(own.select("ds").distinct().select("ds", F.lit(at).cast("long").alias("at"), F.lit(line).alias("value")))
    path = scratch(spark, "logs")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    write_lines(out, path)
    return path


@register("src_tabular", GEO + " SELECT ds, seq, round(lon, 9) AS lon, round(lat, 9) AS lat, stamp, round(value, 6) + 0e0 AS value, speed_kmh, swath_m, CASE WHEN ds % 3 = 2 THEN 'crop ' || ds END AS crop FROM g")
def src_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC2, SRC3, PRJ1: a folder of files of unlike formats, each read by its own."""
    d = files.read_tabular(spark, _tabular_folder(spark, sf_dir))
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("stamp")
    return d.select(log_of(F.col("ds")).alias("ds"), "seq", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), stamp, (F.round("value", 6) + F.lit(0.0)).alias("value"), "speed_kmh", "swath_m", "crop")


@register("src_units", "SELECT DISTINCT ds, u.column AS \"column\", u.unit AS unit FROM log, (SELECT unnest([{'column': 'lat', 'unit': 'deg'}, {'column': 'lon', 'unit': 'deg'}, {'column': 'value', 'unit': 'kg/ha'}, {'column': 'speed_kmh', 'unit': 'km/h'}, {'column': 'swath_m', 'unit': 'm'}]) AS u) WHERE ds % 3 = 1")
def src_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: the units named under headers."""
    return files.source_units(spark, _tabular_folder(spark, sf_dir)).select(log_of(F.col("ds")).alias("ds"), "column", "unit")


@register("src_value", "SELECT ds, CASE WHEN ds % 3 = 0 THEN 'value' WHEN ds % 3 = 1 THEN 'applied_rate' WHEN stddev_samp(moisture_pct) / abs(avg(moisture_pct)) > stddev_samp(speed_kmh) / abs(avg(speed_kmh)) THEN 'moisture_pct' ELSE 'speed_kmh' END AS \"column\" FROM log GROUP BY ds")
def src_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: the main variable where logs lack some."""
    log = bench_log(spark, sf_dir).select("ds", F.when(F.col("ds") % 3 == 0, F.col("value")).alias("value"), F.when(F.col("ds") % 3 <= 1, F.col("applied_rate")).alias("applied_rate"), "moisture_pct", "speed_kmh")
    return files.pick_value(log, candidates=("moisture_pct", "speed_kmh"))


@register("src_operation", "SELECT DISTINCT CASE ds % 5 WHEN 0 THEN 'a/' WHEN 1 THEN 'yield/' WHEN 2 THEN 'Planting/' WHEN 3 THEN 'spray/' ELSE 'b/' END || ds AS ds, CASE ds % 5 WHEN 0 THEN 'harvest' WHEN 1 THEN 'harvest' WHEN 2 THEN 'planting' WHEN 3 THEN 'application' ELSE 'elevation' END AS operation FROM log")
def src_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6: operation by columns, then by path."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("a/", "yield/", "Planting/", "spray/", "b/")]), (F.col("ds") % 5 + 1).cast("int"))
    k = F.col("ds") % 5
    log = bench_log(spark, sf_dir).select(F.concat(name, F.col("ds")).alias("ds"), F.when(k == 0, F.col("moisture_pct")).alias("moisture_pct"), F.when(k < 4, F.col("value")).alias("value"), "elev_m")
    return files.guess_operation(log)


@register("src_maker", """
n AS (SELECT DISTINCT ds FROM log), s AS (SELECT ds, CASE ds % 4 WHEN 0 THEN 'ag_leader' WHEN 1 THEN 'john_deere' WHEN 2 THEN 'raven' ELSE 'generic' END AS maker, CASE ds % 4 WHEN 0 THEN 9e0 WHEN 1 THEN 3e0 WHEN 2 THEN 2.5e0 ELSE 0e0 END AS score, CASE ds % 4 WHEN 0 THEN 9e0 / 9.5e0 WHEN 1 THEN 0.5e0 WHEN 2 THEN 2.5e0 / 3 ELSE 0e0 END AS share FROM n)
SELECT ds, maker, round(share * least(1, score / 5), 4) AS confidence FROM s""")
def src_maker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16: makers by signature columns, hints and path."""
    logs, k = bench_log(spark, sf_dir).select("ds").distinct(), F.col("ds") % 4
    # columns of one maker beside a hint at another; a column that two makers have; a path and a hint at another; nothing
    name = F.when(k == 2, F.concat(F.lit("exports/viper/"), F.col("ds"))).otherwise(F.concat(F.lit("x/"), F.col("ds")))
    own = F.when(k == 0, F.array(F.lit("Obj__Id"), F.lit("Track(deg)"), F.lit("Hybrid"))).when(k == 1, F.array(F.lit("Yld_Vol_Dr"), F.lit("Lon"))).when(k == 2, F.array(F.lit("Rate"))).otherwise(F.array(F.lit("Lon")))
    m = makers.detect_maker(logs.select(name.alias("ds"), F.explode(own).alias("column")))
    return m.select(F.regexp_extract("ds", r"(\d+)$", 1).cast("long").alias("ds"), "maker", F.round("confidence", 4).alias("confidence"))


def _documents(spark: SparkSession, sf_dir: str, wrap: tuple[str, str] = ("", "")) -> str:
    """One feature collection of points for each log."""
    g = _geo(spark, sf_dir).withColumns({"rate": F.col("value"), "speed": F.col("speed_kmh")})
    point = F.col("seq") % 5 != 4
    corner = lambda dx, dy: F.struct((F.col("lon") + dx).alias("a"), (F.col("lat") + dy).alias("b"))
    g = g.withColumn("ring", F.transform(F.array(corner(0, 0), corner(2e-5, 0), corner(2e-5, 4e-5), corner(0, 4e-5)), lambda p: F.array(p["a"], p["b"])))
    points = sinks.as_features(g.where(point).drop("ring"), "rate", "speed", "seq", keep=("ds", "seq"))
    rings = sinks.as_features(g.where(~point), "rate", "speed", "seq", keep=("ds", "seq"))
    all_ = points.unionByName(rings)
    docs = all_.groupBy("ds").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"]), ",").alias("fs"))
    path = scratch(spark, "features")
    write_lines(docs.select("ds", F.lit(0).alias("at"), F.concat(F.lit(wrap[0] + '{"type":"FeatureCollection","features":['), F.col("fs"), F.lit("]}" + wrap[1])).alias("value")), path)
    return path


_AT = "CASE WHEN seq % 5 <> 4 THEN {c} ELSE {c} + {d} END"


@register("src_geojson", GEO + f" SELECT ds, seq AS feature_id, round({_AT.format(c='lon', d='1e-5')}, 8) AS lon, round({_AT.format(c='lat', d='2e-5')}, 8) AS lat, CAST(CASE WHEN seq % 5 <> 4 THEN NULL ELSE 4 END AS BIGINT) AS corners, round(value, 6) + 0e0 AS rate FROM g")
def src_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2, SRC7: points and polygons as features, read back."""
    d = files.read_geojson(spark, _documents(spark, sf_dir))
    rate = F.round(F.try_element_at("properties", F.lit("rate")).cast("double"), 6) + F.lit(0.0)
    return d.select(log_of(F.col("ds")).alias("ds"), F.col("feature_id").cast("long").alias("feature_id"), F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), F.when(F.col("ring").isNotNull(), F.size("ring")).cast("long").alias("corners"), rate.alias("rate"))


@register("src_session", GEO + f" SELECT ds, seq, round({_AT.format(c='lon', d='1e-5')}, 8) AS lon, round(value, 6) + 0e0 AS value, speed_kmh FROM g")
def src_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8: features nested in a session's document."""
    d = files.read_session(spark, _documents(spark, sf_dir, ('{"session":{"data":', "}}")))
    return d.select(log_of(F.col("ds")).alias("ds"), "seq", F.round("lon", 8).alias("lon"), (F.round("value", 6) + F.lit(0.0)).alias("value"), "speed_kmh")


@register("src_kml", GEO + " SELECT ds, 'field ' || ds AS name, round(min(lon), 6) AS west, round(max(lon), 6) AS east, round(min(lat), 6) AS south, round(max(lat), 6) AS north, CAST(4 AS BIGINT) AS corners FROM g GROUP BY ds")
def src_kml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9: each log's bounding box as a placemark, read back."""
    b = _geo(spark, sf_dir).groupBy("ds").agg(*[f(c).alias(n) for f, c, n in ((F.min, "lon", "w"), (F.max, "lon", "e"), (F.min, "lat", "s"), (F.max, "lat", "n"))])
    corner = lambda a, b: F.concat(F.format_string("%.7f", F.col(a)), F.lit(","), F.format_string("%.7f", F.col(b)), F.lit(",0"))
    ring = F.concat_ws(" ", corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"))
    mark = F.concat(F.lit("<kml><Document><Placemark><name>field "), F.col("ds"), F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), ring, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"))
    path = scratch(spark, "kml")
    write_lines(b.select("ds", F.lit(0).alias("at"), mark.alias("value")), path)
    p = files.read_kml(spark, path).select(log_of(F.col("ds")).alias("ds"), "name", "ring")
    of = lambda f, c: F.round(f(F.transform("ring", lambda v: v[c])), 6)
    return p.select("ds", "name", of(F.array_min, "lon").alias("west"), of(F.array_max, "lon").alias("east"), of(F.array_min, "lat").alias("south"), of(F.array_max, "lat").alias("north"), F.size("ring").cast("long").alias("corners"))


@register("src_tasks", """
SELECT CAST(n_nationkey AS BIGINT) AS ds, 'customers' AS kind, 'CTR' || c_custkey AS id, c_name AS name, NULL AS up FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT CAST(c_nationkey AS BIGINT), 'fields', 'PFD' || c_custkey, 'field of ' || c_name, 'CTR' || c_custkey FROM customer
UNION ALL SELECT CAST(c_nationkey AS BIGINT), 'tasks', 'TSK' || c_custkey, c_mktsegment, 'PFD' || c_custkey FROM customer""", over_log=False)
def src_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10: a task register for each nation, read back."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    own = lambda fmt, *cols: F.format_string(fmt, *[F.col(x) for x in cols])
    line = F.concat(
        own('<CTR A="CTR%s" B="%s"/>', "c_custkey", "c_name"), own('<PFD A="PFD%s" C="field of %s" E="CTR%s"/>', "c_custkey", "c_name", "c_custkey"), own('<TSK A="TSK%s" B="%s" E="PFD%s"/>', "c_custkey", "c_mktsegment", "c_custkey")
    )
    rows = c.select(F.col("c_nationkey").alias("ds"), F.col("c_custkey").alias("at"), line.alias("value"))
    ends = c.select(F.col("c_nationkey").alias("ds")).distinct().select("ds", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("at"), F.lit("<TaskData>").alias("value")), F.struct(F.lit(2**62).cast("long").alias("at"), F.lit("</TaskData>").alias("value")))).alias("e")).select("ds", "e.*")
    path = scratch(spark, "tasks")
    write_lines(rows.unionByName(ends), path)
    t = files.read_tasks(spark, path)
    ups = {"customers": F.lit(None).cast("string"), "fields": F.col("customer"), "tasks": F.col("field")}
    parts = [t[k].select(log_of(F.col("ds")).alias("ds"), F.lit(k).alias("kind"), "id", "name", up.alias("up")) for k, up in ups.items()]
    return files.union_logs(*parts)


def _le(c: Column, size: int) -> Column:
    """A whole number as so many bytes in hex, least first."""
    h = F.lpad(F.hex(F.pmod(c.cast("long"), F.lit(2 ** (8 * size)))), 2 * size, "0")
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])


HEADER = '<TIM A="" D="4"><PTN A="" B="" C="" D=""/><DLV A="0002" B=""/><DLV A="0043" B=""/><DLV A="0049" B=""/><DLV A="0048" B=""/></TIM>'


@register("src_binary_logs", GEO + """, e AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS v, CAST(round(speed_kmh * 1e4 / 36) AS BIGINT) AS s FROM g)
SELECT ds, seq, round(CAST(round(lon * 1e7) AS BIGINT) * 1e-7, 7) AS lon, round(CAST(round(lat * 1e7) AS BIGINT) * 1e-7, 7) AS lat, round(v * 1e-2, 6) + 0e0 AS applied_rate, round(s * 36e-4, 6) + 0e0 AS speed_kmh, swath_m, CAST(seq % 3 AS DOUBLE) AS other FROM e""")
def src_binary_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11, SRC12: each log in the binary format of task controllers, decoded and scaled."""
    g = _geo(spark, sf_dir)
    val = lambda i, c: F.concat(F.lit(f"{i:02X}"), _le(c, 4))
    head = F.concat(_le(F.pmod(F.col("seq") * 2000, F.lit(86_400_000)), 4), _le(F.lit(16000), 2), _le(F.round(F.col("lat") * 1e7), 4), _le(F.round(F.col("lon") * 1e7), 4), _le(F.lit(0), 4), F.lit("0104"))
    rec = F.concat(head, val(0, F.round(F.col("value") * 100)), val(1, F.round(F.col("speed_kmh") * 1e4 / 36)), val(2, F.col("swath_m") * 1000), val(3, F.col("seq") % 3))
    data = g.groupBy("ds").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", rec.alias("h")))), lambda s: s["h"]), "")).alias("content"))
    name = F.concat(F.lit("ds="), F.col("ds"))
    both = data.select(F.concat(name, F.lit(".bin")).alias("path"), "content").unionByName(data.select(F.concat(name, F.lit(".xml")).alias("path"), F.lit(HEADER).cast("binary").alias("content")))
    d = files.scale_values(files.decode_logs(both))
    return d.select(log_of(F.col("ds")).alias("ds"), "seq", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), (F.round("applied_rate", 6) + F.lit(0.0)).alias("applied_rate"), (F.round("speed_kmh", 6) + F.lit(0.0)).alias("speed_kmh"), F.round("swath_m", 6).alias("swath_m"), F.try_element_at("ddi_extra", F.lit("ddi_0048")).alias("other"))


CELLS = "c0 AS (SELECT ds, -CAST(floor(y / 9) AS BIGINT) - 1 AS row, CAST(floor(x / 9) AS BIGINT) AS col, avg(elev_m) AS z FROM log GROUP BY ALL)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.bin_points(bench_log(spark, sf_dir), 9.0)


@register("src_grid", CELLS + """, b AS (SELECT ds, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM c0 GROUP BY ds),
f AS (SELECT ds, r0, c0, c1 - c0 + 1 AS n, c, unnest(range(r0, r1 + 1)) AS r FROM (SELECT *, unnest(range(c0, c1 + 1)) AS c FROM b))
SELECT f.ds, f.r - r0 AS row, f.c - c0 AS col, round(-105 + (f.c - f.c0 + 0.5e0) * 1e-4, 8) AS lon, round(50 + (f.r - r0 + 0.5e0) * 1e-4, 8) AS lat, CASE WHEN z IS NULL THEN 0e0 ELSE round(round(z * 100 - 69000 + 0.213e0) / 100, 6) END AS rate
FROM f LEFT JOIN c0 ON c0.ds = f.ds AND c0.row = f.r AND c0.col = f.c""")
def src_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6, SRC13: rates as an integer grid, its bytes, and the cells read back."""
    rates = cut(_cells(spark, sf_dir).withColumn("rate", F.col("z") - 690 + 0.00213))
    rows = sinks.integer_grid(rates, 100.0)
    text = F.array_join(F.transform("values", lambda v: _le(v, 4)), "")
    data = rows.groupBy("ds").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", text.alias("h")))), lambda s: s["h"]), "")).alias("content"))
    e = rates.groupBy("ds").agg((F.max("row") - F.min("row") + 1).alias("rows"), (F.max("col") - F.min("col") + 1).alias("cols"))
    shape = e.select("ds", F.lit(2).alias("kind"), "rows", "cols", F.lit(-105.0).alias("lon0"), F.lit(50.0).alias("lat0"), F.lit(1e-4).alias("dlon"), F.lit(1e-4).alias("dlat"), F.lit(0.01).alias("scale"))
    return r4(files.decode_grids(data, shape).withColumns({"lon": F.round("lon", 8), "lat": F.round("lat", 8)}), "lon", "lat", digits=6)


@register("src_ingest", """
n AS (SELECT DISTINCT ds FROM log)
SELECT ds, CASE ds % 3 WHEN 0 THEN 'tabular' WHEN 1 THEN NULL ELSE 'tabular' END AS reader, CAST(CASE ds % 3 WHEN 0 THEN (SELECT count(*) FROM log l WHERE l.ds = n.ds) ELSE 0 END AS BIGINT) AS n_rows,
  CASE ds % 3 WHEN 0 THEN NULL WHEN 1 THEN 'no reader for .doc' ELSE 'no positions' END AS reason FROM n""")
def src_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15: a folder with logs, files that no reader takes and files without positions; every file has its reason."""
    g = _geo(spark, sf_dir)
    line = F.when(F.col("ds") % 3 == 2, F.concat(F.lit("a"), F.col("seq"), F.lit(";b"))).otherwise(F.concat_ws(",", "lon", "lat", "value"))
    rows = g.select("ds", F.col("seq").alias("at"), line.alias("value"))
    heads = g.select("ds").distinct().select("ds", F.lit(-1).cast("long").alias("at"), F.when(F.col("ds") % 3 == 2, F.lit("this;that")).otherwise(F.lit("lon,lat,rate")).alias("value"))
    path, all_ = scratch(spark, "mixed"), rows.unionByName(heads)
    write_lines(all_.where("ds % 3 <> 1"), f"{path}/logs")
    # Spark's own text writer names a suffix by its codec only; the option gives another
    all_.where("ds % 3 = 1").repartition(F.xxhash64("ds")).sortWithinPartitions("ds", "at").select("ds", "value").write.partitionBy("ds").option("extension", "doc").csv(f"{path}/notes")
    _, report = files.ingest(spark, path)
    return report.select(log_of(F.col("file")).alias("ds"), "reader", "n_rows", "reason")


@register("src_rejects", "SELECT ds, CAST(count(*) FILTER (WHERE seq % 10 <> 7) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE seq % 10 = 3) AS BIGINT) AS n_padded, CAST(count(*) FILTER (WHERE seq % 10 = 7) AS BIGINT) AS n_rejected, min(CASE WHEN seq % 10 = 7 THEN CAST(seq AS VARCHAR) || ',1,2,extra' END) AS line FROM log GROUP BY ds")
def src_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15: short lines are padded, lines with a field too many are kept aside with a reason."""
    g = bench_log(spark, sf_dir).select("ds", "seq", "value")
    k = F.col("seq") % 10
    line = F.when(k == 3, F.concat(F.col("seq").cast("string"), F.lit(",1"))).when(k == 7, F.concat(F.col("seq").cast("string"), F.lit(",1,2,extra"))).otherwise(F.concat_ws(",", "seq", F.lit("1"), F.lit("2")))
    heads = g.select("ds").distinct().select("ds", F.lit(-1).cast("long").alias("at"), F.lit("record,Longitude,Latitude").alias("value"))
    path = scratch(spark, "rejects")
    write_lines(g.select("ds", F.col("seq").alias("at"), line.alias("value")).unionByName(heads), path)
    rows = files.read_tabular(spark, path).groupBy(log_of(F.col("ds")).alias("ds")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("lat").isNull()).alias("n_padded"))
    bad = files.rejected_lines(spark, path).groupBy(log_of(F.col("file")).alias("ds")).agg(F.count(F.lit(1)).alias("n_rejected"), F.min("line").alias("line"))
    return rows.join(bad, "ds", "left").select("ds", "n_rows", "n_padded", F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"), "line")


@register("src_nodata", "SELECT ds, CASE WHEN ds % 2 = 0 THEN -9999e0 ELSE -5000e0 END AS nodata FROM (SELECT DISTINCT ds FROM log)")
def src_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC17: fill values that no header declares."""
    odd = F.pmod(F.col("row") * 5 + F.col("col") * 3, F.lit(7)) == 0
    return files.undeclared_nodata(_cells(spark, sf_dir).withColumn("z", F.when(odd, F.when(F.col("ds") % 2 == 0, -9999.0).otherwise(-5000.0)).otherwise(F.col("z"))))


@register("src_resample", CELLS + " SELECT ds, CAST(floor((row + 0.5e0) * 9 / 30) AS BIGINT) AS row, CAST(floor((col + 0.5e0) * 9 / 30) AS BIGINT) AS col, round(avg(z), 9) AS z FROM c0 GROUP BY ALL")
def src_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC18: block average to cells of 30 m."""
    return r4(files.average_to_cell(_cells(spark, sf_dir), 9.0, 30.0), digits=9)


@register("src_stride", CELLS + ", s AS (SELECT ds, greatest(1, CAST(ceil(sqrt(count(*) / 50e0)) AS BIGINT)) AS s FROM c0 GROUP BY ds) SELECT c0.ds, (col + 0.5e0) * 9 AS x, -(row + 0.5e0) * 9 AS y, round(z, 6) AS elev_m FROM c0 JOIN s ON s.ds = c0.ds WHERE row % s = 0 AND col % s = 0")
def src_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC19: cells as points, at most so many a grid."""
    return r4(files.strided_points(_cells(spark, sf_dir), 9.0, 50), digits=6)


@register("snk_csv", GEO + " SELECT ds, seq, round(lon, 9) AS lon, round(lat, 9) AS lat, round(value, 6) + 0e0 AS value, 'lon,lat,ds,seq,value' AS header FROM g")
def snk_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: positions first."""
    path = scratch(spark, "csv")
    sinks.write_csv(_geo(spark, sf_dir).select("ds", "seq", "value", "lat", "lon"), path)
    d = spark.read.option("header", True).schema("lon double, lat double, ds long, seq long, value double").option("enforceSchema", False).csv(path)
    header = ",".join(spark.read.option("header", True).csv(path).columns)
    return d.select("ds", "seq", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), (F.round("value", 6) + F.lit(0.0)).alias("value"), F.lit(header).alias("header"))


@register("snk_prescription", CELLS + " SELECT ds, printf('%.8f', -105 + (col + 0.5e0) * 9e-5) AS lon, printf('%.8f', 50 - (row + 0.5e0) * 9e-5) AS lat, row % 4 * 10e0 AS rate, 0.0081e0 AS area_ha FROM c0")
def snk_prescription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: centroids with eight decimals, written and read back as text."""
    c = _cells(spark, sf_dir).select("ds", (-105 + (F.col("col") + 0.5) * 9e-5).alias("lon"), (50 - (F.col("row") + 0.5) * 9e-5).alias("lat"), (F.col("row") % 4 * 10.0).alias("rate"), F.lit(0.0081).alias("area_ha"))
    path = scratch(spark, "prescription")
    sinks.prescription_rows(c, "ds").write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("ds long, lon string, lat string, rate double, area_ha double").csv(path)


@register("snk_cleaned", "SELECT ds, seq, round(value, 6) + 0e0 AS value, speed_kmh <= 12 AS kept FROM log")
def snk_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: kept and removed records, by log."""
    path = scratch(spark, "cleaned")
    log = bench_log(spark, sf_dir).select("ds", "seq", "value", F.when(F.col("speed_kmh") > 12, F.lit("speed_range")).alias("removal_reason"))
    sinks.write_cleaned(log, path)
    d = spark.read.parquet(path)
    return d.select(F.col("ds").cast("long").alias("ds"), "seq", (F.round("value", 6) + F.lit(0.0)).alias("value"), F.col("kept").cast("boolean").alias("kept"))


@register("snk_terrain", CELLS + " SELECT ds, 'cells' AS layer, count(*) AS n, round(sum(z), 4) AS total FROM c0 GROUP BY ds UNION ALL SELECT ds, 'bands', count(DISTINCT floor(z)), round(sum(DISTINCT floor(z)), 4) FROM c0 GROUP BY ds")
def snk_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8: one table for each layer."""
    path, c = scratch(spark, "terrain"), _cells(spark, sf_dir)
    sinks.write_terrain(path, cells=c, bands=c.select("ds", F.floor("z").cast("double").alias("z")).distinct())
    parts = [spark.read.parquet(f"{path}/{k}").groupBy("ds").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 4).alias("total")).withColumn("layer", F.lit(k)) for k in ("cells", "bands")]
    return parts[0].unionByName(parts[1]).select("ds", "layer", "n", "total")
