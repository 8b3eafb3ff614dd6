"""Registered queries over rasters of unlike reference systems and over task registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions.lineage import cut
from fieldweave.operators import grid
from fieldweave.plans.log_queries import r4
from fieldweave.plans.source_queries import CELLS, GEO, HEADER, _geo
from fieldweave.plans.source_queries import _le as le
from fieldweave.sources import rasters, task_registers
from fieldweave.sources.bench_log import bench_log, sql

QUERIES, SQL = {}, {}


def register(name: str, query: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if query:
            SQL[name] = sql(query)
        return f

    return keep


#: By the remainder of the log: code, unit, and the affine a, b, d, e of its raster.
KINDS = [(32613, None, 12.0, 0.0, 0.0, -8.0), (2232, 9003, 30.0, 0.0, 0.0, -30.0), (32613, None, 9.0, 0.0, 0.0, -9.0), (32613, 9001, 8.0, 3.0, 3.0, -8.0), (4326, None, 1e-4, 0.0, 0.0, -1e-4), (3857, None, 9.0, 0.0, 0.0, -9.0)]
#: Origins: metres or feet, degrees, map metres.
ORIGIN = {4326: (-105.00003, 50.00007), 3857: (-11_688_546.3, 6_446_275.7)}
MOST = 350


def _raster(spark: SparkSession, sf_dir: str, kinds: int) -> tuple[DataFrame, DataFrame]:
    """(cells, descriptors): the log's cells as a raster of one of the first kinds, by the log."""
    c = grid.bin_points(bench_log(spark, sf_dir), 9.0)
    low = c.groupBy("ds").agg(F.min("row").alias("_r"), F.min("col").alias("_c"), (F.max("row") - F.min("row") + 1).alias("rows"), (F.max("col") - F.min("col") + 1).alias("cols"))
    k = (F.col("ds") % kinds).cast("int")
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), k + 1)
    own = KINDS[:kinds]
    origin = [ORIGIN.get(x[0], (500_000.3, 5_600_000.7)) for x in own]
    names = {"epsg": ("int", 0), "unit": ("int", 1), "a": ("double", 2), "b": ("double", 3), "d": ("double", 4), "e": ("double", 5)}
    meta = low.select("ds", "rows", "cols", *[pick([x[i] for x in own], t).alias(n) for n, (t, i) in names.items()], pick([o[0] for o in origin], "double").alias("c"), pick([o[1] for o in origin], "double").alias("f"), F.lit(1).alias("bands"), F.lit("float32").alias("dtype"), F.lit(None).cast("double").alias("nodata"))
    return c.join(low, "ds").select("ds", (F.col("row") - F.col("_r")).alias("row"), (F.col("col") - F.col("_c")).alias("col"), "z"), meta


_FIT = CELLS + """,
c1 AS (SELECT ds, row - min(row) OVER (PARTITION BY ds) AS row, col - min(col) OVER (PARTITION BY ds) AS col, z FROM c0),
m0 AS (SELECT ds, max(row) + 1 AS rows, max(col) + 1 AS cols, CASE ds % 6 WHEN 0 THEN 12e0 WHEN 1 THEN 30e0 WHEN 3 THEN 8e0 WHEN 4 THEN 1e-4 ELSE 9e0 END AS a, CASE ds % 6 WHEN 0 THEN -8e0 WHEN 1 THEN -30e0 WHEN 3 THEN -8e0 WHEN 4 THEN -1e-4 ELSE -9e0 END AS e, CASE ds % 6 WHEN 3 THEN 3e0 ELSE 0e0 END AS b FROM c1 GROUP BY ds)"""


@register("src_raster_units", _FIT + """,
l AS (SELECT *, CASE ds % 6 WHEN 4 THEN 50.00007e0 - 1e-4 * rows / 2 WHEN 5 THEN degrees(atan(sinh((6446275.7e0 - 9e0 * rows / 2) / 6378137e0))) END AS lat FROM m0),
s AS (SELECT *, CASE ds % 6 WHEN 4 THEN 111320 * cos(radians(lat)) WHEN 5 THEN cos(radians(lat)) WHEN 1 THEN 1200e0 / 3937 ELSE 1 END AS fx, CASE ds % 6 WHEN 4 THEN 111320 WHEN 5 THEN cos(radians(lat)) WHEN 1 THEN 1200e0 / 3937 ELSE 1 END AS fy FROM l)
SELECT ds, CASE ds % 6 WHEN 4 THEN 'geographic' WHEN 5 THEN 'mercator' ELSE 'projected' END AS kind, round(sqrt(a * a + b * b) * fx, 6) AS cell_x_m, round(sqrt(e * e + b * b) * fy, 6) AS cell_y_m, ds % 6 IN (0, 2, 3) AS metric,
  CASE ds % 6 WHEN 4 THEN 'degrees' WHEN 5 THEN 'metres of the map, not of the ground' WHEN 1 THEN 'another unit than metres' END AS reason FROM s""")
def src_raster_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC20: the ground size of cells in metres, feet, degrees and pseudo-Mercator metres."""
    _, meta = _raster(spark, sf_dir, 6)
    return rasters.ground(meta).select("ds", "kind", F.round("cell_x_m", 6).alias("cell_x_m"), F.round("cell_y_m", 6).alias("cell_y_m"), "metric", "reason")


_REGRID = _FIT.replace("% 6", "% 4") + f""",
m1 AS (SELECT *, CASE WHEN ds % 4 = 1 THEN 1200e0 / 3937 ELSE 1e0 END AS u FROM m0),
m2 AS (SELECT *, (500000.3e0 + least(a * cols, 0) + least(b * rows, 0)) * u AS west, (500000.3e0 + greatest(a * cols, 0) + greatest(b * rows, 0)) * u AS east, (5600000.7e0 + least(b * cols, 0) + least(e * rows, 0)) * u AS south, (5600000.7e0 + greatest(b * cols, 0) + greatest(e * rows, 0)) * u AS north,
  sqrt(sqrt(a * a + b * b) * u * (sqrt(b * b + e * e) * u)) AS cell_in, ds % 4 = 2 AND rows * cols <= {MOST} AS native FROM m1),
m3 AS (SELECT *, CASE WHEN ds % 4 = 2 THEN a WHEN cell_in < 10 THEN floor(cell_in / 0.5e0 + 0.5e0) * 0.5e0 ELSE floor(cell_in + 0.5e0) END AS cell0 FROM m2),
m4 AS (SELECT *, ceil((east - west) / cell0 + 1) * ceil((north - south) / cell0 + 1) AS n FROM m3),
m5 AS (SELECT *, cell0 * CASE WHEN n > {MOST} AND NOT native THEN greatest(2, ceil(sqrt(n / {MOST}))) ELSE 1 END AS cell FROM m4),
m6 AS (SELECT *, CASE WHEN native THEN 500000.3e0 ELSE floor(west / cell) * cell END AS x0, CASE WHEN native THEN 5600000.7e0 ELSE ceil(north / cell) * cell END AS y0 FROM m5),
gd AS (SELECT *, CAST(CASE WHEN native THEN cols ELSE greatest(1, ceil((east - x0) / cell)) END AS BIGINT) AS cols_out, CAST(CASE WHEN native THEN rows ELSE greatest(1, ceil((y0 - south) / cell)) END AS BIGINT) AS rows_out, CASE WHEN native THEN 'native' WHEN cell >= 1.5e0 * cell_in THEN 'average' ELSE 'bilinear' END AS method FROM m6)"""


@register("src_raster_grids", _REGRID + " SELECT ds, round(x0, 4) AS x0, round(y0, 4) AS y0, round(cell, 4) AS cell, rows_out, cols_out, method FROM gd")
def src_raster_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC18: the grid of each raster: its cell, snapped origin and cap."""
    _, meta = _raster(spark, sf_dir, 4)
    return r4(rasters.grids(meta, most=MOST).select("ds", "x0", "y0", "cell", "rows_out", "cols_out", "method"))


@register("src_regrid", _REGRID + """,
av AS (SELECT c1.ds, CAST(floor((y0 - (b * (col + 0.5e0) + e * (row + 0.5e0) + 5600000.7e0) * u) / cell) AS BIGINT) AS row, CAST(floor(((a * (col + 0.5e0) + b * (row + 0.5e0) + 500000.3e0) * u - x0) / cell) AS BIGINT) AS col, avg(z) AS z FROM c1 JOIN gd ON gd.ds = c1.ds WHERE method = 'average' GROUP BY ALL),
tr AS (SELECT *, unnest(range(rows_out)) AS row FROM gd WHERE method = 'bilinear'), tc AS (SELECT *, unnest(range(cols_out)) AS col FROM tr),
tx AS (SELECT *, (x0 + (col + 0.5e0) * cell) / u - 500000.3e0 AS dx, (y0 - (row + 0.5e0) * cell) / u - 5600000.7e0 AS dy FROM tc),
tu AS (SELECT *, (e * dx - b * dy) / (a * e - b * b) AS h, (a * dy - b * dx) / (a * e - b * b) AS v FROM tx),
tq AS (SELECT ds, row, col, h, v, CAST(floor(v - 0.5e0) AS BIGINT) + p // 2 AS sr, CAST(floor(h - 0.5e0) AS BIGINT) + p % 2 AS sc, (CASE WHEN p // 2 = 1 THEN v - 0.5e0 - floor(v - 0.5e0) ELSE 1 - (v - 0.5e0 - floor(v - 0.5e0)) END) * (CASE WHEN p % 2 = 1 THEN h - 0.5e0 - floor(h - 0.5e0) ELSE 1 - (h - 0.5e0 - floor(h - 0.5e0)) END) AS w
  FROM tu, (SELECT unnest(range(4)) AS p) WHERE h BETWEEN 0 AND cols AND v BETWEEN 0 AND rows),
bl AS (SELECT tq.ds, tq.row, tq.col, sum(w * z) / sum(w) AS z FROM tq JOIN c1 ON c1.ds = tq.ds AND c1.row = sr AND c1.col = sc GROUP BY ALL HAVING sum(w) > 1e-6)
SELECT ds, row, col, round(z, 6) AS z FROM av UNION ALL SELECT ds, row, col, round(z, 6) FROM bl UNION ALL SELECT c1.ds, c1.row, c1.col, round(z, 6) FROM c1 JOIN gd ON gd.ds = c1.ds WHERE method = 'native'""")
def src_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC18: oblong, foot, rotated and square rasters on square metre cells, bilinear or by block average."""
    cells, meta = _raster(spark, sf_dir, 4)
    return r4(rasters.regrid(cells, meta, most=MOST)[1], digits=6)


_XML = "<ISO11783_TaskData VersionMajor=\"4\">"


@register("src_task_register", GEO + """,
v AS (SELECT *, CAST(floor(ds / 3e0) AS BIGINT) AS register FROM g),
w AS (SELECT register, ds, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM v GROUP BY ALL)
SELECT register, 'TSK' || ds AS task, 'task ' || ds AS label, 'log' AS kind, seq, round(CAST(round(lon * 1e7) AS BIGINT) * 1e-7, 7) AS lon, round(CAST(round(lat * 1e7) AS BIGINT) * 1e-7, 7) AS lat, round(CAST(round(value * 100) AS BIGINT) * 1e-2, 6) + 0e0 AS value FROM v WHERE register % 3 = 0
UNION ALL SELECT register, 'TSK' || ds, 'task ' || ds, 'grid', seq, round(-105 + (seq + 0.5e0) * 1e-4, 7), 50.00005e0, seq * 7 % 1000 / 1e2 FROM v WHERE register % 3 = 1
UNION ALL SELECT register, NULL, 'field ' || ds, 'boundary', k, round(CASE WHEN k IN (0, 3) THEN w ELSE e END, 7), round(CASE WHEN k < 2 THEN s ELSE n END, 7), NULL FROM w, (SELECT unnest(range(4)) AS k) WHERE register % 3 = 2""")
def src_task_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10, SRC14: registers of three logs each, one in three without logs and one in three without grids too."""
    g = _geo(spark, sf_dir).withColumn("reg", F.floor(F.col("ds") / 3))
    c, own = F.col, lambda fmt, *cols: F.format_string(fmt, *[F.col(x) for x in cols])
    folder = lambda name: F.concat(own("r%d/", "reg"), name)
    ordered = lambda h: F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", h.alias("h")))), lambda s: s["h"]), ""))
    record = F.concat(le(F.pmod(c("seq") * 2000, F.lit(86_400_000)), 4), le(F.lit(16000), 2), le(F.round(c("lat") * 1e7), 4), le(F.round(c("lon") * 1e7), 4), le(F.lit(0), 4), F.lit("010100"), le(F.round(c("value") * 100), 4))
    logs = g.where("reg % 3 = 0").groupBy("reg", "ds").agg(ordered(record).alias("content"))
    grids = g.where("reg % 3 < 2").groupBy("reg", "ds").agg(ordered(le(c("seq") * 7 % 1000, 4)).alias("content"))
    box = g.groupBy("reg", "ds").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.count(F.lit(1)).alias("rows"))
    corner = lambda y, x: own('<PNT A="2" C="%.9f" D="%.9f"/>', y, x)
    ring = F.concat(own('<PFD A="PFD%d" C="field %d"><PLN A="1"><LSG A="1">', "ds", "ds"), corner("s", "w"), corner("s", "e"), corner("n", "e"), corner("n", "w"), F.lit("</LSG></PLN></PFD>"))
    named = F.concat(F.when(c("reg") % 3 == 0, own('<TLG A="TLG%d"/>', "ds")).otherwise(""), F.when(c("reg") % 3 < 2, own('<GRD A="50.0" B="-105.0" C="0.0001" D="0.0001" E="%d" F="1" G="GRD%d" I="2"/>', "rows", "ds")).otherwise(""))
    text = F.concat(ring, own('<TSK A="TSK%d" B="task %d">', "ds", "ds"), named, F.lit("</TSK>"))
    register_ = box.groupBy("reg").agg(F.array_join(F.sort_array(F.collect_list(text)), "").alias("t")).select(folder(F.lit("TASKDATA.XML")).alias("path"), F.concat(F.lit(_XML), "t", F.lit("</ISO11783_TaskData>")).cast("binary").alias("content"))
    files = register_.unionByName(logs.select(folder(own("TLG%d.bin", "ds")).alias("path"), "content")).unionByName(logs.select(folder(own("TLG%d.xml", "ds")).alias("path"), F.lit(HEADER).cast("binary").alias("content"))).unionByName(grids.select(folder(own("GRD%d.BIN", "ds")).alias("path"), "content"))
    points, _ = task_registers.read(cut(files))
    reg = F.regexp_extract("ds", r"r(-?\d+)/", 1).cast("long")
    return points.select(reg.alias("register"), "task", "label", "kind", "seq", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), (F.round("value", 6) + F.lit(0.0)).alias("value"))
