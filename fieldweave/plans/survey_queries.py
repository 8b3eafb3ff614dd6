"""Registered queries over the second log: long, uneven surveys, each field on its own cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions.lineage import cut
from fieldweave.operators import design, grid, merge_tree, relief, surface
from fieldweave.plans.log_queries import r4
from fieldweave.sources.bench_log import rough_log, rough_sql

QUERIES, SQL = {}, {}


def register(name: str, query: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if query:
            SQL[name] = rough_sql(query)
        return f

    return keep


GEO = """gm AS (SELECT ds, CASE WHEN median(swath_m) IS NULL THEN 10e0 ELSE least(greatest(median(swath_m), 1e0), 60e0) END AS swath_m, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM rough GROUP BY ds),
gk AS (SELECT *, swath_m / 2 AS edge, round_even(least(greatest(5e0, swath_m / 2), 25) * 2, 0) / 2 + k * 0.5e0 AS cell FROM gm, (SELECT unnest(range(0, 4000)) AS k)),
gc AS (SELECT *, floor((xa - edge) / cell) * cell AS x0, ceil((yb + edge) / cell) * cell AS y0 FROM gk),
gr AS (SELECT *, greatest(ceil((y0 - (ya - edge)) / cell), 1) AS rows, greatest(ceil((xb + edge - x0) / cell), 1) AS cols FROM gc),
geo AS (SELECT ds, swath_m, cell, greatest(1.5e0 * swath_m, 3 * cell) AS gap, edge, x0, y0, CAST(rows AS BIGINT) AS rows, CAST(cols AS BIGINT) AS cols
  FROM (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY k) AS rk FROM gr WHERE rows * cols <= 400000) WHERE rk = 1)"""


@register("ter_geometry", GEO + " SELECT * FROM geo")
def ter_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER6, TER15, TER16: cell, tolerances, origin and extent of each field."""
    return surface.geometry(rough_log(spark, sf_dir))


_SURFACE = GEO + """,
pt AS (SELECT r.ds, x, y, elev_m AS z, cell, gap, edge, -CAST(floor(y / cell) AS BIGINT) - 1 AS row, CAST(floor(x / cell) AS BIGINT) AS col FROM rough r JOIN geo ON geo.ds = r.ds),
rd AS (SELECT ds, row, col, avg(z) AS z, any_value(cell) AS cell, any_value(gap) AS gap, any_value(edge) AS edge FROM pt GROUP BY ds, row, col),
sq AS (SELECT a.i AS dr, b.i AS dc FROM (SELECT unnest(range(-4, 5)) AS i) a, (SELECT unnest(range(-4, 5)) AS i) b WHERE a.i <> 0 OR b.i <> 0),
nr AS (SELECT ds, row - dr AS row, col - dc AS col, dr, dc, z, dr * dr + dc * dc AS d2 FROM rd, sq WHERE sqrt(dr * dr + dc * dc) * cell <= gap),
ho AS (SELECT ds, row, col, sum(z / d2) / sum(1e0 / d2) AS z FROM nr WHERE NOT EXISTS (SELECT 1 FROM rd WHERE rd.ds = nr.ds AND rd.row = nr.row AND rd.col = nr.col) GROUP BY ds, row, col
  HAVING (bool_or(dr > 0 AND abs(dc) <= abs(dr)) AND bool_or(dr < 0 AND abs(dc) <= abs(dr))) OR (bool_or(dc > 0 AND abs(dr) <= abs(dc)) AND bool_or(dc < 0 AND abs(dr) <= abs(dc)))),
co AS (SELECT ds, row, col, z, 'read' AS kind FROM rd UNION ALL SELECT ds, row, col, z, 'filled' FROM ho),
ed AS (SELECT pt.ds, pt.row - dr AS row, pt.col - dc AS col, pt.x, pt.y, pt.z, sqrt(pow((pt.col - dc + 0.5e0) * cell - pt.x, 2) + pow(-(pt.row - dr + 0.5e0) * cell - pt.y, 2)) AS far, edge FROM pt, sq WHERE abs(dr) <= 1 AND abs(dc) <= 1),
ek AS (SELECT *, row_number() OVER (PARTITION BY ds, row, col ORDER BY far, x, y, z) AS rk FROM ed WHERE far <= edge AND NOT EXISTS (SELECT 1 FROM co WHERE co.ds = ed.ds AND co.row = ed.row AND co.col = ed.col)),
en AS (SELECT ek.ds, ek.row AS er, ek.col AS ec, ek.z AS fallback, co.row, co.col, co.z, row_number() OVER (PARTITION BY ek.ds, ek.row, ek.col ORDER BY (co.row - ek.row) * (co.row - ek.row) + (co.col - ek.col) * (co.col - ek.col) NULLS LAST, co.row, co.col) AS rn
  FROM ek LEFT JOIN co ON co.ds = ek.ds AND co.row BETWEEN ek.row - 2 AND ek.row + 2 AND co.col BETWEEN ek.col - 2 AND ek.col + 2 WHERE rk = 1),
eg AS (SELECT en.ds, er, ec, any_value(fallback) AS fallback, en.row, en.col, any_value(en.z) AS z,
    max(CASE WHEN c.row = en.row - 2 THEN c.z END) AS rm2, max(CASE WHEN c.row = en.row - 1 THEN c.z END) AS rm1, max(CASE WHEN c.row = en.row + 1 THEN c.z END) AS r1, max(CASE WHEN c.row = en.row + 2 THEN c.z END) AS r2,
    max(CASE WHEN c.col = en.col - 2 THEN c.z END) AS cm2, max(CASE WHEN c.col = en.col - 1 THEN c.z END) AS cm1, max(CASE WHEN c.col = en.col + 1 THEN c.z END) AS c1, max(CASE WHEN c.col = en.col + 2 THEN c.z END) AS c2
  FROM en LEFT JOIN co c ON c.ds = en.ds AND ((c.col = en.col AND c.row BETWEEN en.row - 2 AND en.row + 2) OR (c.row = en.row AND c.col BETWEEN en.col - 2 AND en.col + 2)) WHERE rn = 1 GROUP BY en.ds, er, ec, en.row, en.col),
sf AS (SELECT * FROM co UNION ALL
  SELECT ds, er, ec, coalesce(z + coalesce((r1 - rm1) * 0.5e0, (z - rm2) * 0.5e0, (r2 - z) * 0.5e0, z - rm1, r1 - z, 0) * (er - row) + coalesce((c1 - cm1) * 0.5e0, (z - cm2) * 0.5e0, (c2 - z) * 0.5e0, z - cm1, c1 - z, 0) * (ec - col), fallback), 'edge' FROM eg)"""


@register("ter_surface", _SURFACE + " SELECT ds, row, col, round(z, 6) AS z, kind FROM sf")
def ter_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER6: cells read, gaps filled, the half swath beyond the outermost track."""
    log = rough_log(spark, sf_dir)
    return r4(surface.surface(log, cut(surface.geometry(log))), digits=6)


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a surface needs of the second log, as a table: its windows sort the whole log, so that is done once."""
    return cut(rough_log(spark, sf_dir).select("ds", "x", "y", "swath_m", "elev_m"))


def _disc(name: str, radius: str) -> str:
    """Height above the mean of a disc, by sums along rows; standardised."""
    return f"""
{name}_t AS (SELECT c.ds, c.row, c.col, c.z - (sum(hi.s - coalesce(lo.s, 0)) / sum(hi.n - coalesce(lo.n, 0))) AS t
  FROM (SELECT w.*, dy, row + dy AS prow, least(col + h, c1) AS chi, greatest(col - h - 1, c0 - 1) AS clo
        FROM (SELECT sf.ds, sf.row, sf.col, sf.z, {radius} AS rad, unnest(range(-CAST(floor({radius}) AS BIGINT), CAST(floor({radius}) AS BIGINT) + 1)) AS dy FROM sf JOIN op ON op.ds = sf.ds) w
        JOIN ex ON ex.ds = w.ds AND ex.prow = w.row + w.dy, LATERAL (SELECT CAST(floor(sqrt(greatest(rad * rad - dy * dy, 0))) AS BIGINT) AS h)) c
  JOIN pf hi ON hi.ds = c.ds AND hi.prow = c.prow AND hi.col = c.chi LEFT JOIN pf lo ON lo.ds = c.ds AND lo.prow = c.prow AND lo.col = c.clo
  WHERE c.chi > c.clo GROUP BY c.ds, c.row, c.col, c.z),
{name}_m AS (SELECT ds, avg(t) AS m, stddev_pop(t) AS s FROM {name}_t GROUP BY ds),
{name} AS (SELECT t.ds, row, col, CASE WHEN s > 0 THEN (t - m) / s ELSE 0 END AS v FROM {name}_t t JOIN {name}_m m ON m.ds = t.ds)"""


_LAYERS = _SURFACE + """,
op AS (SELECT *, greatest(tpi_small * 2, side / 4e0) AS tpi_large FROM (SELECT sf.ds, least(max(row) - min(row) + 1, max(col) - min(col) + 1) AS side, greatest(1.5e0, least(30e0 / any_value(cell), least(max(row) - min(row) + 1, max(col) - min(col) + 1) / 10e0)) AS tpi_small FROM sf JOIN geo ON geo.ds = sf.ds GROUP BY sf.ds)),
ex AS (SELECT ds, row AS prow, min(col) AS c0, max(col) AS c1 FROM sf GROUP BY ds, row),
dn AS (SELECT ds, prow, unnest(range(c0 - 1, c1 + 1)) AS col FROM ex),
pf AS (SELECT dn.ds, dn.prow, dn.col, coalesce(sum(z) OVER w, 0) AS s, count(z) OVER w AS n FROM dn LEFT JOIN sf ON sf.ds = dn.ds AND sf.row = dn.prow AND sf.col = dn.col WINDOW w AS (PARTITION BY dn.ds, dn.prow ORDER BY dn.col)),""" + _disc("ts", "tpi_small") + "," + _disc("tl", "tpi_large") + """,
g0 AS (SELECT sf.ds, row - dr AS row, col - dc AS col, z, dr * dr + dc * dc AS d2, sf.row AS r, sf.col AS k FROM sf, sq WHERE abs(dr) <= 1 AND abs(dc) <= 1),
g1 AS (SELECT *, row_number() OVER (PARTITION BY ds, row, col ORDER BY d2, r, k) AS n FROM g0 WHERE NOT EXISTS (SELECT 1 FROM sf WHERE sf.ds = g0.ds AND sf.row = g0.row AND sf.col = g0.col)),
al AS (SELECT ds, row, col, z FROM sf UNION ALL SELECT ds, row, col, z FROM g1 WHERE n = 1),
st AS (SELECT c.ds, c.row, c.col, c.z, max(a.z) FILTER (WHERE a.row < c.row AND a.col < c.col) AS nw, max(a.z) FILTER (WHERE a.row < c.row AND a.col = c.col) AS n, max(a.z) FILTER (WHERE a.row < c.row AND a.col > c.col) AS ne,
    max(a.z) FILTER (WHERE a.row = c.row AND a.col < c.col) AS w, max(a.z) FILTER (WHERE a.row = c.row AND a.col > c.col) AS e, max(a.z) FILTER (WHERE a.row > c.row AND a.col < c.col) AS sw, max(a.z) FILTER (WHERE a.row > c.row AND a.col = c.col) AS s, max(a.z) FILTER (WHERE a.row > c.row AND a.col > c.col) AS se
  FROM sf c JOIN sq ON abs(dr) <= 1 AND abs(dc) <= 1 JOIN al a ON a.ds = c.ds AND a.row = c.row + dr AND a.col = c.col + dc GROUP BY c.ds, c.row, c.col, c.z),
ly AS (SELECT st.ds, st.row, st.col, st.z, cell, 100 * sqrt(pow(((ne+2*e+se)-(nw+2*w+sw)) / (8 * cell), 2) + pow(((nw+2*n+ne)-(sw+2*s+se)) / (8 * cell), 2)) AS slope_pct, ts.v AS sm, tl.v AS lg
  FROM st JOIN geo ON geo.ds = st.ds JOIN ts ON ts.ds = st.ds AND ts.row = st.row AND ts.col = st.col JOIN tl ON tl.ds = st.ds AND tl.row = st.row AND tl.col = st.col),
lf AS (SELECT *, CASE WHEN lg > 1 AND sm > 1 THEN 1 WHEN lg > 1 THEN 2 WHEN lg < -1 AND sm < -1 THEN 6 WHEN lg < -1 THEN 5 WHEN sm > 1 THEN 2 WHEN sm < -1 THEN 5 WHEN slope_pct < 2 THEN 4 ELSE 3 END AS landform FROM ly)"""


@register("ter_layers", _LAYERS + " SELECT ds, row, col, round(z, 5) AS z, round(slope_pct, 4) AS slope_pct, round(sm, 4) + 0e0 AS tpi_small, round(lg, 4) + 0e0 AS tpi_large FROM ly")
def ter_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER6, DER1, DER6, DER7, DER12: layers of many fields in one job, each with its own cells and radii."""
    layers, _ = surface.analyse(_readings(spark, sf_dir))
    c = F.col
    return layers.select("ds", "row", "col", F.round("z", 5).alias("z"), *[(F.round(c(x), 4) + F.lit(0.0)).alias(x) for x in ("slope_pct", "tpi_small", "tpi_large")])


@register("ter_report", _LAYERS + """,
ar AS (SELECT ds, count(*) FILTER (WHERE landform = 1) * any_value(cell * cell) / 1e4 AS hilltop_ha, count(*) FILTER (WHERE landform = 6) * any_value(cell * cell) / 1e4 AS valley_ha FROM lf GROUP BY ds),
sm AS (SELECT ds, count(*) AS cells, count(*) * any_value(cell * cell) / 1e4 AS area_ha, min(z) AS z_min, max(z) AS z_max, avg(slope_pct) AS slope_mean, 100e0 * count(*) FILTER (WHERE slope_pct > 10) / count(*) AS steep_pct FROM ly GROUP BY ds)
SELECT sm.ds, cells, round(area_ha, 4) AS area_ha, round(z_min, 4) AS z_min, round(z_max, 4) AS z_max, round(slope_mean, 4) AS slope_mean, round(steep_pct, 4) AS steep_pct, round(hilltop_ha, 4) AS hilltop_ha, round(valley_ha, 4) AS valley_ha FROM sm JOIN ar ON ar.ds = sm.ds""")
def ter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS1, LF1, LF2 over the fields' own cells."""
    layers, geo = surface.analyse(_readings(spark, sf_dir))
    layers = cut(layers.select("ds", "z", "slope_pct", "landform"))
    of = lambda k, name: grid.class_areas(layers, "landform", [k], geo).select("ds", F.col("area_ha").alias(name))
    a = relief.terrain_summary(layers, geo).select("ds", "cells", "area_ha", "z_min", "z_max", "slope_mean", "steep_pct")
    return r4(a.join(of(1, "hilltop_ha"), "ds").join(of(6, "valley_ha"), "ds"))


@register("ter_blocks")
def ter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER13: fields of a log that lie apart."""
    log = _readings(spark, sf_dir)
    geo = cut(surface.geometry(log))
    return r4(merge_tree.blocks(surface.surface(log, geo), geo))


@register("dsn_log_direction")
def dsn_log_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DSN1, DSN6: direction and sides of the least rectangle about all positions of a log."""
    return r4(design.direction(rough_log(spark, sf_dir)))
