"""Registered queries over terrain cells: 9 m cells of the machine log's altitude."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions.lineage import cut, keyed
from fieldweave.operators import graph, grid, hydro, merge_tree, relief
from fieldweave.plans.log_queries import QUERIES as _, r4  # noqa: F401
from fieldweave.sources.bench_log import bench_log, sql

QUERIES, SQL = {}, {}
SIZE = 9.0


def register(name: str, query: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if query:
            SQL[name] = sql(query)
        return f

    return keep


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.bin_points(bench_log(spark, sf_dir), SIZE)


def _pits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with pits deep enough to be basins."""
    z = F.col("z") + 0.9 * F.cos(F.col("row") / 2.0) * F.cos(F.col("col") / 3.0)
    return _cells(spark, sf_dir).withColumn("z", z)


#: Cells with every pass shifted by a bowl, so that there is something to fill.
def _bowl(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("z") + 0.3 * F.cos(F.col("row") / 3.0) * F.cos(F.col("col") / 4.0)
    return _cells(spark, sf_dir).withColumn("z", z)


CELLS = "c0 AS (SELECT ds, -CAST(floor(y / 9) AS BIGINT) - 1 AS row, CAST(floor(x / 9) AS BIGINT) AS col, avg(elev_m) AS z FROM log GROUP BY ALL)"
BOWL = CELLS + ", cb AS (SELECT ds, row, col, z + 0.3e0 * cos(row / 3e0) * cos(col / 4e0) AS z FROM c0)"
OFF = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) AS f(dr, dc)"


def _stencil(c: str, fill: bool = True) -> str:
    """Common tables that end in st: each cell of c with its neighbours."""
    ghost = f"""
g0 AS (SELECT {c}.ds, row - dr AS row, col - dc AS col, z, dr, dc, {c}.row AS r, {c}.col AS k FROM {c}, {OFF} WHERE dr <> 0 OR dc <> 0),
g1 AS (SELECT g0.*, row_number() OVER (PARTITION BY ds, row, col ORDER BY dr*dr + dc*dc, r, k) AS n FROM g0 WHERE NOT EXISTS (SELECT 1 FROM {c} v WHERE v.ds = g0.ds AND v.row = g0.row AND v.col = g0.col)),
a AS (SELECT ds, row, col, z FROM {c} UNION ALL SELECT ds, row, col, z FROM g1 WHERE n = 1),""" if fill else f"\na AS (SELECT ds, row, col, z FROM {c}),"
    names = {(-1, -1): "nw", (-1, 0): "n", (-1, 1): "ne", (0, -1): "w", (0, 1): "e", (1, -1): "sw", (1, 0): "s", (1, 1): "se"}
    picks = ", ".join(f"max(CASE WHEN a.row - {c}.row = {o[0]} AND a.col - {c}.col = {o[1]} THEN a.z END) AS {n}" for o, n in names.items())
    return f"{ghost}\nst AS (SELECT {c}.ds, {c}.row, {c}.col, {c}.z, {picks} FROM {c} JOIN a ON a.ds = {c}.ds AND abs(a.row - {c}.row) <= 1 AND abs(a.col - {c}.col) <= 1 GROUP BY ALL)"


@register("ter_cells", CELLS + " SELECT ds, row, col, round(z, 6) AS z FROM c0")
def ter_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER6 (binning), TER16."""
    return r4(_cells(spark, sf_dir), digits=6)


_DER = BOWL + "," + _stencil("cb") + """,
gr AS (SELECT *, ((ne+2*e+se)-(nw+2*w+sw))/72e0 AS dx, ((nw+2*n+ne)-(sw+2*s+se))/72e0 AS dy, ((w+e)/2-z)/81e0 AS d_, ((n+s)/2-z)/81e0 AS e_, (-nw+ne+sw-se)/324e0 AS f_, (e-w)/18e0 AS g_, (n-s)/18e0 AS h_ FROM st),
gs AS (SELECT *, sqrt(dx*dx+dy*dy) AS grad, g_*g_+h_*h_ AS g2 FROM gr)"""


@register(
    "der_stencil",
    _DER + """
SELECT ds, row, col, round(100*grad, 5) AS slope_pct, round(degrees(atan(grad)), 5) AS slope_deg,
  round(CASE WHEN g2 < 1e-12 THEN 0 ELSE -2*(d_*g_*g_+e_*h_*h_+f_*g_*h_)/g2 END, 7) + 0e0 AS profile, round(CASE WHEN g2 < 1e-12 THEN 0 ELSE -2*(d_*h_*h_+e_*g_*g_-f_*g_*h_)/g2 END, 7) + 0e0 AS plan, round(-2*(d_+e_), 7) + 0e0 AS curvature,
  round(greatest(0, least(1, (sin(radians(45)) - cos(radians(45))*(dx*sin(radians(315))+dy*cos(radians(315))))/sqrt(1+grad*grad))), 6) AS hillshade,
  round(greatest(z,nw,n,ne,w,e,sw,s,se)-least(z,nw,n,ne,w,e,sw,s,se), 6) AS roughness, round((abs(z-nw)+abs(z-n)+abs(z-ne)+abs(z-w)+abs(z-e)+abs(z-sw)+abs(z-s)+abs(z-se))/8, 6) AS tri FROM gs""",
)
def der_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DER1, DER4, DER5, DER8, DER9, TER10."""
    d = grid.derivatives(_bowl(spark, sf_dir), SIZE)
    digits = {"slope_pct": 5, "slope_deg": 5, "profile": 7, "plan": 7, "curvature": 7, "hillshade": 6, "roughness": 6, "tri": 6}
    return d.select("ds", "row", "col", *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in digits.items()])


@register("der_aspect", _DER + ", b AS (SELECT ds, row, col, CASE WHEN 100*grad >= 0.5 THEN round(CASE WHEN degrees(atan2(-dx,-dy)) < 0 THEN degrees(atan2(-dx,-dy)) + 360 ELSE degrees(atan2(-dx,-dy)) END, 4) END AS aspect FROM gs) SELECT ds, row, col, aspect + 0e0 AS aspect, CAST(CASE WHEN aspect IS NULL THEN -1 ELSE CAST(floor((aspect + 22.5e0) / 45) AS BIGINT) % 8 END AS BIGINT) AS sector FROM b")
def der_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DER2, DER3."""
    d = grid.derivatives(_bowl(spark, sf_dir), SIZE)
    return d.select("ds", "row", "col", (F.col("aspect") + F.lit(0.0)).alias("aspect"), F.col("sector").cast("long").alias("sector"))


def _disc(r: float) -> str:
    return f"SELECT p.ds, p.row, p.col, p.z - avg(q.z) AS t FROM cb p JOIN cb q ON p.ds = q.ds AND (p.row-q.row)*(p.row-q.row) + (p.col-q.col)*(p.col-q.col) <= {r * r} GROUP BY p.ds, p.row, p.col, p.z"


@register("der_tpi", BOWL + f", t1 AS ({_disc(2)}), t2 AS ({_disc(4.5)}), m AS (SELECT ds, avg(t) AS m, stddev_pop(t) AS s FROM t2 GROUP BY ds) SELECT t1.ds, t1.row, t1.col, round(t1.t, 6) + 0e0 AS tpi_small, round(t2.t, 6) + 0e0 AS tpi_large, round((t2.t - m) / s, 5) + 0e0 AS tpi_std FROM t1 JOIN t2 ON t1.ds = t2.ds AND t1.row = t2.row AND t1.col = t2.col JOIN m ON m.ds = t1.ds")
def der_tpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DER6, DER7."""
    c = cut(_bowl(spark, sf_dir))
    a, b = grid.tpi(c, 2).withColumnRenamed("tpi", "tpi_small"), grid.standardise(grid.tpi(c, 4.5))
    j = a.join(keyed(b), ["ds", "row", "col"])
    return j.select("ds", "row", "col", *[(F.round(x, n) + F.lit(0.0)).alias(y) for x, n, y in (("tpi_small", 6, "tpi_small"), ("tpi", 6, "tpi_large"), ("tpi_std", 5, "tpi_std"))])


_LAND = BOWL + "," + _stencil("cb") + f""",
sl AS (SELECT ds, row, col, 100*sqrt(pow(((ne+2*e+se)-(nw+2*w+sw))/72e0, 2) + pow(((nw+2*n+ne)-(sw+2*s+se))/72e0, 2)) AS slope FROM st),
t1 AS ({_disc(2)}), t2 AS ({_disc(4.5)}), m1 AS (SELECT ds, avg(t) AS m, stddev_pop(t) AS s FROM t1 GROUP BY ds), m2 AS (SELECT ds, avg(t) AS m, stddev_pop(t) AS s FROM t2 GROUP BY ds),
x AS (SELECT sl.ds, sl.row, sl.col, slope, (t1.t - m1.m) / m1.s AS sm, (t2.t - m2.m) / m2.s AS lg FROM sl JOIN t1 ON t1.ds = sl.ds AND t1.row = sl.row AND t1.col = sl.col JOIN t2 ON t2.ds = sl.ds AND t2.row = sl.row AND t2.col = sl.col JOIN m1 ON m1.ds = sl.ds JOIN m2 ON m2.ds = sl.ds),
lf AS (SELECT *, CASE WHEN lg > 1 AND sm > 1 THEN 1 WHEN lg > 1 THEN 2 WHEN lg < -1 AND sm < -1 THEN 6 WHEN lg < -1 THEN 5 WHEN sm > 1 THEN 2 WHEN sm < -1 THEN 5 WHEN slope < 2 THEN 4 ELSE 3 END AS landform FROM x)"""


def _landforms(spark, sf_dir) -> DataFrame:
    c = cut(_bowl(spark, sf_dir))
    s = cut(grid.derivatives(c, SIZE).select("ds", "row", "col", "z", "slope_pct"))
    # each layer is a table: one plan of all would be planned anew at each of its stages, on the driver, and compute a disc twice
    t, u = cut(grid.tpi(c, 2)), cut(grid.tpi(c, 4.5))
    a, b = grid.standardise(t).drop("tpi").withColumnRenamed("tpi_std", "small"), grid.standardise(u).drop("tpi").withColumnRenamed("tpi_std", "large")
    j = s.join(keyed(a), ["ds", "row", "col"]).join(keyed(b), ["ds", "row", "col"])
    return j.withColumn("landform", grid.landform(F.col("small"), F.col("large"), F.col("slope_pct")))


@register("lf_classify", _LAND + " SELECT ds, row, col, CAST(landform AS BIGINT) AS landform FROM lf")
def lf_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LF1."""
    return r4(_landforms(spark, sf_dir).select("ds", "row", "col", "landform"))


@register("lf_areas", _LAND + ", k AS (SELECT unnest(range(1, 7)) AS class), n AS (SELECT ds, count(*) AS total FROM lf GROUP BY ds) SELECT n.ds, class, count(landform) AS cells, round(count(landform) * 81 / 1e4, 4) AS area_ha, round(100e0 * count(landform) / any_value(total), 4) AS pct FROM n CROSS JOIN k LEFT JOIN lf ON lf.ds = n.ds AND lf.landform = class GROUP BY n.ds, class")
def lf_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LF2."""
    return r4(grid.class_areas(_landforms(spark, sf_dir), "landform", list(range(1, 7)), SIZE))


@register("lf_character", _LAND + ", r AS (SELECT ds, max(z) - min(z) AS relief FROM cb GROUP BY ds) SELECT lf.ds, round(avg(slope), 4) AS mean_slope, round(any_value(relief), 4) AS relief, CASE WHEN avg(slope) < 1 AND any_value(relief) < 2 THEN 'flat' WHEN avg(slope) < 3 THEN 'gently_undulating' WHEN avg(slope) < 8 THEN 'rolling' ELSE 'hilly' END AS character FROM lf JOIN r ON r.ds = lf.ds GROUP BY lf.ds")
def lf_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LF3, TS1."""
    a = grid.derivatives(_bowl(spark, sf_dir), SIZE).groupBy("ds").agg(F.avg("slope_pct").alias("mean_slope"), (F.max("z") - F.min("z")).alias("relief"))
    return r4(a.withColumn("character", grid.character(F.col("relief"), F.col("mean_slope"))))


@register("lf_position", CELLS + ", e AS (SELECT ds, min(row) AS r0, max(row) AS r1, min(col) AS k0, max(col) AS k1 FROM c0 GROUP BY ds), p AS (SELECT c0.ds, row, col, (col - k0) / greatest(k1 - k0, 1e-9) AS fx, (r1 - row) / greatest(r1 - r0, 1e-9) AS fy FROM c0 JOIN e ON e.ds = c0.ds), w AS (SELECT *, CASE WHEN fx < 1e0/3 THEN 'west' WHEN fx > 2e0/3 THEN 'east' ELSE '' END AS ew, CASE WHEN fy < 1e0/3 THEN 'south' WHEN fy > 2e0/3 THEN 'north' ELSE '' END AS ns FROM p) SELECT ds, row, col, CASE WHEN ns <> '' AND ew <> '' THEN ns || '-' || ew || ' part' WHEN ns <> '' THEN ns || 'ern part' WHEN ew <> '' THEN ew || 'ern part' ELSE 'centre' END AS part FROM w")
def lf_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LF4."""
    c = _cells(spark, sf_dir)
    e = c.groupBy("ds").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("k0"), F.max("col").alias("k1"))
    fx, fy = (F.col("col") - F.col("k0")) / F.greatest(F.col("k1") - F.col("k0"), F.lit(1e-9)), (F.col("r1") - F.col("row")) / F.greatest(F.col("r1") - F.col("r0"), F.lit(1e-9))
    return c.join(e, "ds").select("ds", "row", "col", grid.position_word(fx, fy).alias("part"))


@register("der_trend", CELLS + ", a AS (SELECT ds, var_pop(col*9e0) AS xx, var_pop(row*-9e0) AS yy, covar_pop(col*9e0, row*-9e0) AS xy, covar_pop(col*9e0, z) AS xz, covar_pop(row*-9e0, z) AS yz, var_pop(z) AS zz FROM c0 GROUP BY ds), b AS (SELECT *, (xz*yy-yz*xy)/(xx*yy-xy*xy) AS b, (yz*xx-xz*xy)/(xx*yy-xy*xy) AS c FROM a) SELECT b.ds, round(100*sqrt(b*b+c*c), 5) AS gradient_pct, round(any_value((b*xz+c*yz)/zz), 5) AS r2, round(max(col*9e0*b - row*9e0*c) - min(col*9e0*b - row*9e0*c), 5) AS drop_m FROM b JOIN c0 ON c0.ds = b.ds GROUP BY b.ds, b, c")
def der_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DER10."""
    return r4(grid.plane_trend(_cells(spark, sf_dir), SIZE).drop("bearing"), digits=5)


_PLANE = CELLS + """, p AS (SELECT ds, col*9e0 AS x, row*-9e0 AS y, z FROM c0),
m AS (SELECT ds, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM p GROUP BY ds),
r AS (SELECT p.ds, z - mz - (xz*yy-yz*xy)/(xx*yy-xy*xy)*(x-mx) - (yz*xx-xz*xy)/(xx*yy-xy*xy)*(y-my) AS res FROM p JOIN m ON m.ds = p.ds)"""


@register("der_relief", _PLANE + " SELECT ds, round(quantile_cont(res, 0.95) - quantile_cont(res, 0.05), 4) AS relief_m FROM r GROUP BY ds")
def der_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DER11."""
    return r4(grid.residual_relief(_cells(spark, sf_dir), SIZE))


@register("der_level", _PLANE + """, q AS (SELECT ds, quantile_cont(res, 0.95) - quantile_cont(res, 0.05) AS relief FROM r GROUP BY ds) SELECT ds, round(relief, 4) AS relief_m, relief < greatest(0.05e0, 2 * 0.02e0 * (ds % 4), 0) AS level FROM q""")
def der_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DER11: whether what the plane leaves is no more than noise."""
    c = _cells(spark, sf_dir)
    noise = c.select("ds").distinct().select("ds", (0.02 * (F.col("ds") % 4)).alias("noise"), F.lit(0.0).alias("step"))
    return r4(grid.is_level(grid.residual_relief(c, SIZE), noise))


@register("ter_smooth", BOWL + ", w AS (SELECT p.ds, p.row, p.col, sum(exp(-((p.row-q.row)*(p.row-q.row)+(p.col-q.col)*(p.col-q.col))/2.88e0) * q.z) / sum(exp(-((p.row-q.row)*(p.row-q.row)+(p.col-q.col)*(p.col-q.col))/2.88e0)) AS z FROM cb p JOIN cb q ON p.ds = q.ds AND abs(p.row-q.row) <= 4 AND abs(p.col-q.col) <= 4 GROUP BY ALL) SELECT ds, row, col, round(z, 6) AS z FROM w")
def ter_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER8."""
    return r4(grid.smooth(_bowl(spark, sf_dir), 1.2), digits=6)


@register("ter_coarsen", BOWL + " SELECT ds, CAST(floor(row / 3e0) AS BIGINT) AS row, CAST(floor(col / 3e0) AS BIGINT) AS col, round(avg(z), 5) AS z FROM cb GROUP BY ALL")
def ter_coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER11."""
    return r4(grid.coarsen(_bowl(spark, sf_dir), 3), digits=5)


@register("ter_fill_gaps", BOWL + ", h AS (SELECT * FROM cb WHERE (row * 7 + col * 3) % 5 <> 0), n AS (SELECT q.ds, q.row + f.dr AS row, q.col + f.dc AS col, q.z, f.dr*f.dr + f.dc*f.dc AS d2 FROM h q, (SELECT a.i AS dr, b.i AS dc FROM (SELECT unnest(range(-2, 3)) AS i) a, (SELECT unnest(range(-2, 3)) AS i) b WHERE a.i*a.i + b.i*b.i BETWEEN 1 AND 4) f), g AS (SELECT ds, row, col, sum(z / d2) / sum(1e0 / d2) AS z FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.ds = n.ds AND h.row = n.row AND h.col = n.col) GROUP BY ds, row, col) SELECT ds, row, col, round(z, 6) AS z, false AS filled FROM h UNION ALL SELECT ds, row, col, round(z, 6), true FROM g")
def ter_fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER6 (gaps within two cells)."""
    holes = _bowl(spark, sf_dir).where("(row * 7 + col * 3) % 5 <> 0")
    return r4(grid.idw_fill(holes, 2.0), digits=6)


@register("ter_step", "SELECT ds, CASE WHEN count(*) < 50 THEN 0e0 WHEN bool_and(abs(v - round(v)) <= 1e-3) THEN 1e0 WHEN bool_and(abs(v*2 - round(v*2)) * 0.5 <= 1e-3) THEN 0.5e0 WHEN bool_and(abs(v*10 - round(v*10)) * 0.1 <= 1e-3) THEN 0.1e0 ELSE 0e0 END AS step FROM (SELECT ds, CASE WHEN ds % 2 = 0 THEN round(elev_m * 10) / 10 ELSE elev_m END AS v FROM log) GROUP BY ds")
def ter_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER3."""
    v = F.when(F.col("ds") % 2 == 0, F.round(F.col("elev_m") * 10) / 10).otherwise(F.col("elev_m"))
    return grid.value_step(bench_log(spark, sf_dir).withColumn("elev_m", v))


_ODD = "lo AS (SELECT *, CASE WHEN seq % 50 = 7 THEN 0e0 WHEN pass_id = 3 THEN elev_m + 100 ELSE elev_m END AS e FROM log)"


@register("ter_fill_values", _ODD + ", m AS (SELECT ds, median(e) AS m FROM lo GROUP BY ds), d AS (SELECT lo.ds, median(abs(e - m)) AS mad, any_value(m) AS m FROM lo JOIN m ON m.ds = lo.ds GROUP BY lo.ds) SELECT lo.ds, seq FROM lo JOIN d ON d.ds = lo.ds WHERE NOT (e IN (0, -9999, -32768) AND abs(e - m) > greatest(30, 10 * mad))")
def ter_fill_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER1."""
    e = F.when(F.col("seq") % 50 == 7, 0.0).otherwise(F.when(F.col("pass_id") == 3, F.col("elev_m") + 100).otherwise(F.col("elev_m")))
    return grid.drop_fill_values(bench_log(spark, sf_dir).withColumn("elev_m", e)).select("ds", "seq")


@register("ter_stray", _ODD + ", p AS (SELECT ds, pass_id, median(e) AS m FROM lo GROUP BY ds, pass_id), o AS (SELECT a.ds, a.pass_id, any_value(a.m) AS m, median(b.m) AS med FROM p a JOIN p b ON a.ds = b.ds AND a.pass_id <> b.pass_id GROUP BY a.ds, a.pass_id HAVING count(*) >= 2), q AS (SELECT o.ds, o.pass_id, any_value(o.m) AS m, any_value(med) AS med, median(abs(b.m - med)) AS mad FROM o JOIN p b ON b.ds = o.ds AND b.pass_id <> o.pass_id GROUP BY o.ds, o.pass_id) SELECT ds, pass_id FROM q WHERE abs(m - med) > greatest(30, 10 * mad)")
def ter_stray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER2."""
    e = F.when(F.col("seq") % 50 == 7, 0.0).otherwise(F.when(F.col("pass_id") == 3, F.col("elev_m") + 100).otherwise(F.col("elev_m")))
    return grid.stray_passes(bench_log(spark, sf_dir).withColumn("elev_m", e))


@register("ter_auto_cell", "s AS (SELECT ds, CASE WHEN median(swath_m) IS NULL THEN 10e0 ELSE least(greatest(median(swath_m), 1e0), 60e0) END AS swath_m, max(x) - min(x) AS w, max(y) - min(y) AS h FROM log GROUP BY ds) SELECT ds, swath_m, greatest(round(least(greatest(5e0, swath_m / 2), 25) * 2) / 2, ceil(sqrt(w * h / 400000) * 2) / 2) AS cell FROM s")
def ter_auto_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER6 (cell size), TER15."""
    return grid.auto_cell(bench_log(spark, sf_dir))


@register("ter_components", BOWL + ", h AS (SELECT ds, row, col, (row + 1073741824) * 2147483648 + col + 1073741824 AS id FROM cb WHERE (row * 5 + col * 11) % 3 <> 0 AND (row + col) % 4 <> 1), r AS (SELECT ds, id AS src, id, row, col FROM h UNION SELECT r.ds, r.src, h.id, h.row, h.col FROM r JOIN h ON h.ds = r.ds AND abs(h.row - r.row) <= 1 AND abs(h.col - r.col) <= 1), l AS (SELECT ds, src, min(id) AS label FROM r GROUP BY ds, src), n AS (SELECT ds, label, count(*) AS cells FROM l GROUP BY ds, label) SELECT h.ds, h.row, h.col, l.label, n.cells FROM h JOIN l ON l.ds = h.ds AND l.src = h.id JOIN n ON n.ds = l.ds AND n.label = l.label WHERE n.cells >= 2")
def ter_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER12."""
    return graph.cell_components(_bowl(spark, sf_dir).where("(row * 5 + col * 11) % 3 <> 0 and (row + col) % 4 <> 1"), 2)


SQL["ter_components"] = SQL["ter_components"].replace("WITH", "WITH RECURSIVE", 1)


def _filled(spark, sf_dir) -> DataFrame:
    return cut(hydro.fill_sinks(_pits(spark, sf_dir)))


#: Levels by relaxation: a cell's level is kept by its key and only falls.
_FILL = CELLS + """, cb AS (SELECT ds, row, col, z + 0.9e0 * cos(row / 2e0) * cos(col / 3e0) AS z FROM c0),
ed AS (SELECT a.ds, a.row, a.col, any_value(a.z) AS z, count(*) AS n FROM cb a JOIN cb b ON b.ds = a.ds AND abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1 GROUP BY a.ds, a.row, a.col),
fl(ds, row, col, z, lev) USING KEY (ds, row, col) AS (
  SELECT ds, row, col, z, z FROM ed WHERE n < 9
  UNION
  SELECT ds, row, col, any_value(z), min(up) FROM (
    SELECT b.ds, b.row, b.col, b.z, CASE WHEN b.z > f.lev THEN b.z ELSE f.lev + 1e-9 END AS up, k.lev AS now
    FROM fl f JOIN cb b ON b.ds = f.ds AND abs(b.row - f.row) <= 1 AND abs(b.col - f.col) <= 1 LEFT JOIN recurring.fl k ON k.ds = b.ds AND k.row = b.row AND k.col = b.col)
  WHERE now IS NULL OR up < now GROUP BY ds, row, col),
fz AS (SELECT ds, row, col, z, lev AS filled, greatest(lev - z, 0) AS depth FROM fl)"""


@register("hyd_fill", _FILL + " SELECT ds, row, col, round(z, 5) AS z, round(filled, 5) AS filled, round(depth, 5) + 0e0 AS depth FROM fz")
def hyd_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HYD1, HYD2."""
    return r4(_filled(spark, sf_dir), digits=5)


SQL["hyd_fill"] = SQL["hyd_fill"].replace("WITH", "WITH RECURSIVE", 1)


_D8 = CELLS + ", c8 AS (SELECT ds, row, col, z + 1e-7 * ((row * 31 + col * 17) % 101) AS z FROM c0)," + _stencil("c8", False) + """,
o8 AS (SELECT ds, row, col, z, unnest([{'i': 0, 'n': e, 'o': w, 'd': 9e0}, {'i': 1, 'n': se, 'o': nw, 'd': 9*sqrt(2e0)}, {'i': 2, 'n': s, 'o': n, 'd': 9e0}, {'i': 3, 'n': sw, 'o': ne, 'd': 9*sqrt(2e0)}, {'i': 4, 'n': w, 'o': e, 'd': 9e0}, {'i': 5, 'n': nw, 'o': se, 'd': 9*sqrt(2e0)}, {'i': 6, 'n': n, 'o': s, 'd': 9e0}, {'i': 7, 'n': ne, 'o': sw, 'd': 9*sqrt(2e0)}]) AS k FROM st),
p8 AS (SELECT ds, row, col, k.i AS i, CASE WHEN k.n IS NULL AND k.o IS NOT NULL THEN -1 ELSE k.i END AS code, (z - CASE WHEN k.n IS NULL AND k.o IS NOT NULL THEN 2*z - k.o ELSE k.n END) / k.d AS fall FROM o8),
b8 AS (SELECT *, row_number() OVER (PARTITION BY ds, row, col ORDER BY fall DESC NULLS LAST, i) AS rk FROM p8 WHERE fall > 0),
d8 AS (SELECT c8.ds, c8.row, c8.col, coalesce(b8.code, -1) AS code FROM c8 LEFT JOIN b8 ON b8.ds = c8.ds AND b8.row = c8.row AND b8.col = c8.col AND rk = 1)"""


def _tilted(spark, sf_dir) -> DataFrame:
    return _cells(spark, sf_dir).select("ds", "row", "col", (F.col("z") + 1e-7 * F.pmod(F.col("row") * 31 + F.col("col") * 17, F.lit(101))).alias("filled"))


SQL_D8 = _D8.replace("((row * 31 + col * 17) % 101)", "((((row * 31 + col * 17) % 101) + 101) % 101)")


@register("hyd_d8", SQL_D8 + " SELECT ds, row, col, CAST(code AS BIGINT) AS code FROM d8")
def hyd_d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HYD4."""
    return r4(hydro.d8(_tilted(spark, sf_dir), SIZE))


@register("hyd_accumulation", SQL_D8 + ", rv AS (SELECT ds, row, col, row + [0,1,1,1,0,-1,-1,-1][code + 1] AS r2, col + [1,1,0,-1,-1,-1,0,1][code + 1] AS c2 FROM d8 WHERE code >= 0), fl AS (SELECT ds, row AS sr, col AS sc, row, col FROM d8 UNION ALL SELECT fl.ds, fl.sr, fl.sc, rv.r2, rv.c2 FROM fl JOIN rv ON rv.ds = fl.ds AND rv.row = fl.row AND rv.col = fl.col) SELECT ds, row, col, CAST(count(*) AS DOUBLE) AS acc FROM fl GROUP BY ds, row, col")
def hyd_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HYD5, HYD6."""
    return hydro.flow_accumulation(cut(hydro.d8(_tilted(spark, sf_dir), SIZE)))


SQL["hyd_accumulation"] = SQL["hyd_accumulation"].replace("WITH", "WITH RECURSIVE", 1)


def _wet(spark, sf_dir):
    f = _filled(spark, sf_dir)
    codes = cut(hydro.d8(f, SIZE))
    acc = cut(hydro.flow_accumulation(codes))
    twi = hydro.wetness(acc, grid.derivatives(f.select("ds", "row", "col", "z"), SIZE), SIZE)
    return f, codes, acc, twi


#: Directions over filled cells, what drains through each, and slopes of the cells as they are.
_FLOW = _FILL + ", c8 AS (SELECT ds, row, col, filled AS z FROM fz)," + _D8[_D8.index(_stencil("c8", False)) :] + """,
rv AS (SELECT ds, row, col, row + [0,1,1,1,0,-1,-1,-1][code + 1] AS r2, col + [1,1,0,-1,-1,-1,0,1][code + 1] AS c2 FROM d8 WHERE code >= 0),
fw AS (SELECT ds, row AS sr, col AS sc, row, col FROM d8 UNION ALL SELECT fw.ds, fw.sr, fw.sc, rv.r2, rv.c2 FROM fw JOIN rv ON rv.ds = fw.ds AND rv.row = fw.row AND rv.col = fw.col),
ac AS (SELECT ds, row, col, CAST(count(*) AS DOUBLE) AS acc FROM fw GROUP BY ds, row, col)"""
_TWI = _FLOW + ", sl AS (WITH " + _stencil("cb").strip() + """ SELECT ds, row, col, 100*sqrt(pow(((ne+2*e+se)-(nw+2*w+sw))/72e0, 2) + pow(((nw+2*n+ne)-(sw+2*s+se))/72e0, 2)) AS slope FROM st),
tw AS (SELECT fz.ds, fz.row, fz.col, fz.z, depth, slope, ln(acc * 9 / greatest(slope / 100, 0.001e0)) AS twi FROM fz JOIN ac ON ac.ds = fz.ds AND ac.row = fz.row AND ac.col = fz.col JOIN sl ON sl.ds = fz.ds AND sl.row = fz.row AND sl.col = fz.col)"""


@register("hyd_wet", _TWI + """, cd AS (SELECT *, slope >= 0.2 OR depth > 0.05 AS cand FROM tw), tt AS (SELECT ds, quantile_cont(CASE WHEN cand THEN twi END, 0.9) AS t, avg(CASE WHEN cand THEN 1e0 ELSE 0e0 END) AS share FROM cd GROUP BY ds)
SELECT cd.ds, count(*) FILTER (WHERE depth > 0.05) AS ponded, round(sum(depth) * 81, 4) AS volume_m3, count(*) FILTER (WHERE share >= 0.02 AND cand AND (depth > 0.05 OR twi >= greatest(t, 8))) AS wet FROM cd JOIN tt ON tt.ds = cd.ds GROUP BY cd.ds""")
def hyd_wet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HYD7, HYD8, HYD9, HYD12."""
    f, _, _, twi = _wet(spark, sf_dir)
    return r4(hydro.summary(f, hydro.guarded_wet(cut(hydro.wet_cells(cut(twi), f).drop("depth")), f, 0.2), SIZE))


#: Lakes by the least cell that each of their cells reaches.
_LAKES = _FILL + """, lk AS (SELECT ds, row, col, z, filled, depth, (row + 1073741824) * 2147483648 + col + 1073741824 AS id FROM fz WHERE depth > 1e-4),
rc(ds, id, row, col, root) USING KEY (ds, id) AS (
  SELECT ds, id, row, col, id FROM lk
  UNION
  SELECT ds, id, any_value(row), any_value(col), min(root) FROM (
    SELECT b.ds, b.id, b.row, b.col, f.root, k.root AS now FROM rc f JOIN lk b ON b.ds = f.ds AND abs(b.row - f.row) <= 1 AND abs(b.col - f.col) <= 1 JOIN recurring.rc k ON k.ds = b.ds AND k.id = b.id)
  WHERE root < now GROUP BY ds, id),
ba AS (SELECT lk.ds, root AS basin, count(*) * 81e0 AS area_m2, max(depth) AS max_depth, avg(depth) AS mean_depth, sum(depth) * 81 AS volume_m3, max(filled) AS spill, min(z) AS bottom, min({'d': -depth, 'r': lk.row, 'c': lk.col}) AS p FROM lk JOIN rc ON rc.ds = lk.ds AND rc.id = lk.id GROUP BY lk.ds, root HAVING max(depth) > 0.05)"""


@register("hyd_basins", _LAKES + " SELECT ds, basin, area_m2, round(max_depth, 4) AS max_depth, round(mean_depth, 4) AS mean_depth, round(volume_m3, 4) AS volume_m3, round(spill, 4) AS spill, round(bottom, 4) AS bottom, p.r AS row, p.c AS col, row_number() OVER (PARTITION BY ds ORDER BY volume_m3 DESC, basin) AS rank FROM ba")
def hyd_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HYD3, HYD11 (floor)."""
    return r4(hydro.basins(_filled(spark, sf_dir), SIZE))


@register("hyd_unlisted", _LAKES + " SELECT ds, count(*) FILTER (WHERE area_m2 >= 700) AS listed, count(*) FILTER (WHERE area_m2 < 700) AS unlisted FROM ba GROUP BY ds")
def hyd_unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HYD11: basins of 700 m2 or more, and the count of the smaller."""
    return hydro.unlisted(_filled(spark, sf_dir), SIZE, 700.0)


for _name in ("hyd_basins", "hyd_unlisted"):
    SQL[_name] = SQL[_name].replace("WITH", "WITH RECURSIVE", 1)


SQL["hyd_wet"] = SQL["hyd_wet"].replace("WITH", "WITH RECURSIVE", 1)


@register("hyd_channels", _FLOW + """, nt AS (SELECT * FROM ac WHERE acc * 81 / 1e4 >= 0.03),
sg AS (SELECT nt.ds, nt.row, nt.col, rv.r2, rv.c2, nt.acc FROM nt JOIN rv ON rv.ds = nt.ds AND rv.row = nt.row AND rv.col = nt.col JOIN nt t ON t.ds = rv.ds AND t.row = rv.r2 AND t.col = rv.c2)
SELECT ds, row, col, r2 AS row2, c2 AS col2, acc, round(9 * sqrt((row-r2)*(row-r2) + (col-c2)*(col-c2)), 4) AS length_m, NOT EXISTS (SELECT 1 FROM sg u WHERE u.ds = sg.ds AND u.r2 = sg.row AND u.c2 = sg.col) AS head FROM sg""")
def hyd_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HYD10."""
    _, codes, acc, _ = _wet(spark, sf_dir)
    return r4(hydro.channels(codes, acc, SIZE, 0.03))


_SEG = {"l": "{'x': x0, 'y': y0 - (v - nw) / (sw - nw) * 9}", "r": "{'x': x0 + 9, 'y': y0 - (v - ne) / (se - ne) * 9}", "t": "{'x': x0 + (v - nw) / (ne - nw) * 9, 'y': y0}", "b": "{'x': x0 + (v - sw) / (se - sw) * 9, 'y': y0 - 9}"}
_LINE = lambda *ends: "[" + ", ".join(f"{{'a': {_SEG[e[0]]}, 'b': {_SEG[e[1]]}}}" for e in ends) + "]"


SQL["hyd_channels"] = SQL["hyd_channels"].replace("WITH", "WITH RECURSIVE", 1)


#: Every head runs down to its outlet; the farthest head of a cell has it.
@register("hyd_lines", _FLOW + """, nt AS (SELECT *, row * 2147483648 + col AS id FROM ac WHERE acc * 81 / 1e4 >= 0.03),
sg AS (SELECT nt.ds, nt.row, nt.col, rv.r2, rv.c2, nt.acc FROM nt JOIN rv ON rv.ds = nt.ds AND rv.row = nt.row AND rv.col = nt.col JOIN nt t ON t.ds = rv.ds AND t.row = rv.r2 AND t.col = rv.c2),
hd AS (SELECT ds, row, col FROM sg WHERE NOT EXISTS (SELECT 1 FROM sg u WHERE u.ds = sg.ds AND u.r2 = sg.row AND u.c2 = sg.col)),
dn AS (SELECT ds, row AS hr, col AS hc, row, col, 0 AS k FROM hd UNION ALL SELECT dn.ds, hr, hc, sg.r2, sg.c2, k + 1 FROM dn JOIN sg ON sg.ds = dn.ds AND sg.row = dn.row AND sg.col = dn.col),
dm AS (SELECT *, row_number() OVER (PARTITION BY ds, row, col ORDER BY k DESC, hr, hc) AS rk FROM dn),
ls AS (SELECT sg.*, hr, hc, k, 9 * sqrt((sg.row-r2)*(sg.row-r2) + (sg.col-c2)*(sg.col-c2)) AS length_m FROM sg JOIN dm ON dm.ds = sg.ds AND dm.row = sg.row AND dm.col = sg.col AND rk = 1)
SELECT ds, (hr + 1073741824) * 2147483648 + hc + 1073741824 AS line, CAST(k AS BIGINT) AS k, row, col, r2 AS row2, c2 AS col2, acc, round(length_m, 4) AS length_m, round(sum(length_m) OVER (PARTITION BY ds, hr, hc), 4) AS line_m FROM ls""")
def hyd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HYD10: drainage lines, longest first, none of which shares a segment with another."""
    _, codes, acc, _ = _wet(spark, sf_dir)
    return r4(hydro.channel_lines(codes, acc, SIZE, 0.03))


SQL["hyd_lines"] = SQL["hyd_lines"].replace("WITH", "WITH RECURSIVE", 1)


@register("con_segments", BOWL + """,
sq AS (SELECT n.ds, n.row, n.col, n.z AS nw, e.z AS ne, s.z AS sw, d.z AS se FROM cb n JOIN cb e ON e.ds = n.ds AND e.row = n.row AND e.col = n.col + 1 JOIN cb s ON s.ds = n.ds AND s.row = n.row + 1 AND s.col = n.col JOIN cb d ON d.ds = n.ds AND d.row = n.row + 1 AND d.col = n.col + 1),
lv AS (SELECT *, unnest(range(CAST(floor(least(nw, ne, sw, se) / 0.1e0) AS BIGINT) + 1, CAST(ceil(greatest(nw, ne, sw, se) / 0.1e0) AS BIGINT))) AS k FROM sq),
cs AS (SELECT *, k * 0.1e0 AS v, (col + 0.5e0) * 9 AS x0, -(row + 0.5e0) * 9 AS y0, (CASE WHEN nw > k * 0.1e0 THEN 8 ELSE 0 END + CASE WHEN ne > k * 0.1e0 THEN 4 ELSE 0 END + CASE WHEN se > k * 0.1e0 THEN 2 ELSE 0 END + CASE WHEN sw > k * 0.1e0 THEN 1 ELSE 0 END) AS c FROM lv),
ln AS (SELECT *, unnest(CASE WHEN c IN (1, 14) THEN """ + _LINE("lb") + " WHEN c IN (2, 13) THEN " + _LINE("br") + " WHEN c IN (3, 12) THEN " + _LINE("lr") + " WHEN c IN (4, 11) THEN " + _LINE("tr") + " WHEN c IN (6, 9) THEN " + _LINE("tb") + " WHEN c IN (7, 8) THEN " + _LINE("lt")
+ " WHEN (c = 5) = ((nw + ne + sw + se) / 4 > v) AND c IN (5, 10) THEN " + _LINE("lt", "br") + " WHEN c IN (5, 10) THEN " + _LINE("lb", "tr") + """ ELSE [] END) AS s FROM cs)
SELECT ds, row, col, round(v, 4) + 0e0 AS level, k % 5 = 0 AS major, round(s.a.x, 4) + 0e0 AS x1, round(s.a.y, 4) + 0e0 AS y1, round(s.b.x, 4) + 0e0 AS x2, round(s.b.y, 4) + 0e0 AS y2 FROM ln""")
def con_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CON2."""
    return r4(grid.contour_segments(_bowl(spark, sf_dir), 0.1, SIZE))


@register("con_interval", CELLS + ", r AS (SELECT ds, max(z) - min(z) AS relief FROM c0 GROUP BY ds), l AS (SELECT r.*, s, abs(relief / s - 12) AS d FROM r, (SELECT unnest([0.1e0,0.2e0,0.25e0,0.5e0,1e0,2e0,2.5e0,5e0,10e0,20e0,25e0,50e0]) AS s) WHERE relief / s BETWEEN 3 AND 40) SELECT r.ds, round(any_value(r.relief), 4) AS relief, arg_min(s, d) AS interval FROM r LEFT JOIN l ON l.ds = r.ds GROUP BY r.ds")
def con_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CON1."""
    c = grid.choose_interval(_cells(spark, sf_dir))
    return c.select("ds", (F.round("relief", 4) + F.lit(0.0)).alias("relief"), "interval")


@register("zon_bands", BOWL + ", e AS (SELECT ds, list_distinct([round(q, 6) FOR q IN quantile_cont(z, [0.25, 0.5, 0.75])]) AS e FROM cb GROUP BY ds), b AS (SELECT cb.ds, z, len(list_filter(e.e, lambda v: v < cb.z)) + 1 AS band FROM cb JOIN e ON e.ds = cb.ds) SELECT ds, CAST(band AS BIGINT) AS band, count(*) AS cells, round(avg(z), 5) AS mean_z, round(count(*) * 81 / 1e4, 4) AS area_ha FROM b GROUP BY ds, band")
def zon_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZON1 (bands), ZON3, YR2."""
    b = grid.equal_count_bands(_bowl(spark, sf_dir), 4)
    return r4(b.groupBy("ds", "band").agg(F.count(F.lit(1)).alias("cells"), F.avg("z").alias("mean_z"), (F.count(F.lit(1)) * 81 / 1e4).alias("area_ha")), digits=5)


@register("yr_by_landform", _LAND + ", v AS (SELECT log.ds, value, landform, avg(value) OVER (PARTITION BY log.ds) AS m FROM log JOIN lf ON lf.ds = log.ds AND lf.row = -CAST(floor(y / 9) AS BIGINT) - 1 AND lf.col = CAST(floor(x / 9) AS BIGINT)) SELECT ds, CAST(landform AS BIGINT) AS landform, count(value) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.75), 4) AS p75, round(stddev_samp(value), 4) AS sd, round((avg(value) - any_value(m)) / any_value(m) * 100, 4) + 0e0 AS delta_pct FROM v GROUP BY ds, landform")
def yr_by_landform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YR1, YR3, JN7 (classes), AGG16: yield by the landform it grew on."""
    from fieldweave.operators import stats

    p = grid.sample_nearest(bench_log(spark, sf_dir), cut(_landforms(spark, sf_dir)), SIZE, "landform").where("landform is not null")
    return r4(stats.group_stats(p, "value", "landform"))


@register("jn_bilinear", BOWL + "," + _stencil("cb") + """,
p AS (SELECT ds, seq AS id, x / 9 - 0.5e0 AS fx, y / 9 - 0.5e0 AS fy FROM log),
k AS (SELECT ds, id, fx, fy, CAST(floor(fx) AS BIGINT) + a.i AS cx, CAST(floor(fy) AS BIGINT) + b.i AS cy FROM p, (SELECT unnest([0, 1]) AS i) a, (SELECT unnest([0, 1]) AS i) b),
j AS (SELECT k.ds, k.id, (1 - abs(fx - cx)) * (1 - abs(fy - cy)) AS w, a.z FROM k JOIN a ON a.ds = k.ds AND a.row = -cy - 1 AND a.col = cx)
SELECT ds, id, round(sum(w * z) / sum(w), 5) AS z FROM j GROUP BY ds, id""")
def jn_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN7 (continuous)."""
    pts = bench_log(spark, sf_dir).select("ds", F.col("seq").alias("id"), "x", "y")
    return r4(grid.sample_bilinear(pts, _bowl(spark, sf_dir), SIZE), digits=5)


def _standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with slope and standardised height above their surroundings."""
    c = cut(_bowl(spark, sf_dir))
    # tables of their own, as in _landforms
    s, t = cut(grid.derivatives(c, SIZE).select("ds", "row", "col", "z", "slope_pct")), cut(grid.tpi(c, 2))
    return cut(s.join(keyed(grid.standardise(t).drop("tpi")), ["ds", "row", "col"]))


#: Hills (h = 1) and lows (h = -1): components beyond +-1 of four cells at least, the level of each ring about
#: them, and the ring at which it stops falling.
_PARTS = BOWL + "," + _stencil("cb") + f""",
sl AS (SELECT ds, row, col, 100*sqrt(pow(((ne+2*e+se)-(nw+2*w+sw))/72e0, 2) + pow(((nw+2*n+ne)-(sw+2*s+se))/72e0, 2)) AS slope FROM st),
t1 AS ({_disc(2)}), m1 AS (SELECT ds, avg(t) AS m, stddev_pop(t) AS s FROM t1 GROUP BY ds),
pc AS (SELECT cb.ds, cb.row, cb.col, z, slope, CASE WHEN (t - m) / s > 0 THEN 1 ELSE -1 END AS h, (cb.row + 1073741824) * 2147483648 + cb.col + 1073741824 AS id FROM cb JOIN t1 ON t1.ds = cb.ds AND t1.row = cb.row AND t1.col = cb.col JOIN m1 ON m1.ds = cb.ds JOIN sl ON sl.ds = cb.ds AND sl.row = cb.row AND sl.col = cb.col WHERE abs((t - m) / s) > 1),
rc(ds, h, id, row, col, root) USING KEY (ds, id) AS (
  SELECT ds, h, id, row, col, id FROM pc
  UNION
  SELECT ds, any_value(h), id, any_value(row), any_value(col), min(root) FROM (
    SELECT b.ds, b.h, b.id, b.row, b.col, f.root, k.root AS now FROM rc f JOIN pc b ON b.ds = f.ds AND b.h = f.h AND abs(b.row - f.row) <= 1 AND abs(b.col - f.col) <= 1 JOIN recurring.rc k ON k.ds = b.ds AND k.id = b.id)
  WHERE root < now GROUP BY ds, id),
pa AS (SELECT pc.*, root AS label FROM pc JOIN rc ON rc.ds = pc.ds AND rc.id = pc.id QUALIFY count(*) OVER (PARTITION BY pc.ds, root) * 81 >= 300),
di AS (SELECT p.ds, p.h, p.label, c.row, c.col, any_value(c.z) AS z, min(greatest(abs(p.row - c.row), abs(p.col - c.col))) AS k FROM pa p JOIN cb c ON c.ds = p.ds GROUP BY p.ds, p.h, p.label, c.row, c.col),
lv AS (SELECT ds, h, label, k, h * quantile_cont(h * z, 0.75) AS level FROM di WHERE k > 0 GROUP BY ds, h, label, k),
fo AS (SELECT a.ds, a.label, arg_min(a.level, a.k) AS foot FROM lv a LEFT JOIN lv b ON b.ds = a.ds AND b.label = a.label AND b.k = a.k + 1 WHERE b.k IS NULL OR NOT a.h * b.level < a.h * a.level GROUP BY a.ds, a.label),
mo AS (SELECT ds, h, label, count(*) AS n, min({{'k': -h * z, 'r': row, 'c': col, 'z': z}}) AS e, avg(row) AS mr, avg(col) AS mc, covar_samp(row, row) AS rr, covar_samp(col, col) AS cc, covar_samp(row, col) AS rc, avg(slope) AS slope, min(h * z) AS low FROM pa GROUP BY ds, h, label),
fe AS (SELECT mo.ds, h, mo.label, n, e.r AS row, e.c AS col, e.z AS extreme_m, h * (e.z - coalesce(foot, h * low)) AS height_m, n * 81e0 / 1e4 AS area_ha, (mc + 0.5e0) * 9 AS x, -(mr + 0.5e0) * 9 AS y,
    CASE WHEN n > 2 THEN sqrt(greatest((rr + cc) / 2 + sqrt(pow((rr - cc) / 2, 2) + rc * rc), 1e-12) / greatest((rr + cc) / 2 - sqrt(pow((rr - cc) / 2, 2) + rc * rc), 1e-12)) ELSE 1e0 END AS elongation, slope AS mean_slope_pct
  FROM mo LEFT JOIN fo ON fo.ds = mo.ds AND fo.label = mo.label)"""


@register("lf_hills", _PARTS + """ SELECT ds, label, row, col, round(extreme_m, 4) AS extreme_m, round(height_m, 4) + 0e0 AS height_m, round(area_ha, 4) AS area_ha, round(x, 4) AS x, round(y, 4) AS y, round(elongation, 2) AS elongation, round(mean_slope_pct, 4) AS mean_slope_pct FROM fe WHERE h = 1""")
def lf_hills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LF5, LF6: hills with their feet."""
    f = relief.features(_standing(spark, sf_dir), SIZE, min_ha=0.03).drop("closed", "rank")
    return r4(f.withColumn("elongation", F.round("elongation", 2)))


SQL["lf_hills"] = SQL["lf_hills"].replace("WITH", "WITH RECURSIVE", 1)


#: From each summit the highest level at which it is joined to each cell; its saddle is the best beside another feature.
_SADDLES = _PARTS + """,
fs AS (SELECT * FROM fe WHERE height_m >= 0.05),
cl(ds, h, label, row, col, lev) USING KEY (ds, label, row, col) AS (
  SELECT ds, h, label, row, col, h * extreme_m FROM fs
  UNION
  SELECT ds, any_value(h), label, row, col, max(up) FROM (
    SELECT f.ds, f.h, f.label, b.row, b.col, least(f.lev, f.h * b.z) AS up, k.lev AS now
    FROM cl f JOIN cb b ON b.ds = f.ds AND abs(b.row - f.row) <= 1 AND abs(b.col - f.col) <= 1 LEFT JOIN recurring.cl k ON k.ds = f.ds AND k.label = f.label AND k.row = b.row AND k.col = b.col)
  WHERE now IS NULL OR up > now GROUP BY ds, label, row, col),
ne AS (SELECT DISTINCT pa.ds, pa.label, pa.row + dr AS row, pa.col + dc AS col FROM pa JOIN fs ON fs.ds = pa.ds AND fs.label = pa.label, """ + OFF + """),
sa AS (SELECT cl.ds, cl.label, any_value(cl.h) AS h, any_value(cl.h) * max(lev) AS level FROM cl JOIN ne ON ne.ds = cl.ds AND ne.row = cl.row AND ne.col = cl.col AND ne.label <> cl.label GROUP BY cl.ds, cl.label),
fh AS (SELECT fs.*, CASE WHEN sa.level IS NOT NULL AND fs.h * (sa.level - (extreme_m - fs.h * height_m)) > 0 THEN fs.h * (extreme_m - sa.level) ELSE height_m END AS up FROM fs LEFT JOIN sa ON sa.ds = fs.ds AND sa.label = fs.label),
fr AS (SELECT *, CASE WHEN h = 1 THEN 'hill' WHEN elongation >= 2.5 THEN 'valley' ELSE 'hollow' END AS shape, row_number() OVER (PARTITION BY ds, h ORDER BY up * area_ha DESC, label) AS rank FROM fh WHERE up >= 0.05)"""


@register("lf_saddles", _SADDLES + " SELECT ds, label, round(level, 6) AS level FROM sa WHERE h = 1")
def lf_saddles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LF7: the saddle of every summit with all other features."""
    s = _standing(spark, sf_dir)
    part = {}
    for high in (True, False):
        c = cut(graph.cell_components(s.where(f"{'' if high else '-'}tpi_std > 1")))
        f = relief.features(s, SIZE, high, 0.03, parts=c).where("height_m >= 0.05")
        part[high] = cut(c.join(keyed(f.select("ds", "label")), ["ds", "label"], "left_semi"))
    return r4(merge_tree.saddles(s, part[True], part[False]), digits=6)


@register("tf_features", _SADDLES + """,
ff AS (SELECT ds, shape AS code, rank, 'ok' AS level, up AS metric FROM fr WHERE rank <= 2
  UNION ALL SELECT ds, CASE WHEN h = 1 THEN 'more_hills' ELSE 'more_lows' END, NULL, 'ok', CAST(count(*) AS DOUBLE) FROM fr WHERE rank > 2 GROUP BY ds, h
  UNION ALL SELECT ds, 'no_features', NULL, 'ok', 0e0 FROM (SELECT DISTINCT ds FROM cb) WHERE ds NOT IN (SELECT ds FROM fr))
SELECT ds, code, rank, level, round(metric, 4) + 0e0 AS metric FROM ff""")
def tf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LF5, LF6, LF7, TF1 (features and valleys): the first of each kind by height over its saddle, and how many more."""
    s = _standing(spark, sf_dir)
    return r4(merge_tree.feature_findings(merge_tree.features(s, SIZE, 0.05, 0.03), s, most=2))


for _name in ("lf_saddles", "tf_features"):
    SQL[_name] = SQL[_name].replace("WITH", "WITH RECURSIVE", 1)


@register("ter_detrend")
def ter_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER5, JN5: offsets of the passes."""
    return r4(relief.pass_offsets(bench_log(spark, sf_dir), 13.5))


#: The twelve nearest of each point, ties by number.
_NEAR = "nn AS (SELECT * FROM (SELECT a.ds, a.seq AS id, a.e AS e, b.x - a.x AS u, b.y - a.y AS v, b.e - a.e AS w, row_number() OVER (PARTITION BY a.ds, a.seq ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.seq) AS k FROM pt a JOIN pt b ON a.ds = b.ds AND a.seq <> b.seq) WHERE k <= 12)"


@register("ter_noise", "pt AS (SELECT ds, seq, x, y, elev_m AS e FROM log), " + _NEAR + """,
s AS (SELECT ds, id, avg(u) AS mu, avg(v) AS mv, avg(w) AS mw, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, w) AS uw, covar_pop(v, w) AS vw FROM nn GROUP BY ds, id),
d AS (SELECT *, 1e-6 + 1e-3 * (uu + vv) AS g FROM s), r AS (SELECT ds, mw - (uw*(vv+g) - vw*uv) / ((uu+g)*(vv+g) - uv*uv) * mu - (vw*(uu+g) - uw*uv) / ((uu+g)*(vv+g) - uv*uv) * mv AS r FROM d),
m AS (SELECT ds, median(r) AS m FROM r GROUP BY ds), n AS (SELECT r.ds, median(abs(r - m)) * 1.4826e0 / 1.05e0 AS noise FROM r JOIN m ON m.ds = r.ds GROUP BY r.ds)
SELECT ds, round(noise, 4) AS noise, round(0.7e0 * noise / (2 * sqrt(pi()) * greatest(0.03e0, 0.004e0 * 18 / sqrt(2e0))), 4) AS sigma FROM n""")
def ter_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER7, TER9: noise of the altitude and the smoothing that it asks for."""
    n = cut(relief.point_noise(bench_log(spark, sf_dir)))
    return r4(n.join(relief.smoothing_sigma(n, SIZE), "ds"))


@register("ter_spikes", "pt AS (SELECT ds, seq, x, y, CASE WHEN seq % 61 = 9 THEN elev_m + 3 ELSE elev_m END AS e FROM log), " + _NEAR + """,
r AS (SELECT ds, id, any_value(e) - median(e + w) AS r FROM nn GROUP BY ds, id), m AS (SELECT ds, median(r) AS m FROM r GROUP BY ds), d AS (SELECT r.ds, median(abs(r - m)) AS mad FROM r JOIN m ON m.ds = r.ds GROUP BY r.ds)
SELECT r.ds, id FROM r JOIN d ON d.ds = r.ds WHERE abs(r) > greatest(0.5e0, 3.5e0 * 1.4826e0 * mad)""")
def ter_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER4: planted spikes of three metres."""
    e = F.when(F.col("seq") % 61 == 9, F.col("elev_m") + 3).otherwise(F.col("elev_m"))
    return relief.altitude_spikes(bench_log(spark, sf_dir).withColumn("elev_m", e))


@register("con_profile", BOWL + "," + _stencil("cb") + """,
ex AS (SELECT ds, max(col) * 9e0 AS x1, -max(row) * 9e0 AS y0, -min(row) * 9e0 AS y1 FROM cb GROUP BY ds),
sta AS (SELECT ds, CAST(i AS BIGINT) AS id, sqrt((x1-5)*(x1-5) + (y1-5-y0-5)*(y1-5-y0-5)) * i / 19 AS d, 5 + i / 19e0 * (x1 - 5) AS x, y0 + 5 + i / 19e0 * (y1 - 5 - y0 - 5) AS y FROM ex, (SELECT unnest(range(20)) AS i)),
p AS (SELECT sta.ds, id, x / 9 - 0.5e0 AS fx, y / 9 - 0.5e0 AS fy FROM sta JOIN cb ON cb.ds = sta.ds AND cb.row = -CAST(floor(y / 9) AS BIGINT) - 1 AND cb.col = CAST(floor(x / 9) AS BIGINT)),
k AS (SELECT ds, id, fx, fy, CAST(floor(fx) AS BIGINT) + a.i AS cx, CAST(floor(fy) AS BIGINT) + b.i AS cy FROM p, (SELECT unnest([0, 1]) AS i) a, (SELECT unnest([0, 1]) AS i) b),
j AS (SELECT k.ds, k.id, (1 - abs(fx - cx)) * (1 - abs(fy - cy)) AS w, a.z FROM k JOIN a ON a.ds = k.ds AND a.row = -cy - 1 AND a.col = cx),
zz AS (SELECT ds, id, sum(w * z) / sum(w) AS z FROM j GROUP BY ds, id)
SELECT sta.ds, sta.id, round(d, 4) + 0e0 AS d, round(x, 4) + 0e0 AS x, round(y, 4) + 0e0 AS y, round(z, 4) AS z,
  round(100 * (lag(z) OVER w - z) / nullif(d - lag(d) OVER w, 0), 4) + 0e0 AS slope_pct FROM sta LEFT JOIN zz ON zz.ds = sta.ds AND zz.id = sta.id WINDOW w AS (PARTITION BY sta.ds ORDER BY sta.id)""")
def con_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CON3: across each field."""
    c = cut(_bowl(spark, sf_dir))
    e = c.groupBy("ds").agg((F.max("col") * SIZE).alias("x"), (-F.max("row") * SIZE).alias("y0"), (-F.min("row") * SIZE).alias("y1"))
    line = e.select("ds", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(5.0).alias("x"), (F.col("y0") + 5).alias("y")), F.struct(F.lit(1).alias("k"), F.col("x").alias("x"), (F.col("y1") - 5).alias("y")))).alias("v")).select("ds", "v.*")
    return r4(relief.profile(line, c, SIZE, 20))


@register("ts_findings", _TWI + """, q AS (SELECT ds, greatest(quantile_cont(twi, 0.9), 8) AS t FROM tw GROUP BY ds),
su AS (SELECT tw.ds, 100e0 * count(*) FILTER (WHERE slope > 10) / count(*) AS steep_pct, count(*) FILTER (WHERE slope > 10) * 81 / 1e4 AS steep_ha, sum(depth) * 81 AS pond, 100e0 * count(*) FILTER (WHERE depth > 0.05 OR twi >= t) / count(*) AS wet FROM tw JOIN q ON q.ds = tw.ds GROUP BY tw.ds),
pp AS (SELECT ds, col*9e0 AS x, row*-9e0 AS y, z FROM fz),
pm AS (SELECT *, (xz*yy-yz*xy)/(xx*yy-xy*xy) AS b, (yz*xx-xz*xy)/(xx*yy-xy*xy) AS c FROM (SELECT ds, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, var_pop(z) AS zz FROM pp GROUP BY ds)),
pr AS (SELECT pp.ds, any_value(100*sqrt(b*b+c*c)) AS grad, any_value((b*xz+c*yz)/zz) AS r2, max(x*b+y*c) - min(x*b+y*c) AS fall, quantile_cont(z - mz - b*(x-mx) - c*(y-my), 0.95) - quantile_cont(z - mz - b*(x-mx) - c*(y-my), 0.05) AS relief FROM pp JOIN pm ON pm.ds = pp.ds GROUP BY pp.ds)
SELECT ds, 'trend' AS code, 'ok' AS level FROM pr WHERE fall >= 0.1 AND (r2 > 0.3 OR grad > 0.5) UNION ALL SELECT ds, 'level', 'ok' FROM pr WHERE relief < 0.05
UNION ALL SELECT ds, 'pond', 'warning' FROM su WHERE pond > 500 UNION ALL SELECT ds, 'steep', 'warning' FROM su WHERE steep_pct >= 1 OR steep_ha >= 0.2 UNION ALL SELECT ds, 'wet', 'ok' FROM su WHERE wet >= 1""")
def ts_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF1, TS1: summary of each field and what it says."""
    f, _, _, twi = _wet(spark, sf_dir)
    wet = hydro.wet_cells(cut(twi), f).select("ds", "row", "col", "slope_pct", "depth", "wet").join(keyed(f.select("ds", "row", "col", "z")), ["ds", "row", "col"])
    s = cut(relief.terrain_summary(wet, SIZE))
    c = f.select("ds", "row", "col", "z")
    s = s.join(grid.plane_trend(c, SIZE), "ds").join(grid.residual_relief(c, SIZE), "ds")
    return relief.terrain_findings(s)


SQL["ts_findings"] = SQL["ts_findings"].replace("WITH", "WITH RECURSIVE", 1)


@register("yr_findings", _LAND + """, vv AS (SELECT log.ds, value, landform, avg(value) OVER (PARTITION BY log.ds) AS m FROM log JOIN lf ON lf.ds = log.ds AND lf.row = -CAST(floor(y / 9) AS BIGINT) - 1 AND lf.col = CAST(floor(x / 9) AS BIGINT)),
gr AS (SELECT ds, landform, count(value) AS n, (avg(value) - any_value(m)) / any_value(m) * 100 AS d FROM vv GROUP BY ds, landform),
tp AS (SELECT ds, max(d) AS top, min(d) AS low FROM gr WHERE n >= 10 GROUP BY ds), co AS (SELECT ds, pow(corr(value, elev_m), 2) AS r2 FROM log GROUP BY ds), j AS (SELECT tp.ds, top, low, r2 FROM tp LEFT JOIN co ON co.ds = tp.ds),
f AS (SELECT ds, 'best_landform' AS code, top AS metric FROM j WHERE top >= 2 UNION ALL SELECT ds, 'worst_landform', low FROM j WHERE low <= -2 UNION ALL SELECT ds, 'about_average', top FROM j WHERE top < 2 AND low > -2 UNION ALL SELECT ds, 'weak_relation', r2 FROM j WHERE r2 < 0.15 UNION ALL SELECT ds, 'strong_relation', r2 FROM j WHERE r2 >= 0.5)
SELECT ds, code, round(metric, 4) + 0e0 AS metric FROM f""")
def yr_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YR4."""
    from fieldweave.operators import stats

    p = grid.sample_nearest(bench_log(spark, sf_dir), cut(_landforms(spark, sf_dir)), SIZE, "landform").where("landform is not null")
    g = stats.group_stats(p, "value", "landform").withColumnRenamed("landform", "class")
    r = stats.relations(bench_log(spark, sf_dir), "value", ["elev_m"]).select("ds", F.col("r_elev_m").alias("r"))
    return r4(relief.yield_findings(g, r))


# -- zones and yield by class -----------------------------------------------------------


@register("zon_landform", _LAND + " SELECT lf.ds, CAST(landform AS BIGINT) AS zone, count(*) AS cells, round(count(*) * 81 / 1e4, 4) AS area_ha, round(avg(cb.z), 5) AS mean_z, round(avg(slope), 4) AS mean_slope FROM lf JOIN cb ON cb.ds = lf.ds AND cb.row = lf.row AND cb.col = lf.col GROUP BY lf.ds, landform")
def zon_landform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZON1 (landform), ZON3: area, mean height and mean slope of each zone."""
    z = relief.zone_summary(_landforms(spark, sf_dir).withColumnRenamed("landform", "zone"), SIZE)
    return z.select("ds", F.col("zone").cast("long").alias("zone"), "cells", F.round("area_ha", 4).alias("area_ha"), F.round("mean_z", 5).alias("mean_z"), F.round("mean_slope", 4).alias("mean_slope"))


@register("zon_points", _LAND + " SELECT lf.ds, (lf.col + 0.5e0) * 9 AS x, -(lf.row + 0.5e0) * 9 AS y, round(cb.z, 6) AS elev_m, round(slope, 5) AS slope_pct, CAST(landform AS BIGINT) AS zone FROM lf JOIN cb ON cb.ds = lf.ds AND cb.row = lf.row AND cb.col = lf.col")
def zon_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZON2: a point for each cell, with its layers and its zone."""
    p = relief.zone_points(_landforms(spark, sf_dir).withColumnRenamed("landform", "zone"), SIZE)
    return p.select("ds", "x", "y", F.round("elev_m", 6).alias("elev_m"), F.round("slope_pct", 5).alias("slope_pct"), F.col("zone").cast("long").alias("zone"))


@register("yr_by_slope", _LAND + """, v AS (SELECT log.ds, value, len(list_filter([2, 5, 10, 15], lambda q: q <= slope)) AS class FROM log JOIN lf ON lf.ds = log.ds AND lf.row = -CAST(floor(y / 9) AS BIGINT) - 1 AND lf.col = CAST(floor(x / 9) AS BIGINT)),
t AS (SELECT ds, avg(value) AS m, count(value) AS n FROM v GROUP BY ds HAVING count(value) >= 30), g AS (SELECT ds, class, count(value) AS n, avg(value) AS mean FROM v GROUP BY ds, class)
SELECT t.ds, k AS class, coalesce(g.n, 0) AS n, round(mean, 4) AS mean, round((mean - m) / m * 100, 4) + 0e0 AS delta_pct FROM t CROSS JOIN (SELECT CAST(unnest(range(5)) AS BIGINT) AS k) LEFT JOIN g ON g.ds = t.ds AND g.class = k""")
def yr_by_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YR1 (fields of 30 matches or more), YR3: yield by slope class, empty classes too."""
    c = cut(_landforms(spark, sf_dir).withColumn("class", F.size(F.filter(F.array(*[F.lit(q) for q in (2.0, 5.0, 10.0, 15.0)]), lambda q: q <= F.col("slope_pct")))))
    p = grid.sample_nearest(bench_log(spark, sf_dir), c, SIZE, "class")
    return r4(relief.yield_by_class(p, "value", "class", [0, 1, 2, 3, 4]))


@register("yr_by_wetness", _TWI + """, q AS (SELECT ds, greatest(quantile_cont(twi, 0.9), 8) AS t FROM tw GROUP BY ds), w AS (SELECT tw.ds, row, col, CASE WHEN depth > 0.05 OR twi >= t THEN 1 ELSE 0 END AS class FROM tw JOIN q ON q.ds = tw.ds),
v AS (SELECT log.ds, value, class FROM log JOIN w ON w.ds = log.ds AND w.row = -CAST(floor(y / 9) AS BIGINT) - 1 AND w.col = CAST(floor(x / 9) AS BIGINT)),
t2 AS (SELECT ds, avg(value) AS m, count(value) AS n FROM v GROUP BY ds HAVING count(value) >= 30), g AS (SELECT ds, class, count(value) AS n, avg(value) AS mean FROM v GROUP BY ds, class)
SELECT t2.ds, k AS class, coalesce(g.n, 0) AS n, round(mean, 4) AS mean, round((mean - m) / m * 100, 4) + 0e0 AS delta_pct FROM t2 CROSS JOIN (SELECT CAST(unnest(range(2)) AS BIGINT) AS k) LEFT JOIN g ON g.ds = t2.ds AND g.class = k""")
def yr_by_wetness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YR3: yield on dry (0) and wet (1) ground."""
    f, _, _, twi = _wet(spark, sf_dir)
    w = cut(hydro.wet_cells(cut(twi), f).select("ds", "row", "col", F.col("wet").cast("int").alias("class")))
    return r4(relief.yield_by_class(grid.sample_nearest(bench_log(spark, sf_dir), w, SIZE, "class"), "value", "class", [0, 1]))


SQL["yr_by_wetness"] = SQL["yr_by_wetness"].replace("WITH", "WITH RECURSIVE", 1)


@register("ter_dem", CELLS + """, e AS (SELECT ds, greatest(1, CAST(ceil(sqrt((max(row) - min(row) + 1) * (max(col) - min(col) + 1) / 150e0)) AS BIGINT)) AS f FROM c0 GROUP BY ds),
k AS (SELECT c0.ds, CAST(floor(row / CAST(f AS DOUBLE)) AS BIGINT) AS row, CAST(floor(col / CAST(f AS DOUBLE)) AS BIGINT) AS col, avg(z * 0.3048e0) AS z, any_value(f) * 9e0 AS cell FROM c0 JOIN e ON e.ds = c0.ds GROUP BY ALL),
s AS (SELECT ds, any_value(cell) AS cell, least(greatest(10e0 * 8e0 * 0.3048e0, any_value(cell)), sqrt(pow(max(row) - min(row) + 1, 2) + pow(max(col) - min(col) + 1, 2)) * any_value(cell) / 4) / any_value(cell) AS sigma FROM k GROUP BY ds),
w AS (SELECT p.ds, p.row, p.col, any_value(s.cell) AS cell, sum(exp(-((p.row-q.row)*(p.row-q.row)+(p.col-q.col)*(p.col-q.col)) / (2*sigma*sigma)) * q.z) / sum(exp(-((p.row-q.row)*(p.row-q.row)+(p.col-q.col)*(p.col-q.col)) / (2*sigma*sigma))) AS z
  FROM k p JOIN s ON s.ds = p.ds JOIN k q ON q.ds = p.ds AND abs(p.row-q.row) <= ceil(3*sigma) AND abs(p.col-q.col) <= ceil(3*sigma) GROUP BY p.ds, p.row, p.col)
SELECT ds, row, col, round(z, 6) AS z, cell FROM w""")
def ter_dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TER14: heights declared in feet, coarsened to 150 cells a grid, smoothed as a raster in steps of eight feet is."""
    d = relief.prepare_dem(_cells(spark, sf_dir), SIZE, factor=0.3048, step=8.0, max_cells=150)
    return d.select("ds", "row", "col", "z", "cell")
