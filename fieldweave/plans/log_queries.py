"""Registered queries over the machine log: track, cleaning, statistics, layers, joins, response."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions.columns import rounded
from fieldweave.operators import clean, economics, layers, response, spatial, stats, track
from fieldweave.sources.bench_log import PASSES, bench_log, sql

QUERIES, SQL = {}, {}


def register(name: str, query: str | None = None, rate: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if query:
            SQL[name] = sql(query, **({"rate": rate} if rate else {}))
        return f

    return keep


def r4(df: DataFrame, *keys: str, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison, integers as long."""
    out = []
    for n, k in df.dtypes:
        c = F.col(f"`{n}`")
        out.append((rounded(c, digits) if k == "double" and n not in keys else c.cast("long") if k in ("int", "smallint", "tinyint") else c).alias(n))
    return df.select(*out)


R = "round({}, 4) + 0e0"
T = "t AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY timestamp NULLS LAST, seq) AS rn FROM log)"


# -- track -------------------------------------------------------------------------------


@register(
    "trk_steps",
    T + """,
s AS (SELECT ds, seq, rn, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, epoch(timestamp) - lag(epoch(timestamp)) OVER w AS dt FROM t WINDOW w AS (PARTITION BY ds ORDER BY rn)),
u AS (SELECT *, sqrt(dx*dx + dy*dy) AS d, CASE WHEN degrees(atan2(dx, dy)) < 0 THEN degrees(atan2(dx, dy)) + 360 ELSE degrees(atan2(dx, dy)) END AS h FROM s),
v AS (SELECT ds, seq, rn, CASE WHEN rn = 1 THEN lead(d) OVER w ELSE d END AS d, CASE WHEN rn = 1 THEN lead(h) OVER w ELSE h END AS h, CASE WHEN rn = 1 THEN lead(dt) OVER w ELSE dt END AS dt FROM u WINDOW w AS (PARTITION BY ds ORDER BY rn))
SELECT ds, seq, rn, round(d, 4) + 0e0 AS distance_m, round(h, 4) + 0e0 AS heading_deg, CASE WHEN dt > 0 AND dt <= 60 THEN round(dt, 4) END AS dt_s FROM v""",
)
def trk_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRK1-4."""
    log = track.sort_by_time(bench_log(spark, sf_dir)).drop("distance_m")
    return r4(track.seconds(track.steps(log)).select("ds", "seq", "rn", "distance_m", "heading_deg", "dt_s"))


@register(
    "trk_speed",
    """
s AS (SELECT ds, seq, elapsed_s, seq + 1 AS rn, CASE WHEN seq % 7 = 3 THEN NULL ELSE distance_m END AS d, elapsed_s - lag(elapsed_s) OVER (PARTITION BY ds ORDER BY seq) AS dt FROM log),
v AS (SELECT *, d / CASE WHEN seq = 0 THEN lead(dt) OVER w ELSE dt END * 3.6e0 AS v FROM s WINDOW w AS (PARTITION BY ds ORDER BY seq))
SELECT ds, seq, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY ds ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY ds ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) + 0e0 AS speed_kmh, 9e0 AS swath_m FROM v""",
)
def trk_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRK5, TRK6: speed from an elapsed clock with holes, default swath."""
    log = bench_log(spark, sf_dir).drop("timestamp", "speed_kmh", "swath_m").withColumn("distance_m", F.when(F.col("seq") % 7 != 3, F.col("distance_m")))
    log = track.sort_by_time(log)
    return r4(track.default_swath(track.speed(track.seconds(log))).select("ds", "seq", "speed_kmh", "swath_m"))


_PASS_SQL = T + """,
s AS (SELECT ds, rn, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM t WINDOW w AS (PARTITION BY ds ORDER BY rn)),
u AS (SELECT ds, rn, CASE WHEN degrees(atan2(dx, dy)) < 0 THEN degrees(atan2(dx, dy)) + 360 ELSE degrees(atan2(dx, dy)) END AS h FROM s),
v AS (SELECT ds, rn, CASE WHEN rn = 1 THEN lead(h) OVER (PARTITION BY ds ORDER BY rn) ELSE h END AS h FROM u),
f AS (
  SELECT ds, rn, coalesce(h, 0e0) AS ref, CAST(0 AS BIGINT) AS pass_id FROM v WHERE rn = 1
  UNION ALL
  SELECT v.ds, v.rn,
    CASE WHEN v.h IS NULL THEN f.ref WHEN abs((v.h - f.ref + 180) - 360 * floor((v.h - f.ref + 180) / 360) - 180) > 35 THEN v.h
         ELSE (f.ref + 0.15e0 * ((v.h - f.ref + 180) - 360 * floor((v.h - f.ref + 180) / 360) - 180)) - 360 * floor((f.ref + 0.15e0 * ((v.h - f.ref + 180) - 360 * floor((v.h - f.ref + 180) / 360) - 180)) / 360) END,
    CASE WHEN v.h IS NOT NULL AND abs((v.h - f.ref + 180) - 360 * floor((v.h - f.ref + 180) / 360) - 180) > 35 THEN f.pass_id + 1 ELSE f.pass_id END
  FROM f JOIN v ON v.ds = f.ds AND v.rn = f.rn + 1)
SELECT ds, rn, pass_id FROM f"""


def _headings(spark, sf_dir):
    return track.steps(track.sort_by_time(bench_log(spark, sf_dir))).drop("pass_id")


@register("trk_passes")
def trk_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRK7, as a fold over each log."""
    return track.detect_passes(_headings(spark, sf_dir)).select("ds", F.col("rn").cast("long").alias("rn"), "pass_id")


@register("trk_passes_native")
def trk_passes_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRK7, without Python."""
    return track.detect_passes_native(_headings(spark, sf_dir)).select("ds", F.col("rn").cast("long").alias("rn"), "pass_id")


SQL["trk_passes"] = SQL["trk_passes_native"] = sql(_PASS_SQL).replace("WITH", "WITH RECURSIVE", 1)


@register(
    "trk_flow_delay",
    "SELECT a.ds, a.seq, round(b.value, 4) + 0e0 AS value FROM log a LEFT JOIN log b ON a.ds = b.ds AND b.seq = a.seq + 6",
)
def trk_flow_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRK8: 12 s on a clock of 2 s."""
    log = track.seconds(track.sort_by_time(bench_log(spark, sf_dir).drop("timestamp")))
    return r4(track.flow_delay(log, 12.0).select("ds", "seq", "value"))


# -- cleaning ----------------------------------------------------------------------------

#: The steps before the spatial and outlier ones, with a tighter moisture and jump.
ROW_STEPS = {
    "null_value": {}, "position": {"max_jump_m": 12.0}, "value_range": {"min": None, "max": 4500.0}, "moisture": {"max": 35.0}, "speed_range": {}, "speed_change": {"max_change_pct": 60.0},
    "swath_partial": {}, "short_pass": {"min_points": 15}, "pass_ends": {"start_m": 6.0, "end_m": 6.0},
}

_FLAGS = T + """,
p9 AS (SELECT ds, quantile_cont(CASE WHEN swath_m > 0 THEN swath_m END, 0.9) AS p90 FROM t GROUP BY ds),
a AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.ds, round(x, 3), round(y, 3) ORDER BY rn) AS dup, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(speed_kmh) OVER w AS pv, p90,
    sum(distance_m) OVER (PARTITION BY t.ds, pass_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS upto, sum(distance_m) OVER (PARTITION BY t.ds, pass_id) AS total
  FROM t JOIN p9 ON t.ds = p9.ds WINDOW w AS (PARTITION BY t.ds ORDER BY rn)),
b AS (
  SELECT *, CASE WHEN value IS NULL OR value < 0 OR value = 0 THEN 'null_value'
    WHEN dup > 1 OR sqrt((x-px)*(x-px) + (y-py)*(y-py)) > 12 THEN 'position'
    WHEN value > 4500 THEN 'value_range'
    WHEN moisture_pct < 5 OR moisture_pct > 35 THEN 'moisture'
    WHEN speed_kmh IS NULL OR speed_kmh < 1.5e0 OR speed_kmh > 20 THEN 'speed_range'
    WHEN pv > 0 AND abs(speed_kmh - pv) / pv * 100 > 60 THEN 'speed_change'
    WHEN swath_m <= 0 OR swath_m < 0.5e0 * p90 THEN 'swath_partial' END AS r1 FROM a),
c AS (SELECT *, coalesce(r1, CASE WHEN count(CASE WHEN r1 IS NULL THEN 1 END) OVER (PARTITION BY ds, pass_id) < 15 THEN 'short_pass' END, CASE WHEN upto < 6 OR total - upto < 6 THEN 'pass_ends' END) AS removal_reason FROM b)"""


@register("cln_row_steps", _FLAGS + " SELECT ds, seq, removal_reason FROM c")
def cln_row_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN1-9, CLN14: the first reason of every record."""
    return clean.run(bench_log(spark, sf_dir), ROW_STEPS).select("ds", "seq", "removal_reason")


@register("cln_by_reason", _FLAGS + " SELECT ds, removal_reason, count(*) AS n, round(100e0 * count(*) / (SELECT count(*) FROM c k WHERE k.ds = c.ds), 4) AS pct FROM c WHERE removal_reason IS NOT NULL GROUP BY ds, removal_reason")
def cln_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5."""
    return r4(clean.removal_by_reason(clean.run(bench_log(spark, sf_dir), ROW_STEPS)))


@register(
    "cln_step_report",
    _FLAGS + """,
st AS (SELECT unnest(range(1, 14)) AS step_no, unnest(['null_value','position','value_range','moisture','speed_range','speed_change','swath_partial','short_pass','pass_ends','overlap','boundary','global_outlier','local_outlier']) AS step),
n AS (SELECT d.ds, st.step_no, st.step, d.total, count(c.seq) AS removed FROM (SELECT ds, count(*) AS total FROM c GROUP BY ds) d CROSS JOIN st LEFT JOIN c ON c.ds = d.ds AND c.removal_reason = st.step GROUP BY ALL)
SELECT ds, CAST(step_no AS BIGINT) AS step_no, step, removed, CAST(total - sum(removed) OVER (PARTITION BY ds ORDER BY step_no) AS BIGINT) AS remaining FROM n""",
)
def cln_step_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6."""
    return r4(clean.step_report(clean.run(bench_log(spark, sf_dir), ROW_STEPS)))


@register(
    "cln_assess",
    _FLAGS + """,
a1 AS (SELECT ds, count(*) AS n, count(removal_reason) AS k, avg(value) AS m0, stddev_samp(value) AS s0, avg(value) FILTER (WHERE removal_reason IS NULL) AS m1, stddev_samp(value) FILTER (WHERE removal_reason IS NULL) AS s1 FROM c GROUP BY ds),
a2 AS (SELECT ds, 100e0 * k / n AS p, s1 / m1 * 100 - s0 / m0 * 100 AS d, (m1 - m0) / m0 * 100 AS s FROM a1)
SELECT ds, round(p, 4) AS removed_pct, round(d, 4) + 0e0 AS cv_delta, round(s, 4) + 0e0 AS mean_shift_pct,
  CASE WHEN p > 45 THEN 'alert' WHEN p > 25 OR p < 2 THEN 'warning' ELSE 'ok' END AS removed_level, CASE WHEN d > 2 THEN 'alert' WHEN d < -3 THEN 'ok' ELSE 'none' END AS cv_level, CASE WHEN abs(s) > 8 THEN 'alert' ELSE 'ok' END AS shift_level FROM a2""",
)
def cln_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7."""
    return r4(clean.assess(clean.run(bench_log(spark, sf_dir), ROW_STEPS)))


_COVER = T + """,
hd AS (SELECT ds, rn, x, y, swath_m, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM t WINDOW w AS (PARTITION BY ds ORDER BY rn)),
h1 AS (SELECT ds, rn, x, y, swath_m, CASE WHEN rn = 1 THEN lead(atan2(dx, dy)) OVER (PARTITION BY ds ORDER BY rn) ELSE atan2(dx, dy) END AS h FROM hd),
box AS (SELECT ds, median(swath_m) AS med, greatest(0.5e0, least(2e0, median(swath_m) / 8)) AS cell, min(x) - median(swath_m) AS ox, min(y) - median(swath_m) AS oy FROM h1 GROUP BY ds),
k AS (SELECT unnest(range(0, 100)) AS k),
sm AS (
  SELECT h1.ds, rn, k.k, cell, CAST(floor((x + cos(h) * swath_m * (k.k / (CAST(greatest(3, ceil(med / cell) + 1) AS INTEGER) - 1e0) - 0.5e0) - ox) / cell + 1e-9) AS BIGINT) AS col,
    CAST(floor((y - sin(h) * swath_m * (k.k / (CAST(greatest(3, ceil(med / cell) + 1) AS INTEGER) - 1e0) - 0.5e0) - oy) / cell + 1e-9) AS BIGINT) AS row
  FROM h1 JOIN box ON h1.ds = box.ds JOIN k ON k.k < greatest(3, ceil(med / cell) + 1))"""


@register("cln_overlap")
def cln_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN10: the covered share of every record (samples on cell edges fall as double arithmetic has it, so there is no SQL)."""
    df = track.steps(track.sort_by_time(bench_log(spark, sf_dir)))
    return r4(clean.overlap(df, {}).select("ds", "rn", "overlap"))


@register("cln_boundary")
def cln_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN11: records within 4 m of ground that no record covered."""
    df = track.steps(track.sort_by_time(bench_log(spark, sf_dir)))
    return r4(clean.boundary(df, {"buffer_m": 4.0}))


@register(
    "cln_global",
    "SELECT ds, round(avg(value) - 3 * stddev_samp(value), 4) + 0e0 AS lo, round(avg(value) + 3 * stddev_samp(value), 4) + 0e0 AS hi, round(quantile_cont(value, 0.005), 4) + 0e0 AS p_lo, round(quantile_cont(value, 0.995), 4) + 0e0 AS p_hi FROM log GROUP BY ds HAVING count(value) >= 20",
)
def cln_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN12, both methods."""
    log = bench_log(spark, sf_dir)
    a = clean.global_outlier(log, {"method": "std", "k": 3.0})
    b = clean.global_outlier(log, {"method": "percentile", "lower_pct": 0.5, "upper_pct": 99.5}).withColumnsRenamed({"lo": "p_lo", "hi": "p_hi"})
    return r4(a.join(b, "ds"))


_KNN = """
nn AS (
  SELECT a.ds, a.seq, b.seq AS other, a.value AS own, b.value AS v, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) AS d2,
    row_number() OVER (PARTITION BY a.ds, a.seq ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.seq) AS rank
  FROM log a JOIN log b ON a.ds = b.ds AND a.seq <> b.seq)"""


def _points(spark, sf_dir):
    return bench_log(spark, sf_dir).select("ds", F.col("seq").alias("id"), "x", "y", "value")


@register("jn_knn", _KNN + " SELECT ds, seq AS id, other AS other_id, round(d2, 4) AS d2, CAST(rank AS BIGINT) AS rank FROM nn WHERE rank <= 8")
def jn_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4: the eight nearest other records of every record."""
    return r4(spatial.knn(_points(spark, sf_dir), 8).select("ds", "id", "other_id", "d2", "rank"))


@register(
    "cln_local",
    _KNN + """,
m AS (SELECT ds, seq, own, median(v) AS med FROM nn WHERE rank <= 12 GROUP BY ALL),
d AS (SELECT m.ds, m.seq, m.own, m.med, median(abs(nn.v - m.med)) AS mad FROM m JOIN nn ON nn.ds = m.ds AND nn.seq = m.seq AND nn.rank <= 12 GROUP BY ALL),
g AS (SELECT ds, median(value) AS gm FROM log GROUP BY ds),
f AS (SELECT log.ds, median(abs(value - gm)) * 1.4826e0 * 0.1e0 AS floor FROM log JOIN g ON log.ds = g.ds GROUP BY log.ds)
SELECT d.ds, d.seq, round(abs(own - med) / greatest(mad * 1.4826e0, floor), 4) + 0e0 AS score FROM d JOIN f ON d.ds = f.ds""",
)
def cln_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN13: the local outlier score of every record."""
    log = bench_log(spark, sf_dir).withColumn("rn", F.col("seq"))
    return r4(clean.local_outlier(log, {"k_neighbors": 12}).withColumnRenamed("rn", "seq"))


@register("cln_harvest")
def cln_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN15: the whole harvest preset; reasons by log."""
    return r4(clean.removal_by_reason(clean.run(bench_log(spark, sf_dir), "harvest")))


# -- statistics --------------------------------------------------------------------------

_DESCRIBE = """
a AS (SELECT ds, count(value) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, min(value) AS min, max(value) AS max, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.95) AS p95 FROM log GROUP BY ds),
s AS (SELECT log.ds, avg(pow(value - mean, 3)) / pow(avg(pow(value - mean, 2)), 1.5e0) AS g FROM log JOIN a ON a.ds = log.ds GROUP BY log.ds)"""


@register(
    "agg_describe",
    _DESCRIBE + " SELECT a.ds, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(min, 4) AS min, round(max, 4) AS max, round(p05, 4) AS p05, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(p95, 4) AS p95, round(abs(sd / mean) * 100, 4) AS cv_pct, round(g * sqrt(n * (n - 1e0)) / (n - 2), 4) + 0e0 AS skew FROM a JOIN s ON a.ds = s.ds",
)
def agg_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1."""
    return r4(stats.describe(bench_log(spark, sf_dir), "value", "ds"))


@register("agg_area_bounds", "SELECT ds, round(sum(swath_m * distance_m) / 1e4, 4) AS area_ha, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max FROM log GROUP BY ds")
def agg_area_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2, AGG3."""
    log = bench_log(spark, sf_dir)
    return r4(stats.worked_area(log).join(stats.bounds(log), "ds"))


@register(
    "agg_histogram",
    """
r AS (SELECT ds, min(value) AS lo, max(value) AS hi FROM log GROUP BY ds),
b AS (SELECT log.ds, least(CAST(floor((value - lo) / ((hi - lo) / 30)) AS BIGINT), 29) AS bin, count(*) AS n FROM log JOIN r ON r.ds = log.ds GROUP BY ALL)
SELECT r.ds, g.bin, round(lo + g.bin * ((hi - lo) / 30), 4) + 0e0 AS low, coalesce(n, 0) AS n FROM r CROSS JOIN (SELECT unnest(range(0, 30)) AS bin) g LEFT JOIN b ON b.ds = r.ds AND b.bin = g.bin""",
)
def agg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4."""
    return r4(stats.histogram(bench_log(spark, sf_dir)))


@register(
    "agg_rate_classes",
    """
e AS (SELECT ds, list_distinct(quantile_cont(moisture_pct, [0, 1/6, 2/6, 3/6, 4/6, 5/6, 1])) AS e FROM log GROUP BY ds),
k AS (SELECT log.ds, greatest(len(list_filter(e.e, lambda z: z < log.moisture_pct)), 1) AS class, value, moisture_pct FROM log JOIN e ON e.ds = log.ds)
SELECT ds, CAST(class AS BIGINT) AS class, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, min(moisture_pct) AS low, max(moisture_pct) AS high FROM k GROUP BY ds, class""",
)
def agg_rate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15: value by class of moisture."""
    return r4(stats.rate_classes(bench_log(spark, sf_dir), "moisture_pct", "value"))


@register("agg_rate_reading", """
e AS (SELECT ds, list_distinct(quantile_cont(moisture_pct, [0, 1/6, 2/6, 3/6, 4/6, 5/6, 1])) AS e FROM log GROUP BY ds),
k AS (SELECT log.ds, greatest(len(list_filter(e.e, lambda z: z < log.moisture_pct)), 1) AS class, avg(value) AS mean FROM log JOIN e ON e.ds = log.ds GROUP BY ALL),
s AS (SELECT ds, (max(mean) - min(mean)) / avg(mean) * 100 AS s FROM k GROUP BY ds), r AS (SELECT ds, corr(moisture_pct, value) AS r FROM log GROUP BY ds)
SELECT s.ds, round(s, 4) AS spread_pct, round(r, 4) + 0e0 AS r, CASE WHEN s < 5 THEN 'flat' WHEN r < -0.3 THEN 'compensating' WHEN r > 0.3 THEN 'reinforcing' ELSE 'weak' END AS reading FROM s JOIN r ON r.ds = s.ds""")
def agg_rate_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15: the reading of the classes."""
    return r4(stats.rate_reading(bench_log(spark, sf_dir), "moisture_pct", "value"))


@register(
    "agg_group_stats",
    "SELECT g.*, round((mean - m) / m * 100, 4) + 0e0 AS delta_pct FROM (SELECT ds, zone, count(value) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.75), 4) AS p75, round(stddev_samp(value), 4) AS sd FROM log GROUP BY ds, zone) g JOIN (SELECT ds, avg(value) AS m FROM log GROUP BY ds) f ON f.ds = g.ds".replace("SELECT g.*, round((mean - m)", "SELECT g.ds, CAST(zone AS BIGINT) AS zone, n, mean, median, p25, p75, sd, round((raw - m)").replace("count(value) AS n,", "count(value) AS n, avg(value) AS raw,"),
)
def agg_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16."""
    return r4(stats.group_stats(bench_log(spark, sf_dir), "value", "zone"))


@register("agg_relations", "a AS (SELECT ds, corr(value, speed_kmh) AS s, corr(value, moisture_pct) AS m, corr(value, elev_m) AS e FROM log GROUP BY ds) SELECT ds, round(s, 4) + 0e0 AS r_speed_kmh, round(m, 4) + 0e0 AS r_moisture_pct, round(e, 4) + 0e0 AS r_elev_m, CASE WHEN abs(s) >= abs(m) AND abs(s) >= abs(e) THEN 'speed_kmh' WHEN abs(m) >= abs(e) THEN 'moisture_pct' ELSE 'elev_m' END AS strongest FROM a")
def agg_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17."""
    return r4(stats.relations(bench_log(spark, sf_dir), "value", ["speed_kmh", "moisture_pct", "elev_m"]))


@register("agg_machine", "SELECT ds, round(median(swath_m), 2) AS swath_m, floor(quantile_cont(speed_kmh, 0.02) * 2) / 2 AS speed_min, ceil(quantile_cont(speed_kmh, 0.98) * 2) / 2 AS speed_max FROM log GROUP BY ds")
def agg_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18."""
    return r4(stats.suggest_machine(bench_log(spark, sf_dir)))


@register("agg_map_scale", "SELECT ds, round(quantile_cont(value, 0.02), 4) + 0e0 AS low, round(quantile_cont(value, 0.98), 4) + 0e0 AS high, round(min(value), 4) AS min, round(max(value), 4) AS max, -round(greatest(abs(quantile_cont(value - 2000, 0.02)), abs(quantile_cont(value - 2000, 0.98))), 4) AS centred FROM log GROUP BY ds")
def agg_map_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19, AGG20."""
    log = bench_log(spark, sf_dir)
    two = stats.map_scale(log.withColumn("value", F.col("value") - 2000), diverging=True).select("ds", F.col("low").alias("centred"))
    return r4(stats.map_scale(log).join(two, "ds"))


@register("agg_sample", "SELECT ds, seq FROM (SELECT ds, seq, row_number() OVER (PARTITION BY ds ORDER BY seq) - 1 AS rn, CAST(ceil(count(*) OVER (PARTITION BY ds) / 100e0) AS BIGINT) AS step FROM log) WHERE rn % step = 0")
def agg_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systematic sample of at most 100 records a log."""
    return stats.systematic_sample(bench_log(spark, sf_dir), 100).select("ds", "seq")


# -- layers ------------------------------------------------------------------------------


@register("agg_levels", "SELECT DISTINCT ds, round(applied_rate, 3) AS level FROM log")
def agg_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12, few distinct rates."""
    return r4(layers.rate_levels(bench_log(spark, sf_dir)))


_WOBBLE = "w AS (SELECT *, applied_rate + (seq % 13 - 6) * 0.25e0 AS rate FROM log)"


@register(
    "agg_density_levels",
    _WOBBLE + """,
s AS (SELECT ds, count(*) AS n, min(rate) AS lo, max(rate) AS hi, greatest(60, least(400, count(*) // 20)) AS bins FROM w GROUP BY ds),
b AS (SELECT w.ds, rate, n, least(CAST(floor((rate - lo) / (hi - lo) * bins) AS BIGINT), bins - 1) AS bin FROM w JOIN s ON s.ds = w.ds),
c AS (SELECT ds, n, bin, count(*) AS c FROM b GROUP BY ALL),
o AS (SELECT *, bin - row_number() OVER (PARTITION BY ds ORDER BY bin) AS run FROM (SELECT *, max(c) OVER (PARTITION BY ds) AS peak FROM c) WHERE c > greatest(1e0, peak * 0.02e0)),
r AS (SELECT ds, n, run, sum(c) AS mass, min(bin) AS b0, max(bin) AS b1 FROM o GROUP BY ALL),
h AS (SELECT * FROM r WHERE mass >= n * 0.03e0)
SELECT b.ds, round(median(rate), 4) + 0e0 AS level FROM b JOIN h ON h.ds = b.ds AND bin BETWEEN b0 AND b1 GROUP BY b.ds, run""".replace("\no AS", "\noc AS").replace("FROM o GROUP", "FROM oc GROUP"),
    rate=PASSES,
)
def agg_density_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12, levels under noise."""
    log = bench_log(spark, sf_dir, PASSES).withColumn("rate", F.col("applied_rate") + (F.col("seq") % 13 - 6) * 0.25)
    return r4(layers.rate_levels(log, "rate"))


@register(
    "agg_continuous_levels",
    """
e AS (SELECT ds, list_sort(list_distinct(quantile_cont(value, [0, 1/12, 2/12, 3/12, 4/12, 5/12, 6/12, 7/12, 8/12, 9/12, 10/12, 11/12, 1]))) AS e FROM log GROUP BY ds)
SELECT ds, round((e[i] + e[i + 1]) / 2, 4) + 0e0 AS level FROM (SELECT ds, e, unnest(range(1, len(e))) AS i FROM e)""",
)
def agg_continuous_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12, no structure to find (valleys are set out of reach): midpoints of equal-count bins."""
    return r4(layers.rate_levels(bench_log(spark, sf_dir), "value", valley=2.0))


@register("jn_nearest_level", _WOBBLE + " SELECT ds, seq, (SELECT min(v) FROM (SELECT unnest([0e0, 45e0, 90e0, 135e0, 180e0]) AS v) z WHERE abs(v - rate) = (SELECT min(abs(v2 - rate)) FROM (SELECT unnest([0e0, 45e0, 90e0, 135e0, 180e0]) AS v2) y)) AS level FROM w", rate=PASSES)
def jn_nearest_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9."""
    log = bench_log(spark, sf_dir, PASSES)
    levels = log.select("ds").distinct().select("ds", F.explode(F.array(*[F.lit(45.0 * i) for i in range(5)])).alias("level"))
    return layers.nearest_level(log.withColumn("rate", F.col("applied_rate") + (F.col("seq") % 13 - 6) * 0.25), levels, "rate").select("ds", "seq", "level")


_CELLS = "c AS (SELECT ds, CAST(floor(x / 20) AS BIGINT) AS col, CAST(floor(y / 20) AS BIGINT) AS row, round(applied_rate, 3) AS rate, {zone} avg(value) AS \"yield\", stddev_samp(value) AS yield_sd, count(*) AS n, avg(x) AS x, avg(y) AS y FROM log WHERE value > 0 GROUP BY ALL HAVING count(*) >= 3)"


def _levelled(spark, sf_dir, rate=PASSES):
    log = bench_log(spark, sf_dir, rate).where("value > 0")
    return layers.nearest_level(log, layers.rate_levels(log))


@register("agg_cells", _CELLS.format(zone="") + ' SELECT ds, col, row, rate, round("yield", 4) + 0e0 AS "yield", round(yield_sd, 4) + 0e0 AS yield_sd, n, round(x, 4) + 0e0 AS x, round(y, 4) + 0e0 AS y FROM c', rate=PASSES)
def agg_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13."""
    return r4(layers.aggregate_cells(_levelled(spark, sf_dir)))


@register("agg_by_rate", _CELLS.format(zone="") + ' SELECT ds, rate, count(*) AS cells, round(avg("yield"), 10) AS "yield", round(stddev_samp("yield"), 10) AS sd, round(avg("yield") * 0.25e0 - rate * 1.5e0, 10) + 0e0 AS profit FROM c GROUP BY ds, rate', rate=PASSES)
def agg_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14."""
    return r4(layers.summary_by_rate(layers.aggregate_cells(_levelled(spark, sf_dir)), 0.25, 1.5), digits=10)


_LAYERS = """
o2 AS (SELECT ds, min(x) AS ox, min(y) AS oy FROM log GROUP BY ds),
y1 AS (SELECT log.ds, CAST(floor((x - ox) / 15) AS BIGINT) AS col, CAST(floor((y - oy) / 15) AS BIGINT) AS row, avg(value) AS "yield", count(*) AS yield_n, avg(x) AS x, avg(y) AS y FROM log JOIN o2 ON o2.ds = log.ds GROUP BY ALL),
r1 AS (SELECT log.ds, CAST(floor((x - ox) / 15) AS BIGINT) AS col, CAST(floor((y - oy) / 15) AS BIGINT) AS row, applied_rate AS rate, count(*) AS n FROM log JOIN o2 ON o2.ds = log.ds WHERE seq % 2 = 0 GROUP BY ALL),
r2 AS (SELECT *, n / sum(n) OVER (PARTITION BY ds, col, row) AS purity, row_number() OVER (PARTITION BY ds, col, row ORDER BY n DESC, rate) AS k FROM r1),
z1 AS (SELECT log.ds, CAST(floor((x - ox) / 15) AS BIGINT) AS col, CAST(floor((y - oy) / 15) AS BIGINT) AS row, zone, count(*) AS n FROM log JOIN o2 ON o2.ds = log.ds GROUP BY ALL),
z2 AS (SELECT *, row_number() OVER (PARTITION BY ds, col, row ORDER BY n DESC, zone) AS k FROM z1)"""


@register("jn_layers", _LAYERS + ' SELECT y1.ds, y1.col, y1.row, round("yield", 4) + 0e0 AS "yield", yield_n, round(x, 4) + 0e0 AS x, round(y, 4) + 0e0 AS y, rate, rate AS measured, r2.n AS rate_n, round(purity, 4) AS purity, CAST(zone AS BIGINT) AS zone FROM y1 JOIN r2 ON y1.ds = r2.ds AND y1.col = r2.col AND y1.row = r2.row AND r2.k = 1 AND purity >= 0.8 LEFT JOIN z2 ON y1.ds = z2.ds AND y1.col = z2.col AND y1.row = z2.row AND z2.k = 1')
def jn_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1, JN2, AGG8-10: yields and every other rate record on a 15 m grid, with the zone carried."""
    log = bench_log(spark, sf_dir)
    rates = log.where("seq % 2 = 0").withColumn("level", F.col("applied_rate"))
    return r4(layers.join_layers(log, rates, 15.0, carry="zone"))


@register("jn_overlap", _LAYERS + ", a AS (SELECT DISTINCT ds, col, row FROM y1), b AS (SELECT DISTINCT ds, col, row FROM r1), m AS (SELECT a.ds, count(*) AS k FROM a JOIN b ON a.ds = b.ds AND a.col = b.col AND a.row = b.row GROUP BY a.ds), c AS (SELECT ds, 'rate' AS layer, count(*) AS cells FROM b GROUP BY ds UNION ALL SELECT ds, 'yield', count(*) FROM a GROUP BY ds) SELECT c.ds, layer, cells, k AS common, round(100e0 * k / cells, 4) AS kept_pct, 100e0 * k / cells < 50 AS low FROM c JOIN m ON c.ds = m.ds")
def jn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10: cells shared by the layers."""
    log = bench_log(spark, sf_dir)
    origin = layers.origin_of(log)
    both = {"yield": layers.cell_means(log, "value", 15.0, origin), "rate": layers.cell_means(log.where("seq % 2 = 0"), "applied_rate", 15.0, origin)}
    return r4(layers.overlap_report(both))


@register("jn_plan_deviation", "d AS (SELECT ds, abs(applied_rate + seq % 5 - applied_rate) AS a, applied_rate AS p FROM log) SELECT ds, round(median(a), 4) AS median_abs, round(median(a / nullif(p, 0)), 4) AS median_rel, coalesce(median(a / nullif(p, 0)) > 0.15, false) AS off_plan FROM d GROUP BY ds")
def jn_plan_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10."""
    log = bench_log(spark, sf_dir)
    return r4(layers.plan_deviation(log.select("ds", F.col("applied_rate").alias("plan"), (F.col("applied_rate") + F.col("seq") % 5).alias("applied"))))


@register("agg_suggest_cell", "SELECT ds, CASE WHEN c <= 5 THEN 5e0 WHEN c <= 10 THEN 10e0 WHEN c <= 15 THEN 15e0 WHEN c <= 20 THEN 20e0 WHEN c <= 25 THEN 25e0 WHEN c <= 30 THEN 30e0 WHEN c <= 40 THEN 40e0 WHEN c <= 50 THEN 50e0 ELSE 60e0 END AS cell_m FROM (SELECT ds, sqrt(80000e0 / min(d)) AS c FROM (SELECT ds, count(*) / (sum(swath_m * distance_m) / 1e4) AS d FROM log GROUP BY ds UNION ALL SELECT ds, count(*) / (sum(swath_m * distance_m) / 1e4) / 3 FROM log GROUP BY ds) GROUP BY ds)")
def agg_suggest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11: a dense and a sparse layer."""
    log = bench_log(spark, sf_dir)
    d = log.groupBy("ds").agg(F.count(F.lit(1)).alias("n")).join(stats.worked_area(log), "ds").select("ds", (F.col("n") / F.col("area_ha")).alias("density"))
    both = d.withColumn("role", F.lit("yield")).unionByName(d.select("ds", (F.col("density") / 3).alias("density"), F.lit("rate").alias("role")))
    return layers.suggest_cell(both)


@register("jn_strip_edges", """
h AS (SELECT DISTINCT a.ds, a.seq FROM log a JOIN log b ON a.ds = b.ds AND a.applied_rate <> b.applied_rate AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) < 12),
n AS (SELECT log.ds, count(*) AS n, count(DISTINCT applied_rate) AS l, count(h.seq) AS g FROM log LEFT JOIN h ON h.ds = log.ds AND h.seq = log.seq GROUP BY log.ds)
SELECT log.ds, log.seq FROM log JOIN n ON n.ds = log.ds LEFT JOIN h ON h.ds = log.ds AND h.seq = log.seq WHERE h.seq IS NULL OR NOT (n.n >= 10 AND n.l >= 2 AND n.g < 0.9 * n.n)""")
def jn_strip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3: records away from strips of another rate."""
    return spatial.drop_strip_edges(bench_log(spark, sf_dir).withColumn("level", F.col("applied_rate"))).select("ds", "seq")


@register("jn_pass_pairs", "SELECT a.ds, a.pass_id, b.pass_id AS other_pass_id, count(*) AS n, round(avg(a.elev_m - b.elev_m), 4) + 0e0 AS offset_m FROM log a JOIN log b ON a.ds = b.ds AND a.pass_id < b.pass_id AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 15 GROUP BY ALL")
def jn_pass_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5: elevation offsets between neighbouring passes."""
    pts = bench_log(spark, sf_dir).select("ds", "x", "y", "pass_id", "elev_m")
    pairs = spatial.pairs_across_passes(pts, 15.0)
    return r4(pairs.groupBy("ds", "pass_id", "other_pass_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("elev_m") - F.col("other_elev_m")).alias("offset_m")))


@register("jn_corridor", "s AS (SELECT DISTINCT ds, i AS station, i * 10e0 AS x, i * 5e0 AS y FROM log, (SELECT unnest(range(0, 40)) AS i)) SELECT s.ds, station, round(avg(log.value), 4) + 0e0 AS value, count(log.value) AS n FROM s LEFT JOIN log ON log.ds = s.ds AND sqrt((s.x-log.x)*(s.x-log.x) + (s.y-log.y)*(s.y-log.y)) <= 10 GROUP BY s.ds, station")
def jn_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6: mean reading along a line of stations."""
    log = bench_log(spark, sf_dir)
    st = log.select("ds").distinct().withColumn("station", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long")))).withColumns({"x": F.col("station") * 10.0, "y": F.col("station") * 5.0})
    return r4(spatial.corridor_mean(st, log, 10.0))


# -- response ----------------------------------------------------------------------------

_SUMS = _CELLS.format(zone="zone,") + """,
k AS (SELECT ds, zone, count(DISTINCT rate) AS k, avg(rate) AS rm, avg("yield") AS ym, max(rate) AS r1 FROM c GROUP BY ds, zone),
s AS (SELECT c.ds, c.zone, count(*) AS n, sum(pow(rate-rm,2)) AS s2, sum(pow(rate-rm,3)) AS s3, sum(pow(rate-rm,4)) AS s4, sum((rate-rm)*("yield"-ym)) AS sty, sum(pow(rate-rm,2)*("yield"-ym)) AS st2y, sum(pow("yield"-ym,2)) AS syy, any_value(rm) AS rm, any_value(ym) AS ym
  FROM c JOIN k ON k.ds = c.ds AND k.zone = c.zone WHERE k >= 3 GROUP BY c.ds, c.zone),
d AS (SELECT *, s4 - s2*s2/n AS q FROM s),
f AS (SELECT *, (sty*q - st2y*s3) / (s2*q - s3*s3) AS b1, (st2y*s2 - sty*s3) / (s2*q - s3*s3) AS c FROM d),
g AS (SELECT *, ym - c*s2/n - b1*rm + c*rm*rm AS a, b1 - 2*c*rm AS b, greatest(0, syy - b1*sty - c*st2y) AS sse FROM f)"""


def _zone_cells(spark, sf_dir):
    return layers.aggregate_cells(_levelled(spark, sf_dir), group=("zone",))


@register("eco_quadratic", _SUMS + " SELECT ds, CAST(zone AS BIGINT) AS zone, n, round(a, 3) + 0e0 AS a, round(b, 3) + 0e0 AS b, round(c, 5) + 0e0 AS c, round(1 - sse / syy, 5) + 0e0 AS r2, round(sqrt(sse / n), 3) AS rmse FROM g", rate=PASSES)
def eco_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ECO1, ECO5 by zone."""
    keys = ["ds", "zone"]
    f = response.quadratic(response.by_rate(_zone_cells(spark, sf_dir), keys), keys)
    return f.select("ds", F.col("zone").cast("long").alias("zone"), "n", rounded("a", 3).alias("a"), rounded("b", 3).alias("b"), rounded("c", 5).alias("c"), rounded("r2", 5).alias("r2"), rounded("rmse", 3).alias("rmse"))


_OPT = """,
e AS (SELECT ds, zone, a, b, c, i, i * 0.1e0 AS r FROM g, (SELECT unnest(range(0, 2001)) AS i)),
p AS (SELECT *, (a + b*r + c*r*r) * 0.25e0 - r * 1.5e0 AS profit, sign(b + 2*c*r - 6) AS sg FROM e),
x AS (SELECT *, lag(sg) OVER (PARTITION BY ds, zone ORDER BY i) > sg AS cross FROM p),
m AS (SELECT ds, zone, arg_min(r, i) AS r, any_value(top) AS top FROM (SELECT *, max(profit) OVER (PARTITION BY ds, zone) AS top FROM x) WHERE profit = top GROUP BY ds, zone),
y AS (SELECT ds, zone, arg_min(r, i) AS r, arg_min(profit, i) AS profit FROM x WHERE "cross" GROUP BY ds, zone)
SELECT m.ds, CAST(m.zone AS BIGINT) AS zone, round(CASE WHEN y.profit >= top - 1e-6 THEN y.r ELSE m.r END, 2) AS optimum_rate, round(CASE WHEN y.profit >= top - 1e-6 THEN y.profit ELSE top END, 2) + 0e0 AS profit_at_optimum FROM m LEFT JOIN y ON y.ds = m.ds AND y.zone = m.zone"""


@register("eco_optimum", _SUMS + _OPT.replace("\np AS", "\npr AS").replace("FROM p)", "FROM pr)").replace(" cross FROM", ' "cross" FROM'), rate=PASSES)
def eco_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ECO7 on the quadratic of each zone."""
    return flagship_of(spark, sf_dir).select("ds", "zone", rounded("optimum_rate", 2).alias("optimum_rate"), rounded("profit_at_optimum", 2).alias("profit_at_optimum"))


def flagship_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rate pays best in each zone of each field, by the quadratic response."""
    keys = ["ds", "zone"]
    fits = response.quadratic(response.by_rate(_zone_cells(spark, sf_dir), keys), keys)
    return response.optimum(fits, keys, 0.25, 1.5, 0.0, 200.0).withColumn("zone", F.col("zone").cast("long"))


@register("eco_models")
def eco_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ECO1-5: all four models of each log."""
    f = response.fit_all(layers.aggregate_cells(_levelled(spark, sf_dir)), ["ds"])
    return f.select("ds", "model", "n", rounded("r2", 3).alias("r2"), rounded("rmse", 2).alias("rmse"))


@register("eco_best")
def eco_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ECO6, ECO7: the best model of each log and its optimum."""
    f = response.fit_best(layers.aggregate_cells(_levelled(spark, sf_dir)), ["ds"])
    return r4(response.optimum(f, ["ds"], 0.25, 1.5, 0.0, 200.0), digits=2)


@register("eco_profit_curve", _SUMS + " SELECT ds, CAST(zone AS BIGINT) AS zone, i, round(200e0 * i / 59, 4) AS rate, round(a + b*(200e0*i/59) + c*(200e0*i/59)*(200e0*i/59), 2) + 0e0 AS \"yield\", round((a + b*(200e0*i/59) + c*(200e0*i/59)*(200e0*i/59)) * 0.25e0 - (200e0*i/59) * 1.5e0, 2) + 0e0 AS profit FROM g, (SELECT unnest(range(0, 60)) AS i)", rate=PASSES)
def eco_profit_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ECO8."""
    keys = ["ds", "zone"]
    fits = response.quadratic(response.by_rate(_zone_cells(spark, sf_dir), keys), keys)
    p = response.profit_curve(fits, keys, 0.25, 1.5, 0.0, 200.0)
    return p.select("ds", F.col("zone").cast("long").alias("zone"), F.col("i").cast("long").alias("i"), rounded("rate").alias("rate"), rounded("yield", 2).alias("yield"), rounded("profit", 2).alias("profit"))


@register(
    "eco_zones",
    _SUMS + """,
e AS (SELECT ds, zone, n, i, i * 0.2e0 AS r, (a + b*(i*0.2e0) + c*(i*0.2e0)*(i*0.2e0)) * 0.25e0 - (i*0.2e0) * 1.5e0 AS profit FROM g, (SELECT unnest(range(0, 1001)) AS i)),
v AS (SELECT ds, sum(n * top) / sum(n) AS vp, count(*) AS z FROM (SELECT ds, zone, max(profit) AS top, any_value(n) AS n FROM e GROUP BY ds, zone) GROUP BY ds),
u AS (SELECT ds, i, r, sum(n * profit) / sum(n) AS pr FROM e GROUP BY ds, i, r),
b AS (SELECT ds, max(pr) AS up FROM u GROUP BY ds)
SELECT v.ds, round(up, 2) + 0e0 AS uniform_profit, round(vp, 2) + 0e0 AS variable_profit, round(vp - up, 2) + 0e0 AS gain FROM v JOIN b ON b.ds = v.ds WHERE z >= 2""",
    rate=PASSES,
)
def eco_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ECO9 on quadratics."""
    z = response.uniform_or_variable(_zone_cells(spark, sf_dir), 0.25, 1.5, 200.0, models=("quadratic",))
    return z.select("ds", *[rounded(c, 2).alias(c) for c in ("uniform_profit", "variable_profit", "gain")])


@register("eco_analyze")
def eco_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ECO10: the whole analysis; the optimum of each log."""
    got = economics.analyze(bench_log(spark, sf_dir).where("value > 0"), 0.25, 1.5, margin_m=2.0, rate_max=200.0, models=("quadratic", "linear_plateau"))
    return r4(got["optimum"], digits=2)


@register("eco_sampled_cells", _CELLS.format(zone="") + """, k AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY md5(col || '|' || row || '|' || CAST(round(rate * 1000) AS BIGINT)), col, row, rate) AS k FROM c)
SELECT ds, col, row, rate, round("yield", 4) + 0e0 AS "yield", round(yield_sd, 4) + 0e0 AS yield_sd, n, round(x, 4) + 0e0 AS x, round(y, 4) + 0e0 AS y FROM k WHERE k <= 20""", rate=PASSES)
def eco_sampled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ECO11: twenty cells of each log."""
    return r4(economics.sampled_cells(layers.aggregate_cells(_levelled(spark, sf_dir)), 20))
