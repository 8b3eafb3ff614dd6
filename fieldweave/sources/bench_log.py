"""A machine log made of the ``events`` table: the shared input of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The same text for Spark SQL and DuckDB.  {events} is the table, {rate} the rate blocks.  The
#: users of a log are 6 and 18 in turn: logs grow in number with the table, not in size.
LOG = """
log_u AS (SELECT event_id, CAST(floor(user_id / 24e0) AS BIGINT) * 2 + CASE WHEN user_id % 24 < 6 THEN 0 ELSE 1 END AS ds, ts, value FROM {events}),
log_o AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY ts, event_id) - 1 AS seq FROM log_u),
log_p AS (SELECT *, CAST(floor(CAST(seq AS DOUBLE)/40) AS BIGINT) AS pass_id FROM log_o),
log_q AS (SELECT *, CASE WHEN pass_id % 2 = 0 THEN seq - pass_id*40 ELSE 39 - (seq - pass_id*40) END AS along FROM log_p),
log AS (
SELECT CAST(ds AS BIGINT) AS ds, CAST(seq AS BIGINT) AS seq, ts AS timestamp, CAST(seq AS DOUBLE)*2e0 AS elapsed_s, pass_id,
  CAST(pass_id AS DOUBLE)*9e0 + CASE WHEN event_id % 97 = 0 THEN 4e0 ELSE 0e0 END AS x,
  CAST(along AS DOUBLE)*4e0 AS y,
  4e0 AS distance_m,
  CASE WHEN event_id % 89 = 0 THEN 0e0 WHEN event_id % 83 = 0 THEN -1e0 ELSE value*10e0 END AS value,
  5e0 + CAST(event_id % 7 AS DOUBLE) + CASE WHEN event_id % 61 = 0 THEN 20e0 ELSE 0e0 END AS speed_kmh,
  CASE WHEN event_id % 31 = 0 THEN 3e0 ELSE 9e0 END AS swath_m,
  8e0 + CAST(event_id % 11 AS DOUBLE)*3e0 AS moisture_pct,
  CAST({rate} AS DOUBLE) AS applied_rate,
  CASE WHEN along < 20 THEN 0 ELSE 1 END AS zone,
  700e0 + CAST(pass_id AS DOUBLE)*5e-2 + CAST(along AS DOUBLE)*2e-2 + CAST(event_id % 5 AS DOUBLE)*1e-2 AS elev_m
FROM log_q)"""
#: Rates in strips of three passes, and pass by pass (which small inputs need for five rates).
STRIPS, PASSES = "(CAST(floor(CAST(pass_id AS DOUBLE)/3) AS BIGINT) % 5)*45", "(pass_id % 5)*45"


def bench_log(spark: SparkSession, sf_dir: str, rate: str = STRIPS) -> DataFrame:
    """The log as a DataFrame, keyed by (ds, seq)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
    return spark.sql("WITH " + LOG.replace("{rate}", rate) + " SELECT * FROM log", events=events)


def sql(query: str, rate: str = STRIPS) -> str:
    """A DuckDB statement over ``log``; the query may begin with further common tables."""
    query = query.strip()
    joint = ",\n" if query[:5].upper() != "SELECT" else "\n"
    return "WITH " + LOG.replace("{rate}", rate).replace("{events}", "events").strip() + joint + query


#: A second log, of ``lineitem``: twenty suppliers a log, so logs are long (some 12,000 records) and grow
#: in number.  Implements differ from log to log, readings lie unevenly, a slough is driven around, one pass
#: is left out, one log in five begins with a stray fix 40 km away, and one in five holds two fields 3 km apart.
ROUGH = """
ro_u AS (SELECT CAST(floor((l_suppkey - 1) / 20e0) AS BIGINT) AS ds, l_orderkey AS ok, l_partkey AS pk, l_quantity AS qty,
  row_number() OVER (PARTITION BY floor((l_suppkey - 1) / 20e0) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS seq FROM {lineitem}),
ro_p AS (SELECT *, 6e0 + 4e0 * (ds % 4) AS swath_m, CAST(floor(seq / 120e0) AS BIGINT) AS pass_id FROM ro_u),
ro_q AS (SELECT *, CASE WHEN pass_id % 2 = 0 THEN seq - pass_id * 120 ELSE 119 - (seq - pass_id * 120) END AS along FROM ro_p),
ro_x AS (SELECT *, CAST(pass_id AS DOUBLE) * swath_m + (pk % 7) * 1e-1 + CASE WHEN ds % 5 = 3 AND seq = 0 THEN 4e4 WHEN ds % 5 = 1 AND pass_id >= 60 THEN 3e3 ELSE 0e0 END AS x, CAST(along AS DOUBLE) * 5e0 + (ok % 5) * 6e-1 AS y FROM ro_q
  WHERE pass_id <> 20 AND NOT (pass_id BETWEEN 8 AND 14 AND along BETWEEN 30 AND 62)),
rough AS (
SELECT ds, CAST(seq AS BIGINT) AS seq, pass_id, x, y, swath_m, qty AS value,
  700e0 + 4e0 * sin(x / 90e0) * cos(y / 70e0) + 1e-2 * x + ((pass_id * 37) % 11 - 5) * 3e-2 + (pk % 13 - 6) * 2e-2 AS elev_m
FROM ro_x)"""


def rough_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second log as a DataFrame, keyed by (ds, seq)."""
    return spark.sql("WITH " + ROUGH + " SELECT * FROM rough", lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def rough_sql(query: str) -> str:
    """A DuckDB statement over ``rough``; the query may begin with further common tables."""
    query = query.strip()
    joint = ",\n" if query[:5].upper() != "SELECT" else "\n"
    return "WITH " + ROUGH.replace("{lineitem}", "lineitem").strip() + joint + query
