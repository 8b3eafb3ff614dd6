"""Readers of finished files, many at a time: each row carries its file as the log's key.

All are lazy Spark readers; only a few lines at the head of a folder are looked at to choose
options.  What cannot be read leaves a row in a quarantine table, not an exception.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.functions import units
from fieldweave.functions.columns import finite, number
from fieldweave.sources import schema

FILE = "_metadata.file_path"


# -- delimited text ----------------------------------------------------------------------


DELIMITERS = (",", ";", "\t", "|")
HEAD_LINES = 30


def heads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, lines): the first lines of each file that are not blank."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).where("_metadata.file_block_start = 0 and trim(value) <> ''").select(F.col(FILE).alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    first = rows.groupBy("file").agg(F.min("at").alias("first"))
    near = rows.join(first, "file").where(F.col("at") < F.col("first") + HEAD_LINES)
    return near.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("lines"))


def sniff(files: DataFrame) -> DataFrame:
    """SRC1: (file, header, sep, decimal_comma, encoding) of heads.

    The delimiter is the one that each line has, then the one most alike in count from line to
    line, then the most frequent; a comma is a decimal mark if another delimiter is in use and
    over a quarter of the cells below the header are digits with one comma; a head that is no
    UTF-8 is read as Latin-1.
    """

    def score(d: str):
        n = F.transform("lines", lambda x: F.size(F.split(x, f"[{d}]")) - 1)
        return F.struct((F.array_min(n) > 0).alias("a"), (-F.size(F.array_distinct(n))).alias("b"), F.aggregate(n, F.lit(0), lambda s, x: s + x).alias("c"), F.lit(-DELIMITERS.index(d)).alias("d"))

    best = F.greatest(*[score(d) for d in DELIMITERS])
    f = files.withColumn("sep", F.element_at(F.array(*[F.lit(d) for d in DELIMITERS]), 1 - best["d"]))
    cells = F.flatten(F.transform(F.slice("lines", 2, HEAD_LINES), lambda x: F.transform(F.split(x, F.concat(F.lit("["), F.col("sep"), F.lit("]"))), F.trim)))
    comma = F.size(F.filter("cells", lambda c: c.rlike("^-?[0-9]+,[0-9]+$"))) > 0.25 * F.size("cells")
    f = f.withColumn("cells", cells).withColumn("decimal_comma", (F.col("sep") != ",") & (F.size("cells") > 0) & comma)
    odd = F.exists("lines", lambda x: ~F.is_valid_utf8(x))
    return f.select("file", F.regexp_replace(F.col("lines")[0], "^\ufeff", "").alias("header"), "sep", "decimal_comma", F.when(odd, "ISO-8859-1").otherwise("UTF-8").alias("encoding"))


def _formats(spark: SparkSession, path: str | list[str]) -> list:
    """The distinct formats under a folder with their files: as many rows as there are formats."""
    f = sniff(heads(spark, path))
    return f.groupBy("header", "sep", "decimal_comma", "encoding").agg(F.collect_list("file").alias("files")).orderBy("header", "sep").collect()


def _lines_of(spark: SparkSession, fmt) -> tuple[DataFrame, list[str]]:
    """The lines of the files of one format (__file, __at in order, __raw where it has other fields than the header), and their columns.

    A short line is padded with nulls; __over is what a line has beyond the last column.
    """
    read = spark.read.option("header", True).option("sep", fmt["sep"]).option("encoding", fmt["encoding"])
    columns = read.csv(fmt["files"]).columns
    fields = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, "__over", "__raw")])
    raw = read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__raw").option("enforceSchema", True).schema(fields).csv(fmt["files"])
    return raw.select(F.col(FILE).alias("__file"), F.monotonically_increasing_id().alias("__at"), *[F.col(f"`{c}`") for c in raw.columns]), columns


def _rows_of(spark: SparkSession, fmt) -> tuple[DataFrame, list[str]]:
    """The rows of the files of one format (ds = file, __n = order in it from 1), and their columns."""
    lines, columns = _lines_of(spark, fmt)
    rows = lines.where("__over is null").drop("__over", "__raw")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("__file").orderBy("__at"))), columns


def rejected_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC15: (file, line, reason) of the lines of delimited files that ``read_tabular`` leaves out: those with more fields than the header."""
    out = spark.createDataFrame([], "file string, line string, reason string")
    for fmt in _formats(spark, path):
        lines, columns = _lines_of(spark, fmt)
        # Spark keeps the text of a line only where it has more than one field too many
        line = F.coalesce("__raw", F.concat_ws(fmt["sep"], *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (*columns, "__over")]))
        out = out.unionByName(lines.where("__over is not null").select(F.col("__file").alias("file"), line.alias("line"), F.lit(f"more fields than the {len(columns)} of the header").alias("reason")))
    return out


def _known_units() -> list[str]:
    return [u.lower() for us in units.UNITS.values() for u in us] + ["%", "deg", "ft", "mi/h"]


def read_tabular(spark: SparkSession, path: str | list[str], aliases=schema.ALIASES) -> DataFrame:
    """SRC1-3: delimited logs as canonical points (ds = file, seq = order in it); a row of units under the header goes.

    Each file is read by its own delimiter, header, decimal mark and encoding: files of one
    format are one read, and the formats are united by column name.
    """
    parts = []
    for fmt in _formats(spark, path):
        rows, columns = _rows_of(spark, fmt)
        cells = F.array(*[F.trim(F.col(f"`{c}`")) for c in columns])
        is_units = F.exists(cells, lambda c: F.lower(c).isin(*_known_units())) & (F.size(F.filter(cells, lambda c: c.try_cast("double").isNotNull())) <= 0.3 * len(columns))
        rows = rows.where(~((F.col("__n") == 1) & F.coalesce(is_units, F.lit(False))))
        names, comma = schema.map_columns(spark, columns, aliases), fmt["decimal_comma"]
        seq = (F.row_number().over(Window.partitionBy("__file").orderBy("__at")) - 1).cast("long").alias("seq")
        own = [(number(F.col(f"`{c}`"), comma) if names.get(c) in schema.NUMERIC else F.col(f"`{c}`")).alias(names.get(c, c)) for c in columns]
        out = rows.select(F.col("__file").alias("ds"), seq, *own)
        parts.append(out.withColumn("timestamp", schema.parse_stamp(F.col("timestamp"))) if "timestamp" in out.columns else out)
    if not parts:
        return spark.createDataFrame([], "ds string, seq long")
    return union_logs(*parts)


def source_units(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC2: (ds, column, unit) where the first row under a header names units."""
    parts = []
    for fmt in _formats(spark, path):
        rows, columns = _rows_of(spark, fmt)
        names = schema.map_columns(spark, columns)
        pairs = F.explode(F.array(*[F.struct(F.lit(names.get(c, c)).alias("column"), F.trim(F.col(f"`{c}`")).alias("unit")) for c in columns])).alias("p")
        parts.append(rows.where("__n = 1").select(F.col("__file").alias("ds"), pairs).select("ds", "p.*").where(F.lower("unit").isin(*_known_units())))
    return union_logs(*parts) if parts else spark.createDataFrame([], "ds string, column string, unit string")


def pick_value(points: DataFrame, ds: str = "ds", candidates: tuple[str, ...] | None = None) -> DataFrame:
    """SRC5: (ds, column): value, applied_rate, target_rate or flow where a log has one, else its number of greatest CV in (0, 5)."""
    if candidates is None:
        candidates = tuple(n for n, k in points.dtypes if k == "double" and n not in ("lon", "lat", "x", "y"))
    order = [c for c in ("value", "applied_rate", "target_rate", "flow_kgs") if c in points.columns]
    cv = [F.struct(F.try_divide(F.stddev_samp(c), F.abs(F.avg(c))).alias("cv"), F.lit(c).alias("c")).alias(f"_{c}") for c in candidates]
    a = points.groupBy(ds).agg(*cv, *[F.count(c).alias(f"n_{c}") for c in order])
    best = F.array_max(F.filter(F.array(*[F.col(f"_{c}") for c in candidates]), lambda s: (s["cv"] > 0) & (s["cv"] < 5)))["c"]
    return a.select(ds, F.coalesce(*[F.when(F.col(f"n_{c}") > 0, F.lit(c)) for c in order], best).alias("column"))


def guess_operation(points: DataFrame, ds: str = "ds", tolerance: float = 1e-6) -> DataFrame:
    """SRC6: operation of each log by its columns, its path and whether value is the target."""
    has = lambda c: F.count(c) > 0 if c in points.columns else F.lit(False)
    same = F.coalesce(F.every(F.abs(F.col("target_rate") - F.col("value")) <= tolerance), F.lit(False)) if {"target_rate", "value"} <= set(points.columns) else F.lit(False)
    a = points.groupBy(ds).agg(has("moisture_pct").alias("m"), has("flow_kgs").alias("f"), has("vigor_index").alias("g"), has("target_rate").alias("t"), has("applied_rate").alias("a"), has("elev_m").alias("e"), has("value").alias("v"), same.alias("same"))
    p = F.lower(F.col(ds).cast("string"))
    return a.select(
        ds,
        F.when(F.col("g"), "vigor").when(F.col("m") | F.col("f") | p.rlike("harvest|yield"), "harvest").when(F.col("same"), "prescription").when(p.rlike("seed|plant|sow"), "planting")
        .when(F.col("t") | F.col("a") | p.rlike("appl|spray|fert"), "application").when(F.col("e") & ~F.col("v"), "elevation").otherwise("unknown").alias("operation"),
    )


# -- nested text -------------------------------------------------------------------------

_COORDS = "array<double>"
FEATURE = "struct<type: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: a row per feature: lon, lat (a polygon's vertex mean), ring, properties."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col(FILE).alias("ds"), F.col("value").alias("j"))
    return _features(raw.select("ds", F.from_json("j", f"struct<features: array<{FEATURE}>>")["features"].alias("fs")))


def _features(df: DataFrame) -> DataFrame:
    f = df.select("ds", F.posexplode("fs").alias("feature_id", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    ring = F.when(kind == "Polygon", F.from_json(raw, f"array<array<{_COORDS}>>")[0]).when(kind == "MultiPolygon", F.from_json(raw, f"array<array<array<{_COORDS}>>>")[0][0])
    open_ring = F.when(F.size(ring) > 1, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)  # the last vertex repeats the first
    point = F.when(kind == "Point", F.from_json(raw, _COORDS))
    mean = lambda i: F.aggregate(open_ring, F.lit(0.0), lambda a, p: a + p[i]) / F.size(open_ring)
    return f.select("ds", "feature_id", finite(F.coalesce(point[0], mean(0))).alias("lon"), finite(F.coalesce(point[1], mean(1))).alias("lat"), open_ring.alias("ring"), F.col("f.properties").alias("properties"))


WRAPPERS = ("$", "$.data", "$.session.data", "$.application.data", "$.result", "$.geojson", "$.data.geojson")
VALUES = ("applied_rate", "rate", "dose", "vigor", "ndvi")


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: vision-system sessions: features under the first known wrapper that has some, the value by priority, vigor_index."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col(FILE).alias("ds"), F.col("value").alias("j"))
    fs = F.coalesce(*[F.get_json_object("j", w + ".features") for w in WRAPPERS])
    f = _features(raw.select("ds", F.from_json(fs, f"array<{FEATURE}>").alias("fs")))
    get = lambda k: F.try_element_at("properties", F.lit(k)).try_cast("double")
    return f.select("ds", F.col("feature_id").cast("long").alias("seq"), "lon", "lat", F.coalesce(*[get(k) for k in VALUES]).alias("value"), F.coalesce(get("vigor"), get("ndvi")).alias("vigor_index"), get("applied_rate").alias("applied_rate"), get("speed").alias("speed_kmh"), schema.parse_stamp(F.try_element_at("properties", F.lit("timestamp"))).alias("timestamp"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: (ds, name, ring) of each placemark's outer ring."""
    coords = T.StructType([T.StructField("LinearRing", T.StructType([T.StructField("coordinates", T.StringType())]))])
    s = T.StructType([T.StructField("name", T.StringType()), T.StructField("Polygon", T.StructType([T.StructField("outerBoundaryIs", coords)]))])
    p = spark.read.format("xml").option("rowTag", "Placemark").schema(s).load(path)
    text = F.trim(F.col("Polygon.outerBoundaryIs.LinearRing.coordinates"))
    pts = F.transform(F.split(text, r"\s+"), lambda v: F.struct(F.split(v, ",")[0].try_cast("double").alias("lon"), F.try_element_at(F.split(v, ","), F.lit(2)).try_cast("double").alias("lat")))
    return p.select(F.col(FILE).alias("ds"), "name", pts.alias("ring")).where("ring is not null")


def read_tasks(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC10: tables of customers, farms, fields and tasks of task registers (one XML each)."""

    def rows(tag: str, names: dict[str, str]) -> DataFrame:
        s = T.StructType([T.StructField("_" + a, T.StringType()) for a in names])
        return spark.read.format("xml").option("rowTag", tag).schema(s).load(path).select(F.col(FILE).alias("ds"), *[F.col("_" + a).alias(n) for a, n in names.items()])

    return {
        "customers": rows("CTR", {"A": "id", "B": "name"}), "farms": rows("FRM", {"A": "id", "B": "name", "I": "customer"}),
        "fields": rows("PFD", {"A": "id", "C": "name", "D": "area_m2", "E": "customer", "F": "farm"}), "tasks": rows("TSK", {"A": "id", "B": "name", "C": "customer", "D": "farm", "E": "field"}), "products": rows("PDT", {"A": "id", "B": "name"}),
    }


# -- binary logs -------------------------------------------------------------------------

#: DDI, factor to the internal unit, canonical column.
DDI = [
    (0x0001, 0.01, "target_rate"), (0x0002, 0.01, "applied_rate"), (0x0003, 1e-6, None), (0x0004, 1e-6, "flow_kgs"), (0x0005, 0.01, "target_rate"), (0x0006, 0.01, "target_rate"), (0x0007, 0.01, "applied_rate"),
    (0x000A, 10.0, "target_rate"), (0x000B, 10.0, "applied_rate"), (0x0043, 0.0036, "speed_kmh"), (0x0046, 0.0036, "speed_kmh"), (0x0048, 1.0, None), (0x0049, 0.001, "swath_m"), (0x0074, 0.001, "distance_m"),
    (0x0075, 0.001, None), (0x0077, 1e-10, None), (0x0082, 0.01, "value"), (0x0083, 1e-4, "moisture_pct"), (0x0084, 0.001, None), (0x0090, 0.001, None),
]
#: The header's optional position fields: attribute, name, format.
POSITION = [("A", "north", "i"), ("B", "east", "i"), ("C", "up", "i"), ("D", "pos_status", "B"), ("E", "pdop", "H"), ("F", "hdop", "H"), ("G", "n_sats", "B"), ("H", "gps_ms", "I"), ("I", "gps_day", "H")]
MAX_VALUES = 64
LONG = "ds string, rec long, ms long, day long, north long, east long, up long, ddi int, raw long, error string"


def _layout(header: bytes) -> tuple[bool, list[tuple[str, str]], list[int]]:
    """Whether time is logged, the fields of a record in order, and the DDI of each logged value.

    An attribute that is present and empty is logged with each record.
    """
    root = ET.fromstring(header)
    time = root if root.tag == "TIM" else root.find(".//TIM")
    ptn = time.find("PTN")
    fields = [(n, f) for a, n, f in POSITION if ptn is not None and ptn.get(a) == ""]
    return time.get("A") == "", fields, [int(d.get("A") or "0", 16) for d in time.findall("DLV")]


def _records(ds: str, header: bytes, data: bytes) -> Iterator[tuple]:
    timed, fields, ddis = _layout(header)
    fmt = "<" + ("IH" if timed else "") + "".join(f for _, f in fields)
    names = (["ms", "day"] if timed else []) + [n for n, _ in fields]
    size, at, rec = struct.calcsize(fmt), 0, 0
    while at + size + 1 <= len(data):
        head = dict(zip(names, struct.unpack_from(fmt, data, at)))
        n = data[at + size]
        at += size + 1
        if n > MAX_VALUES or at + 5 * n > len(data):
            yield (ds, rec, None, None, None, None, None, None, None, "record cut short")
            return
        got = [(data[at + 5 * i], struct.unpack_from("<i", data, at + 5 * i + 1)[0]) for i in range(n)]
        at += 5 * n
        for i, v in got or [(None, None)]:
            yield (ds, rec, head.get("ms"), head.get("day"), head.get("north"), head.get("east"), head.get("up"), ddis[i] if i is not None and i < len(ddis) else None, v, None)
        rec += 1


def read_binary_logs(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: a long row per record and value of all .bin logs with a header .xml of the same name; a log that fails leaves a row with its error."""
    return decode_logs(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content"))


def decode_logs(f: DataFrame) -> DataFrame:
    """SRC11 on files (path, content)."""
    key = lambda ext: F.regexp_replace("path", rf"(?i)\.{ext}$", "")
    x = f.where(F.lower("path").endswith(".xml")).select(key("xml").alias("ds"), F.col("content").alias("header"))
    b = f.where(F.lower("path").endswith(".bin")).select(key("bin").alias("ds"), F.col("content").alias("data"))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in LONG.split(", ")]
        for pdf in frames:
            for ds, header, data in zip(pdf["ds"], pdf["header"], pdf["data"]):
                try:
                    rows = list(_records(ds, bytes(header), bytes(data)))
                except (ET.ParseError, AttributeError, ValueError, TypeError) as e:
                    rows = [(ds, 0, *[None] * 7, f"header: {e}")]
                out = pd.DataFrame(rows, columns=cols)
                yield out.astype({c: "Int64" for c in cols if c not in ("ds", "error")})

    return b.join(x, "ds", "left").mapInPandas(decode, LONG)


def scale_values(long: DataFrame) -> DataFrame:
    """SRC12: a row per record: position, time (days since 1980), canonical columns in internal units, the rest raw in ddi_extra."""
    dim = long.sparkSession.createDataFrame(DDI, "ddi int, factor double, canon string")  # a fixed list
    v = long.where("error is null").join(F.broadcast(dim), "ddi", "left")
    names = sorted({c for _, _, c in DDI if c})
    # of two DDIs of one column the lower has it; the other stays raw
    w = Window.partitionBy("ds", "rec", "canon").orderBy("ddi")
    v = v.withColumn("_k", F.when(F.col("canon").isNotNull(), F.row_number().over(w)))
    own = F.col("_k") == 1
    extra = F.map_from_entries(F.filter(F.array_distinct(F.collect_list(F.when(F.col("ddi").isNotNull() & ~F.coalesce(own, F.lit(False)), F.struct(F.concat(F.lit("ddi_"), F.lpad(F.hex("ddi"), 4, "0")).alias("k"), F.col("raw").cast("double").alias("v"))))), lambda s: s.isNotNull()))
    day = F.expr("timestamp_ntz'1980-01-01 00:00:00' + make_interval(0, 0, 0, cast(day as int), 0, 0, ms / 1000.0)")
    return v.groupBy("ds", "rec").agg(
        F.first("north").alias("_n"), F.first("east").alias("_e"), F.first("up").alias("_u"), F.first(day).alias("timestamp"),
        *[F.max(F.when((F.col("canon") == c) & own, F.col("raw") * F.col("factor"))).alias(c) for c in names], extra.alias("ddi_extra"),
    ).select("ds", F.col("rec").alias("seq"), (F.col("_e") * 1e-7).alias("lon"), (F.col("_n") * 1e-7).alias("lat"), (F.col("_u") * 1e-3).alias("elev_m"), "timestamp", *names, "ddi_extra")


def read_grids(spark: SparkSession, path: str, shape: DataFrame) -> DataFrame:
    """SRC13: prescription grids as cells (ds, row, col, lon, lat, raw), row-major from the south-west.

    shape: (ds, kind, rows, cols, lon0, lat0, dlon, dlat, scale); kind 2 has 32-bit values, kind 1 zone codes of a byte.
    """
    return decode_grids(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("ds"), "content"), shape)


def decode_grids(contents: DataFrame, shape: DataFrame) -> DataFrame:
    """SRC13 on (ds, content)."""
    f = contents.join(shape, "ds")
    kind = dict(contents.dtypes)["ds"]

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                v = np.frombuffer(bytes(r.content), "<u4" if r.kind == 2 else "u1")[: r.rows * r.cols].astype(np.int64)
                yield pd.DataFrame({"ds": r.ds, "i": np.arange(len(v)), "raw": v})

    c = f.mapInPandas(decode, f"ds {kind}, i long, raw long").join(shape, "ds")
    row, col = F.floor(F.col("i") / F.col("cols")), F.col("i") % F.col("cols")
    return c.select("ds", row.alias("row"), col.alias("col"), (F.col("lon0") + (col + 0.5) * F.col("dlon")).alias("lon"), (F.col("lat0") + (row + 0.5) * F.col("dlat")).alias("lat"), F.when(F.col("kind") == 2, F.col("raw") * F.col("scale")).otherwise(F.col("raw").cast("double")).alias("rate"))


def union_logs(*logs: DataFrame) -> DataFrame:
    """SRC14: logs with different columns in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def union_tasks(logs: DataFrame, names: DataFrame, grids: DataFrame, boundaries: DataFrame, ds: str = "ds") -> DataFrame:
    """SRC14: all logs of all tasks with the task's label; a task without a usable log shows its grids, else its boundaries.

    logs, grids and boundaries are points (ds, task, lon, lat, ...); a log that could not be
    decoded has an error and no position.  names: (task, label).
    """
    good = logs.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()) if "error" not in logs.columns else logs.where("error is null and lon is not null and lat is not null")
    have = good.select("task").distinct()
    second = grids.join(have, "task", "left_anti")
    have = have.unionByName(second.select("task").distinct())
    third = boundaries.join(have, "task", "left_anti")
    rows = union_logs(*[d.withColumn("kind", F.lit(k)) for d, k in ((good, "log"), (second, "grid"), (third, "boundary"))])
    return rows.join(names, "task", "left")


# Readers by extension.
READERS = {"csv": "tabular", "txt": "tabular", "tsv": "tabular", "json": "geojson", "geojson": "geojson", "kml": "kml", "xml": "tasks", "bin": "binary"}


def listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, reader, bytes) of everything under a folder; only names and sizes are read (Spark leaves out files of 0 bytes)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    ext = F.lower(F.regexp_extract("file", r"\.([^./]*)$", 1))
    table = F.create_map(*[F.lit(x) for pair in READERS.items() for x in pair])
    return f.select("file", F.try_element_at(table, ext).alias("reader"), "bytes", ext.alias("ext"))


def ingest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC15: a folder's points, and (file, reader, n_rows, n_rejected, reason) of every file under it.

    Each file goes to the reader of its extension; the reason tells why a file gave no points.
    n_rejected counts lines that gave none, which ``rejected_lines`` shows.
    """
    files = listing(spark, path)
    by = {r["reader"]: r["files"] for r in files.where("reader is not null").groupBy("reader").agg(F.collect_list("file").alias("files")).collect()}
    parts, said = [], [spark.createDataFrame([], "file string, why string")]
    bad = spark.createDataFrame([], "file string, line string, reason string")
    if "tabular" in by:
        parts.append(read_tabular(spark, by["tabular"]))
        bad = rejected_lines(spark, by["tabular"])
    if "geojson" in by:
        parts.append(read_geojson(spark, by["geojson"]).select("ds", F.col("feature_id").cast("long").alias("seq"), "lon", "lat"))
    if "kml" in by:
        ring = read_kml(spark, by["kml"]).select("ds", F.posexplode("ring").alias("seq", "p"))
        parts.append(ring.select("ds", F.col("seq").cast("long").alias("seq"), "p.lon", "p.lat"))
    if "binary" in by:
        long = read_binary_logs(spark, [f for k in ("binary", "tasks") for f in by.get(k, ())])
        said.append(long.where("error is not null").groupBy(F.concat("ds", F.lit(".bin")).alias("file")).agg(F.first("error").alias("why")))
        parts.append(scale_values(long).drop("ddi_extra").withColumn("ds", F.concat("ds", F.lit(".bin"))))
    points = union_logs(*parts) if parts else spark.createDataFrame([], "ds string, seq long, lon double, lat double")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  the readers differ in how they write a local path
    n = points.groupBy(plain(F.col("ds")).alias("k")).agg(F.count("lon").alias("n_rows"))
    why = union_logs(*said).select(plain(F.col("file")).alias("k"), "why")
    lost = bad.groupBy(plain(F.col("file")).alias("k")).agg(F.count(F.lit(1)).alias("n_rejected"))
    out = files.withColumn("k", plain(F.col("file"))).join(n, "k", "left").join(why, "k", "left").join(lost, "k", "left")
    reason = F.when(F.col("reader").isNull(), F.concat(F.lit("no reader for ."), F.col("ext"))).when(F.col("why").isNotNull(), F.col("why")).when((F.coalesce("n_rows", F.lit(0)) == 0) & (F.col("reader") != "tasks"), F.lit("no positions"))
    return points, out.select("file", "reader", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"), reason.alias("reason"))


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: (file, reason) of everything under a folder that no reader takes."""
    return listing(spark, path).where("reader is null").select("file", F.concat(F.lit("no reader for ."), F.col("ext")).alias("reason"))


# -- elevation rasters as cell tables ----------------------------------------------------

NODATA = (-9999.0, -9998.0, -32768.0)


def undeclared_nodata(cells: DataFrame, ds: str = "ds") -> DataFrame:
    """SRC17: (ds, nodata): the commonest value that is a known fill, beyond 1e38, or over 1000 m below the median on over 0.5 % of the cells."""
    n = cells.where("z is not null").groupBy(ds, "z").agg(F.count(F.lit(1)).alias("n"))
    m = cells.groupBy(ds).agg(F.percentile("z", F.lit(0.5)).alias("med"), F.count("z").alias("total"))
    odd = F.col("z").isin(*NODATA) | (F.abs("z") >= 1e38) | ((F.col("med") - F.col("z") > 1000) & (F.col("n") > 0.005 * F.col("total")))
    return n.join(m, ds).where(odd).groupBy(ds).agg(F.max_by("z", F.struct("n", "z")).alias("nodata"))


def average_to_cell(cells: DataFrame, native: float, size: float, ds: str = "ds") -> DataFrame:
    """SRC18: block average of native cells to a coarser cell, from the grid's corner."""
    to = lambda c: F.floor((F.col(c) + 0.5) * native / size)
    return cells.where("z is not null").groupBy(ds, to("row").alias("row"), to("col").alias("col")).agg(F.avg("z").alias("z"))


def strided_points(cells: DataFrame, size: float, most: int = 150_000, ds: str = "ds") -> DataFrame:
    """SRC19: cells as points, every s-th row and column so that a grid gives at most that many."""
    s = cells.groupBy(ds).agg(F.greatest(F.lit(1), F.ceil(F.sqrt(F.count(F.lit(1)) / F.lit(most)))).cast("long").alias("_s"))
    c = cells.join(s, ds).where("row % _s = 0 and col % _s = 0")
    return c.select(ds, ((F.col("col") + 0.5) * size).alias("x"), (-(F.col("row") + 0.5) * size).alias("y"), F.col("z").alias("elev_m"))
