"""Task registers with everything they name: rings, logs and grids, many registers in one job (SRC10, SRC14).

A register is an XML file named TASKDATA (any case); what it names lies in its own folder.  All files come as a
table (path, content), so neither names nor contents pass through the driver.  References become edges
(register, task, kind, name), which meet the files by folder and upper-case name; each edge ends as rows or a reason.

Defined cases: an element without its id gives a null id; of tasks that share an id in a register the first name
by order of text is shown; a log that two tasks name is read for both; a name of no file, a header without its
binary, bytes cut short and grids shorter than declared each leave a reason; an empty table of files gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.sources.files import decode_grids, decode_logs, scale_values, union_logs

POINT = "struct<_C: string, _D: string>"
RING = f"array<struct<PNT: array<{POINT}>>>"
REGISTER = f"""
_VersionMajor string, _VersionMinor string, _ManagementSoftwareManufacturer string,
CTR array<struct<_A: string, _B: string>>, FRM array<struct<_A: string, _B: string>>, PDT array<struct<_A: string, _B: string>>,
PFD array<struct<_A: string, _B: string, _C: string, _D: string, _E: string, _F: string, PLN: array<struct<LSG: {RING}>>>>,
TSK array<struct<_A: string, _B: string, _C: string, _D: string, _E: string, TLG: array<struct<_A: string>>,
  GRD: array<struct<_A: string, _B: string, _C: string, _D: string, _E: string, _F: string, _G: string, _I: string>>>>"""
#: Whole numbers of a grid's binary for one of the internal unit.
PER_UNIT = {"mass": 100.0, "volume": 100.0, "count": 0.1}


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content) of everything under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def _named(path: Column) -> tuple[Column, Column, Column]:
    """Folder, upper-case name without extension, and lower-case extension."""
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_extract(path, r"^(.*?)[^/]*$", 1), F.upper(F.regexp_replace(last, r"\.[^.]*$", "")), F.lower(F.regexp_extract(last, r"\.([^.]*)$", 1))


def parse(files: DataFrame) -> DataFrame:
    """(ds, folder, t, broken): one row for each register, its elements nested in t."""
    folder, stem, ext = _named(F.col("path"))
    t = F.from_xml(F.col("content").cast("string"), REGISTER + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    p = files.where((stem == "TASKDATA") & (ext == "xml")).select(F.col("path").alias("ds"), folder.alias("folder"), t.alias("t"))
    return p.select("ds", "folder", "t", (F.col("t").isNull() | F.col("t._broken").isNotNull()).alias("broken"))


def _each(p: DataFrame, element: str, **names: str) -> DataFrame:
    return p.select("ds", F.explode(f"t.{element}").alias("e")).select("ds", *[F.nullif(F.col(f"e.{v}"), F.lit("")).alias(k) for k, v in names.items()])


def fields(p: DataFrame) -> DataFrame:
    """SRC10: (ds, field, name, area_m2, customer, farm), people and farms by name."""
    f = _each(p, "PFD", field="_A", _c="_C", _b="_B", area="_D", customer_id="_E", farm_id="_F")
    name = lambda el, id_, out: _each(p, el, id="_A", name="_B").groupBy("ds", F.col("id").alias(id_)).agg(F.min("name").alias(out))
    f = f.join(name("CTR", "customer_id", "customer"), ["ds", "customer_id"], "left").join(name("FRM", "farm_id", "farm"), ["ds", "farm_id"], "left")
    return f.select("ds", "field", F.coalesce("_c", "_b").alias("name"), F.col("area").try_cast("double").alias("area_m2"), "customer", "farm")


def rings(p: DataFrame) -> DataFrame:
    """SRC10: (ds, field, name, ring, corners): the rings of at least three corners, corners as (lon, lat)."""
    f = p.select("ds", F.explode("t.PFD").alias("f"))
    lines = F.flatten(F.transform(F.filter("f.PLN", lambda n: n["LSG"].isNotNull()), lambda n: n["LSG"]))
    r = f.select("ds", F.col("f._A").alias("field"), F.coalesce(F.nullif("f._C", F.lit("")), F.nullif("f._B", F.lit(""))).alias("name"), F.posexplode(lines).alias("ring", "l"))
    at = F.transform("l.PNT", lambda q: F.struct(q["_D"].try_cast("double").alias("lon"), q["_C"].try_cast("double").alias("lat")))
    r = r.withColumn("corners", F.filter(at, lambda q: q["lon"].isNotNull() & q["lat"].isNotNull()))
    return r.where(F.size("corners") >= 3).select("ds", "field", "name", F.col("ring").cast("long").alias("ring"), "corners")


def tasks(p: DataFrame) -> DataFrame:
    """SRC10: (ds, task, name, customer_id, farm_id, field)."""
    return _each(p, "TSK", task="_A", name="_B", customer_id="_C", farm_id="_D", field="_E")


def references(p: DataFrame) -> DataFrame:
    """SRC14: the edges (ds, folder, task, label, kind, name, grid) from tasks to the files they name."""
    t = p.select("ds", "folder", F.explode("t.TSK").alias("k"))
    g = F.transform("k.GRD", lambda x: F.struct(F.lit("grid").alias("kind"), x["_G"].alias("name"), F.struct(
        F.coalesce(x["_I"].try_cast("int"), F.lit(2)).alias("kind"), x["_F"].try_cast("long").alias("rows"), x["_E"].try_cast("long").alias("cols"), x["_B"].try_cast("double").alias("lon0"),
        x["_A"].try_cast("double").alias("lat0"), x["_D"].try_cast("double").alias("dlon"), x["_C"].try_cast("double").alias("dlat")).alias("grid")))
    none = "struct<kind: int, rows: bigint, cols: bigint, lon0: double, lat0: double, dlon: double, dlat: double>"
    l = F.transform("k.TLG", lambda x: F.struct(F.lit("log").alias("kind"), x["_A"].alias("name"), F.lit(None).cast(none).alias("grid")))
    empty = f"array<struct<kind: string, name: string, grid: {none}>>"
    both = F.concat(F.coalesce(l, F.array().cast(empty)), F.coalesce(g, F.array().cast(empty)))
    label = F.coalesce(F.nullif("k._B", F.lit("")), F.col("k._A"))
    return t.select("ds", "folder", F.col("k._A").alias("task"), label.alias("label"), F.explode(both).alias("e")).select("ds", "folder", "task", "label", "e.*").where("name <> ''")


def read(files: DataFrame, rate: str = "mass") -> tuple[DataFrame, DataFrame]:
    """SRC14: the points of all registers, and what became of each file they name.

    Points are (ds, task, label, kind, source, seq, lon, lat, value, ...).  A register's logs make its points; where
    none gives any, its grids do, and else the corners of its rings.  value is the logged value, else the applied,
    else the target rate.  The report is (ds, task, kind, name, n_rows, reason), a broken register having one row.
    """
    p = parse(files)
    e = references(p)
    folder, stem, ext = _named(F.col("path"))
    # a grid's file may lack the extension; of files that differ in case only, the first by path is read
    own = files.select(folder.alias("folder"), stem.alias("stem"), ext.alias("ext"), "path", "content").where("ext in ('xml', 'bin', '')")
    own = own.groupBy("folder", "stem", "ext").agg(F.min_by("content", "path").alias("content"))
    e = e.withColumn("stem", F.upper("name"))

    named = e.where("kind = 'log'").select("folder", "stem").distinct()
    f = named.join(own.where("ext <> ''"), ["folder", "stem"]).select(F.concat("folder", "stem", F.lit("."), "ext").alias("path"), "content")
    there = f.groupBy(F.regexp_replace("path", r"\.[^.]*$", "").alias("file")).agg(F.max(F.lower("path").endswith(".xml")).alias("_header"), F.max(F.lower("path").endswith(".bin")).alias("_data"))
    ready = there.where("_header and _data").select("file")
    f = f.withColumn("file", F.regexp_replace("path", r"\.[^.]*$", "")).join(ready, "file").drop("file")
    long = decode_logs(f)
    bad = long.where("error is not null").groupBy(F.col("ds").alias("file")).agg(F.min("error").alias("_error"))
    rows = scale_values(long).withColumnRenamed("ds", "file").withColumn("source", F.regexp_extract("file", r"([^/]*)$", 1))
    links = e.where("kind = 'log'").select("ds", "task", "label", "name", F.concat("folder", "stem").alias("file")).distinct()
    logs = rows.join(links, "file").where("lon is not null and lat is not null").select("ds", "task", "label", F.lit("log").alias("kind"), "name", *[c for c in rows.columns if c != "file"])

    grids = e.where("kind = 'grid'").select("ds", "task", "label", "name", "folder", "stem", "grid.*")
    data = own.where("ext in ('bin', '')").groupBy("folder", "stem").agg(F.max_by("content", "ext").alias("content"))
    grids = grids.dropDuplicates(["ds", "task", "name"]).join(data, ["folder", "stem"], "left")
    size = F.col("rows") * F.col("cols") * F.when(F.col("kind") == 1, 1).otherwise(4)
    shape_known = F.col("rows").isNotNull() & F.col("cols").isNotNull() & F.col("lon0").isNotNull() & F.col("lat0").isNotNull() & F.col("dlon").isNotNull() & F.col("dlat").isNotNull()
    grids = grids.withColumn("_why", F.when(~shape_known, "grid without a shape").when(F.col("content").isNull(), "no such file").when(F.length("content") < size, "fewer cells than declared"))
    grids = grids.withColumn("key", F.to_json(F.struct("ds", "task", "name")))
    good = grids.where("_why is null")
    shape = good.select(F.col("key").alias("ds"), F.col("kind").alias("kind"), "rows", "cols", "lon0", "lat0", "dlon", "dlat", F.lit(1 / PER_UNIT[rate]).alias("scale"))
    cells = decode_grids(good.select(F.col("key").alias("ds"), "content"), shape).withColumnRenamed("ds", "key")
    cells = cells.join(good.select("key", "ds", "task", "label", "name", "stem", F.col("cols").alias("_cols")), "key")
    cells = cells.select("ds", "task", "label", F.lit("grid").alias("kind"), "name", F.col("stem").alias("source"), (F.col("row") * F.col("_cols") + F.col("col")).alias("seq"), "lon", "lat", F.col("rate").alias("target_rate"))

    edge = rings(p).select("ds", F.lit(None).cast("string").alias("task"), F.col("name").alias("label"), F.lit("boundary").alias("kind"), F.col("field").alias("name"), F.col("field").alias("source"), "ring", F.posexplode("corners").alias("seq", "q"))
    edge = edge.select("ds", "task", "label", "kind", "name", "source", "ring", F.col("seq").cast("long").alias("seq"), "q.lon", "q.lat")

    n = lambda d: d.groupBy("ds", "task", "kind", "name").agg(F.count(F.lit(1)).alias("n_rows"))
    counted = n(logs).unionByName(n(cells))
    has_log, has_grid = (counted.where(f"kind = '{k}'").select("ds").distinct() for k in ("log", "grid"))
    second = cells.join(has_log, "ds", "left_anti")
    third = edge.join(has_log.unionByName(has_grid).distinct(), "ds", "left_anti")
    points = union_logs(logs, second, third)
    value = [F.col(c) for c in ("value", "applied_rate", "target_rate") if c in points.columns]
    points = points.withColumn("value", F.coalesce(*value))

    key = ["ds", "task", "kind", "name"]
    same = lambda a, b: (a["ds"] == b["ds"]) & a["task"].eqNullSafe(b["task"]) & (a["kind"] == b["kind"]) & (a["name"] == b["name"])
    r = e.select(*key, F.concat("folder", "stem").alias("file")).distinct()
    r = r.join(counted, same(r, counted), "left").select(*[r[k] for k in key], r["file"], F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    failed = grids.select("ds", "task", F.lit("grid").alias("kind"), "name", "_why").where("_why is not null")
    r = r.join(failed, same(r, failed), "left").select(*[r[k] for k in key], r["file"], "n_rows", "_why").join(bad, "file", "left").join(there, "file", "left")
    held = r.join(has_log.withColumn("_logged", F.lit(True)), "ds", "left")
    log_why = F.when(~F.coalesce("_header", F.lit(False)), "no header of that name").when(~F.coalesce("_data", F.lit(False)), "no binary beside the header").when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("n_rows") == 0, "no positions")
    why = F.when(F.col("kind") == "log", log_why).otherwise(F.coalesce("_why", F.when(F.col("_logged"), "not shown: the register has logs")))
    report = held.select(*key, "n_rows", why.alias("reason"))
    broken = p.where("broken").select("ds", *[F.lit(None).cast("string").alias(k) for k in ("task",)], F.lit("register").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("n_rows"), F.lit("not a task register").alias("reason"))
    return points, report.unionByName(broken)
