"""Readers and writers on generated files; streaming on finished ones."""

import json
import struct

from pyspark.sql import functions as F

from fieldweave.sources import files, makers, schema, sinks
from fieldweave.streaming import live


def test_column_names(spark):
    m = schema.map_columns(spark, ["Longitude", "Latitude", "VRYIELDVOL", "Speed(mph)", "Geschwindigkeit (km/h)", "Élévation", "Obj__Id"])
    assert m == {"Longitude": "lon", "Latitude": "lat", "VRYIELDVOL": "value", "Speed(mph)": "speed_kmh", "Élévation": "elev_m"}


def test_csv_with_units_and_decimal_comma(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("Longitude;Latitude;Zeitstempel;Saatmenge (kg/ha);Arbeitsbreite (m)\n;;;kg/ha;m\n-105,5;50,25;2025-09-08T13:30:00;90,5;9,0\n-105,6;50,26;bad;x;9,0\n")
    d = files.read_tabular(spark, str(tmp_path / "a")).orderBy("seq").collect()
    assert len(d) == 2 and d[0]["lon"] == -105.5 and d[0]["value"] == 90.5 and d[1]["value"] is None and d[1]["timestamp"] is None and str(d[0]["timestamp"]) == "2025-09-08 13:30:00"
    u = {r["column"]: r["unit"] for r in files.source_units(spark, str(tmp_path / "a")).collect()}
    assert u == {"value": "kg/ha", "swath_m": "m"}


def test_geojson_and_session(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"ndvi": 0.7, "speed": 9, "timestamp": "2025-01-01T00:00:00"}}, {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}, "properties": {"applied_rate": "12"}}]}
    (tmp_path / "g.json").write_text(json.dumps(fc))
    (tmp_path / "s.json").write_text(json.dumps({"session": {"data": fc}}))
    g = files.read_geojson(spark, str(tmp_path / "g.json")).orderBy("feature_id").collect()
    assert (g[0]["lon"], g[0]["lat"]) == (1.5, 2.5) and (g[1]["lon"], g[1]["lat"]) == (1.0, 1.0) and len(g[1]["ring"]) == 4
    s = files.read_session(spark, str(tmp_path / "s.json")).orderBy("seq").collect()
    assert s[0]["value"] == 0.7 and s[0]["vigor_index"] == 0.7 and s[1]["value"] == 12.0


def test_kml_and_tasks(spark, tmp_path):
    (tmp_path / "b.kml").write_text("<kml><Document><Placemark><name>North</name><Polygon><outerBoundaryIs><LinearRing><coordinates>1,2,0 3,2,0 3,4,0 1,2,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>")
    k = files.read_kml(spark, str(tmp_path / "b.kml")).collect()
    assert k[0]["name"] == "North" and k[0]["ring"][1]["lon"] == 3.0
    (tmp_path / "t.xml").write_text('<ISO11783_TaskData><CTR A="CTR1" B="Ann"/><FRM A="FRM1" B="Home" I="CTR1"/><PFD A="PFD1" C="North" D="1000" E="CTR1" F="FRM1"/><TSK A="TSK1" B="Seed" E="PFD1"/></ISO11783_TaskData>')
    t = files.read_tasks(spark, str(tmp_path / "t.xml"))
    assert t["fields"].first()["name"] == "North" and t["tasks"].first()["field"] == "PFD1"


def test_binary_logs(spark, tmp_path):
    (tmp_path / "TLG1.xml").write_text('<TIM A="" D="4"><PTN A="" B="" C="" D="" G=""/><DLV A="0007" B=""/><DLV A="0043" B=""/><DLV A="0048" B=""/></TIM>')
    rec = lambda i: struct.pack("<IHiiiBB", i * 2000, 16000, 504520000 + i, -1058340000, 585000, 1, 9) + bytes([3]) + b"".join(struct.pack("<Bi", k, v) for k, v in ((0, 9000 + i), (1, 2500), (2, 1)))
    (tmp_path / "TLG1.bin").write_bytes(b"".join(rec(i) for i in range(5)) + struct.pack("<IHiiiBB", 0, 1, 2, 3, 4, 1, 9) + bytes([200]))
    (tmp_path / "TLG2.xml").write_text("<broken")
    (tmp_path / "TLG2.bin").write_bytes(b"123")
    long = files.read_binary_logs(spark, str(tmp_path))
    assert {r["error"] for r in long.where("error is not null").collect()} >= {"record cut short"} and long.where("error like 'header%'").count() == 1
    d = files.scale_values(long).orderBy("seq").collect()
    assert len(d) == 5 and abs(d[1]["applied_rate"] - 90.01) < 1e-9 and abs(d[0]["speed_kmh"] - 9.0) < 1e-9 and abs(d[2]["lat"] - 50.4520002) < 1e-9 and d[0]["ddi_extra"] == {"ddi_0048": 1.0} and d[0]["elev_m"] == 585.0
    assert str(d[1]["timestamp"]) == "2023-10-22 00:00:02"


def test_grid_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 0, 10.0), (1, 0, 1, 20.5), (1, 1, 1, -3.0)], "ds long, row long, col long, rate double")
    rows = sinks.integer_grid(cells, 100.0).orderBy("row").collect()
    assert [r["values"] for r in rows] == [[1000, 2050], [0, 0]]
    (tmp_path / "g.bin").write_bytes(struct.pack("<4I", *[v for r in rows for v in r["values"]]))
    path = spark.read.format("binaryFile").load(str(tmp_path / "g.bin")).first()["path"]
    shape = spark.createDataFrame([(path, 2, 2, 2, 5.0, 6.0, 1.0, 1.0, 0.01)], "ds string, kind int, rows int, cols int, lon0 double, lat0 double, dlon double, dlat double, scale double")
    back = {(r["row"], r["col"]): r for r in files.read_grids(spark, str(tmp_path), shape).collect()}
    assert back[(0, 1)]["rate"] == 20.5 and back[(1, 1)]["rate"] == 0.0 and back[(1, 0)]["lon"] == 5.5 and back[(1, 0)]["lat"] == 7.5


def test_nodata_and_quarantine(spark, tmp_path):
    c = spark.createDataFrame([(1, i, 0, 700.0 + i % 9) for i in range(100)] + [(1, i, 1, -1234.5) for i in range(5)], "ds long, row long, col long, z double")
    assert files.undeclared_nodata(c).first()["nodata"] == -1234.5
    (tmp_path / "a.csv").write_text("x")
    (tmp_path / "c.doc").write_text("x")
    assert {r["reason"] for r in files.quarantine(spark, str(tmp_path)).collect()} == {"no reader for .doc"}


def test_maker_value_and_operation(spark):
    cols = spark.createDataFrame([("sms/a.csv", "Obj__Id"), ("sms/a.csv", "Track_deg_"), ("b.csv", "Tank 1 Rate"), ("c.csv", "foo")], "ds string, column string")
    m = {r["ds"]: r for r in makers.detect_maker(cols).collect()}
    assert m["sms/a.csv"]["maker"] == "ag_leader" and m["sms/a.csv"]["confidence"] == 1.0 and m["b.csv"]["maker"] == "bourgault" and tuple(m["c.csv"]) == ("c.csv", "generic", 0.0)
    more = spark.createDataFrame([("x/1", "Yld_Vol_Dr"), ("Väderstad/2", "Row"), ("a/b.JDF", "Client"), ("d/taskdata.xml", "foo")], "ds string, column string")
    m = {r["ds"]: (r["maker"], round(r["confidence"], 3)) for r in makers.detect_maker(more).collect()}
    # a tie goes to the first maker; a mark listed twice counts twice; an extension and a hint; four marks of one path
    assert m == {"x/1": ("john_deere", 0.3), "Väderstad/2": ("vaderstad", 1.0), "a/b.JDF": ("john_deere", 0.5), "d/taskdata.xml": ("isoxml", 1.0)}
    p = spark.createDataFrame([("h1", 1.0, 5.0, None), ("h1", 2.0, 5.0, None), ("r2", None, 1.0, 7.0)], "ds string, a double, b double, value double")
    assert {r["ds"]: r["column"] for r in files.pick_value(p).collect()} == {"h1": "a", "r2": "value"}
    o = spark.createDataFrame([("x/seed.csv", 1.0, None), ("y.csv", 1.0, 1.0)], "ds string, value double, target_rate double")
    assert {r["ds"]: r["operation"] for r in files.guess_operation(o).collect()} == {"x/seed.csv": "planting", "y.csv": "prescription"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(5.0, 1.25, 2.5)], "rate double, lon double, lat double")
    assert sinks.with_position_first(df).columns == ["lon", "lat", "rate"]
    f = json.loads(sinks.as_features(df, "rate").first()["value"])
    assert f["geometry"]["coordinates"] == [1.25, 2.5] and f["properties"] == {"rate": 5.0}
    assert sinks.prescription_rows(df.withColumn("area_ha", F.lit(1.0))).first()["lon"] == "1.25000000"
    sinks.write_cleaned(df.withColumns({"ds": F.lit(1), "removal_reason": F.lit(None).cast("string")}), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).first()["kept"] == "true"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, i, i * 5.0, 100.0 if i % 4 else 0.0, 9.0 if i % 5 else 50.0) for i in range(400)]
    df = spark.createDataFrame(rows, "ds long, seq long, s double, value double, speed_kmh double")
    df = df.withColumn("timestamp", F.expr("timestamp_ntz'2025-01-01 00:00:00' + make_interval(0,0,0,0,0,0,cast(s as decimal(18,6)))")).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    stream = live.flag_rows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("flags").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["seq"]: r["removal_reason"] for r in spark.sql("select * from flags").collect()}
    assert got == {r["seq"]: r["removal_reason"] for r in live.flag_rows(df).collect()} and got[4] == "null_value" and got[5] == "speed_range"
    agg = live.rolling_rates(live.flag_rows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))))
    q = agg.writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from rates").first()[0] == sum(v is None for v in got.values())


def test_a_folder_of_unlike_files(spark, tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "a.csv").write_text("Longitude,Latitude,Yield,Speed\n1.5,2.5,50,7\n1.6,2.6,51,8\n")
    (d / "b.csv").write_text("Speed,Yield,Latitude,Longitude\n9,60,3.5,4.5\n")
    (d / "sub" / "c.txt").write_text("Longitude;Latitude;Umidade\n5,5;6,5;12,5\n")
    (d / "d.csv").write_bytes("Longitude,Latitude,Élévation\n7.5,8.5,99\n".encode("windows-1252"))
    (d / "e.doc").write_text("no")
    (d / "f.csv").write_text("this,that\n1,2\n")
    (d / "g.csv").write_text('Longitude,Latitude,Yield\n1.5,2.5\n1.6,2.6,51,9\n"1.7",2.7,52\n1.8,2.8,53,\n')
    (d / "TLG1.xml").write_text("<broken")
    (d / "TLG1.bin").write_bytes(b"123")
    p, report = files.ingest(spark, str(d))
    got = {(r["ds"].rsplit("/", 1)[-1], r["lon"], r["lat"], r["value"], r["speed_kmh"], r["moisture_pct"], r["elev_m"]) for r in p.where("lon is not null").collect()}
    assert got == {("a.csv", 1.5, 2.5, 50.0, 7.0, None, None), ("a.csv", 1.6, 2.6, 51.0, 8.0, None, None), ("b.csv", 4.5, 3.5, 60.0, 9.0, None, None), ("c.txt", 5.5, 6.5, None, None, 12.5, None), ("d.csv", 7.5, 8.5, None, None, None, 99.0),
                   ("g.csv", 1.5, 2.5, None, None, None, None), ("g.csv", 1.7, 2.7, 52.0, None, None, None), ("g.csv", 1.8, 2.8, 53.0, None, None, None)}
    lost = {r["file"].rsplit("/", 1)[-1]: r["n_rejected"] for r in report.collect()}
    assert lost["g.csv"] == 1 and sum(lost.values()) == 1
    bad = files.rejected_lines(spark, str(d / "g.csv")).collect()
    assert [(r["line"], r["reason"]) for r in bad] == [("1.6,2.6,51,9", "more fields than the 3 of the header")]
    said = {r["file"].rsplit("/", 1)[-1]: (r["n_rows"], r["reason"]) for r in report.collect()}
    assert said["a.csv"] == (2, None) and said["e.doc"] == (0, "no reader for .doc") and said["f.csv"] == (0, "no positions") and said["d.csv"] == (1, None)
    assert said["TLG1.bin"][1].startswith("header") and said["TLG1.xml"] == (0, None)


def test_names_of_a_rate_are_no_yield(spark):
    names = ["prescribed_rate", "commanded_rate", "rate_target", "mass_flow", "gps_longitude", "Umidade", "yld_vol_dry_2023", "speed mph", "nothing"]
    got = {n: schema.map_columns(spark, [n]).get(n) for n in names}
    assert got == {"prescribed_rate": "target_rate", "commanded_rate": "target_rate", "rate_target": "target_rate", "mass_flow": "value", "gps_longitude": "lon", "Umidade": "moisture_pct", "yld_vol_dry_2023": "value", "speed mph": "speed_kmh", "nothing": None}


def test_tasks_fall_back_to_grids_and_boundaries(spark):
    log = spark.createDataFrame([("l1", "T1", 1.0, 2.0, None), ("l2", "T2", None, None, "record cut short")], "ds string, task string, lon double, lat double, error string")
    at = lambda *rows: spark.createDataFrame(list(rows), "ds string, task string, lon double, lat double")
    got = files.union_tasks(log, spark.createDataFrame([("T1", "Seed"), ("T2", "Spray"), ("T3", None)], "task string, label string"), at(("g1", "T1", 0.0, 0.0), ("g2", "T2", 3.0, 3.0)), at(("b2", "T2", 9.0, 9.0), ("b3", "T3", 4.0, 4.0)))
    assert {(r["ds"], r["kind"], r["label"]) for r in got.collect()} == {("l1", "log", "Seed"), ("g2", "grid", "Spray"), ("b3", "boundary", None)}
