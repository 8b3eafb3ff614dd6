"""Registers with rings, logs and grids: what is read, what stands in for it, and each reason."""

import struct

from fieldweave.sources import task_registers

HEAD = '<TIM A="" D="4"><PTN A="" B=""/><DLV A="0002" B=""/></TIM>'
FIELD = '<PFD A="PFD1" C="North" D="25000" E="CTR1" F="FRM1"><PLN A="1"><LSG A="1"><PNT A="2" C="50.0" D="-105.0"/><PNT A="2" C="50.0" D="-104.9"/><PNT A="2" C="50.1" D="-104.9"/></LSG><LSG A="2"><PNT C="50.0" D="-105.0"/><PNT C="x" D="-105.0"/></LSG></PLN></PFD>'
PEOPLE = '<CTR A="CTR1" B="Ann"/><FRM A="FRM1" B="Home" I="CTR1"/>'
GRID = '<GRD A="50.0" B="-105.0" C="0.1" D="0.2" E="3" F="2" G="{name}" I="2"/>'


def record(ms, lat, lon, raw):
    return struct.pack("<IHii", ms, 16000, int(round(lat * 1e7)), int(round(lon * 1e7))) + bytes([1, 0]) + struct.pack("<i", raw)


def register(*inner):
    return ('<?xml version="1.0" encoding="UTF-8"?><ISO11783_TaskData VersionMajor="4" VersionMinor="3">' + "".join(inner) + "</ISO11783_TaskData>").encode()


def read(spark, files):
    points, report = task_registers.read(spark.createDataFrame(list(files.items()), "path string, content binary"))
    return points, {(r["ds"].split("/")[0], r["task"], r["name"]): (r["n_rows"], r["reason"]) for r in report.collect()}


def test_logs_of_all_tasks_with_their_labels(spark):
    files = {
        "a/TASKDATA.XML": register(PEOPLE, FIELD, '<TSK A="TSK1" B="Seed"><TLG A="TLG00001"/><TLG A="TLG00002"/><TLG A="TLG00003"/>' + GRID.format(name="GRD00001") + "</TSK>", '<TSK A="TSK2" B=""><TLG A="tlg00001"/><TLG A="TLG00004"/></TSK>'),
        "a/TLG00001.XML": HEAD.encode(), "a/tlg00001.bin": record(0, 50.0, -105.0, 1234) + record(1000, 50.1, -105.1, 2000),
        "a/TLG00002.xml": HEAD.encode(),
        "a/TLG00004.XML": b"<TIM", "a/TLG00004.BIN": record(0, 50.0, -105.0, 1),
        "a/GRD00001.bin": struct.pack("<6I", *range(6)),
    }
    points, why = read(spark, files)
    got = sorted((r["task"], r["label"], r["kind"], r["seq"], round(r["lat"], 6), round(r["value"], 6)) for r in points.collect())
    assert got == [("TSK1", "Seed", "log", 0, 50.0, 12.34), ("TSK1", "Seed", "log", 1, 50.1, 20.0), ("TSK2", "TSK2", "log", 0, 50.0, 12.34), ("TSK2", "TSK2", "log", 1, 50.1, 20.0)]
    assert why["a", "TSK1", "TLG00001"] == (2, None) and why["a", "TSK2", "tlg00001"] == (2, None)
    assert why["a", "TSK1", "TLG00002"] == (0, "no binary beside the header") and why["a", "TSK1", "TLG00003"] == (0, "no header of that name")
    assert why["a", "TSK1", "GRD00001"] == (6, "not shown: the register has logs") and why["a", "TSK2", "TLG00004"][1].startswith("header")


def test_grids_then_rings_stand_in_for_logs(spark):
    files = {
        "g/taskdata.xml": register(FIELD, '<TSK A="T" B="Plan"><TLG A="TLG9"/>' + GRID.format(name="GRD00001") + GRID.format(name="GRD00002") + GRID.format(name="GRD00003") + "</TSK>"),
        "g/GRD00001.BIN": struct.pack("<6I", *range(0, 600, 100)), "g/GRD00002": struct.pack("<2I", 1, 2),
        "r/TASKDATA.XML": register(PEOPLE, FIELD), "x/TASKDATA.XML": b"<ISO11783_TaskData><CTR", "x/other.xml": register(FIELD),
    }
    points, why = read(spark, files)
    rows = points.collect()
    cells = sorted((r["seq"], round(r["lon"], 6), round(r["lat"], 6), r["value"]) for r in rows if r["kind"] == "grid")
    assert cells == [(i, round(-105 + (i % 3 + 0.5) * 0.2, 6), round(50 + (i // 3 + 0.5) * 0.1, 6), float(i)) for i in range(6)]
    corners = [(r["ds"], r["label"], r["lon"]) for r in rows if r["kind"] == "boundary"]
    assert sorted(corners) == [("r/TASKDATA.XML", "North", -105.0), ("r/TASKDATA.XML", "North", -104.9), ("r/TASKDATA.XML", "North", -104.9)]
    assert len(rows) == 9
    assert why["g", "T", "GRD00001"] == (6, None) and why["g", "T", "GRD00002"] == (0, "fewer cells than declared") and why["g", "T", "GRD00003"] == (0, "no such file")
    assert why["g", "T", "TLG9"] == (0, "no header of that name") and why["x", None, None] == (0, "not a task register")


def test_registry_tables_and_empty_input(spark):
    files = spark.createDataFrame([("a/TASKDATA.XML", register(PEOPLE, FIELD, '<TSK A="TSK1" B="Seed" C="CTR1" D="FRM1" E="PFD1"/>'))], "path string, content binary")
    p = task_registers.parse(files)
    assert [tuple(r) for r in task_registers.fields(p).collect()] == [("a/TASKDATA.XML", "PFD1", "North", 25000.0, "Ann", "Home")]
    assert [tuple(r)[1:] for r in task_registers.tasks(p).collect()] == [("TSK1", "Seed", "CTR1", "FRM1", "PFD1")]
    assert task_registers.rings(p).count() == 1
    points, report = task_registers.read(files.limit(0))
    assert points.count() == 0 and report.count() == 0
