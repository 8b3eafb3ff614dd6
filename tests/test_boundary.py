"""CLN11 on logs with holes, wide and missing swaths and oblique headings, against a plain loop; and what it sends."""

import contextlib
import io
import math
import random

from fieldweave.operators import clean


def _log(n=140, seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = (i // 14) * 6.0 + r.random(), (i % 14) * 5.0 + r.random()
        if 40 <= i < 44:
            x, y = x + 120, y
        swath = [6.0, 6.0, 6.0, 25.0, 0.0, None][r.choice([0, 0, 0, 1, 2, 3, 4, 5])]
        rows.append((i % 2, i, None if i == 77 else x, y, swath, [0.0, 90.0, 33.0, None][i % 4]))
    return rows + [(9, i, float(i), 0.0, 6.0, 0.0) for i in range(9)]  # too few for a log


def _plain(rows, buffer):
    out = set()
    for ds in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == ds and r[2] is not None and r[4] is not None and r[4] > 0]
        if len(mine) < 10:
            continue
        widths = sorted(r[4] for r in mine)
        n = len(widths)
        med = (widths[(n - 1) // 2] + widths[n // 2]) / 2
        cell = max(0.5, min(2.0, med / 8))
        samples = max(3, math.ceil(med / cell) + 1)
        ox, oy = min(r[2] for r in mine) - med, min(r[3] for r in mine) - med
        covered = set()
        for _, _, x, y, swath, heading in mine:
            h = math.radians(heading or 0.0)
            for k in range(samples):
                off = swath * (k / (samples - 1) - 0.5)
                covered.add((math.floor((y - math.sin(h) * off - oy) / cell), math.floor((x + math.cos(h) * off - ox) / cell)))
        r = math.ceil(buffer / cell)
        for _, rn, x, y, _, _ in mine:
            a, b = math.floor((y - oy) / cell), math.floor((x - ox) / cell)
            if any((a + i, b + j) not in covered for i in range(-r, r + 1) for j in range(-r, r + 1) if math.hypot(i, j) * cell < buffer):
                out.add((ds, rn))
    return out


def test_boundary_agrees_with_a_plain_loop(spark):
    rows = _log()
    df = spark.createDataFrame(rows, "ds long, rn int, x double, y double, swath_m double, heading_deg double").repartition(7)
    for buffer in (0.6, 1.5, 4.0):
        got = clean.boundary(df, {"buffer_m": buffer})
        assert got.schema["rn"].dataType.typeName() == "integer"
        assert {tuple(r) for r in got.collect()} == _plain(rows, buffer)
    assert any(0 < len(_plain(rows, b)) < len(rows) - 20 for b in (1.5, 4.0))


def test_a_disc_is_a_look_up_for_each_row_of_cells(spark):
    """No row for each cell of the disc: the samples and one look-up a row of cells are dealt out once."""
    df = spark.createDataFrame(_log(), "ds long, rn int, x double, y double, swath_m double, heading_deg double").localCheckpoint()
    with contextlib.redirect_stdout(io.StringIO()) as out:
        clean.boundary(df, {"buffer_m": 4.0}).explain()
    plan = out.getvalue()
    assert plan.count("Generate explode") == 1 and "LeftAnti" not in plan
