"""Joins by cell and point sort both sides: what explode adds to a small table must not go through the driver."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from fieldweave.operators import graph, grid, hydro, spatial, track


def _plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.fixture()
def cells(spark):
    return spark.range(400).select(F.lit(1).cast("long").alias("ds"), (F.col("id") / 20).cast("long").alias("row"), (F.col("id") % 20).alias("col"), F.col("id").cast("double").alias("z"))


def test_cells_are_not_broadcast(cells):
    codes = cells.select("ds", "row", "col", F.lit(-1).alias("code"))
    for df in (grid.ghosts(cells), grid.disc_mean(cells, 4.5), grid.standardise(grid.tpi(cells, 2)), grid.smooth(cells, 1.2), grid.residual_relief(cells, 9.0), hydro.channels(codes, cells.withColumn("acc", F.lit(9.0)), 9.0, 0.03)):
        assert "BroadcastHashJoin" not in _plan(df)


def test_components_are_not_broadcast(cells):
    assert "BroadcastHashJoin" not in _plan(graph.cell_components(cells.where("(row + col) % 3 > 0"), 2))


def test_points_are_not_broadcast(cells):
    points = cells.select("ds", F.monotonically_increasing_id().alias("id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    assert "BroadcastHashJoin" not in _plan(spatial.within(points, points, 2.0))
    log = points.select("ds", F.col("id").alias("rn"), F.lit(2.0).alias("dt_s"), F.col("x").alias("value"))
    assert _plan(track.flow_delay(log, 4.0)).count("BroadcastHashJoin") <= 1  # the delay of each log
