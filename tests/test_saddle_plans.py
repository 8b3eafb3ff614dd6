"""Components are taken once for each kind of feature; nothing that grows with the fields is broadcast or solved in one task."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from fieldweave.operators import graph, merge_tree, relief
from fieldweave.plans import terrain_queries


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.fixture()
def taken(monkeypatch):
    calls = []
    monkeypatch.setattr(graph, "cell_components", lambda *a, f=graph.cell_components: (calls.append(1), f(*a))[1])
    return calls


@pytest.fixture()
def plans(monkeypatch):
    out = []
    for module in (merge_tree, relief):
        monkeypatch.setattr(module, "cut", lambda df, f=module.cut: (out.append(plan(df)), f(df))[1])
    return out


@pytest.fixture()
def layers(spark):
    z = F.sin(F.col("id") % 20) + F.cos(F.floor(F.col("id") / 20))
    return spark.range(400).select(F.lit(1).cast("long").alias("ds"), F.floor(F.col("id") / 20).alias("row"), (F.col("id") % 20).alias("col"), z.alias("z"), z.alias("tpi_std"), F.lit(1.0).alias("slope_pct"))


def test_saddles_are_not_broadcast(spark, taken, plans, layers, monkeypatch):
    monkeypatch.setattr(terrain_queries, "_standing", lambda *a: layers)
    terrain_queries.lf_saddles(spark, "")
    assert len(taken) == 2
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_features_take_components_once(taken, layers):
    assert merge_tree.features(layers, 9.0, 0.05, 0.03).columns
    assert len(taken) == 2


def test_fields_are_solved_in_many_tasks(spark, plans):
    rows = [(1, p * 9 + k, p, p * 9.0, k * 4.0, 700.0 + p % 3) for p in range(4) for k in range(9)]
    relief.pass_offsets(spark.createDataFrame(rows, "ds long, seq long, pass_id long, x double, y double, elev_m double"), 13.5, rounds=1)
    assert plans[-1].count("REPARTITION_BY_NUM") == 2
