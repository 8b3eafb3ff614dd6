"""Layers that a query reads more than once are tables: none is planned and computed again in one large plan."""

import pytest

from fieldweave.operators import relief
from fieldweave.plans import terrain_queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture()
def calls(monkeypatch):
    """Exchanges of each table that is written on the way, and of what is left."""
    import contextlib
    import io

    def exchanges(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        return out.getvalue().count("Exchange hashpartitioning")

    written = []
    for module in (terrain_queries, relief):
        monkeypatch.setattr(module, "cut", lambda df, f=module.cut: (written.append(exchanges(df)), f(df))[1])
    return lambda df: max([*written, exchanges(df)])


@pytest.mark.parametrize("name", ["zon_points", "zon_landform", "lf_classify", "yr_by_slope", "yr_findings"])
def test_no_plan_holds_a_layer_twice(spark, calls, name):
    assert calls(terrain_queries.QUERIES[name](spark, DIR)) <= 13


def test_residuals_are_taken_once(spark, calls):
    from fieldweave.sources.bench_log import bench_log

    assert calls(relief.point_noise(bench_log(spark, DIR))) <= 2
