"""Track, cleaning, layers, response, quality and design on planted data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import columns as C
from fieldweave.functions import crs, units
from fieldweave.operators import clean, design, layers, quality, response, spatial, stats, track


def log(spark, n_passes=12, per=40, ds=1, seed=3):
    r = random.Random(seed)
    rows = []
    for p in range(n_passes):
        for k in range(per):
            y = k * 4.0 if p % 2 == 0 else (per - 1 - k) * 4.0
            rows.append((ds, len(rows), len(rows) * 2.0, p * 9.0, y, 3000 + 200 * math.sin(p / 3) + r.gauss(0, 60), 8 + r.random(), 9.0, 14.0))
    return spark.createDataFrame(rows, "ds long, seq long, elapsed_s double, x double, y double, value double, speed_kmh double, swath_m double, moisture_pct double")


def test_finite_and_guards(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 2.0), (3.0, 3.0), (None, 4.0)], "a double, b double")
    assert [r["a"] for r in C.clean_numbers(df).collect()] == [None, None, 3.0, None]
    assert df.agg(C.pearson(F.lit(1.0), "b").alias("r")).first()["r"] is None
    assert spark.range(1).select(C.rounded(F.lit(-0.00001)).alias("z")).first()["z"] == 0.0
    assert [r[0] for r in spark.createDataFrame([("1,5",), ("x",), (" 2 ",)], "t string").select(C.number("t", True)).collect()] == [1.5, None, 2.0]


def test_passes_agree_and_count(spark):
    t = track.derive(log(spark).drop("pass_id"))
    n = t.groupBy("pass_id").count().count()
    assert n >= 12
    native = track.detect_passes_native(track.steps(track.sort_by_time(log(spark))))
    assert native.join(t.select("ds", "rn", F.col("pass_id").alias("p")), ["ds", "rn"]).where("pass_id <> p").count() == 0


def test_elevation_layer_is_no_track(spark):
    assert "heading_deg" not in track.derive(log(spark), operation="elevation").columns


def test_flow_delay_and_no_clock(spark):
    t = track.seconds(track.sort_by_time(log(spark)))
    a = {r["rn"]: r["value"] for r in t.collect()}
    b = {r["rn"]: r["value"] for r in track.flow_delay(t, 5.0).collect()}  # 5 / 2 rounds half to even: 2
    assert b[1] == a[3] and b[480] is None
    off = {r["rn"]: r["value"] for r in track.flow_delay(t, 0.0).collect()}
    assert off == a


def test_cleaning_finds_planted_defects(spark):
    base = log(spark)
    bad = base.withColumn("value", F.when(F.col("seq") % 97 == 5, 0.0).when(F.col("seq") == 203, 9000.0).when(F.col("seq") == 300, None).otherwise(F.col("value")))
    bad = bad.withColumn("speed_kmh", F.when(F.col("seq") % 101 == 7, 40.0).otherwise(F.col("speed_kmh")))
    again = base.where("seq between 120 and 159").withColumns({"seq": F.col("seq") + 1000, "elapsed_s": F.col("elapsed_s") + 2000, "y": F.col("y") + 0.4, "value": F.col("value") * 0.2})
    cfg = dict(clean.PRESETS["harvest"], flow_delay_s=0.0, pass_ends={"start_m": 0.0, "end_m": 0.0}, position={"max_jump_m": 0})
    out = clean.run(bad.unionByName(again), cfg)
    why = {r["seq"]: r["removal_reason"] for r in out.collect()}
    assert why[5] == "null_value" and why[300] == "null_value" and why[7] == "speed_range"
    assert sum(why[s] == "overlap" for s in why if s >= 1000) >= 20 and sum(why[s] is not None for s in why if s >= 1000) >= 36
    assert why[203] in ("global_outlier", "local_outlier")
    kept = sum(v is None for v in why.values())
    assert kept > 380
    rep = clean.step_report(out).orderBy("step_no").collect()
    assert rep[-1]["remaining"] == kept and sum(r["removed"] for r in rep) == len(why) - kept


def test_presets_cover_operations():
    assert clean.preset_for("harvest") == "harvest" and clean.preset_for("soil") == "minimal" and clean.preset_for(None) == "minimal"


def test_missing_columns_skip_steps(spark):
    df = log(spark).drop("moisture_pct")
    assert clean.run(df, {"moisture": {}, "null_value": {}}).where("removal_reason is not null").count() == 0


def test_knn_with_ties_and_lonely_points(spark):
    pts = [(1, i, float(i % 5), float(i // 5)) for i in range(25)] + [(1, 25, 500.0, 500.0), (1, 26, 0.0, 0.0), (2, 1, 0.0, 0.0), (3, 1, 0.0, 0.0), (3, 2, 1.0, 1.0)]
    df = spark.createDataFrame(pts, "ds long, id long, x double, y double")
    got = {(r["ds"], r["id"]): [] for r in df.collect()}
    for r in spatial.knn(df, 4).collect():
        got[(r["ds"], r["id"])].append((r["rank"], r["other_id"]))
    for ds, i, x, y in pts:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for d, j, a, b in pts if d == ds and j != i)[:4]
        assert [j for _, j in sorted(got[(ds, i)])] == [j for _, j in near]


def test_knn_far_from_a_stray_fix_and_along_a_line(spark):
    """Stray fixes 40 km away, a log along a line, repeated positions, a lone point, points without a position."""
    r0 = random.Random(5)
    pts = [("a", i, float(x), float(y)) for i, (x, y) in enumerate((r0.uniform(0, 300), r0.uniform(0, 300)) for _ in range(400))] + [("a", 400, 40_000.0, 10.0), ("a", 401, 40_001.0, 10.0), ("a", 402, -9_000.0, 3.0)]
    pts += [("line", i, 2.5 * i, 7.0) for i in range(120)] + [("same", i, 1.0, 1.0) for i in range(9)] + [("lone", 0, 3.0, 3.0), ("a", 500, None, 1.0), ("a", 501, 1.0, float("nan"))]
    got = {}
    for r in spatial.knn(spark.createDataFrame(pts, "ds string, id long, x double, y double"), 5).collect():
        got.setdefault((r["ds"], r["id"]), []).append((r["rank"], r["other_id"]))
    want = {}
    for ds, i, x, y in pts:
        if x is not None and y == y and ds != "lone":
            near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for d, j, u, v in pts if d == ds and j != i and u is not None and v == v)
            want[ds, i] = [(n + 1, j) for n, (_, j) in enumerate(near[:5])]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_levels_under_noise(spark):
    r = random.Random(1)
    rows = [(1, lv + r.gauss(0, 2.0)) for lv in (0, 60, 120, 180, 240) for _ in range(400)] + [(2, 90.0)] * 10 + [(3, r.uniform(0, 100)) for _ in range(2000)]
    got = layers.rate_levels(spark.createDataFrame(rows, "ds long, applied_rate double")).collect()
    one = sorted(x["level"] for x in got if x["ds"] == 1)
    assert len(one) == 5 and all(abs(a - b) < 1 for a, b in zip(one, (0, 60, 120, 180, 240)))
    assert [x["level"] for x in got if x["ds"] == 2] == [90.0]
    assert len([x for x in got if x["ds"] == 3]) == 12


def curve(spark, f, noise=0.0, seed=5, rates=(0, 45, 90, 135, 180, 225)):
    r = random.Random(seed)
    rows = [(1, 0, float(x), f(x) + r.gauss(0, noise)) for x in rates for _ in range(20)]
    return spark.createDataFrame(rows, "ds long, zone long, rate double, `yield` double")


def test_quadratic_optimum_of_a_known_curve(spark):
    cells = curve(spark, lambda x: 1400 + 14 * x - 0.0217 * x * x)
    f = response.quadratic(response.by_rate(cells, ["ds"]), ["ds"]).first()
    assert f["a"] == pytest.approx(1400, abs=1e-6) and f["b"] == pytest.approx(14) and f["c"] == pytest.approx(-0.0217) and f["r2"] == pytest.approx(1)
    fits = response.quadratic(response.by_rate(cells, ["ds"]), ["ds"])
    o = response.optimum(fits, ["ds"], 0.2, 1.0, 0.0, 400.0).first()
    assert abs(o["optimum_rate"] - (14 - 5) / (2 * 0.0217)) <= 0.2 and not o["at_range_limit"]


@pytest.mark.parametrize(
    "name,f",
    [
        ("quadratic_plateau", lambda x: 2000 + 20 * min(x, 100) - 0.1 * min(x, 100) ** 2),
        ("linear_plateau", lambda x: 1000 + 8 * min(x, 110)),
        ("mitscherlich", lambda x: 3000 * (1 - math.exp(-0.015 * (x + 30)))),
    ],
)
def test_plateau_models_recover_their_curve(spark, name, f):
    cells = curve(spark, f)
    fit = response.REGISTRY[name](response.by_rate(cells, ["ds"]), ["ds"]).first()
    assert fit["r2"] > 0.9995
    assert response.fit_best(cells, ["ds"]).first()["r2"] >= fit["r2"] - 1e-9


def test_few_rates(spark):
    two = curve(spark, lambda x: 100 + x, rates=(0, 50))
    assert response.fit_best(two, ["ds"]).count() == 0
    three = curve(spark, lambda x: 100 + x - 0.01 * x * x, rates=(0, 50, 100))
    assert response.fit_best(three, ["ds"]).first()["model"] == "quadratic"


def test_zones_gain(spark):
    a = curve(spark, lambda x: 1400 + 14 * x - 0.04 * x * x)
    b = curve(spark, lambda x: 2000 + 6 * x - 0.04 * x * x).withColumn("zone", F.lit(1).cast("long"))
    z = response.uniform_or_variable(a.unionByName(b), 0.25, 1.0, 225.0, models=("quadratic",)).first()
    assert z["gain"] > 5


def test_stats_edge_cases(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 1.0), (2, 1.0), (3, None)], "ds long, value double")
    d = {r["ds"]: r for r in stats.describe(df, "value", "ds").collect()}
    assert d[1]["sd"] == 0 and d[1]["skew"] == 0 and d[2]["skew"] == 0 and 3 not in d
    h = stats.histogram(df.where("ds < 3"), bins=4)
    assert {r["ds"]: r["n"] for r in h.groupBy("ds").agg(F.sum("n").alias("n")).collect()} == {1: 1, 2: 3}
    ring = spark.sql("select array(struct(0d as x, 0d as y), struct(4d as x, 0d as y), struct(4d as x, 3d as y)) as r")
    assert ring.select(stats.ring_area(F.col("r"))).first()[0] == 6.0


def test_utm_of_published_points(spark):
    # the CN Tower: zone 17N, 630084 m east, 4833438 m north
    p = spark.createDataFrame([(1, -79.387139, 43.642567), (2, 151.2153, -33.8568)], "ds long, lon double, lat double")
    r = {x["ds"]: x for x in crs.project(p).collect()}
    assert r[1]["epsg"] == 32617 and abs(r[1]["x"] - 630084) < 2 and abs(r[1]["y"] - 4833438) < 2
    assert r[2]["epsg"] == 32756
    back = {x["ds"]: x for x in crs.to_lonlat(crs.project(p).drop("lon", "lat")).collect()}
    assert abs(back[2]["lon"] - 151.2153) < 1e-9 and abs(back[2]["lat"] + 33.8568) < 1e-9


def test_units(spark):
    assert units.factor("rate_mass", "bu/ac", "Canola") == pytest.approx(22.6796 / 0.40468564224)
    assert units.factor("speed", "furlong") is None
    assert units.table(spark).where("unit = 'bu/ac'").count() == 14


def test_unit_doubt_finds_bushels(spark):
    df = log(spark).withColumn("value", F.col("value") / (22.6796 / 0.40468564224))
    assert quality.unit_candidates(df, "canola", default_unit="bu/ac").where("rank = 1").first()["unit"] == "bu/ac"


def test_direction_of_a_turned_field(spark):
    a = math.radians(30)
    pts = [(1, x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)) for x, y in ((0, 0), (400, 0), (400, 100), (0, 100))]
    d = design.direction(spark.createDataFrame(pts, "ds long, x double, y double")).first()
    assert abs(d["angle"] - 30) < 1e-3 and abs(d["long_m"] - 400) < 1e-3


def test_blocks_hold_every_rate_once(spark):
    cells = spark.range(400).select(F.lit(1).cast("long").alias("ds"), (F.col("id") % 20 * 10.0).alias("x"), (F.floor(F.col("id") / 20) * 10.0).alias("y"))
    a = design.assign_strips(cells, [0.0, 60.0, 120.0], 20.0, blocks=3)
    by = {(r["block"], r["rate"]) for r in a.select("block", "rate").distinct().collect()}
    assert by == {(b, r) for b in range(3) for r in (0.0, 60.0, 120.0)}


def test_optimum_sorts_no_curve(spark):
    """The rates of a fit stay in its row: no sort, no exchange, one crossing of several."""
    from fieldweave.operators import response

    fits = spark.createDataFrame([(1, "quadratic", 10.0, 2.0, -0.01, 100.0, 0.9, 1.0, 50), (2, "linear_plateau", 5.0, 1.0, 60.0, 60.0, 0.8, 1.0, 50)], "ds long, model string, a double, b double, c double, plateau double, r2 double, rmse double, n long")
    o = response.optimum(fits, ["ds"], 1.0, 0.5, 0.0, 200.0)
    plan = o._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    assert {r["ds"]: round(r["optimum_rate"], 6) for r in o.collect()} == {1: 75.0, 2: 60.0}
