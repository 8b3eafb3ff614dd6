"""Terrain features and surveys: hills and lows, pass offsets, noise, profiles, findings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.lineage import cut, keyed
from fieldweave.operators import graph, grid, passes, spatial
from fieldweave.operators.grid import width


def _whole(df: DataFrame, size: float | DataFrame, ds: str) -> tuple[DataFrame, float | Column]:
    """As ``width``, for aggregates by field."""
    df, size = width(df, size, ds)
    return df, F.first(size) if isinstance(size, Column) else size


def features(layers: DataFrame, size: float | DataFrame, high: bool = True, min_ha: float = 0.05, ds: str = "ds", parts: DataFrame | None = None) -> DataFrame:
    """LF5: hills (or lows) as components of the standardised TPI beyond +-1.

    layers: (ds, row, col, z, tpi_std, slope_pct[, depth]); parts: their components, where the caller has them.  Per feature: extreme cell and its
    height, hectares, centroid, elongation, mean slope, height above (below) its foot (LF6) and
    whether it holds a pond; ranked by height times area.
    """
    sign = 1.0 if high else -1.0
    part, wide = width(graph.cell_components(layers.where(sign * F.col("tpi_std") > 1), 1, ds) if parts is None else parts, size, ds)
    part = part.where(F.col("cells") * wide * wide >= min_ha * 1e4).drop("_cell")
    c = cut(part.join(keyed(layers), [ds, "row", "col"]))
    foot = graph.grow_rings(c, layers, high, ds)
    pond = F.max("depth") > 0.05 if "depth" in layers.columns else F.lit(False)
    cov = lambda a, b: F.covar_samp(a, b)
    a = c.groupBy(ds, "label").agg(
        F.count(F.lit(1)).alias("cells"), F.min(F.struct((-sign * F.col("z")).alias("k"), "row", "col", "z")).alias("e"), F.avg("row").alias("mr"), F.avg("col").alias("mc"),
        cov("row", "row").alias("rr"), cov("col", "col").alias("cc"), cov("row", "col").alias("rc"), F.avg("slope_pct").alias("mean_slope_pct"), F.min(sign * F.col("z")).alias("low"), pond.alias("closed"),
    )
    half, root = (F.col("rr") + F.col("cc")) / 2, F.sqrt(F.pow((F.col("rr") - F.col("cc")) / 2, 2) + F.pow("rc", F.lit(2)))
    elong = F.when(F.col("cells") > 2, F.sqrt(F.greatest(half + root, F.lit(1e-12)) / F.greatest(half - root, F.lit(1e-12)))).otherwise(1.0)
    f, size = width(a.join(keyed(foot.withColumnRenamed("level", "foot")), [ds, "label"], "left"), size, ds)
    f = f.select(
        ds, "label", F.col("e.row").alias("row"), F.col("e.col").alias("col"), F.col("e.z").alias("extreme_m"), (sign * (F.col("e.z") - F.coalesce("foot", sign * F.col("low")))).alias("height_m"), (F.col("cells") * size * size / 1e4).alias("area_ha"),
        ((F.col("mc") + 0.5) * size).alias("x"), (-(F.col("mr") + 0.5) * size).alias("y"), elong.alias("elongation"), "mean_slope_pct", "closed",
    )
    return f.withColumn("rank", F.row_number().over(Window.partitionBy(ds).orderBy(F.desc(F.col("height_m") * F.col("area_ha")), "label")))


def saddle_level(summits: DataFrame, cells: DataFrame, stop: DataFrame, tile: int = 64, ds: str = "ds") -> DataFrame:
    """LF7: (ds, label, level): the highest level at which a summit is still joined to a cell of stop.

    A flood of the inverted surface from the stop cells gives it for all summits at once.
    """
    src = cells.select(ds, "row", "col", (-F.col("z")).alias("z")).join(keyed(stop.select(ds, "row", "col", F.lit(True).alias("source"))), [ds, "row", "col"], "left").withColumn("source", F.coalesce("source", F.lit(False)))
    m = graph.minimax(src, tile, eps=0.0, ds=ds)
    return summits.select(ds, "label", "row", "col").join(keyed(m), [ds, "row", "col"]).select(ds, "label", (-F.col("level")).alias("level"))


#: A limit of passes beyond which a session leaves fields as they are (none by default: all are estimated).
MAX_PASSES: int | None = None
#: Passes up to which a field's system is one dense matrix, bounds of the ridge, and rounds of its estimate.
DENSE_PASSES, RIDGE, RIDGE_ROUNDS = 2000, (1e-4, 10.0), 30


def _ridge(gram: np.ndarray, at_b: np.ndarray, b: np.ndarray) -> float:
    """Noise over spread of the offsets, both learnt from the equations by EM in the eigenbasis of the system."""
    if len(b) < 2:
        return 1.0
    s2, axes = np.linalg.eigh(gram)
    s2, c = np.maximum(s2, 0.0), axes.T @ at_b
    spread = max(float(np.var(b)), 1e-8)
    noise = 0.1 * spread
    for _ in range(RIDGE_ROUNDS):
        wide = s2 + noise / spread
        mean = c / wide
        left = float(b @ b - 2 * mean @ c + mean @ (s2 * mean))
        spread, noise = (float(mean @ mean) + noise * float((1 / wide).sum())) / len(s2), (left + noise * float((s2 / wide).sum())) / len(b)
        spread, noise = max(spread, 1e-12), max(noise, 1e-12)
    return float(np.clip(noise / spread, *RIDGE))


def _ridge_by_blocks(solve: Callable[[float], tuple[np.ndarray, np.ndarray, float]], b: np.ndarray) -> float:
    """As ``_ridge``, for a system of blocks (``passes.system``)."""
    if len(b) < 2:
        return 1.0
    spread = max(float(np.var(b)), 1e-8)
    noise = 0.1 * spread
    for _ in range(RIDGE_ROUNDS):
        mean, left, trace = solve(noise / spread)
        spread, noise = (float(mean @ mean) + noise * trace) / len(mean), (float(left @ left) + noise * (len(mean) - noise / spread * trace)) / len(b)
        spread, noise = max(spread, 1e-12), max(noise, 1e-12)
    return float(np.clip(noise / spread, *RIDGE))


def pass_offsets(points: DataFrame, radius: float, rounds: int = 3, ds: str = "ds") -> DataFrame:
    """TER5: (ds, pass_id, offset): what each pass lies above its neighbours.

    Spark joins the points of different passes within radius, keeps those whose neighbours lie about
    them evenly, and sums the shares of pass in pass: the equations say that a pass's median stands above
    its neighbours by its offset less theirs.  Each round takes the medians anew, of heights less the
    offsets so far.  A field's system is one dense matrix up to ``DENSE_PASSES`` passes, and beyond them solved
    block by block from its shares (``passes``), so the group that solves it holds a row for each pair of passes
    beside each other and no square of passes.  Passes without evidence keep what they have.
    """
    p = points.where("elev_m is not null").select(ds, F.col("seq").alias("id"), "x", "y", "pass_id", F.col("elev_m").alias("z"))
    n = p.groupBy(ds, "pass_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    few = n.groupBy(ds).agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    few = (few if MAX_PASSES is None else few.where(F.col("k") <= MAX_PASSES)).select(ds)
    p = cut(p.join(few, ds, "left_semi"))
    near = spatial.within(p, p.drop("id"), radius, ds).where("pass_id <> other_pass_id")
    # one row for each point and pass beside it
    side = near.groupBy(ds, "id", "pass_id", "other_pass_id").agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum("other_x").alias("sx"), F.sum("other_y").alias("sy"), F.sum("other_z").alias("sz"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z"))
    w = Window.partitionBy(ds, "id")
    side = side.withColumns({"k": F.sum("m").over(w), "cx": F.sum("sx").over(w), "cy": F.sum("sy").over(w), "d": F.col("z") - F.sum("sz").over(w) / F.sum("m").over(w)})
    even = cut(side.where(F.hypot(F.col("cx") / F.col("k") - F.col("x"), F.col("cy") / F.col("k") - F.col("y")) < 0.3 * radius).select(ds, "id", "pass_id", "other_pass_id", (F.col("m") / F.col("k")).alias("w"), "d"))
    used = even.groupBy(ds, "pass_id").agg(F.count_distinct("id").cast("double").alias("u"))
    share = even.groupBy(ds, "pass_id", "other_pass_id").agg(F.sum("w").alias("w")).join(keyed(used), [ds, "pass_id"]).select(ds, "pass_id", "other_pass_id", (F.col("w") / F.col("u")).alias("w"))
    kind, of_pass = dict(points.dtypes)[ds], dict(points.dtypes)["pass_id"]
    system, dense = cut(share), DENSE_PASSES

    def solve(shares: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        if not len(shares):
            return pd.DataFrame({ds: now[ds], "pass_id": now["pass_id"], "offset": now["offset"], "lam": now["lam"]})
        now = now.sort_values("pass_id")
        at = {v: i for i, v in enumerate(now["pass_id"])}
        b, use = now["b"].to_numpy(float), now["b"].notna().to_numpy()
        i, j = ([at[v] for v in shares[c]] for c in ("pass_id", "other_pass_id"))
        w, b, lam = shares["w"].to_numpy(), b[use], now["lam"].iloc[0]
        if len(at) > dense:
            of = passes.system(len(at), np.flatnonzero(use), np.array(i), np.array(j), w, b)
            lam = _ridge_by_blocks(of, b) if lam != lam else lam
            step = of(lam)[0]
        else:
            a = np.eye(len(at))
            a[i, j] -= w
            a = a[use]
            gram, at_b = a.T @ a, a.T @ b
            lam = _ridge(gram, at_b, b) if lam != lam else lam
            step = np.linalg.solve(gram + lam * np.eye(len(at)), at_b)
        step -= np.average(step, weights=now["n"])
        return pd.DataFrame({ds: now[ds], "pass_id": now["pass_id"], "offset": now["offset"] + step, "lam": lam})

    # fields are small and dear to solve: partitions joined by their bytes would solve all of them in one task
    dealt = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ds)
    state = n.join(few, ds, "left_semi").select(ds, "pass_id", F.lit(0.0).alias("offset"), F.lit(float("nan")).alias("lam"))
    for _ in range(rounds):
        of = lambda c, o: state.select(ds, F.col("pass_id").alias(c), F.col("offset").alias(o))
        q = even.join(keyed(of("other_pass_id", "beside")), [ds, "other_pass_id"]).groupBy(ds, "id", "pass_id").agg((F.first("d") + F.sum(F.col("w") * F.col("beside"))).alias("q")).join(keyed(of("pass_id", "own")), [ds, "pass_id"])
        med = q.groupBy(ds, "pass_id").agg(F.percentile(F.col("q") - F.col("own"), F.lit(0.5)).alias("b"))
        now = n.join(keyed(state), [ds, "pass_id"]).join(keyed(med), [ds, "pass_id"], "left")
        state = cut(dealt(system).groupBy(ds).cogroup(dealt(now).groupBy(ds)).applyInPandas(solve, f"{ds} {kind}, pass_id {of_pass}, offset double, lam double"))
    return state.select(ds, "pass_id", "offset")


def detrend_passes(points: DataFrame, radius: float, ds: str = "ds") -> DataFrame:
    """TER5: elev_m less its pass's offset."""
    return points.join(keyed(pass_offsets(points, radius, ds=ds)), [ds, "pass_id"], "left").withColumn("elev_m", F.col("elev_m") - F.coalesce("offset", F.lit(0.0))).drop("offset")


def point_noise(points: DataFrame, k: int = 12, ds: str = "ds") -> DataFrame:
    """TER7: (ds, noise): 1.4826 MAD / 1.05 of each point's residual from a plane through its neighbours."""
    p = cut(points.where("elev_m is not null").select(ds, F.col("seq").alias("id"), "x", "y", F.col("elev_m").alias("z")))
    n = spatial.knn(p, k, ds).withColumns({"u": F.col("other_x") - F.col("x"), "v": F.col("other_y") - F.col("y"), "w": F.col("other_z") - F.col("z")})
    c = F.col
    s = n.groupBy(ds, "id").agg(
        F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.avg("w").alias("mw"), F.var_pop("u").alias("uu"), F.var_pop("v").alias("vv"), F.covar_pop("u", "v").alias("uv"), F.covar_pop("u", "w").alias("uw"), F.covar_pop("v", "w").alias("vw")
    )
    ridge = 1e-6 + 1e-3 * (c("uu") + c("vv"))
    det = (c("uu") + ridge) * (c("vv") + ridge) - c("uv") * c("uv")
    b, g = (c("uw") * (c("vv") + ridge) - c("vw") * c("uv")) / det, (c("vw") * (c("uu") + ridge) - c("uw") * c("uv")) / det
    s = cut(s.select(ds, (c("mw") - b * c("mu") - g * c("mv")).alias("r")))
    m = s.groupBy(ds).agg(F.percentile("r", F.lit(0.5)).alias("m"))
    return s.join(m, ds).groupBy(ds).agg((F.percentile(F.abs(c("r") - c("m")), F.lit(0.5)) * 1.4826 / 1.05).alias("noise"))


def altitude_spikes(points: DataFrame, step: float = 0.0, k: int = 12, ds: str = "ds") -> DataFrame:
    """TER4: (ds, id) of points further from the median of their neighbours than max(0.5, 3.5 robust sd, 3 steps)."""
    p = cut(points.where("elev_m is not null").select(ds, F.col("seq").alias("id"), "x", "y", F.col("elev_m").alias("z")))
    r = spatial.knn(p, k, ds).groupBy(ds, "id").agg((F.first("z") - F.percentile("other_z", F.lit(0.5))).alias("r"))
    m = r.groupBy(ds).agg(F.percentile("r", F.lit(0.5)).alias("m"))
    d = r.join(m, ds)
    mad = d.groupBy(ds).agg(F.percentile(F.abs(F.col("r") - F.col("m")), F.lit(0.5)).alias("mad"))
    return d.join(mad, ds).where(F.abs("r") > F.greatest(F.lit(0.5), 3.5 * 1.4826 * F.col("mad"), F.lit(3.0 * step))).select(ds, "id")


def smoothing_sigma(noise: DataFrame, size: float | DataFrame, step: float = 0.0, ds: str = "ds") -> DataFrame:
    """TER9: (ds, sigma in cells) that brings the noise down to the slope it would fake."""
    noise, size = width(noise, size, ds)
    target = F.greatest(F.lit(0.03), size * F.lit(0.004 * 2 / 2**0.5))
    s = 0.7 * F.col("noise") / (2 * np.pi**0.5 * target)
    return noise.select(ds, F.when(F.lit(step > 0), F.greatest(s, F.lit(10 * step))).otherwise(s).alias("sigma"))


def survey(points: DataFrame, ds: str = "ds") -> DataFrame:
    """TER13: width of the surveyed strip (from the smaller axis of the points) and median spacing."""
    a = points.groupBy(ds).agg(F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy"))
    low = (F.col("xx") + F.col("yy")) / 2 - F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, 2) + F.pow("xy", F.lit(2)))
    near = spatial.knn(cut(points.select(ds, F.col("seq").alias("id"), "x", "y")), 1, ds).groupBy(ds).agg(F.percentile(F.sqrt("d2"), F.lit(0.5)).alias("spacing_m"))
    return a.select(ds, F.sqrt(12 * F.greatest(low, F.lit(0.0))).alias("strip_m")).join(near, ds)


def options(cells: DataFrame, size: float | DataFrame, noise: float = 0.0, step: float = 0.0, ds: str = "ds") -> DataFrame:
    """DER12: TPI radii in cells from the extent, least feature height, slope that noise alone makes (%)."""
    a = cells.groupBy(ds).agg(F.least((F.max("row") - F.min("row") + 1), (F.max("col") - F.min("col") + 1)).alias("side"))
    a, size = width(a, size, ds)
    small = F.greatest(F.lit(1.5), F.least(F.lit(30.0) / size, F.col("side") / 10))
    return a.select(ds, small.alias("tpi_small"), F.greatest(small * 2, F.col("side") / 4.0).alias("tpi_large"), F.lit(max(0.5, 2 * noise, step)).alias("min_height_m"), (F.lit(100 * noise * 0.75**0.5) / (2 * size)).alias("noise_slope_pct"))


def refused(cells: DataFrame, size: float | DataFrame, radius_m: float, ds: str = "ds") -> DataFrame:
    """DER13: (ds, reason): fields too small, or scales wider than their diagonal."""
    a = cells.groupBy(ds).agg((F.max("row") - F.min("row") + 1).alias("h"), (F.max("col") - F.min("col") + 1).alias("w"), F.count(F.lit(1)).alias("n"))
    a, size = width(a, size, ds)
    why = F.when((F.col("h") < 3) | (F.col("w") < 3), "fewer than 3 rows or columns").when(F.col("n") < 9, "fewer than 9 cells").when(F.lit(radius_m <= 0) | (F.lit(radius_m) > F.hypot("h", "w") * size), "scale out of range")
    return a.select(ds, why.alias("reason")).where("reason is not null")


def profile(line: DataFrame, cells: DataFrame, size: float | DataFrame, stations: int = 50, ds: str = "ds") -> DataFrame:
    """CON3: height and downhill slope at equally spaced stations of each polyline (ds, k, x, y)."""
    w = Window.partitionBy(ds).orderBy("k")
    p = line.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).where("x2 is not null")
    p = p.withColumn("len", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).withColumn("d1", F.sum("len").over(w)).withColumn("d0", F.col("d1") - F.col("len"))
    total = p.groupBy(ds).agg(F.max("d1").alias("total"))
    st = total.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stations - 1).cast("long")))).withColumn("d", F.col("total") * F.col("id") / (stations - 1))
    j = st.join(p, ds).where("d >= d0 and (d < d1 or (d = total and d1 = total))")
    t = (F.col("d") - F.col("d0")) / F.nullif("len", F.lit(0.0))
    at = j.select(ds, "id", "d", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"))
    z = at.join(keyed(grid.sample_bilinear(at, cells, size, ds)), [ds, "id"], "left")
    v = Window.partitionBy(ds).orderBy("id")
    return z.withColumn("slope_pct", 100 * F.try_divide(F.lag("z").over(v) - F.col("z"), F.col("d") - F.lag("d").over(v)))


def yield_findings(groups: DataFrame, relation: DataFrame, ds: str = "ds") -> DataFrame:
    """YR4: codes from yield by landform (ds, class, n, delta_pct) and the strongest relation (ds, r)."""
    g = groups.where("n >= 10")
    a = g.groupBy(ds).agg(F.max_by("class", "delta_pct").alias("best"), F.max("delta_pct").alias("top"), F.min_by("class", "delta_pct").alias("worst"), F.min("delta_pct").alias("low")).join(relation, ds, "left")
    r2 = F.col("r") * F.col("r")
    code = lambda c, k, v: F.when(c, F.struct(F.lit(k).alias("code"), v.cast("double").alias("metric")))
    rows = F.array(
        code(F.col("top") >= 2, "best_landform", F.col("top")), code(F.col("low") <= -2, "worst_landform", F.col("low")), code((F.col("top") < 2) & (F.col("low") > -2), "about_average", F.col("top")),
        code(r2 < 0.15, "weak_relation", r2), code(r2 >= 0.5, "strong_relation", r2),
    )
    return a.select(ds, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("f")).select(ds, "f.*")


def terrain_findings(summary: DataFrame, ds: str = "ds") -> DataFrame:
    """TF1: codes from one summary row a field: drop_m, r2, gradient_pct, steep_pct, steep_ha, pond_m3, wet_pct, relief_m."""
    c = F.col
    code = lambda k, cond, level: F.when(cond, F.struct(F.lit(k).alias("code"), F.lit(level).alias("level")))
    rows = F.array(
        code("trend", (c("drop_m") >= 0.1) & ((c("r2") > 0.3) | (c("gradient_pct") > 0.5)), "ok"), code("level", c("relief_m") < 0.05, "ok"),
        code("pond", c("pond_m3") > 500, "warning"), code("steep", (c("steep_pct") >= 1) | (c("steep_ha") >= 0.2), "warning"), code("wet", c("wet_pct") >= 1, "ok"),
    )
    return summary.select(ds, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("f")).select(ds, "f.*")


def terrain_summary(layers: DataFrame, size: float | DataFrame, ds: str = "ds") -> DataFrame:
    """TS1: one wide row a field from (z, slope_pct[, depth, wet])."""
    has = set(layers.columns)
    layers, size = _whole(layers, size, ds)
    q = lambda c: F.percentile(c, F.array(*[F.lit(p) for p in (0.05, 0.5, 0.95)])).alias(f"{c}_q")
    n = F.count(F.lit(1))
    return layers.groupBy(ds).agg(
        n.alias("cells"), (n * size * size / 1e4).alias("area_ha"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"), q("z"), F.avg("slope_pct").alias("slope_mean"), q("slope_pct"),
        (100.0 * F.count_if(F.col("slope_pct") > 10) / n).alias("steep_pct"), (F.count_if(F.col("slope_pct") > 10) * size * size / 1e4).alias("steep_ha"),
        (F.sum("depth") * size * size if "depth" in has else F.lit(0.0)).alias("pond_m3"), (100.0 * F.count_if("wet") / n if "wet" in has else F.lit(0.0)).alias("wet_pct"),
    )


def zone_summary(cells: DataFrame, size: float | DataFrame, ds: str = "ds") -> DataFrame:
    """ZON3: cells, hectares, mean height and mean slope of each zone of cells (ds, z, slope_pct, zone)."""
    cells, size = _whole(cells, size, ds)
    n = F.count(F.lit(1))
    return cells.groupBy(ds, "zone").agg(n.alias("cells"), (n * size * size / 1e4).alias("area_ha"), F.avg("z").alias("mean_z"), F.avg("slope_pct").alias("mean_slope"))


def zone_points(cells: DataFrame, size: float | DataFrame, ds: str = "ds") -> DataFrame:
    """ZON2: one point for each cell, with all its layers."""
    own = [c for c in cells.columns if c not in (ds, "row", "col", "z")]
    cells, size = width(cells, size, ds)
    return cells.select(ds, ((F.col("col") + 0.5) * size).alias("x"), (-(F.col("row") + 0.5) * size).alias("y"), F.col("z").alias("elev_m"), *own)


def yield_by_class(points: DataFrame, value: str, column: str, classes: list, least: int = 30, ds: str = "ds") -> DataFrame:
    """YR1, YR3: (ds, class, n, mean, delta_pct) for every class, the empty ones too; fields with fewer matched records are left out."""
    p = points.where(F.col(column).isNotNull() & F.col(value).isNotNull())
    all_ = p.groupBy(ds).agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    dim = all_.select(ds, "_m", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    got = p.groupBy(ds, F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    j = dim.join(keyed(got), [ds, "class"], "left")
    return j.select(ds, "class", F.coalesce("n", F.lit(0)).alias("n"), "mean", (F.try_divide(F.col("mean") - F.col("_m"), F.col("_m")) * 100).alias("delta_pct"))


def refused_for_yield(layers: DataFrame, bands: int = 8, ds: str = "ds") -> DataFrame:
    """YR5: (ds, reason) of layers (ds, zones_by, n_values, n_positions) that cannot be read against the relief."""
    reason = F.when(F.lit(not 2 <= bands <= 20), "bands outside 2 to 20").when(F.col("zones_by").isNotNull(), "a zone layer is no measurement").when(F.coalesce("n_values", F.lit(0)) == 0, "no values").when(F.coalesce("n_positions", F.lit(0)) == 0, "no positions")
    return layers.select(ds, reason.alias("reason")).where("reason is not null")


#: Fixed value: metres of smoothing for each metre of a quantised raster's step.
QUANTISED_STEPS = 10.0


def prepare_dem(cells: DataFrame, size: float, factor: float = 1.0, step: float = 0.0, max_cells: int = 400_000, smooth_m: float | None = None, ds: str = "ds") -> DataFrame:
    """TER14: (ds, row, col, z, cell): heights in metres, coarsened until a grid has max_cells at most.

    A raster whose values come in steps (in its own unit) is smoothed by QUANTISED_STEPS times the step,
    by one cell at least and a quarter of its diagonal at most, and rounded to the micrometre; each grid
    has its own coarsening and width.
    """
    step *= abs(factor)
    span = lambda c: F.max(c) - F.min(c) + 1
    f = cells.groupBy(ds).agg(F.greatest(F.lit(1), F.ceil(F.sqrt(span("row") * span("col") / F.lit(float(max_cells))))).cast("long").alias("_f"))
    to = lambda c: F.floor(F.col(c) / F.col("_f")).cast("long").alias(c)
    c = cells.join(f, ds).groupBy(ds, to("row"), to("col")).agg(F.avg(F.col("z") * factor).alias("z"), (F.first("_f") * size).alias("cell"))
    if smooth_m is None and step <= 0:
        return c
    c = cut(c)
    across = F.hypot(span("row"), span("col")) * F.first("cell")
    metres = F.lit(smooth_m) if smooth_m is not None else F.least(F.greatest(F.lit(QUANTISED_STEPS * step), F.first("cell")), across / 4)
    s = c.groupBy(ds).agg((metres / F.first("cell")).alias("_s")).withColumn("_r", F.ceil(3 * F.col("_s")).cast("long"))
    near = F.sequence(-F.col("_r"), F.col("_r"))
    sent = c.join(s, ds).withColumn("_a", F.explode(near)).withColumn("_b", F.explode(near))
    weight = F.exp(-(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b")) / (2 * F.col("_s") * F.col("_s")))
    sent = sent.select(ds, (F.col("row") + F.col("_a")).alias("row"), (F.col("col") + F.col("_b")).alias("col"), weight.alias("_w"), (weight * F.col("z")).alias("_z"))
    mean = sent.groupBy(ds, "row", "col").agg((F.sum("_z") / F.sum("_w")).alias("_z"))
    z = F.round("_z", 6) if step > 0 else F.col("_z")
    return c.select(ds, "row", "col", "cell").join(keyed(mean), [ds, "row", "col"]).select(ds, "row", "col", z.alias("z"), "cell")
