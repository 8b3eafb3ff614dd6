"""LF7 for all features of all fields at once: a merge tree of the surface, contracted tile by tile.

Cells joined in order of falling height form a tree: two summits meet at the height at which their
islands join.  Only few cells matter to it: those on the rim of a tile, summits, and cells beside a
feature (at which an island has reached that feature).  A tile joins its own cells highest first, and
whenever two islands that both hold such a cell meet, it keeps one edge at that height; all heights at
which these cells meet stay as they were, and everything else is dropped.  Tiles of tiles do the same
with the edges that are left, until a field is one tile; then its summits are read off.  No tile holds
more than its cells, or the rims of the tiles in it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.lineage import cut, keyed
from fieldweave.operators import graph, grid, relief
from fieldweave.operators.grid import KEY, width

TILE, STEP = 64, 8
#: Stands for the features of the other kind, whose numbers do not matter.
OTHER = -1
#: Stands for no summit (a null would make pandas read the numbers as doubles, which do not hold them).
NONE = -2


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _contract(pairs: np.ndarray, height: np.ndarray, keep: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges between kept nodes at the heights at which their islands meet; pairs of node numbers meet at height."""
    parent = list(range(len(keep)))
    kept = [i if k else -1 for i, k in enumerate(keep.tolist())]  # a kept node of each island
    out = []
    for e in np.argsort(-height, kind="stable").tolist():
        a, b = (_find(parent, int(i)) for i in pairs[e])
        if a == b:
            continue
        if kept[a] >= 0 and kept[b] >= 0:
            out.append((kept[a], kept[b], float(height[e])))
        parent[b] = a
        kept[a] = kept[a] if kept[a] >= 0 else kept[b]
    return out


def _climb(nodes: pd.DataFrame, edges: pd.DataFrame) -> list[tuple[int, float]]:
    """(label, height) at which each summit's island first reaches a feature other than its own."""
    at = {v: i for i, v in enumerate(nodes["id"])}
    events = [(-h, 0, i, i) for i, h in enumerate(nodes["up"])] + [(-h, 1, at[a], at[b]) for a, b, h in zip(edges["a"], edges["b"], edges["up"])]
    parent = list(range(len(at)))
    touched = [set(map(int, t)) if t is not None else set() for t in nodes["touch"]]
    open_ = [set() if s == NONE else {int(s)} for s in nodes["summit"]]
    out = []
    for h, kind, i, j in sorted(events):
        a, b = _find(parent, i), _find(parent, j)
        if kind and a == b:
            continue
        if kind:
            parent[b] = a
            touched[a] = set(sorted(touched[a] | touched[b])[:2])  # two tell any feature from another
            open_[a] |= open_[b]
        done = {s for s in open_[a] if touched[a] - {s}}
        out += [(s, -h) for s in done]
        open_[a] -= done
    return out


def saddles(cells: DataFrame, patches: DataFrame, stops: DataFrame | None = None, high: bool = True, ds: str = "ds") -> DataFrame:
    """(ds, label, level): the highest level at which each feature's summit is joined to ground beside another feature.

    cells (ds, row, col, z), patches (ds, row, col, label) the cells of the features, stops (ds, row, col)
    cells of features of the other kind.  For lows (high false) all is mirrored.  A feature that meets no
    other has no row.
    """
    sign = 1.0 if high else -1.0
    kind = dict(cells.dtypes)[ds]
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in grid.NAMES]))
    marks = patches.select(ds, *KEY, "label")
    if stops is not None:
        marks = marks.unionByName(stops.select(ds, *KEY, F.lit(OTHER).cast("long").alias("label")))
    touch = marks.select(ds, "label", *KEY, near.alias("o")).groupBy(ds, (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")).agg(F.slice(F.array_sort(F.collect_set("label")), 1, 2).alias("touch"))
    own = cells.select(ds, *KEY, (sign * F.col("z")).alias("up"))
    tops = patches.join(keyed(own), [ds, *KEY]).groupBy(ds, "label").agg(F.min(F.struct((-F.col("up")).alias("k"), *KEY)).alias("t"))
    tops, touch = cut(tops.select(ds, F.col("t.row").alias("row"), F.col("t.col").alias("col"), F.col("label").alias("summit"))), cut(touch)
    # fields without features have no saddles
    nodes = cut(own.join(keyed(tops.select(ds).distinct()), ds, "left_semi").join(keyed(touch), [ds, *KEY], "left").join(keyed(tops), [ds, *KEY], "left").withColumns({"id": graph.cell_id(), "summit": F.coalesce("summit", F.lit(NONE).cast("long"))}))
    # tiles count from the field's own corner: from any other a field could be two tiles at every size
    corner = nodes.groupBy(ds).agg(F.min("row").alias("r0"), F.min("col").alias("c0"))
    nodes = cut(nodes.join(keyed(corner), ds).withColumns({"row": F.col("row") - F.col("r0"), "col": F.col("col") - F.col("c0")}).drop("r0", "c0"))
    side = TILE
    tile = lambda c, n=None: F.floor(F.col(c) / (n or side))
    # pairs of neighbours in different tiles; within a tile positions tell them
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    rim = nodes.where((F.pmod("row", F.lit(side)).isin(0, side - 1)) | (F.pmod("col", F.lit(side)).isin(0, side - 1)))
    to = rim.select(ds, F.col("id").alias("a"), F.col("up").alias("ua"), F.col("row").alias("ra"), F.col("col").alias("ca"), o.alias("o")).select(ds, "a", "ua", "ra", "ca", (F.col("ra") + F.col("o.dr")).alias("row"), (F.col("ca") + F.col("o.dc")).alias("col"))
    crossing = to.where((tile("ra") != tile("row")) | (tile("ca") != tile("col"))).join(keyed(rim.select(ds, *KEY, F.col("id").alias("b"), F.col("up").alias("ub"))), [ds, *KEY])
    ends = lambda df: df.select(ds, "a", "b", F.least("ua", "ub").alias("up"), "ra", "ca", F.col("row").alias("rb"), F.col("col").alias("cb"))
    crossing = cut(ends(crossing))
    inside = None  # edges within tiles; none yet
    steps = [(0, 1), (1, -1), (1, 0), (1, 1)]
    out_schema = f"{ds} {kind}, a long, b long, up double"

    def shrink(mine: pd.DataFrame, edges: pd.DataFrame | None) -> pd.DataFrame:
        ids = mine["id"].to_numpy()
        if edges is None:
            row, col, up = (mine[c].to_numpy() for c in ("row", "col", "up"))
            order = np.lexsort((col, row))
            place = (row * 2**31 + col)[order]
            pairs, height = [], []
            for dr, dc in steps:
                want = (row + dr) * 2**31 + col + dc
                at = np.minimum(np.searchsorted(place, want), len(place) - 1)
                hit = np.flatnonzero(place[at] == want)
                pairs.append(np.stack([hit, order[at[hit]]], axis=1))
                height.append(np.minimum(up[hit], up[order[at[hit]]]))
            pairs, height = np.concatenate(pairs), np.concatenate(height)
        else:
            order = np.argsort(ids)
            find = lambda v: order[np.searchsorted(ids[order], v)]
            pairs, height = np.stack([find(edges["a"].to_numpy(np.int64)), find(edges["b"].to_numpy(np.int64))], axis=1), edges["up"].to_numpy(float)
        got = _contract(pairs, height, mine["keep"].to_numpy(bool))
        a, b, h = zip(*got) if got else ((), (), ())
        return pd.DataFrame({ds: [mine[ds].iloc[0]] * len(got), "a": ids[list(a)] if got else [], "b": ids[list(b)] if got else [], "up": h})

    marked = F.col("touch").isNotNull() | (F.col("summit") != NONE)
    while True:
        wide = crossing.select(ds, F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("_rim", F.lit(True))
        here = nodes.join(keyed(wide), [ds, "id"], "left").withColumn("keep", marked | F.col("_rim").isNotNull()).drop("_rim").withColumns({"tr": tile("row", side), "tc": tile("col", side)})
        here = here.select(ds, "tr", "tc", "id", *KEY, "up", "keep", "touch", "summit")
        small = here.select(ds, "tr", "tc", "id", *KEY, "up", "keep")
        if inside is None:
            edges = cut(small.groupBy(ds, "tr", "tc").applyInPandas(lambda pdf: shrink(pdf, None), out_schema))
        else:
            # columns of their own, as the edges meet the nodes again
            both = inside.join(keyed(nodes.select(ds, F.col("id").alias("a"), tile("row", side).alias("tr"), tile("col", side).alias("tc"))), [ds, "a"])
            both = both.select(*[F.col(c).alias(c) for c in (ds, "tr", "tc", "a", "b", "up")])
            edges = cut(small.groupBy(ds, "tr", "tc").cogroup(both.groupBy(ds, "tr", "tc")).applyInPandas(lambda mine, e: shrink(mine, e) if len(mine) else pd.DataFrame({ds: [], "a": [], "b": [], "up": []}), out_schema))
        nodes = cut(here.where("keep").select(ds, "id", *KEY, "up", "touch", "summit"))
        if crossing.isEmpty():
            break
        side *= STEP
        same = (F.floor(F.col("ra") / side) == F.floor(F.col("rb") / side)) & (F.floor(F.col("ca") / side) == F.floor(F.col("cb") / side))
        inside = edges.unionByName(crossing.where(same).select(ds, "a", "b", "up"))
        crossing = cut(crossing.where(~same))

    def read(mine: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        got = _climb(mine, edges) if len(mine) else []
        return pd.DataFrame({ds: [mine[ds].iloc[0]] * len(got) if len(mine) else [], "label": [s for s, _ in got], "level": [sign * h for _, h in got]})

    return nodes.groupBy(ds).cogroup(edges.groupBy(ds)).applyInPandas(read, f"{ds} {kind}, label long, level double")


def features(layers: DataFrame, size: float | DataFrame, min_height: float = 0.0, min_ha: float = 0.05, ds: str = "ds") -> DataFrame:
    """LF5, LF6, LF7: hills and lows with their heights above foot or saddle, whichever is higher, ranked by kind.

    Each kind is first read against its own foot; what stands min_height above it is then measured to the
    saddles with all others of both kinds, and goes if that leaves less.  shape: hill, or, for lows, valley
    (2.5 times as long as wide) or hollow.
    """
    alone, patch = {}, {}
    for high in (True, False):
        part = cut(graph.cell_components(layers.where((1.0 if high else -1.0) * F.col("tpi_std") > 1), 1, ds))
        f = cut(relief.features(layers, size, high, min_ha, ds, part).where(F.col("height_m") >= min_height))
        alone[high], patch[high] = f, cut(part.join(keyed(f.select(ds, "label")), [ds, "label"], "left_semi"))
    out = None
    for high in (True, False):
        sign = 1.0 if high else -1.0
        met = saddles(layers, patch[high], patch[not high], high, ds)
        f = alone[high].join(keyed(met), [ds, "label"], "left")
        foot = F.col("extreme_m") - sign * F.col("height_m")
        nearer = F.coalesce(sign * (F.col("level") - foot) > 0, F.lit(False))
        f = f.withColumn("height_m", F.when(nearer, sign * (F.col("extreme_m") - F.col("level"))).otherwise(F.col("height_m"))).drop("level").where(F.col("height_m") >= min_height)
        shape = F.lit("hill") if high else F.when(F.col("elongation") >= 2.5, "valley").otherwise("hollow")
        f = f.withColumns({"shape": shape, "rank": F.row_number().over(Window.partitionBy(ds).orderBy(F.desc(F.col("height_m") * F.col("area_ha")), "label"))})
        out = f if out is None else out.unionByName(f)
    return out


def feature_findings(found: DataFrame, fields: DataFrame, offsets: DataFrame | None = None, most: int = 5, ds: str = "ds") -> DataFrame:
    """TF1: (ds, code, rank, level, metric) of the first features of each kind and how many more there are, and of
    fields without any; with offsets (ds, pass_id, offset) also of fields whose passes shift by more than 0.3 m.
    """
    named = found.where(F.col("rank") <= most).select(ds, F.col("shape").alias("code"), F.col("rank").cast("long").alias("rank"), F.lit("ok").alias("level"), F.col("height_m").alias("metric"))
    kind = F.when(F.col("shape") == "hill", "more_hills").otherwise("more_lows")
    more = found.where(F.col("rank") > most).groupBy(ds, kind.alias("code")).agg(F.count(F.lit(1)).cast("double").alias("metric"))
    none = fields.select(ds).distinct().join(found.select(ds).distinct(), ds, "left_anti").select(ds, F.lit("no_features").alias("code"), F.lit(0.0).alias("metric"))
    rest = more.unionByName(none).select(ds, "code", F.lit(None).cast("long").alias("rank"), F.lit("ok").alias("level"), "metric")
    out = named.unionByName(rest)
    if offsets is not None:
        sd = offsets.groupBy(ds).agg(F.stddev_pop("offset").alias("metric")).where("metric > 0.3")
        out = out.unionByName(sd.select(ds, F.lit("pass_offsets").alias("code"), F.lit(None).cast("long").alias("rank"), F.lit("warning").alias("level"), "metric"))
    return out


def blocks(cells: DataFrame, size: float | DataFrame, ds: str = "ds") -> DataFrame:
    """TER13: (ds, blocks, largest_ha, second_ha, apart_m, separate): parts of a survey that no gap bridges.

    cells are a surface's, which reaches a gap beyond its readings.  separate: the second part has a
    hectare and 5 % of the ground at least; blocks counts such parts, apart_m lies between the centres
    of the two largest.
    """
    part, cell = width(graph.cell_components(cells, 1, ds), size, ds)
    part = part.select(ds, "label", (F.col("col") + 0.5) * cell, -(F.col("row") + 0.5) * cell, F.lit(1.0) * cell * cell / 1e4).toDF(ds, "label", "x", "y", "ha")
    a = part.groupBy(ds, "label").agg((F.count(F.lit(1)) * F.first("ha")).alias("ha"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    total = Window.partitionBy(ds)
    a = a.withColumns({"least": F.greatest(F.lit(1.0), 0.05 * F.sum("ha").over(total)), "rank": F.row_number().over(total.orderBy(F.desc("ha"), "label"))})
    pick = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c)))
    b = a.groupBy(ds).agg(F.count_if(F.col("ha") >= F.col("least")).alias("blocks"), pick("ha", 1).alias("largest_ha"), pick("ha", 2).alias("second_ha"), F.hypot(pick("x", 1) - pick("x", 2), pick("y", 1) - pick("y", 2)).alias("apart_m"), F.max("least").alias("least"))
    return b.withColumn("separate", F.coalesce(F.col("second_ha") >= F.col("least"), F.lit(False))).drop("least")
