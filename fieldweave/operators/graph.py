"""Iterative graph jobs over many fields at once: components, accumulation along a forest, minimax levels.

Each round is a DataFrame job; its result is checkpointed, the rows that changed say when to
stop, and a cap of rounds raises instead of returning something half done.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.lineage import cut, keyed

MAX_ROUNDS = 2000


def cell_id(row: str = "row", col: str = "col"):
    """One long for a cell; ordered by row, then column."""
    return (F.col(row) + 2**30) * F.lit(2**31) + (F.col(col) + 2**30)


def components(edges: DataFrame, ds: str = "ds") -> DataFrame:
    """(ds, node, root): the least node that each node of the undirected edges (ds, a, b) reaches, by alternating stars."""
    cur = cut(edges.where("a <> b").select(ds, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if cur.isEmpty():
        return cur.select(ds, F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(MAX_ROUNDS):
        turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
        both = cur.select(ds, turned).select(ds, "e.a", "e.b")
        least = both.groupBy(ds, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(keyed(least), [ds, "a"]).select(ds, F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy(ds, "b").agg(F.min("a").alias("m"))
        cur = cut(large.join(keyed(least), [ds, "b"]).select(ds, F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct())
        # stars: each node has one edge, to a node that has none of its own
        roots = cur.select(ds, F.col("a").alias("b")).distinct()
        if cur.join(keyed(roots), [ds, "b"], "left_semi").isEmpty() and cur.groupBy(ds, "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return cur.select(ds, F.col("b").alias("node"), F.col("a").alias("root"))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _islands(there: np.ndarray) -> np.ndarray:
    """At each place of a tile the least place of its 8-connected island; places without ground stand alone."""
    n, m = there.shape
    at, pairs = np.arange(n * m).reshape(n, m), []
    for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
        one = (slice(0, n - dr), slice(max(-dc, 0), m - max(dc, 0)))
        two = (slice(dr, n), slice(max(dc, 0), m + min(dc, 0)))
        both = there[one] & there[two]
        pairs.append((at[one][both], at[two][both]))
    a, b = (np.concatenate(k) for k in zip(*pairs))
    root = at.ravel().copy()
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != (up := root[root])).any():
            root = up


def cell_components(cells: DataFrame, min_cells: int = 1, ds: str = "ds", tile: int = 128) -> DataFrame:
    """TER12: the 8-connected component of each cell (ds, row, col), numbered by its first cell; small ones go.

    A square tile finds its own islands, each kept as one row of places; only the islands that meet
    across rims of tiles go through the rounds, so these follow the tiles of a field and not its cells.
    """
    kind, key = dict(cells.dtypes)[ds], [ds, "tr", "tc"]

    def own(mine: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = mine["tr"].iloc[0] * tile, mine["tc"].iloc[0] * tile
        place = ((mine["row"].to_numpy() - r0) * tile + mine["col"].to_numpy() - c0).astype(np.int64)
        there = np.zeros(tile * tile, bool)
        there[place] = True
        root = _islands(there.reshape(tile, tile))[place]
        order = np.argsort(root, kind="stable")
        first, start = np.unique(root[order], return_index=True)
        label = (first // tile + r0 + 2**30) * 2**31 + first % tile + c0 + 2**30
        same = {c: [mine[c].iloc[0]] * len(first) for c in key}
        return pd.DataFrame(same | {"label": label, "place": np.split(place[order].astype(np.int32), start[1:])})

    tiles = cells.select(ds, "row", "col").withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})
    tiles = cut(tiles.groupBy(*key).applyInPandas(own, f"{ds} {kind}, tr long, tc long, label long, place array<int>"))
    row, col = F.col("tr") * tile + F.floor(F.col("p") / tile), F.col("tc") * tile + F.col("p") % tile
    at_rim = lambda p: (F.floor(p / tile) % (tile - 1) == 0) | (p % tile % (tile - 1) == 0)
    rim = tiles.select(*key, "label", F.explode(F.filter("place", at_rim)).alias("p")).select(*key, "label", row.alias("row"), col.alias("col"))
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    sent = rim.select(*key, F.col("label").alias("a"), "row", "col", o.alias("o")).select(*key, "a", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    sent = sent.where((F.floor(F.col("row") / tile) != F.col("tr")) | (F.floor(F.col("col") / tile) != F.col("tc"))).select(ds, "a", "row", "col")
    edges = sent.join(keyed(rim.select(ds, "row", "col", F.col("label").alias("b"))), [ds, "row", "col"]).select(ds, "a", "b")
    roots = components(edges, ds)
    parts = tiles.select(ds, "label", F.size("place").alias("n")).join(keyed(roots.withColumnRenamed("node", "label")), [ds, "label"], "left").withColumn("root", F.coalesce("root", "label"))
    n = parts.groupBy(ds, "root").agg(F.sum("n").alias("cells")).where(F.col("cells") >= min_cells)
    named = parts.select(ds, "label", "root").join(keyed(n), [ds, "root"])
    lab = tiles.join(keyed(named), [ds, "label"]).select(ds, "tr", "tc", "root", "cells", F.explode("place").alias("p"))
    return lab.select(ds, row.alias("row"), col.alias("col"), F.col("root").alias("label"), "cells")


def accumulate(pointers: DataFrame, ds: str = "ds") -> DataFrame:
    """HYD6: the weight of each node and of all that flows into it, along pointers (ds, id, ptr, w); ptr is null at an outlet.

    Pointer doubling: after k rounds acc holds the 2^k nearest levels upstream, so the rounds
    are the logarithm of the longest path.
    """
    cur = cut(pointers.select(ds, "id", "ptr", F.col("w").cast("double").alias("acc")))
    for _ in range(64):
        if cur.where("ptr is not null").isEmpty():
            return cur.select(ds, "id", "acc")
        got = cur.where("ptr is not null").groupBy(ds, F.col("ptr").alias("id")).agg(F.sum("acc").alias("more"))
        nxt = cur.select(ds, F.col("id").alias("ptr"), F.col("ptr").alias("next"))
        cur = cut(cur.join(keyed(got), [ds, "id"], "left").join(keyed(nxt), [ds, "ptr"], "left").select(ds, "id", F.col("next").alias("ptr"), (F.col("acc") + F.coalesce("more", F.lit(0.0))).alias("acc")))
    raise RuntimeError("the pointers have a cycle")


def minimax(cells: DataFrame, tile: int = 64, eps: float = 1e-9, ds: str = "ds") -> DataFrame:
    """HYD1, LF7: (ds, row, col, z, level): the least level over which each cell drains to a source.

    cells have z and source (true: level is z).  A path's level is the highest z on it, plus
    eps for each step onto a lower cell.  A square tile is one row of arrays, which is flooded
    by itself (a heap over its cells); then only the rim cells whose level fell are sent to the
    tiles beside them, and only tiles that were told something are flooded again, until no rim
    falls.
    """
    kind = dict(cells.dtypes)[ds]
    schema = f"{ds} {kind}, tr long, tc long, row array<long>, col array<long>, z array<double>, level array<double>, fell array<boolean>"
    key = [ds, "tr", "tc"]
    at = {"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)}
    level = F.when(F.col("source"), F.col("z"))
    packed = cells.select(ds, "row", "col", "z", level.alias("level")).withColumns(at).groupBy(*key).agg(F.collect_list(F.struct("row", "col", "z", "level")).alias("c"))
    tiles = packed.select(*key, F.col("c.row").alias("row"), F.col("c.col").alias("col"), F.col("c.z").alias("z"), F.col("c.level").alias("level"))
    wide = tile + 2

    def flood(mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        t = mine.iloc[0]
        first = "fell" not in mine.columns
        if not first and not len(told):
            return mine.assign(fell=[np.zeros(len(t["row"]), bool)])
        r0, c0 = t["tr"] * tile - 1, t["tc"] * tile - 1
        place = (np.asarray(t["row"]) - r0) * wide + np.asarray(t["col"]) - c0
        z, known = np.full(wide * wide, np.nan), np.full(wide * wide, np.inf)
        z[place] = np.asarray(t["z"], float)
        was = np.array([np.inf if v is None or v != v else v for v in t["level"]], float)
        known[place] = was
        heap = [(v, int(p)) for v, p in zip(was, place) if v < np.inf] if first else []
        if len(told):
            halo = (told["row"].to_numpy() - r0) * wide + told["col"].to_numpy() - c0
            heap += [(v, int(p)) for v, p in zip(told["level"], halo)]
            known[halo] = told["level"].to_numpy()
        heapq.heapify(heap)
        ground, low = z.tolist(), known.tolist()
        steps = [a * wide + b for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
        while heap:
            v, p = heapq.heappop(heap)
            if v > low[p]:
                continue
            for k in steps:
                q = p + k
                if 0 <= q < len(ground) and ground[q] == ground[q] and abs(q % wide - p % wide) <= 1:
                    up = ground[q] if ground[q] > v else v + eps
                    if up < low[q]:
                        low[q] = up
                        heapq.heappush(heap, (up, q))
        now = np.array(low)[place]
        fell = now < (np.inf if first else was)  # a first round tells all it knows
        out = {c: [t[c]] for c in (*key, "row", "col", "z")}
        return pd.DataFrame(out | {"level": [[None if v == np.inf else v for v in now]], "fell": [fell]})

    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])).alias("o")
    told = cells.sparkSession.createDataFrame([], f"{ds} {kind}, tr long, tc long, row long, col long, level double")
    for _ in range(MAX_ROUNDS):
        tiles = cut(tiles.groupBy(*key).cogroup(told.groupBy(*key)).applyInPandas(flood, schema))
        rim = tiles.where(F.exists("fell", lambda f: f)).select(*key, F.explode(F.arrays_zip("row", "col", "level", "fell")).alias("x")).where("x.fell")
        sent = rim.select(*key, "x.row", "x.col", "x.level", o).withColumns({"t2": F.floor((F.col("row") + F.col("o.a")) / tile), "c2": F.floor((F.col("col") + F.col("o.b")) / tile)})
        sent = sent.where("t2 <> tr or c2 <> tc").select(ds, F.col("t2").alias("tr"), F.col("c2").alias("tc"), "row", "col", "level").distinct()
        told = cut(sent.join(keyed(tiles.select(*key)), key, "left_semi"))
        if told.isEmpty():
            return tiles.select(ds, F.explode(F.arrays_zip("row", "col", "z", "level")).alias("x")).select(ds, "x.row", "x.col", "x.z", "x.level")
    raise RuntimeError(f"levels did not settle in {MAX_ROUNDS} rounds")


#: Rings about a feature that a first look at it takes.
REACH = 4


def grow_rings(features: DataFrame, cells: DataFrame, falling: bool = True, ds: str = "ds") -> DataFrame:
    """LF6: (ds, label, level): the p75 of the ring about each feature where it stops falling (rising for lows).

    A ring holds the cells at one distance from the feature, across holes in the field too.  A round takes
    the rings up to a reach at once; only features that fall to the last of them are looked at again, with
    twice the reach.  No ring lies beyond the field's extent, so the rounds are the logarithm of its side.
    """
    sign = 1.0 if falling else -1.0
    cells = cells.select(ds, "row", "col", "z")
    extent = cut(cells.groupBy(ds).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")))
    live = features = features.select(ds, "label", "row", "col")
    done, reach = None, REACH
    while True:
        # the cells of a column share it: what lies between two belongs to the nearer
        w = Window.partitionBy(ds, "label", "col").orderBy("row")
        row, col = F.col("row"), F.col("col")
        above, below = F.floor((F.lag("row").over(w) + row) / 2) + 1, F.floor((row + F.lead("row").over(w)) / 2)
        tall = live.join(keyed(extent), ds).withColumns({"_a": F.greatest(row - reach, "r0", above), "_b": F.least(row + reach, "r1", below)})
        tall = tall.select(ds, "label", "row", "col", "c0", "c1", F.explode(F.sequence("_a", "_b")).alias("_row"))
        wide = tall.select(ds, "label", "col", "_row", F.abs(F.col("_row") - row).alias("_v"), F.explode(F.sequence(F.greatest(col - reach, "c0"), F.least(col + reach, "c1"))).alias("_col"))
        near = wide.groupBy(ds, "label", F.col("_row").alias("row"), F.col("_col").alias("col")).agg(F.min(F.greatest("_v", F.abs(F.col("_col") - F.col("col")))).alias("k")).where("k > 0")
        rings = near.join(keyed(cells), [ds, "row", "col"]).groupBy(ds, "label", "k").agg((sign * F.percentile(sign * F.col("z"), F.lit(0.75))).alias("level"))
        w = Window.partitionBy(ds, "label").orderBy("k")
        falls = (F.lead("k").over(w) == F.col("k") + 1) & (sign * F.lead("level").over(w) < sign * F.col("level"))
        # a feature without ground beside it has no foot
        ends = rings.withColumn("falls", F.coalesce(falls, F.lit(False))).groupBy(ds, "label").agg(F.min("k").alias("k0"), F.min(F.when(~F.col("falls"), F.struct("k", "level"))).alias("e"))
        ends = cut(ends.where("k0 = 1").select(ds, "label", "e.k", "e.level"))
        stopped, last = ends.where(F.col("k") < reach).select(ds, "label", "level"), ends.where(F.col("k") == reach)
        done = stopped if done is None else done.unionByName(stopped)
        if last.isEmpty():
            return done
        live, reach = features.join(keyed(last.select(ds, "label")), [ds, "label"], "left_semi"), 2 * reach
