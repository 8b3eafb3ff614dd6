"""TER6 by field: each field's own cells, and a surface over them from the readings of its log.

``geometry`` is one row a field: (ds, swath_m, cell, gap, edge, x0, y0, rows, cols).  Every cell
operator of the library takes it where it takes a cell size, so fields of different implements go
through one job.  Cell indices count from the absolute origin; as x0 and y0 are multiples of the
cell, two logs of one field and cell meet cell by cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.columns import cell as cell_of
from fieldweave.functions.lineage import cut, keyed
from fieldweave.operators import grid, relief
from fieldweave.operators.grid import KEY

#: Limits of a swath and what stands for a missing one, limits of a cell, cells a grid has at most.
SWATH, NO_SWATH, CELL, MAX_CELLS = (1.0, 60.0), 10.0, (2.0, 25.0), 400_000
#: Cells along the side of a tile, and how far from an edge cell the gradient looks.
TILE, NEAREST = 128, 2


def _shape(c: Column) -> tuple[Column, Column, Column, Column]:
    """Origin and extent of a grid of cells c that covers the readings and the edge about them."""
    lo = lambda v: (F.floor((F.col(v) - F.col("edge")) / c) * c).cast("double")
    hi = lambda v: (F.ceil((F.col(v) + F.col("edge")) / c) * c).cast("double")
    x0, y0 = lo("xmin"), hi("ymax")
    return x0, y0, F.greatest(F.ceil((y0 - (F.col("ymin") - F.col("edge"))) / c), F.lit(1)), F.greatest(F.ceil((F.col("xmax") + F.col("edge") - x0) / c), F.lit(1))


def geometry(points: DataFrame, cell_m: float | None = None, max_gap_m: float | None = None, max_cells: int = MAX_CELLS, value: str = "elev_m", ds: str = "ds") -> DataFrame:
    """TER6, TER15, TER16: cell, tolerances, origin and extent of each field with readings.

    The cell is half the swath, 5 m at least, within 2 to 25 m and to the half metre, and grows by
    half metres until the grid has max_cells.  gap is how far from a reading a cell may be, edge
    how far beyond the outermost.
    """
    v = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(value).isNotNull())
    good = F.when(F.col("swath_m") > 0, F.col("swath_m"))
    a = v.groupBy(ds).agg(F.percentile(good, F.lit(0.5)).alias("med"), *[f(c).alias(f"{c}{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    a = a.withColumn("swath_m", F.when(F.col("med").isNull(), NO_SWATH).otherwise(F.least(F.greatest(F.col("med"), F.lit(SWATH[0])), F.lit(SWATH[1]))))
    own = F.lit(float(cell_m)) if cell_m else F.bround(F.least(F.greatest(F.lit(5.0), F.col("swath_m") / 2, F.lit(CELL[0])), F.lit(CELL[1])) * 2, 0) / 2
    a = a.withColumns({"edge": F.lit(float(max_gap_m)) if max_gap_m else F.col("swath_m") / 2, "own": own})
    # no cell below the root of area / max_cells can do; at the upper bound each term is half of max_cells
    w, h, m = F.col("xmax") - F.col("xmin") + 2 * F.col("edge"), F.col("ymax") - F.col("ymin") + 2 * F.col("edge"), float(max_cells)
    first = F.greatest(F.lit(0), F.floor((F.sqrt(w * h / m) - F.col("own")) * 2) - 1)
    last = F.greatest(first, F.ceil((F.greatest(F.sqrt(2 * w * h / m), 4 * (w + h) / max(m - 8, 1.0)) - F.col("own")) * 2) + 1)

    def fits(k: Column) -> Column:
        _, _, rows, cols = _shape(F.col("own") + k * 0.5)
        return rows * cols <= max_cells

    a = a.withColumn("k", F.element_at(F.filter(F.sequence(first, last), fits), 1)).withColumn("cell", F.col("own") + F.col("k") * 0.5)
    x0, y0, rows, cols = _shape(F.col("cell"))
    gap = F.lit(float(max_gap_m)) if max_gap_m else F.greatest(1.5 * F.col("swath_m"), 3.0 * F.col("cell"))
    return a.select(ds, "swath_m", "cell", gap.alias("gap"), "edge", x0.alias("x0"), y0.alias("y0"), rows.cast("long").alias("rows"), cols.cast("long").alias("cols"))


def _beside(v: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """At each cell the value of the cell dr rows and dc columns on; zero beyond the array."""
    out, (n, m) = np.zeros_like(v), v.shape
    if abs(dr) < n and abs(dc) < m:
        out[max(-dr, 0) : n - max(dr, 0), max(-dc, 0) : m - max(dc, 0)] = v[max(dr, 0) : n + min(dr, 0), max(dc, 0) : m + min(dc, 0)]
    return out


def _square(reach: int) -> list[tuple[int, int]]:
    """All (dr, dc) of a square about a cell but the cell itself."""
    return [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a or b]


def _core(z: np.ndarray, read: np.ndarray, cell: float, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Heights and mask of the cells filled: within the gap of cells read, which lie on two opposite sides."""
    num, den = np.zeros_like(z), np.zeros_like(z)
    side = {k: np.zeros_like(read) for k in "nswe"}
    for dr, dc in _square(int(gap // cell)):
        d2 = float(dr * dr + dc * dc)
        if d2**0.5 * cell > gap:
            continue
        there = _beside(read, dr, dc)
        num, den = num + np.where(there, _beside(z, dr, dc), 0.0) / d2, den + there / d2
        for k, on in (("n", dr > 0 and abs(dc) <= dr), ("s", dr < 0 and abs(dc) <= -dr), ("w", dc > 0 and abs(dr) <= dc), ("e", dc < 0 and abs(dr) <= -dc)):
            if on:
                side[k] |= there
    filled = ~read & ((side["n"] & side["s"]) | (side["e"] & side["w"]))
    return np.where(filled, num / np.where(den > 0, den, 1.0), 0.0), filled


def _run_on(z: np.ndarray, core: np.ndarray, fallback: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Heights of edge cells: the nearest cell of the core with its slope continued, else the reading's own height."""

    def slope(dr: int, dc: int) -> np.ndarray:
        at = lambda k: (_beside(core, k * dr, k * dc), _beside(z, k * dr, k * dc))
        (b2, zb2), (b1, zb1), (a1, za1), (a2, za2) = (at(k) for k in (-2, -1, 1, 2))
        return np.select([a1 & b1, b2, a2, b1, a1], [(za1 - zb1) * 0.5, (z - zb2) * 0.5, (za2 - z) * 0.5, z - zb1, za1 - z], 0.0)

    down, right = slope(1, 0), slope(0, 1)
    out, open_ = fallback.copy(), edge.copy()
    for dr, dc in sorted(_square(NEAREST), key=lambda o: (o[0] * o[0] + o[1] * o[1], o)):
        hit = open_ & _beside(core, dr, dc)
        out = np.where(hit, _beside(z, dr, dc) + _beside(down, dr, dc) * -dr + _beside(right, dr, dc) * -dc, out)
        open_ &= ~hit
    return out


def surface(points: DataFrame, geo: DataFrame, value: str = "elev_m", ds: str = "ds") -> DataFrame:
    """TER6: (ds, row, col, z, kind) of each cell with ground that was driven over.

    read: the mean of its readings.  filled: within the gap of cells read, with such on two opposite
    sides (so a skipped strip is bridged, and the outline is not its hull): their mean by inverse
    squared distance.  edge: beyond the outermost track, within half a swath of a reading: the slope
    of the nearest of those cells continued, so a hillside runs off the edge of a field and no rim
    is left about it.

    Readings go to the square tile that holds them, and to those beside it that they reach; each tile
    is one group of arrays, so a reading is shuffled about once and its cells not at all.
    """
    kind = dict(points.dtypes)[ds]
    v = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(value).isNotNull())
    # what a cell depends on: readings within the gap of the core cells that it looks at
    reach, band = F.floor(F.col("gap") / F.col("cell")), F.ceil(F.col("edge") / F.col("cell"))
    g = geo.select(ds, "cell", "gap", "edge", (reach + F.greatest(band, F.lit(2 * NEAREST))).cast("long").alias("halo"))
    p = v.select(ds, "x", "y", F.col(value).cast("double").alias("z")).join(g, ds).withColumns({"row": -cell_of("y", F.col("cell")) - 1, "col": cell_of("x", F.col("cell"))})
    tiles = lambda k: F.explode(F.sequence(F.floor((F.col(k) - F.col("halo")) / TILE), F.floor((F.col(k) + F.col("halo")) / TILE)))
    p = p.withColumn("tr", tiles("row")).withColumn("tc", tiles("col")).drop("row", "col")
    names = [ds, *KEY, "z", "kind"]

    def lay(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        _, tr, tc = key
        cell, gap, edge, halo = (mine[c].iloc[0] for c in ("cell", "gap", "edge", "halo"))
        r0, c0, n = tr * TILE - halo, tc * TILE - halo, TILE + 2 * halo
        x, y, h = (mine[c].to_numpy() for c in ("x", "y", "z"))
        row, col = -np.floor(y / cell).astype(np.int64) - 1, np.floor(x / cell).astype(np.int64)
        at = (row - r0) * n + col - c0
        count = np.bincount(at, minlength=n * n).reshape(n, n)
        read = count > 0
        z = np.bincount(at, h, minlength=n * n).reshape(n, n) / np.maximum(count, 1)
        new, filled = _core(z, read, cell, gap)
        z, core = np.where(filled, new, z), read | filled
        # the edge: cells of the tile outside the core whose centre lies within half a swath of a reading
        own = np.zeros_like(core)
        own[halo : halo + TILE, halo : halo + TILE] = True
        beside, wide = np.zeros_like(core), _square(int(np.ceil(edge / cell)))
        for dr, dc in wide:
            beside |= _beside(core, dr, dc)
        beside &= own & ~core
        met = []
        for dr, dc in wide:
            r, c = row - r0 + dr, col - c0 + dc
            i = np.flatnonzero((r >= 0) & (r < n) & (c >= 0) & (c < n))
            i = i[beside[r[i], c[i]]]
            far = np.hypot((col[i] + dc + 0.5) * cell - x[i], -(row[i] + dr + 0.5) * cell - y[i])
            near = far <= edge
            i, far = i[near], far[near]
            met.append((r[i] * n + c[i], far, i))
        to, far, i = (np.concatenate(k) for k in zip(*met)) if met else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((h[i], y[i], x[i], far, to))
        to, first = np.unique(to[order], return_index=True)
        fallback, rim = np.zeros(n * n), np.zeros(n * n, bool)
        fallback[to], rim[to] = h[i][order][first], True
        rim = rim.reshape(n, n)
        z = np.where(rim, _run_on(z, core, fallback.reshape(n, n), rim), z)
        r, c = np.nonzero((core | rim) & own)
        what = np.where(rim[r, c], "edge", np.where(read[r, c], "read", "filled"))
        return pd.DataFrame({ds: [mine[ds].iloc[0]] * len(r), "row": r + r0, "col": c + c0, "z": z[r, c], "kind": what})[names]

    return p.groupBy(ds, "tr", "tc").applyInPandas(lay, f"{ds} {kind}, row long, col long, z double, kind string")


def _means(z: np.ndarray, there: np.ndarray, radius: float) -> np.ndarray:
    """As ``grid.disc_mean``, by running sums along the rows of one array; z is 0 where no cell is there."""
    n, m = z.shape
    reach = 1 if radius < 1 else int(radius)
    run = lambda v: np.pad(np.cumsum(v, axis=1, dtype=float), ((0, 0), (reach + 1, reach)), mode="edge")
    out = []
    for v in (z, there):
        s, total = run(v), np.zeros((n, m))
        s[:, : reach + 1] = 0.0
        for dy in range(-min(reach, n - 1), min(reach, n - 1) + 1):
            h = 1 if radius < 1 else int(np.sqrt(radius * radius - dy * dy))
            to, of = slice(max(-dy, 0), n - max(dy, 0)), slice(max(dy, 0), n + min(dy, 0))
            total[to] += s[of, reach + 1 + h : reach + 1 + h + m] - s[of, reach - h : reach - h + m]
        out.append(total)
    return out[0] / np.maximum(out[1], 1.0)


def _standard(v: np.ndarray) -> np.ndarray:
    """As ``grid.standardise``."""
    sd = v.std()
    return (v - v.mean()) / sd if sd > 0 else np.zeros_like(v)


def _relief(row: np.ndarray, col: np.ndarray, z: np.ndarray, radii: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """At each cell of a field the eastward and northward rise (per cell) and its standardised position indices.

    Missing neighbours take the nearest valid cell's height (TER10), ties by row and column.
    """
    r, c = row - row.min() + 1, col - col.min() + 1
    there = np.zeros((r.max() + 2, c.max() + 2), bool)
    # heights count from one of them, so that long sums lose nothing
    there[r, c], full = True, np.zeros(there.shape)
    full[r, c] = z - z[0]
    v, open_ = full.copy(), ~there
    for dr, dc in sorted(_square(1), key=lambda o: (o[0] * o[0] + o[1] * o[1], o)):
        hit = open_ & _beside(there, dr, dc)
        v = np.where(hit, _beside(full, dr, dc), v)
        open_ &= ~hit
    at = {name: v[r + dr, c + dc] for (dr, dc), name in grid.NAMES.items()}
    dx = ((at["ne"] + 2.0 * at["e"] + at["se"]) - (at["nw"] + 2.0 * at["w"] + at["sw"])) / 8.0
    dy = ((at["nw"] + 2.0 * at["n"] + at["ne"]) - (at["sw"] + 2.0 * at["s"] + at["se"])) / 8.0
    return dx, dy, *(_standard((full - _means(full, there, radius))[r, c]) for radius in radii)


def analyse(points: DataFrame, noise: DataFrame | None = None, ds: str = "ds") -> tuple[DataFrame, DataFrame]:
    """A terrain analysis of every field of a job, each on its own cells: (layers, geometry).

    layers: (ds, row, col, z, slope_pct, slope_deg, aspect, tpi_small, tpi_large (standardised), landform).
    noise (ds, noise) sets each field's smoothing (TER9); without it the surface stays as it is.
    The radii of the position indices follow from the extents (DER12).

    Cells are shuffled once, by field: a field's grid has ``MAX_CELLS`` at most, so its arrays are bounded
    whatever the readings, while sums over discs sent from cell to cell grow with radius times cells.
    """
    kind = dict(points.dtypes)[ds]
    geo = cut(geometry(points, ds=ds))
    cells = cut(surface(points, geo, ds=ds).drop("kind"))
    if noise is not None:
        cells = cut(grid.smooth(cells, relief.smoothing_sigma(noise, geo, ds=ds), ds))
    radii = cut(relief.options(cells, geo, ds=ds).select(ds, "tpi_small", "tpi_large").join(geo.select(ds, "cell"), ds))

    def measure(mine: pd.DataFrame) -> pd.DataFrame:
        row, col, z = (mine[k].to_numpy() for k in (*KEY, "z"))
        cell, small, large = (float(mine[k].iloc[0]) for k in ("cell", "tpi_small", "tpi_large"))
        dx, dy, near, wide = _relief(row, col, z, (small, large))
        return pd.DataFrame({ds: mine[ds], "row": row, "col": col, "z": z, "dx": dx / cell, "dy": dy / cell, "tpi_small": near, "tpi_large": wide})

    layers = cells.join(keyed(radii), ds).groupBy(ds).applyInPandas(measure, f"{ds} {kind}, row long, col long, z double, dx double, dy double, tpi_small double, tpi_large double")
    grad = F.hypot("dx", "dy")
    layers = layers.select(ds, *KEY, "z", (100 * grad).alias("slope_pct"), F.degrees(F.atan(grad)).alias("slope_deg"), grid.aspect(F.col("dx"), F.col("dy")).alias("aspect"), "tpi_small", "tpi_large")
    return layers.withColumn("landform", grid.landform(F.col("tpi_small"), F.col("tpi_large"), F.col("slope_pct"))), geo
