"""Embedding whitening by spectrum slicing.

Entries become integers, so counts and sums are exact: one pass sums the vectors, a second the
products of their differences from the rounded mean (small integers, summed as decimals).  Each
task adds up its own vectors first and sends one number an entry of the matrix; no vector is
shuffled.  The covariance, whose size is that of a vector squared whatever the table, is finished
from these exact sums and sliced on the driver:

* an LDLᵀ factorisation (Bunch-Kaufman pivots) of the covariance less a shift counts, by
  Sylvester's law, the eigenvalues above the shift; bisection on the counts isolates each leading
  eigenvalue;
* inverse iteration at the middle of its slice, then Rayleigh quotient iteration, which converges
  cubically, gives eigenvalue and eigenvector; leaving the slice narrows the slice;
* counts on both sides of each value found certify its number (equal values share theirs).

The components are then applied to all rows where they lie.

Defined results: a row goes if its vector is null or holds a null or non-finite entry, or has
another length than most vectors (the shorter of equally frequent lengths), as it then lacks
entries; rows without a vec_id and repeated rows stay, each with its own result; entries beyond
2**53 / 64 count as that; a deviation beyond a long is null; a component without variance (one
vector, equal vectors, fewer vectors than components) has a null ``whitened``, an ``explained`` of
0 and no part in ``identity_error``; vectors shorter than the number of components have as many as
entries; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

COMPONENTS = 32
SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**53
#: Of the covariance's norm: what rounding leaves of an eigenvalue, and the residual that ends an iteration.
ROUNDING, RESIDUAL = 1e-13, 1e-14


def vectors(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold whole finite vectors (of a size), and these as a matrix of integers."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), int(lengths.sum()))
    values = flat.to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(values)  # a null entry reads as NaN
    row = np.repeat(np.arange(len(lengths)), lengths)
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0) & (np.bincount(row[bad], minlength=len(lengths)) == 0)
    if size is None:
        return valid, lengths
    valid &= lengths == size
    kept = values[valid[row]].reshape(-1, size)
    return valid, np.clip(np.floor(SCALE * kept), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _wide(a: np.ndarray) -> np.ndarray:
    """The integers as Python's, which do not overflow."""
    return a.astype(object)


def _sums(rows: DataFrame, schema: str, one) -> dict:
    """Entries of small arrays summed over all tasks: one makes each batch's (i, j) -> integer, which tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            part = one(b)
            total = part if total is None else total + part
        if total is not None:
            at = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array([str(x) for x in total.reshape(-1)])], names=["i", "j", "v"])

    made = rows.mapInArrow(run, "i int, j int, v string")
    return {(r["i"], r["j"]): r["v"] for r in made.groupBy("i", "j").agg(F.sum(F.col("v").cast(schema)).alias("v")).collect()}  # as many as the matrix has entries


def inertia(a: np.ndarray) -> tuple[int, int]:
    """(positive, negative) eigenvalues of a symmetric matrix, by LDLᵀ with 1 x 1 and 2 x 2 pivots."""
    a, positive, negative = a.copy(), 0, 0
    bound = (1 + 17**0.5) / 8
    while len(a):
        n = len(a)
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if n > 1 else 0
        most, width, at = (column[r - 1] if n > 1 else 0.0), 1, 0
        if n > 1 and abs(a[0, 0]) < bound * most:
            other = np.abs(a[:, r])
            other[r] = 0
            if abs(a[0, 0]) * other.max() >= bound * most * most:
                pass
            elif abs(a[r, r]) >= bound * other.max():
                at = r
            else:
                width, at = 2, r
        if width == 1:
            if at:
                a[[0, at]] = a[[at, 0]]
                a[:, [0, at]] = a[:, [at, 0]]
            d = a[0, 0]
            positive, negative = positive + (d > 0), negative + (d < 0)
            if d:
                a[1:, 1:] -= np.outer(a[1:, 0], a[1:, 0] / d)
            a = a[1:, 1:]
        else:
            if at != 1:
                a[[1, at]] = a[[at, 1]]
                a[:, [1, at]] = a[:, [at, 1]]
            positive, negative = positive + 1, negative + 1  # a 2 x 2 pivot has one of each
            a[2:, 2:] -= a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
            a = a[2:, 2:]
    return positive, negative


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above a shift."""
    return inertia(v - shift * np.eye(len(v)))[0]


def leading(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and unit eigenvectors as rows."""
    size = len(v)
    norm = float(np.abs(v).sum(axis=1).max())
    if norm == 0:
        return np.zeros(count), np.eye(size)[:count]
    top, bottom = norm * (1 + ROUNDING) + norm * ROUNDING, -norm * ROUNDING * size
    known = {top: 0, bottom: size}
    rng = np.random.default_rng(11)
    values, rows = np.zeros(count), np.zeros((count, size))
    for k in range(count):

        def look(shift: float) -> int:
            if shift not in known:
                known[shift] = above(v, shift)
            return known[shift]

        # of all shifts counted so far, the nearest on each side
        lo, hi = max(s for s, n in known.items() if n > k), min(s for s, n in known.items() if n <= k)
        while known[lo] - known[hi] > 1 and hi - lo > ROUNDING * norm:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if look(mid) > k else (lo, mid)
        x = rng.standard_normal(size)
        while True:
            found = _refine(v, x, lo, hi, rows[:k], norm)
            if found is not None:
                values[k], rows[k] = found
                break
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if look(mid) > k else (lo, mid)
    slack = 10 * ROUNDING * norm
    for k in range(count):
        # at most k lie above the value and more than k above what is just below it: it is number k + 1, or equal to it
        if above(v, values[k] + slack) > k or above(v, values[k] - slack) < k + 1:
            raise ArithmeticError(f"eigenvalue {k + 1} is not certified")
    return values, rows


def _refine(v: np.ndarray, x: np.ndarray, lo: float, hi: float, found: np.ndarray, norm: float):
    """An eigenpair in a slice by inverse, then Rayleigh quotient iteration; None if that leaves the slice."""
    size, shift = len(v), (lo + hi) / 2
    slack = 10 * ROUNDING * norm

    def step(x, shift):
        for nudge in (0.0, ROUNDING * norm, -3 * ROUNDING * norm):
            try:
                y = np.linalg.solve(v - (shift + nudge) * np.eye(size), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and np.abs(y).max() > 0:
                break
        else:
            return x
        for _ in range(2):  # orthogonal to what was found
            y = y - found.T @ (found @ y)
            y = y / np.linalg.norm(y)
        return y

    x = step(step(x, shift), shift)
    for _ in range(60):
        shift = float(x @ v @ x)
        if not lo - slack <= shift <= hi + slack:
            return None if hi - lo > ROUNDING * norm else (shift, _signed(x))
        residual = np.linalg.norm(v @ x - shift * x)
        y = step(x, shift)
        if residual <= RESIDUAL * norm * size**0.5:
            return float(y @ v @ y), _signed(y)
        x = y
    return (shift, _signed(x)) if hi - lo <= ROUNDING * norm else None


def _signed(x: np.ndarray) -> np.ndarray:
    """The sign that makes the largest entry positive."""
    return x if x[np.abs(x).argmax()] > 0 else -x


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    spark = table.sparkSession
    own = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    kinds = dict(own.dtypes)
    only = own.select("vector")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, n = vectors(b.column(0))
            size, count = np.unique(n[valid], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(count, pa.int64())], names=["size", "n"])

    usual = only.mapInArrow(lengths, "size int, n long").groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "size").first()
    out_schema = f"vec_id {kinds['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if usual is None:
        return spark.createDataFrame([], out_schema)
    size, n = usual["size"], usual["n"]
    keep = min(components, size)
    s = _sums(only, "decimal(38,0)", lambda b: _wide(vectors(b.column(0), size)[1]).sum(axis=0, keepdims=True) + np.zeros((1, size), object))
    total = np.array([int(s[0, j]) for j in range(size)], object)
    middle = np.array([(2 * t + n) // (2 * n) for t in total], object)
    small = middle.astype(np.int64)

    def products(b: pa.RecordBatch) -> np.ndarray:
        y = vectors(b.column(0), size)[1] - small
        most = int(np.abs(y).max(initial=0))
        if most * most * max(len(y), 1) < 2**53:  # exact in doubles, whose products are fast
            f = y.astype(np.float64)
            return _wide((f.T @ f).astype(np.int64))
        return _wide(y).T @ _wide(y)

    g = _sums(only, "decimal(38,0)", products)
    rest = total - n * middle  # sum of the differences
    gram = [[int(g[i, j]) for j in range(size)] for i in range(size)]
    v = np.array([[(n * gram[i][j] - rest[i] * rest[j]) / (n * n) for j in range(size)] for i in range(size)], np.float64)
    trace = float(sum(n * gram[i][i] - rest[i] * rest[i] for i in range(size)) / (n * n))
    values, axes = leading(v, keep)
    has = values > size * ROUNDING * max(float(np.abs(v).sum(axis=1).max()), 0.0)
    values = np.where(has, values, 0.0)
    axes_t, root = np.ascontiguousarray(axes.T), np.where(has, np.sqrt(np.where(has, values, 1.0)), np.nan)
    mean = np.array([float(Decimal(int(r)) / Decimal(n)) for r in rest])  # of the differences
    explained = values / trace if trace > 0 else np.zeros(keep)

    def white(column: pa.Array):
        valid, x = vectors(column, size)
        return valid, x, ((x - small) - mean) @ axes_t / root

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(keep), np.zeros((keep, keep))
        for b in batches:
            w = white(b.column(0))[2]
            first += w.sum(axis=0)
            second += w.T @ w
        both = np.vstack([first, second])
        at = np.indices(both.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(both.reshape(-1))], names=["i", "j", "v"])

    moments = np.zeros((keep + 1, keep))
    for r in only.mapInArrow(spread, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # (keep + 1) * keep numbers
        moments[r["i"], r["j"]] = r["v"] / n
    off = np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(keep))[np.ix_(has, has)]
    error = float(off.max(initial=0.0))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, x, w = white(b.column(1))
            if not len(x):
                continue
            far = n * (x - small) - rest.astype(np.int64) if n * int(np.abs(x - small).max()) + int(max(abs(r) for r in rest)) < 2**62 else n * _wide(x - small) - rest
            most = max(abs(int(far.max())), abs(int(far.min())))
            squares = (far * far if most * most * size < 2**63 else _wide(far) ** 2).sum(axis=1).tolist()
            deviation = pa.array([q if q < 2**63 else None for q in squares], pa.int64())
            ids = b.column(0).filter(pa.array(valid))
            each = pa.array(np.repeat(np.arange(len(x)), keep))
            flat = w.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(each),
                    pa.array(np.tile(np.arange(1, keep + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(flat), n), pa.int64()),
                    deviation.take(each),
                    pa.array(flat, pa.float64(), mask=np.isnan(flat)),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(flat), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.mapInArrow(apply, out_schema)


def op11_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 leading whitened components of every embedding."""
    return whiten(C.table(spark, sf_dir, "embeddings"))
