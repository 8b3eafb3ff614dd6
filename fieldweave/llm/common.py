"""Helpers shared by the text operators: keys, checkpoints, word hashing, span arithmetic."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions.lineage import shared_dir

#: A word is a run of characters other than the six ASCII blanks.  Spark, RE2 and Python
#: agree on this class; ``bytes.split()`` splits UTF-8 on exactly these blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null identifier inside keys, so that nulls join and order (first).
NULL_ID = -(2**63)
#: Spark's own switch: shuffle files go when the SQL execution that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U64 = np.uint64

_rng = np.random.default_rng(20_240_117)
#: Odd multipliers of the multilinear window hashes (two independent rows).
MULT = _rng.integers(0, 2**63, (2, 64), dtype=np.uint64) * U64(2) + U64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder (smaller than a checkpoint, read by column), and its path.

    Shuffle files that only served to write it are removed when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path), path


def store(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder."""
    return stored(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_key(col: str) -> Column:
    """The identifier as a long that is never null."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(dk, rk, text): the identifier, a hash that tells rows of one identifier apart, the text.

    Only these columns (and what more asks for) go on, so further columns of the input cannot clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_key(id_col).alias("dk"), F.xxhash64(text).alias("rk"), text.alias("text"), *more)


def shared_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """(dk): the identifiers, other than null, that occur in more than one row; stored, so that its size is known."""
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(id_key(id_col).alias("dk")).agg(F.count(F.lit(1)).alias("n"))
    return store(ids.where("n > 1").select("dk"))


def told_apart(base: DataFrame, shared: DataFrame) -> DataFrame:
    """The keyed rows, with rk 0 where the identifier has no other row: (dk, rk) still names one text, and a shuffle packs the zeros away.

    Rows without an identifier keep their hash, and a salt deals them evenly.
    """
    null = F.col("dk") == NULL_ID
    salted = base.withColumn("__salt", F.when(null, F.col("rk")).otherwise(F.lit(0)))
    ids = shared.select("dk", F.lit(0).cast("long").alias("__salt"), F.lit(True).alias("__shared"))
    rk = F.when(null | F.col("__shared"), F.col("rk")).otherwise(F.lit(0).cast("long")).alias("rk")
    return salted.join(ids, ["dk", "__salt"], "left").select(*[rk if n == "rk" else n for n in base.columns])


def packed(base: DataFrame) -> DataFrame:
    """The keyed texts with text as zstandard frames, so that a shuffle of them is small."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            frames = pa.array([press.compress(t) for t in b.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([frames if n == "text" else b.column(n) for n in b.schema.names], names=b.schema.names)

    # keys are never null: said here, no filter for it sets two uses of one shuffle apart
    kinds = {n: "binary" if n == "text" else k + " NOT NULL" * (n in ("dk", "rk")) for n, k in base.dtypes}
    return base.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def unpacked(frame: bytes) -> bytes:
    return zstandard.decompress(frame) if frame is not None else b""


def doc_id(col: str = "dk") -> Column:
    """The identifier back from its key."""
    return F.when(F.col(col) != NULL_ID, F.col(col))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH3-128 of each word as an (n, 2) array of uint64."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), dtype=np.uint64).reshape(-1, 2)


def mix(a: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    a = (a ^ (a >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    a = (a ^ (a >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> U64(33))


def windows(h: np.ndarray, width: int, row: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` consecutive symbols (multilinear, then mixed)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += h[j : j + n] * MULT[row, j]
    return mix(out)


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the positions below n that lie in any [start, end)."""
    if not len(starts):
        return np.zeros(n, bool)
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, np.minimum(starts, n), 1)
    np.add.at(delta, np.minimum(ends, n), -1)
    return np.cumsum(delta[:n]) > 0


def run_code(pos: str, length: str) -> Column:
    """A run of windows as one long, which travels well: position, length (255 at most)."""
    return F.shiftleft(F.col(pos).cast("long"), 32).bitwiseOR(F.col(length).cast("long"))


def run_spans(codes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what the coded runs of one text cover, for windows of a width."""
    a = np.asarray(codes if codes is not None else (), np.int64)
    return a >> 32, (a >> 32) + (a & 255) - 1 + width


def known_runs(dk: np.ndarray, rk: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """(dk, rk, pos, length) of the runs of consecutive positions, 255 at most each."""
    order = np.lexsort((pos, rk, dk))
    dk, rk, pos = dk[order], rk[order], pos[order]
    head = np.concatenate(([True], (dk[1:] != dk[:-1]) | (rk[1:] != rk[:-1]) | (pos[1:] > pos[:-1] + 1)))
    since = np.arange(len(head)) - np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    at = np.flatnonzero(head | (since % 255 == 0))
    last = np.concatenate((at[1:], [len(head)])) - 1
    return dk[at], rk[at], pos[at], pos[last] - pos[at] + 1


def scatter(dk: np.ndarray, rk: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A key of its own for each settled row, so that they are dealt evenly."""
    return signed(mix(dk.view(np.uint64) ^ (rk.view(np.uint64) * MULT[1, 1]) ^ (pos.astype(np.uint64) * MULT[1, 2])))


def batch(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema)


def rows(b: pa.RecordBatch):
    """The rows of a batch as tuples; strings come as their UTF-8 bytes."""
    return zip(*[(c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in b.columns])


def ddl(schema: pa.Schema) -> str:
    """An Arrow schema as Spark's DDL."""
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)
