"""SimHash fingerprints linked by meet-in-the-middle ball hashing.

Fingerprints link when 3 or fewer of their 64 bits differ.  Half of that radius is 1.5, so
one end of a link walks one bit and the other end at most two, and they meet on a common
variant:

* every distinct fingerprint emits itself and its 64 one-bit variants (role 0); two of these
  balls meet whenever the distance is 2 or less;
* at distance exactly 3 the two ends differ in parity, and two of the three bits lie in the
  same half of the word.  So only odd fingerprints emit two-bit variants (role 1), and only
  those whose two bits share a half: 2 * C(32, 2) = 992.  The even end walks the third bit.

Variants are shuffled; in each variant's group all members of role 0 are within 1 bit of the
variant, so the first of them links to every other member at 3 bits or less, which is checked
on the fingerprints themselves.  A group has at most 1 + 64 + 992 distinct fingerprints by
construction, whatever the size of the input, and gives a star, not all pairs.  Exact copies
are one fingerprint from the start.  Components of the links are found by alternating star
contraction over tables, with a checkpoint a round; nothing is gathered on the driver.

Defined results: null and empty texts have fingerprint zero and link like any other; a null
doc_id is the smallest of its component only if the component has no other (it is ignored by
the minimum); repeated rows are equal members; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

RADIUS, SHINGLE, SEED = 3, 3, 42
MAX_ROUNDS = 60
#: Fingerprints whose variants one task makes.
SPREAD = 50_000
#: Near copies of the pipeline's stage: words a shingle, least similarity, bands and rows of MinHash
#: values (a pair at 0.8 shares none of the bands with a chance of 0.672 ** 24 = 7e-5).
NEAR_SHINGLE, NEAR, BANDS, ROWS = 5, 0.8, 24, 5
#: Sets of one key up to which they are compared as rows, one a pair; more are compared block by block, with at most
#: so many sets and hashes a block (about; blocks are dealt by a hash), and so many hashes counted at once.
PAIRWISE, BLOCK, BLOCK_HASHES, COLUMNS = 32, 2_048, 2_000_000, 2_048

_one = np.array([0] + [1 << i for i in range(64)], np.uint64)
_half = [(1 << i) | (1 << j) for i in range(32) for j in range(i)]
_two = np.array(_half + [x << 32 for x in _half], np.uint64)
_times = np.random.default_rng(8_241_205).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * C.U64(2) + C.U64(1)
_fold = bytes.maketrans(C.UPPER.encode(), C.LOWER.encode())


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of the 3-word shingles, repeats included."""
    words = (text or b"").translate(_fold).split()
    if not words:
        return 0
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return hash_of(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded scratch space for very long texts
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rk, fp): per row of docs its identifier, text hash and fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for _, _, t in C.rows(b)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(C.signed(fps))], schema=schema)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("rk"), text.alias("text")).mapInArrow(run, C.ddl(schema))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("v", pa.int64()), ("fp", pa.int64()), ("role", pa.int8())])
    for b in batches:
        all_fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(all_fp), 200):
            fp = all_fp[i : i + 200]
            odd = fp[np.bitwise_count(fp) % 2 == 1]
            for own, flips, role in ((fp, _one, 0), (odd, _two, 1)):
                v = (own[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(v)), pa.array(C.signed(np.repeat(own, len(flips)))), pa.array(np.full(len(v), role, np.int8))], schema=schema)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): verified links that connect what the full set of links connects; a < b."""
    w = Window.partitionBy("v").orderBy("role", "fp")
    # a fingerprint becomes some hundred rows: deal them by number, not by the bytes they have before
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // SPREAD))
    met = distinct.select("fp").repartition(n, "fp").mapInArrow(_variants, "v long, fp long, role byte")
    first = met.select("fp", F.first("fp").over(w).alias("hub"), F.first("role").over(w).alias("hub_role"))
    near = (F.col("hub_role") == 0) & (F.col("hub") != F.col("fp")) & (F.bit_count(F.expr("hub ^ fp")) <= RADIUS)
    return first.where(near).select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Alternating star contraction: a large-star step links each node's larger neighbours to its
    least neighbour, a small-star step links the smaller ones.  A hub's edges are aggregated
    by a minimum and joined back, so Spark can split a hub's rows.
    """
    cur = C.cut(edges.select("a", "b"))
    if cur.isEmpty():
        return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(MAX_ROUNDS):
        # large star: (u, v) both ways; v > u goes to the least of u and its neighbours
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: each node's smaller neighbours, and the node itself, go to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        cur = C.cut(large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct())
        # stars: each node has one edge, to a node that has none of its own
        if cur.join(cur.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and cur.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return cur.select(F.col("b").alias("node"), F.col("a").alias("root"))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint and the least doc_id it reaches."""
    fps = C.cut(fingerprints(docs, id_col, text_col).select("doc_id", "fp"))
    distinct = C.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct))
    # a distinct fingerprint without links is its own root
    own = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    member = C.cut(own.join(least, "root").select("fp", "component_id"))
    return fps.join(member, "fp")


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_fold).split()


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct hashes of the NEAR_SHINGLE-word shingles, ordered; of fewer words, the hash of them all."""
    words = _words(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < NEAR_SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    return np.unique(C.windows(C.word_hashes(words)[:, 0], NEAR_SHINGLE))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key of each band of the set's MinHash values; sets of a similarity s share a band's key with s ** ROWS."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 1 << 12):  # bounded scratch space for very long texts
        part = shingles[i : i + (1 << 12), None] * _times[None, :]
        part ^= part >> C.U64(32)
        part *= C.U64(0xFF51AFD7ED558CCD)
        least = np.minimum(least, part.min(axis=0))
    grid = least.reshape(BANDS, ROWS) * C.MULT[0, :ROWS]
    return C.mix(grid.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * C.MULT[1, 0])


def whole_row(docs: DataFrame) -> Column:
    """A hash of all columns, which tells rows apart that agree in identifier and text."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])))


def _near_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(dk, rk, wh, fp, sh, bands): keys of each row, fingerprint, hash of the shingle set, and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            sets = [shingle_set(t) for t in texts]
            fps = C.signed(np.array([fingerprint(t) for t in texts], np.uint64))
            sh = C.signed(np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64))
            bands = pa.array([C.signed(band_keys(x)) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("dk"), b.column("rk"), b.column("wh"), pa.array(fps), pa.array(sh), bands], names=["dk", "rk", "wh", "fp", "sh", "bands"])

    return C.keyed(docs, id_col, text_col, whole_row(docs).alias("wh")).mapInArrow(run, "dk long, rk long, wh long, fp long, sh long, bands array<long>")


def block_links(mine: pd.DataFrame) -> list[tuple[int, int]]:
    """Near pairs (positions) of sets of block i with sets of block j; they connect all parts that such pairs connect.

    mine has found, part, own (the set's block), i and j.  Common hashes are counted as a product of 0/1
    matrices, some columns at a time; hashes that one set alone has are left out.
    """
    n, sets, own = len(mine), mine["found"].tolist(), mine["own"].to_numpy()
    size = np.fromiter(map(len, sets), np.int64, n)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(n), size), times[col] > 1
    row, col = row[shared], (np.cumsum(times > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    left, right = np.flatnonzero(own == mine["i"].iloc[0]), np.flatnonzero(own == mine["j"].iloc[0])
    common = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        lo, hi = np.searchsorted(col, (c, c + COLUMNS))
        has = np.zeros((n, COLUMNS), np.float32)
        has[row[lo:hi], col[lo:hi] - c] = 1
        common += has[left] @ has[right].T
    a, b = np.nonzero(common >= NEAR * (size[left][:, None] + size[right] - common))
    a, b = left[a], right[b]
    part = np.unique(mine["part"], return_inverse=True)[1]
    apart = part[a] != part[b]
    a, b = a[apart], b[apart]
    _, first = np.unique(np.minimum(part[a], part[b]) * n + np.maximum(part[a], part[b]), return_index=True)
    over, out = list(range(n)), []

    def top(x: int) -> int:
        while over[x] != x:
            over[x] = over[over[x]]
            x = over[x]
        return x

    for x, y in zip(a[first].tolist(), b[first].tolist()):
        u, v = top(part[x]), top(part[y])
        if u != v:
            over[u] = v
            out.append((x, y))
    return out


def candidates(member: DataFrame) -> DataFrame:
    """(x, y): pairs of sets of different parts that share a key; keys of member (key, sh, part, n) have at most PAIRWISE sets."""
    left, right = (member.select("key", F.col("sh").alias(n), F.col("part").alias(f"p{n}")) for n in ("x", "y"))
    return left.join(right, "key").where("x < y and px <> py").select("x", "y").distinct()


def in_blocks(member: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): fingerprints of near sets of the keys of member (key, sh, part, n), which connect what all of them connect.

    A key's sets are dealt to blocks and two blocks meet in one group, so a key of n sets is n / BLOCK rows a set
    and not n; a group holds two blocks at most.
    """
    sized = member.join(found.select("sh", F.size("found").alias("k")), "sh").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
    blocks = sized.select("key", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("k") / BLOCK_HASHES)).alias("blocks"))
    dealt = member.select("key", "sh", "part").join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("sh"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", "sh", "part", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(mine: pd.DataFrame) -> pd.DataFrame:
        fp = mine["fp"].to_numpy()
        got = np.array(block_links(mine), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fp[got[:, 0]], "b": fp[got[:, 1]]})

    return dealt.join(found, "sh").groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def near_links(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, known: DataFrame | None = None) -> DataFrame:
    """(a, b): fingerprints of rows whose shingle sets have a Jaccard similarity of NEAR or more.

    Sets that share a band's key are candidates.  First one set of each key's group, drawn anew for
    each band, meets all others; then all sets of the group that these links (and those of known,
    edges (a, b) between fingerprints) do not yet connect: small groups pair by pair, large ones block
    by block.  What is not compared is connected already, so the links connect what all candidates of
    NEAR or more connect.  Candidates are compared by their sets.
    """
    sets = C.store(rows.groupBy("sh").agg(F.min("fp").alias("fp"), F.max("fp").alias("other"), F.min(F.struct("dk", "rk")).alias("row"), F.first("bands").alias("bands")))
    # rows of one set with several fingerprints
    alike = rows.select("sh", F.col("fp").alias("b")).join(sets.where("fp <> other").select("sh", F.col("fp").alias("a")), "sh").where("a <> b").select("a", "b")
    met = sets.select("sh", F.explode("bands").alias("key"))
    hubs = met.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "sh").alias("o"), "sh")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = met.join(hubs.select("key", F.col("hub.sh").alias("hub")), "key").where("sh <> hub")
    pairs = C.store(pairs.select(F.least("sh", "hub").alias("x"), F.greatest("sh", "hub").alias("y")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([C.signed(shingle_set(t)) for t in b.column("text").cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("sh"), b.column("fp"), found], names=["sh", "fp", "found"])

    ends_of = lambda pairs: pairs.select(F.col("x").alias("sh")).union(pairs.select("y"))

    def found_of(need: DataFrame) -> tuple[DataFrame, str]:
        """(sh, fp, found): the sets with their hashes, made from the texts again."""
        need = sets.join(need.distinct(), "sh").select("sh", "fp", F.col("row.dk").alias("dk"), F.col("row.rk").alias("rk"))
        # repeated rows of one identifier and text come once
        texts = C.keyed(docs, id_col, text_col).join(need, ["dk", "rk"]).select("sh", "fp", "text")
        return C.stored(texts.mapInArrow(run, "sh long, fp long, found array<long>").dropDuplicates(["sh"]))

    def alike_of(pairs: DataFrame, found: DataFrame) -> DataFrame:
        x, y = (found.select(F.col("sh").alias(n), F.col("fp").alias(f"f{n}"), F.col("found").alias(f"s{n}")) for n in ("x", "y"))
        both = pairs.join(x, "x").join(y, "y")
        # sets of too unlike sizes cannot be near: they are not intersected
        both = both.where((F.size("sx") >= NEAR * F.size("sy")) & (F.size("sy") >= NEAR * F.size("sx"))).withColumn("common", F.size(F.array_intersect("sx", "sy")))
        near = both.where(F.col("common") >= NEAR * (F.size("sx") + F.size("sy") - F.col("common")))
        return near.select(F.col("fx").alias("a"), F.col("fy").alias("b"))

    ends = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found, path = found_of(ends_of(pairs))
    first = C.store(ends(alike_of(pairs, found).union(alike)))
    C.discard(rows.sparkSession, path)
    roots = components(first if known is None else first.union(known).distinct())
    part = sets.select("sh", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("sh", F.coalesce("root", "fp").alias("part"))
    member = met.join(part, "sh")
    torn = member.groupBy("key").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.count(F.lit(1)).alias("n")).where("p0 <> p1").select("key", "n")
    member = C.store(member.join(torn, "key"))
    few, many = member.where(F.col("n") <= PAIRWISE), member.where(F.col("n") > PAIRWISE)
    rest = C.store(candidates(few).join(pairs, ["x", "y"], "left_anti"))
    found, path = found_of(ends_of(rest).union(many.select("sh")))
    out = C.store(ends(first.union(alike_of(rest, found)).union(in_blocks(many, found))))
    C.discard(rows.sparkSession, path)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns of docs: the least doc_id, of its rows the least text hash and row hash.

    Rows link by SimHash (3 bits, as in op8) and where the Jaccard similarity of their five-word
    shingles is 0.8 or more.  The rows to keep are found from these alone; the texts are joined by key.
    """
    rows = C.store(_near_rows(docs, id_col, text_col))
    distinct = C.cut(rows.groupBy("fp").agg(F.min(F.struct((F.col("dk") == C.NULL_ID).alias("n"), "dk", "rk", "wh")).alias("least")))
    close = C.cut(links(distinct))
    roots = components(close.union(near_links(rows, docs, id_col, text_col, close)).distinct())
    own = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("least", F.coalesce("root", "fp").alias("root"))
    dk, rk, wh = keys = [C.fresh(docs, n) for n in ("dk", "rk", "wh")]
    keep = own.groupBy("root").agg(F.min("least").alias("k")).select(*[F.col(f"k.{a}").alias(b) for a, b in zip(("dk", "rk", "wh"), keys)])
    marked = docs.withColumns({dk: C.id_key(id_col), rk: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), wh: whole_row(docs)})
    # what is left of a key are rows that agree in every column
    return marked.join(keep, keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
