"""Repeated byte strings by bucket-pointer refinement over sampled suffixes.

A suffix is in a bucket, whose identifier stands for the suffix's first bytes.  The initial
buckets are q-grams of 16 bytes.  A bucket is refined by sorting its suffixes on the
identifiers of the buckets that their later offsets are in:

    id(i, 32) = (id(i, 16), id(i + 16, 16))        id(i, 50) = (id(i, 32), id(i + 18, 32))

so each level's updated identifiers are what the next one points to.  An identifier is a hash
of its pair instead of a rank, so that a document can follow its own pointers in place: a rank
would have to be sent back for every byte.  The sorting is global: the documents lie in chunks,
a chunk sends its distinct identifiers, in order, to the parts of the identifiers' range, and
each part merges and sorts what all chunks sent and answers one bit for each: does the bucket
stay open?  What a round has settled never comes back:

1. *initial buckets*, for one suffix of each 50-byte window: the one whose q-gram has the least
   hash in the window (equal windows choose alike; about 1 position in 18).  A bucket with
   suffixes of one document is closed.
2. *depth 32*: an open suffix p stands for the windows that chose it.  Those with 18 bytes or
   fewer before p hold the suffix of p to depth 32, those with 16 or more hold that of p - 16;
   windows whose refined bucket has one document are closed.
3. *hulls*: the windows of p that are still open cover one string, the hull, named by pointers
   to the identifiers of depth 32 that cover it.  In documents other than the least that has the
   hull all its windows are settled as repeats.
4. *depth 32 again*, over the suffixes that the last round left open: most buckets have now
   lost all documents but one.
5. *depth 50*: each window that is left, by itself; all but the least document's are repeats.

A chunk sends equal identifiers once, so a passage that a third of all documents share is one
entry a chunk in one of the parts, which have equal shares of the hash range; no pairs are
formed and no group depends on the data's skew.  A round that settles repeats (3 and 5) decides
equality at 96 bits; the others send only as many bits as the table's size needs, since they
only select what is compared later.  Each round is a table in the shared folder; its forerunner
and its shuffle files are removed.

Defined results: null and empty texts have no bytes; a null doc_id orders first; rows that
share a doc_id (null is one, too) never count against one another; repeated rows have equal
results; an empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, Q, DEEP = 50, 16, 32
#: Bytes of text in a chunk of a small table, the most that a chunk of a large one has, and the table's
#: bytes up to which it counts as small (a longer text is a chunk of its own).
CHUNK, MOST, SMALL = 4_000_000, 32_000_000, 1_000_000_000
#: Positions whose q-grams are made at a time (below 2**20), and identifiers of a part.
SLAB, PART = 1_000_000, 1_000_000
MIN_PARTS = 96

_odd = np.random.default_rng(9_091_973).integers(0, 2**63, (2, 8), dtype=np.uint64) * C.U64(2) + C.U64(1)
_LEFT = C.U64(0x5BF0_3635_D1C2_58A9)

CHUNKS = "chunk long, ids array<long>, sizes array<int>, frame binary"
#: A chunk's state has part -1; else a part's identifiers (asked) or bits (answered).
ROWS = "chunk long, part int, n int, blob binary"
_rows = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])


# ---- chunks of texts


def _pack(size: int):
    """Batches of (id, text) to chunks of about so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, press = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        ids, texts, held, made = [], [], 0, 0

        def chunk():
            frame = press.compress(b"".join(texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([first + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([frame], pa.binary())],
                names=["chunk", "ids", "sizes", "frame"],
            )

        for b in batches:
            for i, t in C.rows(b):
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held >= size:
                    yield chunk()
                    ids, texts, held, made = [], [], 0, made + 1
        if texts:
            yield chunk()

    return run


class Texts:
    """The texts of a chunk as one array of bytes, and names of its suffixes."""

    def __init__(self, row: dict):
        self.chunk, self.ids = row["chunk"], row["ids"]
        self.dk = np.array([C.NULL_ID if i is None else i for i in self.ids], np.int64)
        self.size = np.array(row["sizes"], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.n = int(self.size.sum())
        self.data = zstandard.decompress(row["frame"]) + bytes(2 * WINDOW) if self.n else bytes(2 * WINDOW)
        #: the eight bytes at each position, without a copy
        self.eight = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))

    def of(self, p: np.ndarray) -> np.ndarray:
        """The document that each position is in."""
        return np.searchsorted(self.start, p, "right") - 1

    def gram(self, p: np.ndarray, chain: int = 0) -> np.ndarray:
        """Identifiers of the initial buckets."""
        m = _odd[chain]
        return C.mix(C.mix(self.eight[p]) * m[0] + C.mix(self.eight[p + 8]) * m[1])

    def deep(self, p: np.ndarray, chain: int = 0) -> np.ndarray:
        """Identifiers at depth 32: those of depth 16 here and at the later offset 16."""
        m = _odd[chain]
        return C.mix(self.gram(p, chain) * m[2] + self.gram(p + Q, chain) * m[3])

    def window(self, s: np.ndarray, chain: int = 0) -> np.ndarray:
        """Identifiers at depth 50: those of depth 32 here and at the later offset 18."""
        m = _odd[chain]
        return C.mix(self.deep(s, chain) * m[4] + self.deep(s + (WINDOW - DEEP), chain) * m[5])

    def hull(self, lo: np.ndarray, size: np.ndarray, chain: int = 0) -> np.ndarray:
        """Identifiers of strings of 50 to 84 bytes: three of depth 32, the first, a middle and the last, cover them."""
        m = _odd[chain]
        a, b, c = (self.deep(x, chain) for x in (lo, lo + (size - DEEP) // 2, lo + size - DEEP))
        return C.mix(a * m[4] + b * m[5] + c * m[6] + size.astype(np.uint64) * m[7])

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(p, lo, n): each chosen suffix, the first window that chose it and the number of these windows."""
        got = []
        span = WINDOW - Q + 1
        last = self.start + self.size - WINDOW  # of each document the last window
        for a in range(0, self.n, SLAB):
            b = min(a + SLAB, self.n)
            d = np.arange(self.of(np.array([a]))[0], self.of(np.array([b - 1]))[0] + 1)
            first = np.maximum(self.start[d], a)
            count = np.maximum(np.minimum(last[d], b - 1) - first + 1, 0)
            s = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            if not len(s):
                continue
            low = self.gram(np.arange(a, min(b + span, self.n + WINDOW)))
            low = (low >> C.U64(20)) << C.U64(20) | np.arange(len(low), dtype=np.uint64)
            h = 1
            while 2 * h <= span:
                low = np.minimum(low[:-h], low[h:])
                h *= 2
            if span > h:
                low = np.minimum(low[: h - span], low[span - h :])
            p = (low[s - a] & C.U64(2**20 - 1)).astype(np.int64) + a
            # a suffix chosen by windows of two documents lies in neither, so p alone tells runs apart
            at = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            got.append((p[at], s[at], np.diff(np.concatenate((at, [len(p)])))))
        if not got:
            return (np.zeros(0, np.int64),) * 3
        p, lo, n = (np.concatenate(x) for x in zip(*got))
        at = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))  # runs that slabs have cut
        return p[at], lo[at], np.add.reduceat(n, at)


# ---- what chunks and parts send one another


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes()


def _coded(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits as byte planes, the first (ordered) as differences."""
    first = columns[0]
    body = _planes(np.diff(first, prepend=first.dtype.type(0))) + b"".join(map(_planes, columns[1:]))
    return zstandard.ZstdCompressor(level=1).compress(body) if body else b""


def _decoded(blob: bytes, n: int, kinds: tuple) -> list[np.ndarray]:
    if not n:
        return [np.zeros(0, k) for k in kinds]
    a = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(len(kinds), 8, n)
    out = [np.ascontiguousarray(x.T).reshape(-1).view(k) for x, k in zip(a, kinds)]
    return [np.cumsum(out[0], dtype=kinds[0]), *out[1:]]


class Asked:
    """Distinct identifiers of a chunk in order, with the least document of each."""

    def __init__(self, key: np.ndarray, dk: np.ndarray, extra: np.ndarray | None = None):
        order = np.lexsort((dk, key) if extra is None else (dk, extra, key))
        k, d = key[order], dk[order]
        new = k[1:] != k[:-1]
        if extra is not None:
            e = extra[order]
            new |= e[1:] != e[:-1]
        at = np.flatnonzero(np.concatenate(([True], new))[: len(k)])
        last = np.concatenate((at[1:], [len(k)]))[: len(at)].astype(np.int64) - 1
        self.key, self.least = k[at], d[at]
        self.extra = None if extra is None else e[at]
        self.several = self.least != d[last]
        self.place = np.zeros(len(key), np.int64)
        self.place[order] = np.repeat(np.arange(len(at)), last + 1 - at)

    def rows(self, chunk: int, parts: int, bits: int) -> list[tuple]:
        bounds = np.array([-(-i * 2**bits // parts) for i in range(1, parts)], np.uint64)
        cuts = [0, *np.searchsorted(self.key, bounds).tolist(), len(self.key)]
        more = [] if self.extra is None else [self.extra, self.least]
        return [(chunk, i, b - a, _coded(self.key[a:b], *[x[a:b] for x in more])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 4, _rows)], schema=_rows)


def _answer(t: pa.Table, kinds: tuple, decide: Callable) -> pa.Table:
    """One bit for each identifier that the chunks sent to this part."""
    n = t["n"].to_pylist()
    columns = [_decoded(b, k, kinds) for b, k in zip(t["blob"].to_pylist(), n)]
    bit = decide(*[np.concatenate(x) for x in zip(*columns)])
    cuts = np.cumsum(n)
    blobs = [np.packbits(bit[b - k : b]).tobytes() for k, b in zip(n, cuts)]
    return _table(list(zip(t["chunk"].to_pylist(), t["part"].to_pylist(), n, blobs)))


def _in_two_chunks(t: pa.Table) -> pa.Table:
    def decide(key):
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out = np.zeros(len(key), bool)
        out[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
        return out

    return _answer(t, (np.uint64,), decide)


def _in_lesser_document(t: pa.Table) -> pa.Table:
    def decide(key, extra, dk):
        order = np.lexsort((dk, extra, key))
        k, e, d = key[order], extra[order], dk[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (e[1:] != e[:-1])))
        out = np.zeros(len(key), bool)
        out[order] = d > d[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        return out

    return _answer(t, (np.uint64, np.uint64, np.int64), decide)


# ---- the rounds: texts, state and answers of a chunk to what it asks next and its next state

State = list[np.ndarray]


def _top(key: np.ndarray, bits: int) -> np.ndarray:
    """So many bits of identifiers; mixed anew, since chosen q-grams are those of least hash and would meet in a few parts."""
    return C.mix(key * _odd[1, 7]) >> C.U64(64 - bits)


def _grams(x: Texts, bits: int) -> tuple[Asked, np.ndarray, np.ndarray, np.ndarray]:
    p, lo, n = x.samples()
    return Asked(_top(x.gram(p), bits), x.dk[x.of(p)]), p, lo, n


def _sides(x: Texts, p: np.ndarray, lo: np.ndarray, n: np.ndarray, bits: int) -> tuple[Asked, np.ndarray, np.ndarray]:
    """Depth 32 of the suffixes at p and p - 16, where a window of p holds it."""
    right = np.flatnonzero(lo + n - 1 >= p - (WINDOW - DEEP))
    left = np.flatnonzero(lo <= p - Q)
    key = np.concatenate((_top(x.deep(p[right]), bits), _top(x.deep(p[left] - Q) ^ _LEFT, bits)))
    return Asked(key, x.dk[x.of(p[np.concatenate((right, left))])]), right, left


def _narrowed(p, lo, n, asked: Asked, bit: np.ndarray, right, left) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose buckets of depth 32 are open."""
    open_ = (asked.several | bit)[asked.place]
    end = lo + n
    to_right, to_left = np.zeros(len(p), bool), np.zeros(len(p), bool)
    to_right[right], to_left[left] = open_[: len(right)], open_[len(right) :]
    lo = np.where(to_left, lo, np.maximum(lo, p - (Q - 1)))
    end = np.where(to_right, end, np.minimum(end, p - (WINDOW - DEEP)))
    keep = end > lo
    return p[keep], lo[keep], (end - lo)[keep]


def _hulls(x: Texts, p, lo, n) -> Asked:
    size = n - 1 + WINDOW
    shape = ((p - lo) * 100 + size).astype(np.uint64)
    return Asked(x.hull(lo, size) ^ C.mix(shape), x.dk[x.of(p)], x.hull(lo, size, 1) >> C.U64(32))


def _windows(x: Texts, lo, n) -> tuple[Asked, np.ndarray]:
    s = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return Asked(x.window(s), x.dk[x.of(s)], x.window(s, 1) >> C.U64(32)), s


def _known(asked: Asked, bit: np.ndarray, dk: np.ndarray) -> np.ndarray:
    return (dk > asked.least[asked.place]) | bit[asked.place]


def _round_1(x: Texts, state: State, bit: np.ndarray, bits: int) -> tuple[State, Asked]:
    return [], _grams(x, bits)[0]


def _round_2(x: Texts, state: State, bit: np.ndarray, bits: int) -> tuple[State, Asked]:
    asked, *sample = _grams(x, bits)
    keep = (asked.several | bit)[asked.place]
    sample = [a[keep] for a in sample]
    return sample, _sides(x, *sample, bits)[0]


def _round_3(x: Texts, state: State, bit: np.ndarray, bits: int) -> tuple[State, Asked]:
    sample = _narrowed(*state, bit=bit, **dict(zip(("asked", "right", "left"), _sides(x, *state, bits))))
    return list(sample), _hulls(x, *sample)


def _round_4(x: Texts, state: State, bit: np.ndarray, bits: int) -> tuple[State, Asked]:
    p, lo, n = state
    known = _known(_hulls(x, p, lo, n), bit, x.dk[x.of(p)])
    rest = p[~known], lo[~known], n[~known]
    return [*rest, lo[known], n[known]], _sides(x, *rest, bits)[0]


def _round_5(x: Texts, state: State, bit: np.ndarray, bits: int) -> tuple[State, Asked]:
    _, lo, n = _narrowed(*state[:3], bit=bit, **dict(zip(("asked", "right", "left"), _sides(x, *state[:3], bits))))
    return [lo, n, *state[3:]], _windows(x, lo, n)[0]


def _removed(x: Texts, state: State, bit: np.ndarray) -> np.ndarray:
    """Mask of the bytes of the chunk that go."""
    asked, s = _windows(x, *state[:2])
    s = s[_known(asked, bit, x.dk[x.of(s)])]
    lo, n = state[2:]
    return C.cover(x.n, np.concatenate((s, lo)), np.concatenate((s, lo + n - 1)) + WINDOW)


#: How many ordered arrays a round's state has; arrays are kept as one block.
def _held(state: State) -> tuple[int, bytes]:
    sizes = [len(a) for a in state]
    body = b"".join(_planes(np.diff(a, prepend=np.int64(0))) for a in state)
    return len(state), zstandard.ZstdCompressor(level=1).compress(np.array(sizes, np.int64).tobytes() + body)


def _restored(k: int, blob: bytes) -> State:
    body = zstandard.decompress(blob)
    out, at = [], 8 * k
    for n in np.frombuffer(body, np.int64, k).tolist():
        a = np.frombuffer(body, np.uint8, 8 * n, at).reshape(8, n)
        out.append(np.cumsum(np.ascontiguousarray(a.T).reshape(-1).view(np.int64)))
        at += 8 * n
    return out


def _received(texts: pa.Table, sent: pa.Table) -> tuple[Texts, State, np.ndarray]:
    """A chunk's texts, its state, and the answers in the order of what it asked."""
    rows = sorted(zip(sent["part"].to_pylist(), sent["n"].to_pylist(), sent["blob"].to_pylist()))
    state = next((_restored(n, b) for p, n, b in rows if p < 0), [])
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for p, n, b in rows if p >= 0]
    return Texts(texts.to_pylist()[0]), state, np.concatenate(bits) if bits else np.zeros(0, bool)


def _asking(step: Callable, parts: int, bits: int, exact: bool):
    def run(texts: pa.Table, sent: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table([])
        x, state, bit = _received(texts, sent)
        state, asked = step(x, state, bit, bits)
        return _table([(x.chunk, -1, *_held(state)), *asked.rows(x.chunk, parts, 64 if exact else bits)])

    return run


OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"


def _finish(texts: pa.Table, sent: pa.Table) -> pa.Table:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", spans), ("kept", pa.binary())])
    out = []
    if texts.num_rows:
        x, state, bit = _received(texts, sent)
        gone = _removed(x, state, bit)
        for i, a, n in zip(x.ids, x.start.tolist(), x.size.tolist()):
            own, text = gone[a : a + n], x.data[a : a + n]
            if own.any():
                text = np.frombuffer(text, np.uint8)[~own].tobytes()
            out.append((i, n, n - len(text), [{"start": s, "end": e} for s, e in zip(*(r.tolist() for r in C.runs(own)))], text))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every row: its bytes, how many go, where, and what is left.

    A byte goes if it lies in a 50-byte string that also starts in a document of smaller doc_id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = int(min(MOST, CHUNK * max(1.0, math.sqrt(total / SMALL))))
    per_byte = 2 / (WINDOW - Q + 2)
    parts = max(MIN_PARTS, math.ceil(total * per_byte / PART))
    bits = min(64, max(32, math.ceil(math.log2(total + 1)) + 8))
    chunks, _ = C.stored(base.mapInArrow(_pack(size), CHUNKS))
    nothing = docs.sparkSession.createDataFrame([], ROWS)
    sent, path = nothing, None
    answers = [None, _in_two_chunks, _in_two_chunks, _in_lesser_document, _in_two_chunks, _in_lesser_document]

    def known(k: int) -> DataFrame:
        if answers[k] is None:
            return sent
        return sent.where("part < 0").unionByName(sent.where("part >= 0").groupBy("part").applyInArrow(answers[k], ROWS))

    def joined(k: int, run: Callable, schema: str) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(known(k).groupBy("chunk")).applyInArrow(run, schema)

    for k, step in enumerate((_round_1, _round_2, _round_3, _round_4, _round_5)):
        exact = answers[k + 1] is _in_lesser_document
        before = path
        sent, path = C.stored(joined(k, _asking(step, parts, bits, exact), ROWS))
        if before:
            C.discard(docs.sparkSession, before)
    return joined(5, _finish, OUT)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: bytes, bytes removed, removed runs, digest of the bytes kept."""
    out = remove_repeats(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
