"""LM scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark.

Texts become *blocks* of at most ``BLOCK`` tokens, each stored as one row: the hashes of its
distinct words and the tokens as indexes into them.  A longer text continues in the next block
with the last tokens as context, so no row and no task grows with a text.

The model is built from the highest order down.  For each order a block sends, to every *shard*
(a range of 64-bit hashes), its distinct n-grams with what it adds to their counts: at the top
order occurrences in training texts; below it what follows from the n-grams of the next order
that the block owns - one for the suffix (its continuation count; occurrences, if it starts a
text) and, for the prefix as a context, the count and its class 1, 2 or 3+.  A shard sums them
into sorted hash arrays in a file that its worker maps into memory, and answers every block from
the mapped arrays, n-gram by n-gram; of all blocks that add to an n-gram the first is its owner.
A frequent n-gram thus meets as one entry a block, and a shard holds at most about ``ENTRIES``
entries whatever the corpus.  With the answers of all orders a block scores its own tokens; only
counts of counts, a few numbers an order, reach the driver.

Tokens: words of the text with A-Z lower-cased, then one end.  Texts start in a context of
``ORDER - 1`` start marks, which are never predicted.  Discounts come from counts of counts of
each order (0.5, 1 and 1.5 where a small corpus leaves one of them empty); the unigrams are
interpolated with 1 / (V + 1), so that an unseen word has a probability.  N-grams are told apart
by 64 bits.

Defined results: null and empty texts are one end token; rows without a doc_id are not held out;
every row has its own result, repeated rows alike; copies count as often as they occur; a very
long text is read in slices and spans blocks; without training texts every probability is 1; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import mmap
import re
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ORDER = 3
HELD_OUT, FOLDS = 2, 7
#: Tokens a block has at most, entries a shard has about, bytes of text that are cut into words at a time.
BLOCK, ENTRIES, SLICE = 2**20, 2**20, 2**22
#: Not words: they hold a blank.
START, END = b" start", b" end"
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: What a shard knows of an n-gram: its count (below the top order the continuation count) and, below the top
#: order, its total as a context, how many n-grams of count 1, 2, 3 and more follow it, and occurrences (of words).
COUNT, TOTAL, ONES, TWOS, MORE, RAW = FIELDS = range(6)

_BLOCKS = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("ids", pa.binary()), ("key", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("n", pa.list_(pa.int32()))])
_SENT = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("adds", pa.binary())])
_ANSWER = pa.schema([("level", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("values", pa.binary()), *[(c, pa.int64()) for c in ("n1", "n2", "n3", "n4", "adjusted", "raw", "words")]])
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>", pa.list_(pa.bool_()): "array<boolean>", pa.float64(): "double", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def fold(doc: Column) -> Column:
    """crc32 of the identifier as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(FOLDS))


def pack(a: np.ndarray) -> bytes:
    """Numbers from 0 up as a zstandard frame of the byte planes of the shortest type that holds them, after its size."""
    most = int(a.max(initial=0))
    size = next(n for n in (1, 2, 4, 8) if most < 2 ** (8 * n))
    short = a.astype(f"u{size}")
    return bytes([size]) + zstandard.ZstdCompressor(level=3).compress(short.view(np.uint8).reshape(-1, size).T.tobytes())


def unpack(frame: bytes, kind=np.int64) -> np.ndarray:
    """The numbers of a frame as one type, or, for kind None, as the short type they have in it."""
    planes = np.frombuffer(zstandard.decompress(memoryview(frame)[1:]), np.uint8).reshape(frame[0], -1)
    short = planes.T.copy().view(f"u{frame[0]}").reshape(-1)
    return short if kind is None else short.astype(kind)


def _hashes(frame: bytes) -> np.ndarray:
    """Sorted hashes, which travel as differences."""
    return np.cumsum(unpack(frame, np.uint64), dtype=np.uint64)


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The tokens of the text, in lists of about a slice."""
    at, to = 0, None
    while to != len(text):
        blank = _BLANK.search(text, at + SLICE)
        to = blank.start() if blank else len(text)
        yield text[at:to].lower().split() + [END] * (to == len(text))  # bytes: A-Z only
        at = to


def blocks(docs: DataFrame, id_col: str, text_col: str, order: int) -> DataFrame:
    """The texts as blocks of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        vocab: dict[bytes, int] = {}
        ids: list[np.ndarray] = []
        pieces: list[tuple[int, int | None, bool, int]] = []
        held, made, row = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, made
            words, flat = np.array([xxhash.xxh64_intdigest(w) for w in vocab], np.uint64), np.concatenate(ids)
            often = np.argsort(-np.bincount(flat), kind="stable")  # frequent words get small numbers, which pack well
            rank = np.empty(len(often), np.int32)
            rank[often] = np.arange(len(often), dtype=np.int32)
            out = C.batch(_BLOCKS, [part | made], [pack(words[often])], [pack(rank[flat])], *[[list(x)] for x in zip(*pieces)])
            vocab.clear(), ids.clear(), pieces.clear()
            held, made = 0, made + 1
            return out

        for b in batches:
            for doc, train, text in C.rows(b):
                before = [START] * (order - 1)  # the context of the next piece
                for words in _slices(text):
                    while words:
                        now, words = words[: BLOCK - held], words[BLOCK - held :]
                        with_context = [*before, *now]
                        fresh = set(with_context).difference(vocab)
                        vocab.update(zip(fresh, range(len(vocab), len(vocab) + len(fresh))))
                        ids.append(np.fromiter(map(vocab.__getitem__, with_context), np.int32, len(with_context)))
                        pieces.append((part | row, doc, train, len(now)))
                        before = with_context[-(order - 1) :]
                        held += len(now)
                        if held >= BLOCK:
                            yield flush()
                row += 1
        if pieces:
            yield flush()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(F.col(id_col)) != HELD_OUT, F.lit(True)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(run, _ddl(_BLOCKS))


def ordered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted hashes): the number of each hash is sorted along in its low bits, which is faster than an argsort."""
    low = C.U64((1 << max(len(hashes), 1).bit_length()) - 1)
    order = (np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)) & low).astype(np.int64)
    out = hashes[order]
    if (out[1:] < out[:-1]).any():  # different hashes with equal high bits
        order = np.argsort(hashes, kind="stable")
        out = hashes[order]
    return order, out


class Grams(NamedTuple):
    """The distinct n-grams of a block by hash, and the place among them of what ends at a token and just before it."""

    keys: np.ndarray
    own: np.ndarray
    before: np.ndarray | None


class Tokens:
    """A block's tokens: hashes of its n-grams, and which of them train."""

    def __init__(self, row: dict, order: int):
        self.words, self.ids, n = unpack(row["words"], np.uint64), unpack(row["ids"], np.int32), np.array(row["n"], np.int64)
        self.hash = self.words[self.ids]
        self.order, self.is_start = order, self.hash == C.U64(xxhash.xxh64_intdigest(START))
        self.piece = np.repeat(np.arange(len(n)), n)
        self.train = np.array(row["train"], bool)[self.piece]
        # each piece begins with its context, whose last token counts as an end of n-grams, too
        self.at = np.arange(len(self.piece)) + (self.piece + 1) * (order - 1)
        self.slot = np.arange(len(self.piece)) + self.piece + 1
        self.ends = np.zeros(len(self.piece) + len(n), np.int64)
        self.ends[self.slot] = self.at
        first = np.cumsum(n + 1) - n - 1
        self.ends[first] = self.ends[first + 1] - 1

    def grams(self, n: int) -> Grams:
        """Contexts of the top order are not asked for."""
        top = n == self.order
        if n == 1:  # each word once; those of a context alone are asked for, too
            order, hashes = ordered(C.windows(self.words, 1))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place = rank[self.ids[self.ends]]
            return Grams(hashes, place[self.slot], place[self.slot - 1])
        order, hashes = ordered(C.windows(self.hash, n)[(self.at if top else self.ends) - n + 1])
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        place = np.empty(len(hashes), np.int64)
        place[order] = np.cumsum(new) - 1
        return Grams(hashes[new], place if top else place[self.slot], None if top else place[self.slot - 1])


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of the sorted keys begins; shards are ranges of hashes."""
    place = ((keys >> C.U64(32)) * C.U64(shards)) >> C.U64(32)
    return np.searchsorted(place, np.arange(shards + 1, dtype=np.uint64))


def _adds(tokens: Tokens, n: int, grams: Grams, above: np.ndarray | None) -> np.ndarray:
    """What a block adds to the fields of its n-grams; above: the answers for its (n + 1)-grams."""
    size = len(grams.keys)
    raw = np.bincount(grams.own[tokens.train], minlength=size)
    if above is None:
        return raw[None]
    out = np.zeros((len(FIELDS), size), np.int64)
    if n == 1:
        out[RAW] = raw
    longer = tokens.grams(n + 1)
    at = np.zeros(len(longer.keys), np.int64)
    at[longer.own] = np.arange(len(longer.own))  # a token at which each ends
    own = above[-1] > 0
    at, count = at[own], above[COUNT][own]
    suffix, prefix = grams.own[at], grams.before[at]
    starts = tokens.is_start[tokens.at[at] - n + 1]
    add = lambda place, x=None: np.bincount(place, x, minlength=size).astype(np.int64)  # noqa: E731  sums below 2**53
    out[COUNT], out[TOTAL] = add(suffix, np.where(starts, count, 1)), add(prefix, count)
    for field, of_class in ((ONES, count == 1), (TWOS, count == 2), (MORE, count >= 3)):
        out[field] = add(prefix[of_class])
    return out


def _answers(found: pa.Table, level: int, order: int) -> np.ndarray:
    """The answers to a block's n-grams of one order, in the order of their hashes; the last row marks those it owns."""
    fields = 1 if level == order else len(FIELDS)
    here = sorted((x for x in zip(found["level"].to_pylist(), found["shard"].to_pylist(), found["values"].to_pylist()) if x[0] == level), key=lambda x: x[1])
    return np.concatenate([unpack(v, None).reshape(fields + 1, -1) for _, _, v in here], axis=1)


def _sum_up(level: int, order: int):
    """The work of one shard: sorted hash arrays from all blocks' n-grams, and an answer to each block."""
    fields = 1 if level == order else len(FIELDS)

    def run(sent: pa.Table) -> pa.Table:
        rows = sorted(sent.select(["block", "keys", "adds"]).to_pylist(), key=lambda r: r["block"])
        shard = sent["shard"][0].as_py()
        every = np.concatenate([_hashes(r["keys"]) for r in rows])
        order, every = ordered(every)
        head = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        size = len(head)
        adds = np.concatenate([unpack(r["adds"]).reshape(fields, -1) for r in rows], axis=1)
        sums = [np.add.reduceat(a[order], head) for a in adds]
        with tempfile.TemporaryFile() as file:  # the task's own scratch, gone with it
            for a in (every[head], *sums):
                file.write(a.tobytes())
            file.flush()
            del every, order, adds, sums
            mapped = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
            hashes = np.frombuffer(mapped, np.uint64, size)
            values = np.frombuffer(mapped, np.int64, size * fields, size * 8).reshape(fields, size)
            taken = values[COUNT] == 0  # nothing to own
            words = values[-1] if fields > 1 else taken[:0]
            stats = [int((values[COUNT] == k).sum()) for k in (1, 2, 3, 4)] + [int(values[COUNT].sum()), int(words.sum()), int((words > 0).sum())]
            out = []
            for k, r in enumerate(rows):
                at = np.searchsorted(hashes, _hashes(r["keys"]))
                own = (unpack(r["adds"]).reshape(fields, -1)[COUNT] > 0) & ~taken[at]
                taken[at[own]] = True
                out.append((level, shard, r["block"], pack(np.concatenate([values[:, at], own[None].astype(np.int64)]).reshape(-1)), *(stats if k == 0 else [0] * len(stats))))
            del hashes, values, words
            mapped.close()
        return pa.Table.from_batches([C.batch(_ANSWER, *zip(*out))])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney's discounts of counts 1, 2, 3 and more."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return d if all(0 <= x <= k + 1 for k, x in enumerate(d)) else (0.5, 1.0, 1.5)


def _score(order: int, stats: dict[int, dict[str, int]]):
    """The work of one block when all answers are there: sums of its pieces."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        tokens, pieces = Tokens(row, order), len(row["key"])
        one = stats[1]
        n, v = one["raw"], one["words"]
        below = None
        for level in range(1, order + 1):
            d = np.array([0.0, *discounts(*(stats[level][f"n{k}"] for k in (1, 2, 3, 4)))])
            grams, answer = tokens.grams(level), _answers(found, level, order)
            count = answer[COUNT][grams.own]
            kept = np.maximum(count - d[np.minimum(count, 3)], 0.0)
            if level == 1:
                total = one["adjusted"]
                spare = (d[1] * one["n1"] + d[2] * one["n2"] + d[3] * (one["words"] - one["n1"] - one["n2"])) / total if total else 1.0
                p = (kept / total if total else 0.0) + spare / (v + 1)
                known = answer[RAW][grams.own]
                base = np.log10((known + 1.0) / (n + v + 1.0))
            else:
                total, ones, twos, more = below[TOTAL : MORE + 1, context]
                seen = np.maximum(total, 1)
                p = np.where(total > 0, kept / seen + (d[1] * ones + d[2] * twos + d[3] * more) / seen * p, p)
            below, context = answer, grams.before
        add = lambda x: np.bincount(tokens.piece, x, minlength=pieces)
        return pa.Table.from_batches([C.batch(schema, row["key"], row["doc_id"], row["n"], add(known > 0).astype(np.int64), add(base), add(np.log10(p)))])

    return run, _ddl(schema)


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row of docs."""
    spark = docs.sparkSession
    made, made_at = C.stored(blocks(docs, id_col, text_col, order))
    asked_for = made.select(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    shards = -(-asked_for // ENTRIES) or 1
    found, paths = None, [made_at]

    def sent(level: int):
        def rows(block: pa.Table, above: pa.Table | None) -> pa.Table:
            row = block.to_pylist()[0]
            tokens = Tokens(row, order)
            grams = tokens.grams(level)
            keys, edges = grams.keys, _shards(grams.keys, shards)
            adds = _adds(tokens, level, grams, None if above is None else _answers(above, level + 1, order))
            out = [(s, row["block"], pack(np.diff(keys[a:b], prepend=C.U64(0))), pack(adds[:, a:b].reshape(-1))) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            return pa.Table.from_batches([C.batch(_SENT, *zip(*out))])

        return rows

    for level in range(order, 0, -1):
        rows = sent(level)
        if found is None:

            def first(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for k in range(b.num_rows):
                        yield from rows(pa.Table.from_batches([b.slice(k, 1)]), None).to_batches()

            messages = made.mapInArrow(first, _ddl(_SENT))
        else:
            above = found.where(F.col("level") == level + 1).select("level", "shard", "block", "values")
            messages = made.groupBy("block").cogroup(above.groupBy("block")).applyInArrow(rows, _ddl(_SENT))
        answers, path = C.stored(messages.groupBy("shard").applyInArrow(_sum_up(level, order), _ddl(_ANSWER)))
        found = answers if found is None else found.unionByName(answers)
        paths.append(path)
    sums = found.groupBy("level").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "adjusted", "raw", "words")])
    stats = {r["level"]: r.asDict() for r in sums.collect()}  # one row an order
    if not stats:
        stats = {k: dict.fromkeys(("n1", "n2", "n3", "n4", "adjusted", "raw", "words"), 0) for k in range(1, order + 1)}
    run, kind = _score(order, stats)
    parts = made.groupBy("block").cogroup(found.select("level", "shard", "block", "values").groupBy("block")).applyInArrow(run, kind)
    of_row = parts.groupBy("key").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    out, _ = C.stored(
        of_row.select(
            "doc_id",
            F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
            "n_tokens",
            "n_known",
            F.lit(stats[1]["raw"]).cast("long").alias("train_tokens"),
            "base_score",
            "score",
            F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
        )
    )
    for path in paths:
        C.discard(spark, path)
    return out


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the trigram model."""
    return language_model_scores(C.table(spark, sf_dir, "documents"))
