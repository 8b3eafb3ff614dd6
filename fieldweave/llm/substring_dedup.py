"""Repeated word passages by difference-cover anchors.

Positions of a document whose index modulo 13 lies in {0, 1, 3, 9} are anchors.  That set is
a perfect difference cover: for any two residues there is a shift below 13 that takes both
into it.  So two equal runs of 20 words, wherever they start, share one aligned anchor whose
8-word window lies inside both (12 + 8 = 20).  The job

1. hashes the 8-word windows at anchors only (4 of 13 positions) and keeps the anchors whose
   hash occurs twice or more;
2. extends each of these to the 20-word windows that contain it, and nothing else;
3. gives each such window to the group of its 128-bit hash, where all but the earliest go.

Every task first combines a bounded block of its own documents: of equal windows in a block
only the earliest is shuffled, the others are settled on the spot.  A passage that a third of
all documents share therefore meets as one row a block, and no pairs are ever formed.

Defined results: null and empty texts have no words; a null doc_id orders first; rows with the
same doc_id never count as earlier than one another (equal rows get equal results); an empty
table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

PERIOD, COVER, ANCHOR, WINDOW = 13, np.array([0, 1, 3, 9]), 8, 20
#: Words that a task combines at a time.
BLOCK = 1_000_000

#: mark is 2 * position, plus 1 if the task already knows that the anchor repeats.  What varies
#: from row to row stands together and the rest after it, as a shuffle compresses that best.
ANCHORS = pa.schema([("h", pa.int64()), ("mark", pa.int32()), ("dk", pa.int64()), ("rk", pa.int64())])
#: k1 and the upper half of kp are 96 bits of the window's hash, the lower half of kp is its
#: position; len is 0, or the length of a run of settled windows.
WINDOWS = pa.schema([("k1", pa.int64()), ("kp", pa.int64()), ("len", pa.int32()), ("dk", pa.int64()), ("rk", pa.int64())])
#: Bits of an anchor's hash that a shuffle carries: an anchor only selects what is compared later.
ANCHOR_BITS = 48


def _blocks(batches, columns, per_doc, size: int) -> Iterator[list[np.ndarray]]:
    """per_doc(row) gives equally long arrays and a weight; they come joined, a bounded block at a time."""
    held, weight = [], 0
    for b in batches:
        for row in C.rows(b.select(columns)):
            got, w = per_doc(row)
            if got is not None:
                held.append(got)
            weight += w
            if weight >= size and held:
                yield [np.concatenate(x) for x in zip(*held)]
                held, weight = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def per_doc(row):
        dk, rk, text = row
        words = text.split()
        n = len(words)
        if n < WINDOW:
            return None, n
        at = (np.arange(0, n, PERIOD)[:, None] + COVER).ravel()
        at = at[at <= n - ANCHOR]
        h = C.windows(C.word_hashes(words)[:, 0], ANCHOR)[at]
        h = (h >> C.U64(64 - ANCHOR_BITS)) << C.U64(64 - ANCHOR_BITS)
        return (h, np.full(len(at), dk), np.full(len(at), rk), at.astype(np.int32)), n

    for h, dk, rk, pos in _blocks(batches, ["dk", "rk", "text"], per_doc, BLOCK):
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
        first, alone = np.empty_like(new), np.empty_like(new)
        first[order] = new
        alone[order] = new & np.concatenate((new[1:], [True]))
        # what is known to repeat needs no meeting place: deal it by its own position.  Rows stay
        # in the order of documents, in which they compress best
        key = np.where(first, C.signed(h), C.scatter(dk, rk, pos))
        yield C.batch(ANCHORS, key, 2 * pos + ~alone, dk, rk)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def per_doc(row):
        dk, rk, frame, anchors = row
        words = C.unpacked(frame).split()
        n = len(words)
        if n < WINDOW:
            return None, n
        a = np.asarray(anchors, np.int64)
        a = a[a <= n - ANCHOR]
        m = n - WINDOW + 1
        at = np.flatnonzero(C.cover(m, np.maximum(a - (WINDOW - ANCHOR), 0), a + 1))
        if not len(at):
            return None, n
        h = C.word_hashes(words)
        return (C.windows(h[:, 0], WINDOW)[at], (C.windows(h[:, 1], WINDOW, 1)[at] >> C.U64(32)).astype(np.uint32).view(np.int32), np.full(len(at), dk), np.full(len(at), rk), at), len(at)

    for was in _blocks(batches, ["dk", "rk", "text", "anchors"], per_doc, BLOCK):
        order = np.lexsort((was[4], was[3], was[2], was[1], was[0]))
        k1, k2, dk, rk, pos = (x[order] for x in was)
        new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        same = np.concatenate(([False], (dk[1:] == dk[:-1]) & (rk[1:] == rk[:-1]) & (pos[1:] > pos[:-1]))) & ~new
        gone = (dk > dk[start]) | same
        keep = np.sort(order[~gone])
        kp = (was[1][keep].astype(np.int64) << 32) | was[4][keep]
        yield C.batch(WINDOWS, C.signed(was[0][keep]), kp, np.zeros(len(keep), np.int32), was[2][keep], was[3][keep])
        if gone.any():
            dk, rk, pos, size = C.known_runs(dk[gone], rk[gone], pos[gone])
            yield C.batch(WINDOWS, C.scatter(dk, rk, pos), pos, size, dk, rk)


def repeated_windows(base: DataFrame, texts: DataFrame) -> DataFrame:
    """(dk, rk, runs): per text of a doc_id the coded runs of windows that also start earlier.

    base has its rows told apart, and texts are its packed rows.  They are joined by (dk, rk)
    here, as they are by the caller: one shuffle of the texts serves both joins.
    """
    anchors = base.mapInArrow(_anchor_rows, C.ddl(ANCHORS))
    again = F.count(F.lit(1)).over(Window.partitionBy("h")) > 1
    hits = (
        anchors.withColumn("again", again)
        .where("again or mark % 2 = 1")
        .groupBy("dk", "rk")
        .agg(F.collect_set(F.expr("mark div 2")).alias("anchors"))
    )
    found = texts.join(hits, ["dk", "rk"]).mapInArrow(_window_rows, C.ddl(WINDOWS))
    # dealt by k1 as packed; the parts of kp are taken out afterwards
    found = found.repartition("k1").select("k1", F.shiftright("kp", 32).alias("k2"), "dk", "rk", F.col("kp").bitwiseAND(0x7FFFFFFF).cast("int").alias("pos"), "len")
    w = Window.partitionBy("k1", "k2").orderBy("dk", "rk", "pos")
    inside = (F.lag("dk").over(w) == F.col("dk")) & (F.lag("rk").over(w) == F.col("rk")) & (F.lag("pos").over(w) < F.col("pos"))
    later = F.col("dk") > F.first("dk").over(w)
    return (
        found.withColumn("gone", (F.col("len") > 0) | later | F.coalesce(inside, F.lit(False)))
        .where("gone")
        .withColumn("len", F.greatest("len", F.lit(1)))
        .groupBy("dk", "rk")
        .agg(F.collect_list(C.run_code("pos", "len")).alias("runs"))
    )


def _removed(n: int, found) -> np.ndarray:
    return C.cover(n, *C.run_spans(found, WINDOW))


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("dk", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    for b in batches:
        out = []
        for dk, frame, found in C.rows(b.select(["dk", "text", "runs"])):
            words = C.unpacked(frame).split()
            gone = _removed(len(words), found)
            kept = words if not gone.any() else [words[i] for i in np.flatnonzero(~gone)]
            out.append((dk, len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        if out:
            yield C.batch(schema, *zip(*out))


def _kept_text(texts, founds) -> list[str | None]:
    out = []
    for text, found in zip(texts, founds):
        if text is None or not found:
            out.append(text)
            continue
        at = [m.span() for m in re.finditer(C.WORD, text)]
        gone = _removed(len(at), found)
        parts, last = [], None
        for i in np.flatnonzero(~gone):
            if last is not None:  # the white space before a kept word, where its neighbour stays; else one space
                parts.append(text[at[i - 1][1] : at[i][0]] if last == i - 1 else " ")
            parts.append(text[at[i][0] : at[i][1]])
            last = i
        out.append("".join(parts))
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every repeated word removed from the text; all other columns stay.

    A text without repeats is returned as it is, and a null text stays null.
    """
    shared = C.shared_ids(docs, id_col)
    base = C.told_apart(C.keyed(docs, id_col, text_col), shared)
    rest = F.struct(*[(F.col(f"`{c}`").isNull() if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])
    texts = C.packed(C.told_apart(C.keyed(docs, id_col, text_col, rest.alias("rest")), shared))
    joined = texts.join(repeated_windows(base, texts), ["dk", "rk"], "left")
    kind = dict(texts.dtypes)["rest"]

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [C.unpacked(t).decode() for t in b.column("text").to_pylist()]
            fixed = _kept_text(raw, b.column("runs").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(fixed, pa.string()), b.column("rest")], names=["text", "rest"])

    out = joined.mapInArrow(fix, f"text string, rest {kind}")
    new = F.when(~F.col("rest")[text_col], F.col("text"))
    return out.select(*[(new if c == text_col else F.col("rest")[c]).alias(c) for c in docs.columns])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: words, words removed, digest of the words kept."""
    docs = C.table(spark, sf_dir, "documents")
    base = C.told_apart(C.keyed(docs, "doc_id", "text"), C.shared_ids(docs, "doc_id"))
    texts = C.packed(base)
    joined = texts.join(repeated_windows(base, texts), ["dk", "rk"], "left")
    out = joined.mapInArrow(_digest_rows, "dk long, n_words long, n_removed long, kept_sha256 string")
    return out.select(C.doc_id().alias("doc_id"), "n_words", "n_removed", "kept_sha256")
