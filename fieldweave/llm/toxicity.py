"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: words, the stems of words (their first 3 to 8 characters,
as languages with compounds and inflection need), word pairs, and skip-grams (pairs with one or two
words between), hashed into 2**20 bins.
FTRL-proximal keeps a rate for every coordinate and an L1 threshold, so most bins stay at
zero; the others, 2**20 at most, are broadcast to score the corpus.

Learning uses labelled rows only, at most ``SAMPLE`` of them with at most ``SAMPLE_BYTES`` of
text together, taken by the hash of doc_id from all rows outside the held-out fold (a text that does
not fit any more is passed over, and the next one tried); a corpus with fewer labels uses them all.  Their features are made in parallel, from whole texts; the
weights are learnt in a few passes over the sample in one task, whose size the two bound.

Defined results: null and empty texts have no features and get the bias alone; rows without a
usable label do not train; a labelled text of more than ``SAMPLE_BYTES`` does not train either; very long texts are scored whole; a doc_id with several labels trains on the largest, and one with
several texts on that of least hash; without any label every score is 0; repeated rows score alike; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BINS = 20
SAMPLE, SAMPLE_BYTES = 10_000, 64_000_000
ALPHA, BETA, L1, L2, EPOCHS = 0.2, 1.0, 2.0, 1.0, 4
HELD_OUT, FOLDS, THRESHOLD = 2, 4, 0.3
#: Characters a stem has; a word as long as that has none.
STEMS = (3, 4, 5, 6, 7, 8)
#: Lower-cases A-Z; blanks and ASCII punctuation separate words.
_table = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or c in b"#$%&*@-" else 32 for c in range(256))
_rng = np.random.default_rng(5_151)
_value, _place = (_rng.integers(0, 2**63, n, dtype=np.uint64) * C.U64(2) + C.U64(1) for n in (256, 64))
_stem = C.U64(0x2545F4914F6CDD1D)
_gap = [C.U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def fold(doc: Column) -> Column:
    """crc32 of the identifier as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(FOLDS))


def _bins(text: bytes | None) -> list[np.ndarray]:
    """Bins of a text's words, stems, word pairs and skip-grams, with repeats."""
    data = np.frombuffer((text or b"").translate(_table), np.uint8)
    data = np.concatenate(([32], data, [32])).astype(np.uint8)
    blank = data == 32
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if not len(start):
        return []
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    # a word's hash: its bytes' values times multipliers of their places, summed by word
    place = np.arange(len(data)) - np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [len(data)]))))
    value = _value[data] * _place[place & 63]
    value[blank] = 0
    h = C.mix(np.add.reduceat(value, start) + (end - start).astype(np.uint64))
    out = [h] + [C.mix(h[:-d] * g + h[d:]) for d, g in zip((1, 2, 3), _gap) if len(h) > d]
    # a stem's hash is that of its bytes: the sum up to the character after it
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(chars, start)
    for k in STEMS:
        to = chars[np.minimum(first + k, len(chars) - 1)]
        longer = to < end
        out.append(C.mix(upto[to[longer]] - upto[start[longer]] + _stem))
    return [(x >> C.U64(64 - BINS)).astype(np.int32) for x in out]


def features(text: bytes | None) -> np.ndarray:
    """The distinct bins of a text, sorted."""
    got = _bins(text)
    return np.unique(np.concatenate(got)) if got else np.zeros(0, np.int32)


def ftrl(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(bins, weights, bias) learnt by FTRL-proximal from (bins, label) rows, in the order given."""
    z, n = np.zeros(2**BINS), np.zeros(2**BINS)
    bz, bn = 0.0, 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    def bias_of():
        return -bz / ((BETA + math.sqrt(bn)) / ALPHA)

    for _ in range(EPOCHS):
        for x, y in rows:
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            bias = bias_of()
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + w.sum()))))
            g = p - y
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[x] += g - step * w
            n[x] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / ALPHA * bias
            bn += g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at], bias_of()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float] | None:
    """Weights from the labelled rows outside the held-out fold; None if there are none."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("dk")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    usable = usable.where((fold(F.col("dk")) != HELD_OUT) & F.col("y").isin(0, 1))
    chosen = C.cut(usable.orderBy(F.xxhash64("dk"), "dk").limit(SAMPLE))  # a stated bound on what is learnt from
    schema = pa.schema([("dk", pa.int64()), ("rk", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for dk, rk, text, y in C.rows(b):
                out.append((dk, rk, y, features(text)))
            if out:
                yield C.batch(schema, *zip(*out))

    # chosen has at most SAMPLE rows of two numbers: it goes to the documents, which stay put
    rows = C.keyed(docs, id_col, text_col).join(F.broadcast(chosen), "dk").groupBy("dk").agg(F.min(F.struct("rk", "text")).alias("t"), F.max("y").alias("y"))
    rows = C.store(rows.select("dk", "t.rk", "t.text", "y", F.octet_length("t.text").alias("size")))

    def fitting(pdf: pd.DataFrame) -> pd.DataFrame:
        room, kept = SAMPLE_BYTES, []
        for dk, size in pdf.sort_values(["o", "dk"])[["dk", "size"]].itertuples(index=False):
            if size <= room:
                room -= size
                kept.append(dk)
        return pd.DataFrame({"dk": pd.Series(kept, dtype="int64")})

    # at most SAMPLE rows of three numbers
    kept = rows.select("dk", "size", F.xxhash64("dk").alias("o"), F.lit(0).alias("one")).groupBy("one").applyInPandas(fitting, "dk long")
    made = rows.join(F.broadcast(kept), "dk").select("dk", "rk", "text", "y").mapInArrow(run, "dk long, rk long, y int, x array<int>")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(o=C.mix(pdf["dk"].to_numpy().view(np.uint64))).sort_values(["o", "dk", "rk"])
        at, w, bias = ftrl(list(zip(pdf["x"], pdf["y"])))
        return pd.DataFrame({"bin": np.concatenate(([-1], at)), "w": np.concatenate(([bias], w))})

    got = made.where(F.size("x") > 0).groupBy(F.lit(0).alias("one")).applyInPandas(fit, "bin int, w double").toPandas()
    if not len(got):
        return None
    own = got[got["bin"] >= 0].sort_values("bin")
    return own["bin"].to_numpy(np.int32), own["w"].to_numpy(), float(got.loc[got["bin"] < 0, "w"].iloc[0])


def _scorer(model):
    if model is None:
        return lambda text: 0.0
    at, w, bias = model
    dense = np.zeros(2**BINS)
    dense[at] = w

    def score(text: bytes | None) -> float:
        hit = [x[dense[x] != 0] for x in _bins(text)]
        x = np.unique(np.concatenate(hit)) if hit else np.zeros(0, np.int32)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + float(dense[x].sum())))))

    return score


def scores(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with one more column: the score from 0 to 1, nullable in no row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(held.value)
        for b in batches:
            texts = b.column(b.schema.names.index(text_col)).cast(pa.binary()).to_pylist()
            cols = [b.column(i) for i, n in enumerate(b.schema.names) if n != name]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([score(t) for t in texts], pa.float64())], names=[*[n for n in b.schema.names if n != name], name])

    from pyspark.sql import types as T

    schema = T.StructType([f for f in docs.schema if f.name != name] + [T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, C.table(spark, sf_dir, "labels"))
    return scores(docs, model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with their columns."""
    model = train(docs, labels, id_col, text_col)
    score = C.fresh(docs, "score")
    return scores(docs, model, id_col, text_col, score).where(F.col(score) < THRESHOLD).drop(score)
