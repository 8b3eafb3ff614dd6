"""Quality rules: base counts and zstandard compression bands.

A text of repeated passages compresses too well, random characters hardly compress.  What is
normal depends on the length, so each band has limits of its own, for the whole text and for
its full chunks of ``CHUNK`` bytes:

* the whole text is rejected if its ratio (compressed / raw bytes) leaves its band;
* it is rejected if more than ``CHUNK_SHARE`` of its full chunks leave the chunk band, so a
  long text cannot hide bad stretches behind good ones.

Short texts, for which a ratio says nothing, have no limits.

Defined results: a null text has no words and fails the base rule; repeated rows each have
their own result; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LEVEL, CHUNK, CHUNK_SHARE, REPEAT = 3, 4096, 0.25, 8
#: (least bytes, lowest ratio kept, highest ratio kept), by rising length.
BANDS = [(0, 0.0, 9.0), (128, 0.0, 1.05), (256, 0.30, 0.92), (512, 0.28, 0.85), (1024, 0.26, 0.78), (4096, 0.22, 0.74), (16384, 0.20, 0.72)]
CHUNK_BAND = (0.22, 0.74)
_symbols = re.compile(rb"[#*$%&|<>]")
_words_only = bytes(range(0x80, 0xC0)) + b" \t\n\r\x0b\x0c"

OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64())]
)


def band(n: int) -> tuple[float, float]:
    """The limits for a text of n bytes."""
    return next((lo, hi) for least, lo, hi in reversed(BANDS) if n >= least)


def _repeat_words(words: list[bytes]) -> int:
    n = len(words)
    if n <= REPEAT:
        return 0
    h = C.windows(C.word_hashes(words)[:, 0], REPEAT)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.concatenate((same, [False])) | np.concatenate(([False], same))
    at = order[again]
    return int(C.cover(n, at, at + REPEAT).sum())


def measure(text: bytes | None, press: zstandard.ZstdCompressor) -> tuple:
    """The columns of OUT after doc_id."""
    text = text or b""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]  # bytes.strip() drops the same blanks
    repeat = _repeat_words(words)
    failed = n < 20 or 100 * repeat > 30 * n
    size = len(text)
    ratio = len(press.compress(text)) / size if size else 0.0
    lo, hi = band(size)
    bad, chunks = 0, size // CHUNK
    for i in range(chunks):
        r = len(press.compress(text[i * CHUNK : (i + 1) * CHUNK])) / CHUNK
        bad += not CHUNK_BAND[0] <= r <= CHUNK_BAND[1]
    kept = not failed and lo <= ratio <= hi and bad <= CHUNK_SHARE * chunks
    return n, len(text.translate(None, _words_only)), len(_symbols.findall(text)), len(lines) - len(set(lines)), repeat, failed, kept, ratio, chunks, bad


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ratio and verdict for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            out = [(i, *measure(t, press)) for i, t in C.rows(b)]
            if out:
                yield C.batch(OUT, *zip(*out))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, C.ddl(OUT))


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and the compression verdict of every document."""
    return quality(C.table(spark, sf_dir, "documents"))
