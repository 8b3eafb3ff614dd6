"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words, the patterns are the 10-word windows of the benchmark items (an item of
fewer words is one shorter pattern).  For each pattern length m, with blocks of B words:

* the shift table gives for each block of B words the least distance from its end to the end
  of a pattern that contains it; a block that no pattern has shifts by m - B + 1;
* where the shift is 0, the block is a suffix of patterns: its bucket lists them by their
  first block, and the words themselves are compared to confirm an occurrence.

The document is scanned once per pattern length; positions that cannot end a match are skipped.
An item's words are held once, a pattern is a place in them.  Tables go to the tasks as one
broadcast of at most ``MAX_PATTERNS`` patterns (some 300 bytes each in a worker); a benchmark
with more is dealt into blocks, which are compiled, broadcast and searched one after another,
and the spans of their scans are united per document.

Defined results: null has no words; repeated items count once by id; null item ids are left
out of the digest but their windows hit; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 10
#: Patterns that one scan carries to the tasks, and words of a longer item that are compiled together.
MAX_PATTERNS, PIECE = 300_000, 50_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lower-cases A-Z and blanks every ASCII character that is no letter or digit; other bytes belong to words.
_table = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_table).split()


class Matcher:
    """The tables for the patterns of one length: (item number, its words, first word of the pattern)."""

    def __init__(self, m: int, patterns: list[tuple[int, list[bytes], int]]):
        self.m, self.block = m, min(2, m)
        self.default = m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.suffix: dict[tuple, list[int]] = {}
        b, known = self.block, {}
        #: of each distinct pattern its words, its place in them and the items that have it
        self.words, self.at, self.items = [], [], []
        for number, words, start in patterns:
            digest = xxhash.xxh3_128_digest(b" ".join(words[start : start + m]))
            k = known.setdefault(digest, len(self.at))
            if k < len(self.at):
                if number not in self.items[k]:
                    self.items[k] += (number,)
                continue
            self.words.append(words)
            self.at.append(start)
            self.items.append((number,))
            for end in range(b, m + 1):
                key = tuple(words[start + end - b : start + end])
                if self.shift.get(key, self.default) > m - end:
                    self.shift[key] = m - end
            self.suffix.setdefault(tuple(words[start + m - b : start + m]), []).append(k)

    def search(self, words: list[bytes]) -> list[tuple[int, tuple[int, ...]]]:
        """(start, item numbers) of each occurrence."""
        m, b, shift, default, found = self.m, self.block, self.shift, self.default, []
        end, n = m, len(words)
        while end <= n:
            key = tuple(words[end - b : end])
            step = shift.get(key, default)
            if step:
                end += step
                continue
            start = end - m
            first, here = words[start], words[start:end]
            for k in self.suffix[key]:
                own, at = self.words[k], self.at[k]
                if own[at] == first and own[at : at + m] == here:
                    found.append((start, self.items[k]))
            end += 1
        return found


def compile_patterns(items: list[tuple[int, bytes | None]]) -> list[Matcher]:
    """Tables by pattern length for (number, text) items."""
    by: dict[int, list] = {}
    same: dict[bytes, bytes] = {}
    for number, text in items:
        w = [same.setdefault(x, x) for x in words_of(text)]
        m = min(WINDOW, len(w))
        if m:
            by.setdefault(m, []).extend((number, w, i) for i in range(len(w) - m + 1))
    return [Matcher(m, p) for m, p in sorted(by.items())]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of many words as overlapping pieces that have the same windows."""
    schema = pa.schema([("item", pa.string()), ("text", pa.string()), ("n", pa.int64())])
    for b in batches:
        out = []
        for item, text in C.rows(b):
            words = words_of(text)
            for i in range(0, max(1, len(words) - WINDOW + 1), PIECE):
                piece = words[i : i + PIECE + WINDOW - 1]
                out.append((None if item is None else item.decode(), b" ".join(piece).decode(), len(piece)))
        if out:
            yield C.batch(schema, *zip(*out))


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[Callable[[], list]]:
    """The items in blocks of about MAX_PATTERNS patterns; each is fetched when it is its turn."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    pieces = C.store(items.mapInArrow(_pieces, "item string, text string, n long"))
    total = pieces.agg(F.sum("n").alias("n")).first()["n"] or 0
    n = 1 if total <= MAX_PATTERNS else -(-2 * total // MAX_PATTERNS)
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [lambda k=k: pieces.where(block == k).select("item", "text").collect() for k in range(n)]


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(dk, rk, n_words, n_hit, items): per row of docs its words, the words hit and the items that occur."""
    base = C.keyed(docs, id_col, text_col)
    first, *more = _item_blocks(benchmark, item_col, item_text_col)
    whole = _scan(base, first())[0]
    if not more:
        return whole.select("dk", "rk", "n_words", "n_hit", "items")
    whole = C.store(whole)
    hits = [whole]
    for block in more:
        found, sent = _scan(base, block())
        hits.append(C.store(found))
        sent.unpersist()
    # equal rows have equal hits: one of them goes on, and each of them gets what it finds
    hits = [h.where("n_hit > 0").select("dk", "rk", "items", "spans").dropDuplicates(["dk", "rk"]) for h in hits]
    united = reduce(DataFrame.union, hits).groupBy("dk", "rk").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    flat = united.withColumn("spans", F.array_sort("spans")).withColumn(
        "n_hit",
        F.expr("aggregate(spans, struct(0 as n, 0 as upto), (s, x) -> struct(s.n + greatest(0, x.e - greatest(x.s, s.upto)) as n, greatest(s.upto, x.e) as upto), s -> cast(s.n as long))"),
    )
    none = F.array().cast("array<string>")
    joined = whole.select("dk", "rk", "n_words").join(flat.select("dk", "rk", "n_hit", "items"), ["dk", "rk"], "left")
    return joined.select("dk", "rk", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))


def _scan(base: DataFrame, block: list) -> tuple[DataFrame, Broadcast]:
    names = [r["item"] for r in block]
    matchers = base.sparkSession.sparkContext.broadcast(compile_patterns([(i, r["text"].encode()) for i, r in enumerate(block)]))
    schema = pa.schema(
        [("dk", pa.int64()), ("rk", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for dk, rk, text in C.rows(b):
                words = words_of(text)
                starts, ends, hit = [], [], set()
                for m in matchers.value:
                    for s, numbers in m.search(words):
                        starts.append(s)
                        ends.append(s + m.m)
                        hit.update(numbers)
                s, e = C.runs(C.cover(len(words), np.array(starts, np.int64), np.array(ends, np.int64))) if starts else ((), ())
                spans = [{"s": int(x), "e": int(y)} for x, y in zip(s, e)]
                out.append((dk, rk, len(words), sum(x["e"] - x["s"] for x in spans), sorted({names[i] for i in hit if names[i] is not None}), spans))
            if out:
                yield C.batch(schema, *zip(*out))

    return base.mapInArrow(run, "dk long, rk long, n_words long, n_hit long, items array<string>, spans array<struct<s:int,e:int>>"), matchers


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    out = occurrences(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select(
        C.doc_id().alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with all their columns."""
    dk, rk = C.fresh(docs, "dk"), C.fresh(docs, "rk")
    hit = occurrences(docs, benchmark, id_col, text_col).where("n_hit > 0").select(F.col("dk").alias(dk), F.col("rk").alias(rk)).distinct()
    marked = docs.withColumns({dk: C.id_key(id_col), rk: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    return marked.join(hit, [dk, rk], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same rows in DuckDB's SQL.
OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
pat AS (
  SELECT DISTINCT item, least(10, len(ws)) AS m, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS p
  FROM (SELECT *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT m FROM pat),
dw AS (
  SELECT rid, i, m, array_to_string(ws[i:i + m - 1], ' ') AS p
  FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, lens WHERE len(ws) >= m)),
occ AS (SELECT DISTINCT dw.rid, dw.i, dw.m, pat.item FROM dw JOIN pat ON dw.p = pat.p AND dw.m = pat.m),
hits AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT rid, i, m FROM occ)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM occ WHERE item IS NOT NULL) GROUP BY rid)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid)
"""
