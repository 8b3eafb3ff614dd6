"""Mixing sources to target weights by hash-threshold histograms.

Every source has a target number of words.  It is met by whole passes over the source and a
hash threshold for the rest: the documents whose hash lies below it are taken once more.  The
threshold is found without sorting documents: word counts are summed by source and the top 12
bits of the hash; the bucket in which the running sum passes the budget is the boundary; only
it is split by the next 12 bits, and so on, until 60 bits are fixed.  Thresholds are nested: a
larger budget takes a superset of documents.  Reruns agree, as the hash depends on doc_id only
(for rows without one, on their text).

Targets are a water filling: sources take their weight's share of the total until they reach
``cap`` times their size, and what is left is shared among the others by weight.  In order of
cap / weight the capped sources come first, so running sums over the table of sources (one row
a source) give the level directly.

Defined results: a null text has size 0; null is a source of its own, last in order; repeated
rows (and rows that share a doc_id) are taken together; sources of size 0 have target 0; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
BITS, ROUNDS = 12, 5
#: Sources up to which their table is broadcast; beyond it Spark joins it as any table.
BROADCAST_SOURCES = 20_000


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, sk, source, size, h): what mixing needs of each row."""
    doc = F.col(id_col).cast("long")
    return docs.select(
        doc.alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")).alias("sk"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(C.WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(doc.cast("string"), F.concat(F.lit("text "), F.coalesce(F.col(text_col), F.lit("")))).cast("binary")), 1, 15), 16, 10).cast("long").alias("h"),
    )


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(sk, source, source_size, target) of each source; the windows run over one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n % len(weights) + 1).cast("int"))
    t = totals.withColumn("w", w).withColumn("top", F.lit(float(cap)) * F.col("source_size")).withColumn("r", F.col("top") / F.col("w"))
    fill = Window.orderBy("r", F.col("source").asc_nulls_last())
    t = t.withColumn("before", F.sum("top").over(fill.rowsBetween(Window.unboundedPreceding, 0)) - F.col("top"))
    t = t.withColumn("rest", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    all_rows = Window.partitionBy()
    t = t.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.col("before")) / F.col("rest"))
    level = F.max(F.when(F.col("level") < F.col("r"), F.col("level"))).over(all_rows)
    return t.withColumn("fill", level).select("sk", "source", "source_size", F.coalesce(F.least(F.col("top"), F.col("fill") * F.col("w")), F.col("top")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs."""
    rows = C.cut(sizes(docs, id_col, text_col, source_col))
    totals = C.cut(rows.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")))
    small = F.broadcast if totals.count() <= BROADCAST_SOURCES else (lambda df: df)
    t = targets(totals, weights, share, cap)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long")
    t = t.withColumn("passes", passes).withColumn("left", F.col("target") - F.col("passes") * F.col("source_size"))
    state = C.cut(t.withColumns({"prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "at": F.lit(0).cast("long")}))
    w = Window.partitionBy("sk").orderBy("bucket")
    for k in range(ROUNDS):
        shift = BITS * (ROUNDS - 1 - k)
        inside = rows.select("sk", "size", "h").where("size > 0").join(small(state.select("sk", "prefix")), "sk")
        inside = inside.where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = inside.groupBy("sk", F.shiftright("h", shift).bitwiseAND(2**BITS - 1).alias("bucket")).agg(F.sum("size").alias("n"))
        run = hist.withColumn("cum", F.sum("n").over(w)).join(small(state.select("sk", F.col("below").alias("base"), "left")), "sk")
        over = run.where(F.col("base") + F.col("cum") > F.col("left"))
        edge = over.groupBy("sk").agg(F.min(F.struct("bucket", "n", "cum", "base")).alias("e"))
        edge = edge.select("sk", F.col("e.bucket").alias("bucket"), F.col("e.n").alias("n"), (F.col("e.base") + F.col("e.cum") - F.col("e.n")).alias("under"))
        state = C.cut(
            state.join(edge, "sk", "left").select(
                "sk", "source_size", "target", "passes", "left", (F.col("prefix") * 2**BITS + F.coalesce("bucket", F.lit(0))).alias("prefix"), F.coalesce("under", "below").alias("below"), F.coalesce("n", F.lit(0)).alias("at")
            )
        )
    nearer = F.abs(F.col("below") + F.col("at") - F.col("left")) < F.abs(F.col("below") - F.col("left"))
    edge = state.select("sk", "source_size", "target", "passes", F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("threshold"))
    more = F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return rows.join(small(edge), "sk").select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("passes") + more)).alias("taken"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB's SQL, by sorting.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
r AS (
  SELECT *, CAST(CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, 2e0 * source_size AS top FROM s),
l AS (
  SELECT *, top / w AS r,
         (1.5e0 * sum(source_size) OVER () - (sum(top) OVER (ORDER BY top / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - top))
         / sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
f AS (SELECT *, max(CASE WHEN level < r THEN level END) OVER () AS fill FROM l),
t AS (SELECT *, coalesce(least(top, fill * w), top) AS target FROM f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS passes FROM t),
q AS (
  SELECT d.doc_id, d.size, d.h, p.source, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY source, h) AS same FROM q)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN upto <= rest OR (upto - same <= rest AND abs(upto - rest) < abs(upto - same - rest)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
