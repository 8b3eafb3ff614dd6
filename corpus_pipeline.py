"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. toxicity: rows that score at or above the threshold go;
2. SimHash near-dedup: of each component (fingerprints within 3 bits, or a Jaccard similarity of 0.8
   of five-word shingles) the row of least doc_id stays;
3. substring dedup: words of passages that also start earlier go, an unchanged text stays as it is;
4. decontamination: rows in which a benchmark window occurs go;
5. mixing: what the mix takes of each row that is left.

All stages but the last return the columns of ``documents``, whatever their names.  Rows with one
doc_id and one text are one component in stage 2, of which the row of least hash over all columns
stays; a row without a doc_id stays only if its component has no row with one.  Null and empty
texts are not toxic, are one component, and hold no passages; very long texts are read whole; an
empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.llm import common as C
from fieldweave.llm import decontaminate, mixing, simhash, substring_dedup
from fieldweave.llm import toxicity as tox


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic rows; the classifier learns from the labels of rows outside the held-out fold."""
    return tox.reject_toxic(docs, C.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each SimHash component."""
    return simhash.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages; n_chars follows the text where it changed."""
    before = C.fresh(docs, "before")
    out = substring_dedup.dedup_substrings(docs.withColumn(before, F.length("text")))
    changed = F.length("text") != F.col(before)
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(before)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows with benchmark passages."""
    return decontaminate.clean_documents(docs, C.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each row."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: SQL cannot express the classifier and the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read by the next."""
    docs = C.table(spark, sf_dir, "documents")
    folder = f"{C.shared_dir(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
