"""Cutting a plan that several later steps read, the folder for what is written on the way, and joins by cell."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where none is set a local session (tests) gets one of its own; a cluster has to name one, as
    executors do not share a machine's folders.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again.

    A checkpoint would keep the size that its plan was estimated at, which joins multiply from
    round to round; a table has the size it has, so small ones are joined without a shuffle.
    """
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame) -> DataFrame:
    """df for a join by cell or point, which sorts both sides and sends neither to the driver.

    Spark's estimates do not count the rows that explode adds, nor how tightly Parquet packs cells, so it
    would take tables of many million rows for small ones and broadcast them.
    """
    return df.hint("merge")
