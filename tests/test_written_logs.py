"""Each log is one file, its head first, however unevenly the parts of a union are packed."""

from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldweave.plans import source_queries


def test_heads_stay_with_their_lines(spark, tmp_path):
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(least)
    spark.conf.set(least, "16k")
    try:
        g = spark.range(60_000).select((F.col("id") % 40).alias("ds"), "id")
        g = g.withColumn("at", (F.row_number().over(Window.partitionBy("ds").orderBy("id")) - 1).cast("long"))
        rows = g.select("ds", "at", F.concat(F.lit("line "), "at").alias("value"))
        heads = g.select("ds").distinct().select("ds", F.lit(-1).cast("long").alias("at"), F.lit("head").alias("value"))
        source_queries.write_lines(rows.unionByName(heads), str(tmp_path / "logs"))
    finally:
        spark.conf.set(least, before)
    folders = list(Path(tmp_path / "logs").glob("ds=*"))
    assert len(folders) == 40
    for folder in folders:
        (file,) = folder.glob("*.txt")
        assert file.read_text().splitlines() == ["head", *[f"line {i}" for i in range(1500)]]
