"""The registered queries over the machine-log tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldweave.plans import field_queries, log_queries, raster_queries, source_queries, survey_queries, terrain_queries

QUERIES = log_queries.QUERIES | field_queries.QUERIES | terrain_queries.QUERIES | survey_queries.QUERIES | source_queries.QUERIES | raster_queries.QUERIES
SQL = log_queries.SQL | field_queries.SQL | terrain_queries.SQL | survey_queries.SQL | source_queries.SQL | raster_queries.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rate pays best in each zone of each field, with every step checked elsewhere."""
    return log_queries.flagship_of(spark, sf_dir)
