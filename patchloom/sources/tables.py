"""Input tables, read by Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchloom.shipping import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; Spark prunes columns and pushes filters into the scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
