"""The driver's Parquet tables, pruned to what a query names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table, or the named columns of it."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def active(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted; the predicate reaches the Parquet scan."""
    return df.where(F.col("deleted") == 0)
