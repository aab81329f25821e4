"""Vector tables as Parquet, one directory per collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_UNITS = 65_535


def prepared(chunks: DataFrame, dim: int) -> DataFrame:
    """Checks the length of every vector (a wrong one fails the job) and cuts the content to what a store holds."""
    good = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("wrong vector length for "), F.col("id"))).cast("array<float>"))
    return chunks.withColumn("embedding", good).withColumn("content", F.substring("content", 1, MOST_UNITS))


def assembled(metadata: Column, collection: Column, doc_id: Column, index: Column) -> Column:
    """Chunk metadata (map) with collection_name, doc_id and chunk_index written over it."""
    names = ["collection_name", "doc_id", "chunk_index"]
    own = F.create_map(*[x for n, c in zip(names, (collection, doc_id, index), strict=True) for x in (F.lit(n), c.cast("string"))])
    return F.map_concat(F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(names)), own)


def append(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("append").partitionBy("collection_name").parquet(path)


def read(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """A collection's rows; other directories are not read."""
    rows = spark.read.parquet(path)
    return rows if collection is None else rows.where(F.col("collection_name") == collection)


def rewritten(rows: DataFrame, path: str) -> None:
    """Replaces the collections that occur in the rows, each as a whole. The rows must not be read from the same place lazily."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection_name").parquet(path)


def without_document(rows: DataFrame, doc_id: str) -> DataFrame:
    return rows.where(~F.coalesce(F.get_json_object("metadata", "$.doc_id") == doc_id, F.lit(False)))


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti")


def replaced(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Upsert by id."""
    return without_ids(rows, chunks).unionByName(chunks)
