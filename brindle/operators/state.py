"""State changes as functions from tables to tables: cascades, patches, upserts, recounts, refresh decisions.

Spark tables are not transactional: callers write the result to a new place and swap it in.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Non-null values of the changes replace those of the rows; keys that the rows lack are ignored."""
    fields = [c for c in changes.columns if c != key]
    joined = rows.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields]), key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changed keys are replaced, new ones added."""
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes)


def soft_delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """deleted = 1 where the key is among those gone."""
    marks = gone.select(key).distinct().withColumn("_gone", F.lit(1))
    return rows.join(marks, key, "left").withColumn("deleted", F.coalesce("_gone", "deleted")).drop("_gone")


def cascade(gone: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    return [soft_delete(t, gone, key) for t in tables]


def number(rows: DataFrame, group: str, index: str, order: list[str]) -> DataFrame:
    """Indexes for the rows that have none: after the largest of their group (from 0), in order."""
    by = Window.partitionBy(group, F.col(index).isNull()).orderBy(*order)
    top = F.coalesce(F.max(index).over(Window.partitionBy(group)), F.lit(-1))
    return rows.withColumn(index, F.coalesce(F.col(index), (top + F.row_number().over(by)).cast("int")))


def recount(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str) -> DataFrame:
    """Adds the number of children, 0 for none: aggregated before the join."""
    counts = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count("*").alias(name))
    return parents.join(counts, parent_key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def removed(count: Column, n: Column) -> Column:
    """A counter after removals, not below 0."""
    return F.greatest(count - n, F.lit(0))


def due(schedules: DataFrame, as_of: datetime, most: int | None = None) -> DataFrame:
    """Enabled schedules whose time has come (or is not set) and that no one holds, in order of time; ``most`` is the batch size."""
    now = F.lit(as_of).cast("timestamp_ntz")
    rows = schedules.where((F.col("enabled") == 1) & (F.col("next_run_time").isNull() | (F.col("next_run_time") <= now)) & (F.col("lock_until").isNull() | (F.col("lock_until") < now)))
    return rows if most is None else rows.orderBy(F.col("next_run_time").asc_nulls_first(), "id").limit(most)


def refresh(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """(key, decision) of sources (key, etag, last_modified, content_hash): 'unchanged' if etag or time of change are the same, else
    if the hash is; else 'changed', or 'new' without a previous state."""
    old = previous.select(key, *[F.col(c).alias(f"_old_{c}") for c in ("etag", "last_modified", "content_hash")], F.lit(True).alias("_known"))
    same = [F.col(c) == F.col(f"_old_{c}") for c in ("etag", "last_modified", "content_hash")]
    unchanged = F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False)) | F.coalesce(same[2], F.lit(False))
    return current.join(old, key, "left").select(key, F.when(F.col("_known").isNull(), "new").when(unchanged, "unchanged").otherwise("changed").alias("decision"))


def recover(rows: DataFrame, as_of: datetime, minutes: int) -> DataFrame:
    """Running rows not updated for so many minutes (10 at least) are failed."""
    limit = F.lit(as_of - timedelta(minutes=max(minutes, 10))).cast("timestamp_ntz")
    return rows.withColumn("status", F.when((F.col("status") == "RUNNING") & (F.col("update_time") < limit), "FAILED").otherwise(F.col("status")))
