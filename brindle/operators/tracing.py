"""Spans of traces: layout, depth, slowest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hierarchy import hierarchy


def extents(spans: DataFrame, trace: str) -> DataFrame:
    return spans.groupBy(trace).agg(F.min("start_time").alias("_begin"), F.max("end_time").alias("_end"))


def waterfall(spans: DataFrame, trace: str, id: str = "id", least: float = 0.5) -> DataFrame:
    """(trace, id, offset_pct, width_pct) to two decimals: place and length of each span within its trace, at least ``least`` wide
    and never beyond 100; an aggregate joined back, so that a trace of any number of spans needs no single task."""
    micros = lambda a, b: F.timestamp_diff("MICROSECOND", a, b).cast("double")
    rows = spans.where(F.col("start_time").isNotNull() & F.col("end_time").isNotNull())
    placed = rows.join(extents(rows, trace), trace)
    whole = F.greatest(micros(F.col("_begin"), F.col("_end")), F.lit(1.0))
    offset = F.least(F.lit(100.0), F.greatest(F.lit(0.0), micros(F.col("_begin"), F.col("start_time")) * 100 / whole))
    width = F.least(F.lit(100.0) - offset, F.greatest(F.lit(least), micros(F.col("start_time"), F.col("end_time")) * 100 / whole))
    return placed.select(trace, id, F.round(offset, 2).alias("offset_pct"), F.round(F.greatest(width, F.lit(0.0)), 2).alias("width_pct"))


def summary(spans: DataFrame, trace: str, id: str = "id") -> DataFrame:
    """(trace, spans, total_ms, avg_ms, slowest): the slowest by duration, then smallest id."""
    best = F.min(F.struct((-F.coalesce("duration_ms", F.lit(0))).alias("d"), F.col(id))).alias("b")
    made = spans.groupBy(trace).agg(F.count("*").alias("spans"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"), F.floor(F.coalesce(F.avg("duration_ms"), F.lit(0.0)) + 0.5).cast("bigint").alias("avg_ms"), best)
    return made.select(trace, "spans", "total_ms", "avg_ms", F.col(f"b.{id}").alias("slowest"))


def depths(nodes: DataFrame) -> DataFrame:
    """(node, depth) of spans (node, parent_node) of unique ids, by pointer doubling."""
    return hierarchy(nodes.select(F.col("node").alias("code"), F.col("parent_node").alias("parent")), with_paths=False).select(F.col("code").alias("node"), "depth")
