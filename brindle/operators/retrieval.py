"""Vector and multi-channel retrieval.

Rankings never carry texts or vectors through a shuffle: rows are scored at the scan, cut to ids and scores, ranked with a
row limit (which Spark applies before the shuffle), and texts are joined back by id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine

# Order of the channels; names that are not listed come last.
PRIORITY = {"INTENT_DIRECTED": 1, "KEYWORD_ES": 2, "VECTOR_GLOBAL": 3}
LAST = 99


class Channel(Protocol):
    """A source of candidates (request, id, score, position)."""

    name: str

    def enabled(self, request: dict) -> bool: ...

    def search(self, request: dict) -> DataFrame: ...


#: A post-processor of candidates, for ``DataFrame.transform``.
Processor = Callable[[DataFrame], DataFrame]


def metadata(name: str) -> Column:
    return F.get_json_object("metadata", f"$.{name}")


def scored(vectors: DataFrame, query: list[float], places: int = 6) -> DataFrame:
    """(id, collection_name, score) of the rows whose vector has the query's length; rows of one id count once, the best."""
    vector = F.lit([float(x) for x in query]).cast("array<double>")
    rows = vectors.where(F.size("embedding") == len(query)).select("id", metadata("collection_name").alias("collection_name"), F.round(cosine(F.col("embedding"), vector), places).alias("score"))
    return rows.where("score is not null").groupBy("id", "collection_name").agg(F.max("score").alias("score"))


def search(vectors: DataFrame, query: list[float], k: int, collection: str | None = None, default: str | None = None) -> DataFrame:
    """The k rows of a collection (a blank name means the default, and none all) of highest cosine, ties by id."""
    name = (collection or "").strip() or default
    rows = vectors if name is None else vectors.where(metadata("collection_name") == name)
    return scored(rows, query).orderBy(F.col("score").desc(), "id").limit(k)


def search_each(vectors: DataFrame, query: list[float], k: int, collections: DataFrame | None = None) -> DataFrame:
    """The best k of every collection; with a table (collection_name[, k]) of those, k per collection if it has the column."""
    rows = scored(vectors, query)
    most: Column = F.lit(k)
    if collections is not None:
        rows = rows.join(collections, "collection_name")
        most = F.coalesce(F.col("k"), most) if "k" in collections.columns else most
    rank = F.row_number().over(Window.partitionBy("collection_name").orderBy(F.col("score").desc(), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("collection_name", "id", "score", "rank")


def gates(scores: DataFrame, request: str = "request", score: str = "score", directed: float = 0.4, confident: float = 0.6) -> DataFrame:
    """Per request: whether the directed channel has an intent of enough score, its confidence, and whether the global channel is
    on (no score at all, or none that is confident)."""
    best = scores.groupBy(request).agg(F.max(score).alias("best"))
    return best.select(request, F.coalesce(F.col("best") >= directed, F.lit(False)).alias("directed_on"), F.coalesce("best", F.lit(0.0)).alias("directed_confidence"), F.coalesce(F.col("best") < confident, F.lit(True)).alias("global_on"), F.lit(0.7).alias("global_confidence"))


def union_channels(results: list[DataFrame]) -> DataFrame:
    """All candidates of all channels, in no order; positions carry the order."""
    return reduce(DataFrame.unionByName, results)


def channel_priority(channel: Column) -> Column:
    order = F.lit(LAST)
    for name, priority in PRIORITY.items():
        order = F.when(channel == name, priority).otherwise(order)
    return order


def deduplicate(candidates: DataFrame, request: str = "request", key: str = "key") -> DataFrame:
    """One row per request and key, from (request, key, id, channel, position, score): the slot of its first appearance by channel
    priority and position, the content of its highest score (of equals the first). slot counts from 1; not sorted by score.

    Both are minima of structs, combined before the shuffle.
    """
    place = F.struct(channel_priority(F.col("channel")).alias("p"), F.col("position"), F.col("id"))
    best = F.struct((-F.col("score")).alias("s"), channel_priority(F.col("channel")).alias("p"), F.col("position"), F.col("id"))
    one = candidates.groupBy(request, key).agg(F.min(place).alias("first"), F.min(best).alias("best"))
    slot = F.row_number().over(Window.partitionBy(request).orderBy("first", key))
    return one.select(request, key, F.col("best.id").alias("id"), (-F.col("best.s")).alias("score"), slot.alias("slot"))


def rerank_noop(rows: DataFrame, top: int, request: str = "request", position: str = "slot") -> DataFrame:
    """The first rows in the order given."""
    return rows.where(F.col(position) <= top)


def rerank(rows: DataFrame, top: int, request: str = "request", position: str = "slot", score: str = "model_score") -> DataFrame:
    """By a model's score, filled up with rows that it gave none in the order given; if top is not positive or no more rows than
    that exist, all rows as given. rank counts from 1."""
    by = Window.partitionBy(request)
    given = F.row_number().over(by.orderBy(position))
    model = F.row_number().over(by.orderBy(F.col(score).desc_nulls_last(), position))
    few = F.count("*").over(by) <= top if top > 0 else F.lit(True)
    return rows.withColumn("rank", F.when(few, given).otherwise(model)).where((F.col("rank") <= top) if top > 0 else F.lit(True))


def contexts(rows: DataFrame, request: str = "request", order: str = "slot", text: str = "text", separator: str = "\n") -> DataFrame:
    """(request, context): the texts of each request in order, which must be cut to a top k before; null texts are left out."""
    listed = F.sort_array(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
    return rows.groupBy(request).agg(F.array_join(F.transform(listed, lambda x: x[text]), separator).alias("context"))
