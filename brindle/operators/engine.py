"""The retrieval engine: channels by priority, then processors in order; and retrieval of sub-questions.

A channel is a plan over all requests at once. Each channel's rows are written before the next step, so that a channel that fails, in
planning or in running, counts as empty and takes nothing with it; a processor that fails is skipped.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..session import keep
from .retrieval import metadata

LOG = logging.getLogger(__name__)
CANDIDATES = "request string, key string, id string, channel string, position int, score double"
# Multipliers and thresholds of the channels, and the rows of a question whose intents name none.
DIRECTED_TIMES, GLOBAL_TIMES, DIRECTED_LEAST, GLOBAL_BELOW, TOP_K = 2, 3, 0.4, 0.6, 10


@dataclass(frozen=True)
class Channel:
    """``enabled`` is a condition on the requests; ``search`` makes (request, key, id, position, score) of those it holds for."""

    name: str
    priority: int
    search: Callable[[DataFrame], DataFrame]
    enabled: Column | None = None


def retrieve(requests: DataFrame, channels: list[Channel], processors: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The candidates of all channels, passed through the processors. A channel's rows carry its name; without channels, or if all
    fail, the processors get no rows."""
    spark, found = requests.sparkSession, None
    for channel in sorted(channels, key=lambda c: (c.priority, c.name)):
        try:
            asked = requests if channel.enabled is None else requests.where(channel.enabled)
            rows = channel.search(asked).withColumn("channel", F.lit(channel.name)).select("request", "key", "id", "channel", F.col("position").cast("int"), F.col("score").cast("double"))
            rows = keep(rows, f"channel-{channel.name.lower()}")
        except Exception as error:  # whatever a channel runs into, the others count
            LOG.warning("channel %s failed: %s", channel.name, str(error)[:200])
            continue
        found = rows if found is None else found.unionByName(rows)
    found = spark.createDataFrame([], CANDIDATES) if found is None else found
    for process in processors:
        try:
            done = process(found)
            done.schema  # a plan that can't be made fails here
            found = done
        except Exception as error:
            LOG.warning("processor %s skipped: %s", getattr(process, "__name__", process), str(error)[:200])
    return found


def searched(vectors: DataFrame, requests: DataFrame, places: int = 6) -> DataFrame:
    """(request, id, collection_name, score, position) of the best ``k`` rows of each request (request, vector, k[, collection_name]),
    per collection: of the collection it names, or of each. Rows of one id count once."""
    rows = vectors.select("id", metadata("collection_name").alias("collection_name"), "embedding")
    every = "collection_name" not in requests.columns
    ask = requests.select("request", "vector", "k", *([] if every else ["collection_name"]))
    both = rows.join(F.broadcast(ask)) if every else rows.join(ask, "collection_name")  # requests are a stated set, and small
    scored = both.where(F.size("embedding") == F.size("vector")).select("request", "id", "collection_name", "k", F.round(cosine(F.col("embedding").cast("array<double>"), F.col("vector")), places).alias("score"))
    one = scored.where("score is not null").groupBy("request", "id", "collection_name", "k").agg(F.max("score").alias("score"))
    by = Window.partitionBy("request", "collection_name").orderBy(F.col("score").desc(), "id")
    return one.withColumn("position", F.row_number().over(by)).where(F.col("position") <= F.col("k")).drop("k")


def directed(vectors: DataFrame, intents: DataFrame, k: int = TOP_K, times: int = DIRECTED_TIMES, least: float = DIRECTED_LEAST) -> Callable[[DataFrame], DataFrame]:
    """The channel of the intents (request, item, collection_name, top_k, score): each intent of enough score searches its collection
    for its own top_k (if positive, else k) times ``times`` (if positive)."""

    def search(requests: DataFrame) -> DataFrame:
        own = F.when(F.col("top_k") > 0, F.col("top_k")).otherwise(k) * (times if times > 0 else 1)
        ask = requests.select("request", "vector").join(intents.where(F.col("score") >= least).select("request", "item", "collection_name", own.alias("k")), "request")
        # a request's intents of one collection share the widest search of it
        wide = ask.groupBy("request", "collection_name").agg(F.max("k").alias("k"), F.first("vector").alias("vector"))
        return searched(vectors, wide).withColumn("key", F.col("id"))

    return search


def everywhere(vectors: DataFrame, collections: DataFrame, k: int = TOP_K, times: int = GLOBAL_TIMES) -> Callable[[DataFrame], DataFrame]:
    """The global channel: the best k * times of each live collection."""

    def search(requests: DataFrame) -> DataFrame:
        rows = vectors.join(F.broadcast(collections.select("collection_name").distinct()), metadata("collection_name") == F.col("collection_name"), "left_semi")  # a row a knowledge base
        return searched(rows, requests.select("request", "vector", F.lit(k * (times if times > 0 else 1)).alias("k"))).withColumn("key", F.col("id"))

    return search


def first_seen(rows: DataFrame, group: str, value: str, order: list[Column]) -> DataFrame:
    """(group, value, place): the distinct values of each group in the order in which they first appear."""
    one = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(F.struct(*order)).alias("_o"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_o", value))).drop("_o")


def question_k(intents: DataFrame, least: float = 0.35, k: int = TOP_K) -> DataFrame:
    """(question, k): the largest positive top_k of a question's knowledge intents (kind 0 or null, score enough), else ``k``."""
    good = (F.col("score") >= least) & (F.coalesce("kind", F.lit(0)) == 0)
    return intents.groupBy("question").agg(F.coalesce(F.max(F.when(good & (F.col("top_k") > 0), F.col("top_k"))), F.lit(k)).cast("int").alias("k"))


def for_questions(intents: DataFrame, rows: DataFrame, least: float = 0.35, k: int = TOP_K, shared: str = "multi_channel") -> DataFrame:
    """(question, item, id, slot): the first k rows (question, id, slot) of each question, given to every one of its knowledge
    intents, or to ``shared`` where it has none."""
    good = intents.where((F.col("score") >= least) & (F.coalesce("kind", F.lit(0)) == 0)).select("question", "item").distinct()
    kept = rows.join(question_k(intents, least, k), "question", "left").where(F.col("slot") <= F.coalesce("k", F.lit(k))).drop("k")
    return kept.join(good, "question", "left").select("question", F.coalesce("item", F.lit(shared)).alias("item"), "id", "slot")


def plan_of_prompt(intents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question, scene, template): of the intents (question, item, kind, template) those that have chunks (question, item) or are
    tools (kind 2) stay; scene is KB_ONLY, MCP_ONLY, MIXED or EMPTY; a single intent that stays brings its own template, if any."""
    has = chunks.select("question", "item").distinct().withColumn("_has", F.lit(True))
    left = intents.join(has, ["question", "item"], "left").withColumn("_stays", (F.col("kind") == 2) | F.coalesce("_has", F.lit(False)))
    kb, tool = F.count_if(F.col("_stays") & (F.coalesce("kind", F.lit(0)) == 0)), F.count_if(F.col("_stays") & (F.col("kind") == 2))
    scene = F.when((kb > 0) & (tool > 0), "MIXED").when(kb > 0, "KB_ONLY").when(tool > 0, "MCP_ONLY").otherwise("EMPTY")
    own = F.when(F.count_if(F.col("_stays")) == 1, F.max(F.when(F.col("_stays") & (F.trim("template") != ""), F.col("template"))))
    return left.groupBy("question").agg(scene.alias("scene"), own.alias("template"))
