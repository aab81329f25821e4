"""Registered queries of the llm operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import conversations, leaks, neighbours, pairs, quantiles, spans, splitting, tokens
from .sql import SQL  # noqa: F401

MESSAGE = ("id", "conversation_id", "role", "content", "create_time", "deleted")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.found(table(spark, folder, "structured_document"))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All items as ordered pieces, by extent; the text is the part of the item between begin and end."""
    return splitting.pieces(table(spark, folder, "structured_document"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defects(table(spark, folder, "t_message", *MESSAGE))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.found(table(spark, folder, "t_rag_trace_run", "trace_id", "trace_name", "status", "start_time", "duration_ms", "deleted"))


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per trace_name over all days: the days' sketches, added up."""
    runs = quantiles.successful(table(spark, folder, "t_rag_trace_run", "trace_id", "trace_name", "status", "start_time", "duration_ms", "deleted"))
    days = quantiles.sketch(runs, ["trace_day", "trace_name"], "duration_ms")
    return quantiles.quantiles(quantiles.roll_up(days, ["trace_name"]), ["trace_name"], [5, 25, 50, 75, 95, 99])


def p5_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per trace_name by sketches, as to whether their rank in the table is right to within one in a hundred of the rows."""
    runs = quantiles.successful(table(spark, folder, "t_rag_trace_run", "trace_id", "trace_name", "status", "start_time", "duration_ms", "deleted"))
    made = quantiles.quantiles(quantiles.sketch(runs, ["trace_name"], "duration_ms"), ["trace_name"], [5, 25, 50, 75, 95, 99])
    rank = F.ceil(F.col("n") * F.col("q") / 100)
    within = (F.col("below") - F.col("n") / 100 < rank) & (rank <= F.col("upto") + F.col("n") / 100)
    return quantiles.ranks(made, runs, ["trace_name"], "duration_ms").select("trace_name", "q", "n", within.alias("within"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.found(table(spark, folder, "t_knowledge_vector", "id", "embedding"))


def p6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar vectors of every vector whose id is divisible by 100, out of the graph of all."""
    return neighbours.of_queries(table(spark, folder, "t_knowledge_vector", "id", "embedding"))


def p6_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar vectors to the same queries by greedy search of the graph."""
    vectors = table(spark, folder, "t_knowledge_vector", "id", "embedding")
    return neighbours.searched(vectors, F.expr("try_cast(id as decimal(38, 0)) % 100 = 0"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.found(table(spark, folder, "t_message", *MESSAGE), table(spark, folder, "t_conversation", "conversation_id", "deleted"))


def p7_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.rebuilt(table(spark, folder, "t_message", *MESSAGE), table(spark, folder, "t_conversation", "conversation_id", "deleted"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents", "doc_id", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.found(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_item", "item_id", "text"))


def p9_alignments(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.alignments(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_item", "item_id", "text"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.found(table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p5_found, p5_percentiles, p5_bounds, p6_found, p6_neighbours, p6_search, p7_found, p7_conversations, p8_ids, p9_found, p9_alignments, p10_found)}
