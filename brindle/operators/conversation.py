"""Conversation memory and feedback state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .delivery import event_key


def last_turns(messages: DataFrame, n: int) -> DataFrame:
    """The last n rows per conversation by (create_time, id), with ``back`` (1 is the last). The limit applies before the shuffle."""
    order = Window.partitionBy("conversation_id").orderBy(F.col("create_time").desc(), F.col("id").desc())
    return messages.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)


def history(messages: DataFrame, turns: int) -> DataFrame:
    """The last 2 * turns user and assistant rows per conversation, without assistant rows before the first user row; seq from 1."""
    some = last_turns(messages.where(F.col("role").isin("user", "assistant")), 2 * turns)
    order = Window.partitionBy("conversation_id").orderBy(F.col("back").desc())
    begun = F.max(F.col("role") == "user").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return some.withColumn("_begun", begun).where("_begun").withColumn("seq", F.row_number().over(order)).drop("_begun", "back")


def compaction(messages: DataFrame, summaries: DataFrame, trigger: int, keep: int) -> DataFrame:
    """(conversation_id, after_id, before_id, rows): what to sum up in conversations with at least ``trigger`` user rows: the rows
    after the last summarised one and before the oldest of the latest ``keep`` user rows, both excluded. Conversations with nothing
    to sum up are left out."""
    users = messages.where(F.col("role") == "user")
    many = users.groupBy("conversation_id").agg(F.count("*").alias("asked")).where(F.col("asked") >= trigger).select("conversation_id")
    cut = last_turns(users, keep).where(F.col("back") == keep).select("conversation_id", F.col("id").alias("before_id"))
    last = summaries.groupBy("conversation_id").agg(F.max("last_message_id").alias("after_id"))
    span = many.join(cut, "conversation_id").join(last, "conversation_id", "left")
    inside = messages.join(span, "conversation_id").where((F.col("id") < F.col("before_id")) & (F.col("after_id").isNull() | (F.col("id") > F.col("after_id"))))
    return inside.groupBy("conversation_id", "after_id", "before_id").agg(F.count("*").alias("rows"))


def latest_votes(feedback: DataFrame) -> DataFrame:
    """(message_id, user_id, vote, reason, submit_time) per message and user of the latest submission; a later arrival with an
    earlier submit time does not overwrite. Both ids lose outer white space, as events do. Ties: the first received, then the smallest delivery_id."""
    rank = F.struct((-F.col("submit_time")).alias("s"), F.col("received_at"), F.col("delivery_id"), F.col("vote"), F.col("reason"))
    key = [k.alias(c) for k, c in zip(event_key({"message_id": True, "user_id": True}), ("message_id", "user_id"), strict=True)]
    last = feedback.select(*key, rank.alias("r")).groupBy("message_id", "user_id").agg(F.min("r").alias("r"))
    return last.select("message_id", "user_id", "r.vote", "r.reason", (-F.col("r.s")).alias("submit_time"))


def with_votes(messages: DataFrame, votes: DataFrame) -> DataFrame:
    """Messages with the vote of their user; only assistant rows have one."""
    own = votes.select(F.col("message_id").alias("id"), "user_id", "vote")
    return messages.join(own, ["id", "user_id"], "left").withColumn("vote", F.when(F.col("role") == "assistant", F.col("vote")))
