"""Rebuilding conversations from message rows by pointer jumping.

Each message points to its parent (given, or the row before it in its conversation). Jumping pointers double their span
per round, so a conversation of n turns takes about log2(n) joins; what does not arrive at a first message is an orphan
(its topmost ancestor names a missing parent) or part of a cycle. Turns come out as rows in order, so that
no conversation is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hierarchy import climb
from ..session import keep
from .turns import blank, linked, turns


def positions(messages: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of (id, parent_id): (id, root, depth, orphan) of the messages that arrive at a first message or at one whose parent is
    missing, and (code, parent) of those on or below a cycle. Ids are unique and not null."""
    known = messages.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    links = messages.select("id", "parent_id").join(known, "parent_id", "left")
    links = keep(links.select(F.col("id").alias("code"), F.when(F.col("known"), F.col("parent_id")).alias("parent"), (F.col("parent_id").isNotNull() & F.col("known").isNull()).alias("lost")), "turn-links")
    arrived, circling = climb(links.select("code", "parent"), label="turns")
    lost = links.where("lost").select(F.col("code").alias("top"), F.lit(True).alias("orphan"))
    placed = arrived.join(lost, "top", "left").select(F.col("code").alias("id"), F.col("top").alias("root"), "depth", F.coalesce("orphan", F.lit(False)).alias("orphan"))
    return placed, circling


def placed(messages: DataFrame) -> DataFrame:
    """The rows that count with their place: (conversation_id, id, role, prev_role, blank, root, depth, orphan). The parent of a row
    is the row before it; root and depth are null for a row on or below a cycle."""
    rows = linked(turns(messages, blank=blank(F.col("content"))), ["id", "role"], "turn-rows")
    found, _ = positions(rows.select("id", F.col("prev_id").alias("parent_id")))
    return keep(rows.select("conversation_id", "id", "role", "prev_role", "blank").join(found, "id", "left"), "turns")


def verdicts(turn: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id, reason) of every live conversation id, from the rows of ``placed``; reason is null for a sound one, else
    the first of 'empty', 'broken', 'missing_reply' that holds. A conversation is sound if its rows are one path from a user's row
    at depth 0, user and assistant in turn; an orphan, a cycle, or rows that lead to several roots break it. All of it combines
    before the shuffle."""
    at = F.col("depth")
    flags = turn.groupBy("conversation_id").agg(
        F.min("blank").alias("blank"),
        F.max(at.isNull() | F.col("orphan") | F.col("role").isNull() | ((F.col("role") == "assistant") & ((at == 0) | (F.col("prev_role") == "assistant")))).alias("broken"),
        (F.min("root") != F.max("root")).alias("apart"),
        F.count_if(F.col("role") == "user").alias("asked"),
        F.count_if((F.col("role") == "assistant") & (at > 0) & (F.col("prev_role") == "user") & ~F.col("blank")).alias("answered"),
    )
    live = conversations.where((F.col("deleted") == 0) & F.col("conversation_id").isNotNull()).select("conversation_id").distinct()
    broken = F.coalesce("broken", F.lit(False)) | F.coalesce("apart", F.lit(False))
    reason = F.when(F.coalesce("blank", F.lit(True)), "empty").when(broken, "broken").when(F.col("asked") > F.col("answered"), "missing_reply")
    return live.join(flags, "conversation_id", "left").select("conversation_id", reason.alias("reason"))


def found(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id, reason) of the conversations to be dropped."""
    return verdicts(placed(messages), conversations).where("reason is not null")


def rebuilt(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """The sound conversations: conversation_id, turn (from 0), role, id; content joins by id."""
    turn = placed(messages)
    sound = verdicts(turn, conversations).where("reason is null").select("conversation_id")
    return turn.join(sound, "conversation_id", "left_semi").select("conversation_id", F.col("depth").alias("turn"), "role", "id")
