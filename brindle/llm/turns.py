"""Chat rows as ordered turns: one row per id, roles in one spelling, the row before each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hierarchy import SPACE
from ..operators.ordering import with_previous


def role(column: F.Column) -> F.Column:
    """user, assistant or system; null for any other role."""
    name = F.lower(F.regexp_replace(column, SPACE, ""))
    return F.when(name.isin("user", "human"), "user").when(name.isin("assistant", "bot", "ai"), "assistant").when(name == "system", "system")


def blank(column: F.Column) -> F.Column:
    """Null, or without a letter or digit."""
    return ~F.coalesce(column.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def turns(messages: DataFrame, **more: F.Column) -> DataFrame:
    """(conversation_id, id, create_time, role, *more) of the rows that count: deleted = 0, one per id, no system rows.

    Deliveries of one id hold the same fields; should they differ, the smallest create_time with its row counts. Rows
    without an id do not count.
    """
    rows = messages.where((F.col("deleted") == 0) & F.col("id").isNotNull()).select("id", "conversation_id", "create_time", role(F.col("role")).alias("role"), *[c.alias(n) for n, c in more.items()])
    one = rows.groupBy("id").agg(F.min(F.struct("create_time", "conversation_id", "role", *more)).alias("t"))
    return one.select("id", "t.create_time", "t.conversation_id", "t.role", *[F.col(f"t.{n}").alias(n) for n in more]).where("role is null or role <> 'system'")


def linked(rows: DataFrame, carry: list[str], label: str, only: F.Column | None = None) -> DataFrame:
    """``turns`` with prev_<c> of the row before in the conversation."""
    return with_previous(rows, "conversation_id", ["create_time", "id"], carry, label, only)
