"""Messages delivered at least once: keep exactly one copy of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hierarchy import SPACE


def event_key(columns: dict[str, bool]) -> list[F.Column]:
    """Key columns; those marked True are identifiers and lose outer white space. Null is a value of its own."""
    return [(F.regexp_replace(F.col(c), SPACE, "") if ident else F.col(c)).alias(f"_k{i}") for i, (c, ident) in enumerate(columns.items())]


def kept_deliveries(rows: DataFrame, key: dict[str, bool], arrival: str = "received_at", delivery: str = "delivery_id") -> DataFrame:
    """(_k0.., delivery) of the copy to keep of each event: earliest arrival, then smallest delivery id.

    This is rank 1 by (arrival, delivery) within each event, taken as a minimum, which is combined before the shuffle: an event
    with a third of all deliveries costs one row per map task. A null arrival counts as later than any.
    """
    rank = F.struct(F.col(arrival).isNull().alias("late"), F.col(arrival).alias("at"), F.col(delivery).alias("delivery"))
    names = [f"_k{i}" for i in range(len(key))]
    return rows.select(*event_key(key), rank.alias("r")).groupBy(*names).agg(F.min("r").alias("r")).select(*names, F.col("r.delivery").alias("_kept"))


def distinct_events(rows: DataFrame, key: dict[str, bool], arrival: str = "received_at", delivery: str = "delivery_id") -> DataFrame:
    """The kept rows, whole. ``delivery`` must be unique."""
    return rows.join(kept_deliveries(rows, key, arrival, delivery).select(F.col("_kept").alias(delivery)), delivery, "left_semi")


def surplus_deliveries(rows: DataFrame, key: dict[str, bool], arrival: str = "received_at", delivery: str = "delivery_id") -> DataFrame:
    """The rows that are not kept. ``delivery`` must be unique."""
    return rows.join(kept_deliveries(rows, key, arrival, delivery).select(F.col("_kept").alias(delivery)), delivery, "left_anti")


def new_events(batch: DataFrame, stored: DataFrame, key: dict[str, bool], arrival: str = "received_at", delivery: str = "delivery_id") -> DataFrame:
    """Of a new batch the kept rows of events that are not among the stored rows (null-safe on every part of the key)."""
    fresh = distinct_events(batch, key, arrival, delivery).withColumns({f"_k{i}": c for i, c in enumerate(event_key(key))})
    old = stored.select(*event_key(key)).distinct()
    names = [f"_k{i}" for i in range(len(key))]
    old = old.select(*[F.col(n).alias(f"_o{n}") for n in names])
    same = [F.col(n).eqNullSafe(F.col(f"_o{n}")) for n in names]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return fresh.join(old, condition, "left_anti").drop(*names)


FEEDBACK_KEY = {"message_id": True, "user_id": True, "submit_time": False}
