"""Queries of the general problems: hierarchies (p3) and deliveries (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery, hierarchy
from ..tables import table

NODE_COLUMNS = ("id", "intent_code", "parent_code", "level", "update_time", "deleted")


def _tree(spark: SparkSession, folder: str, with_paths: bool) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.live_nodes(table(spark, folder, "t_intent_node", *NODE_COLUMNS)), with_paths)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.findings(_tree(spark, folder, False))


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Each live node with its place: kind, root, depth and full path."""
    return _tree(spark, folder, True).select(F.col("code").alias("intent_code"), "kind", F.col("root").alias("root_code"), "depth", F.array_join("path", "/").alias("path"))


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(_tree(spark, folder, True))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "message_feedback_event", "delivery_id", "message_id", "user_id", "submit_time", "received_at")
    return delivery.surplus_deliveries(rows, delivery.FEEDBACK_KEY).select("delivery_id")


def p4_events(spark: SparkSession, folder: str) -> DataFrame:
    """The kept delivery of each event, whole."""
    rows = table(spark, folder, "message_feedback_event")
    return delivery.distinct_events(rows, delivery.FEEDBACK_KEY).select("delivery_id", "batch_id", "message_id", "user_id", "vote", "reason", "comment_text", "submit_time", "received_at")


def p4_new(spark: SparkSession, folder: str) -> DataFrame:
    """The events of half of the batches that the other half, which stands for what is stored, does not hold."""
    rows = table(spark, folder, "message_feedback_event", "delivery_id", "batch_id", "message_id", "user_id", "submit_time", "received_at")
    late = F.coalesce(F.md5("batch_id") < "8", F.lit(False))
    return delivery.new_events(rows.where(late), rows.where(~late), delivery.FEEDBACK_KEY).select("delivery_id", "batch_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_paths, p3_descendants, p4_found, p4_events, p4_new)}

_NODES = r"""
WITH RECURSIVE latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY update_time DESC NULLS LAST) AS rn FROM t_intent_node) WHERE rn = 1 AND deleted = 0),
nodes AS (SELECT intent_code AS code, level, nullif(lower(regexp_replace(parent_code, '^\s+|\s+$', '', 'g')), '') AS named FROM latest),
links AS (SELECT n.code, n.level, p.code AS parent, n.named IS NOT NULL AND p.code IS NULL AS lost FROM nodes n LEFT JOIN nodes p ON n.named = p.code),
climb AS (
  SELECT code, code AS here, 0::BIGINT AS depth, [code] AS up FROM links
  UNION ALL
  SELECT c.code, l.parent, c.depth + 1, list_append(c.up, l.parent) FROM climb c JOIN links l ON c.here = l.code WHERE l.parent IS NOT NULL AND NOT list_contains(c.up, l.parent)),
ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY depth DESC) AS rn FROM climb) WHERE rn = 1),
placed AS (
  SELECT e.code, n.level, t.parent IS NOT NULL AS circling, t.lost, e.here, e.depth, e.up, list_position(e.up, t.parent) AS ring
  FROM ends e JOIN links t ON e.here = t.code JOIN links n ON e.code = n.code),
tree AS (
  SELECT code, level, CASE WHEN circling AND ring = 1 THEN 'on_cycle' WHEN circling THEN 'below_cycle' WHEN lost THEN 'orphan' ELSE 'tree' END AS kind,
    CASE WHEN circling THEN list_min(up[ring:]) ELSE here END AS root, CASE WHEN circling THEN ring - 1 ELSE depth END::BIGINT AS depth,
    CASE WHEN circling THEN list_reverse(up[:ring]) ELSE list_reverse(up) END AS path
  FROM placed)
"""

SQL = {
    "p3_found": _NODES + """
SELECT code AS intent_code, CASE WHEN kind <> 'tree' THEN kind ELSE 'level' END AS finding, root AS root_code, depth FROM tree
WHERE kind <> 'tree' OR level IS NULL OR level <> depth""",
    "p3_paths": _NODES + "SELECT code AS intent_code, kind, root AS root_code, depth, array_to_string(path, '/') AS path FROM tree",
    "p3_descendants": _NODES + "SELECT path[i] AS ancestor, code AS descendant, (len(path) - i)::BIGINT AS distance FROM (SELECT code, path, unnest(range(1, len(path))) AS i FROM tree)",
    "p4_found": r"""
SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY regexp_replace(message_id, '^\s+|\s+$', '', 'g'), regexp_replace(user_id, '^\s+|\s+$', '', 'g'), submit_time
  ORDER BY received_at, delivery_id) AS rn FROM message_feedback_event) WHERE rn > 1""",
    "p4_new": r"""
WITH k AS (SELECT delivery_id, batch_id, received_at, coalesce(md5(batch_id) < '8', false) AS late, regexp_replace(message_id, '^\s+|\s+$', '', 'g') AS m, regexp_replace(user_id, '^\s+|\s+$', '', 'g') AS u, submit_time AS s FROM message_feedback_event),
r AS (SELECT *, row_number() OVER (PARTITION BY m, u, s ORDER BY received_at, delivery_id) AS rn FROM k WHERE late)
SELECT delivery_id, batch_id FROM r WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE NOT late AND k.m IS NOT DISTINCT FROM r.m AND k.u IS NOT DISTINCT FROM r.u AND k.s IS NOT DISTINCT FROM r.s)""",
    "p4_events": r"""
SELECT delivery_id, batch_id, message_id, user_id, vote, reason, comment_text, submit_time, received_at FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(message_id, '^\s+|\s+$', '', 'g'),
  regexp_replace(user_id, '^\s+|\s+$', '', 'g'), submit_time ORDER BY received_at, delivery_id) AS rn FROM message_feedback_event) WHERE rn = 1""",
}
