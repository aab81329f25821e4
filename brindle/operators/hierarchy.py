"""Parent-child links to full hierarchies by pointer doubling.

Each round joins the pointers that have not yet arrived with the pointers of the rows they name, so the distance
that a pointer spans doubles and a tree of depth d takes about log2(d) rounds. Rows that do not arrive at a top
lead into a cycle. Arrived rows take no more steps; they are only looked up. No group is gathered: a parent with a third of all
rows as children is one hot join key whose other side has one row, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import counted, drop, keep

SPACE = r"^[\s\u0085\u00a0\u2000-\u200a\u2028\u2029\u202f\u3000]+|[\s\u0085\u00a0\u2000-\u200a\u2028\u2029\u202f\u3000]+$"


def clean_code(column) -> F.Column:
    """Trimmed (any white space) and lower-cased; blank becomes null."""
    text = F.lower(F.regexp_replace(column, SPACE, ""))
    return F.when(text != "", text)


def live_nodes(rows: DataFrame, code: str = "intent_code", parent: str = "parent_code", id: str = "id", version: str = "update_time", deleted: str = "deleted", keep_columns: tuple[str, ...] = ("level",)) -> DataFrame:
    """(code, parent, *keep_columns) of the latest state of each id, without deleted ones.

    Of equal update times the largest row (by its columns) counts, nulls first, so that the choice is fixed. Rows
    without a code are no nodes. Of several live ids with one code the smallest id counts.
    """
    rest = [c for c in dict.fromkeys((code, parent, *keep_columns))]
    state = F.struct(F.col(version), F.col(deleted), *[F.col(c) for c in rest])
    latest = rows.groupBy(F.col(id).alias("_id")).agg(F.max(state).alias("s")).where((F.col(f"s.{deleted}") == 0) & F.col(f"s.{code}").isNotNull())
    nodes = latest.select("_id", F.col(f"s.{code}").alias("code"), clean_code(F.col(f"s.{parent}")).alias("parent"), *[F.col(f"s.{c}").alias(c) for c in keep_columns])
    one = nodes.groupBy("code").agg(F.min(F.struct("_id", "parent", *keep_columns)).alias("n"))
    return one.select("code", F.col("n.parent").alias("parent"), *[F.col(f"n.{c}").alias(c) for c in keep_columns])


def climb(links: DataFrame, with_paths: bool = False, label: str = "climb") -> tuple[DataFrame, DataFrame | None]:
    """Follow the pointers (code, parent) of unique codes to their tops; parent is null at a top and otherwise names a code.

    Returns (code, top, depth[, path]) of the rows that arrive, path from the top to the row, and (code, parent) of the
    rows that do not (None if all arrive). Stops in the round in which no row arrives: depths have no gaps, so none is
    deeper. A round is one job, which counts what it writes; rows that wait and rows that have arrived are written apart.
    """
    path, parts = (["path"], ["head"]) if with_paths else ([], [])
    still = {"left": F.count_if(F.col("at").isNotNull())}
    seed = links.select("code", "parent", F.when(F.col("parent").isNull(), F.col("code")).alias("top"), F.col("parent").alias("at"), F.col("parent").isNotNull().cast("bigint").alias("steps"), *([F.array("code").alias("path")] if with_paths else []), F.col("parent").isNull().alias("gone"))
    step, seen = counted(seed, f"{label}-0", "gone", **still)
    arrived, left, turn = None, seen.left, 0
    while True:
        fresh = step.where("gone").select("code", "top", F.col("steps").alias("depth"), *path)
        arrived = fresh if arrived is None else arrived.unionByName(fresh)
        if not left:
            return arrived, None
        turn += 1
        waiting = step.where("not gone").select("code", "parent", "at", "steps", *path)
        # a waiting pointer meets either a row that has arrived or the pointer of a row that waits too
        met = arrived.select(F.col("code").alias("at"), "top", F.col("depth").alias("more"), F.lit(None).cast("string").alias("next"), *[F.col(c).alias("head") for c in path])
        met = met.unionByName(waiting.select(F.col("code").alias("at"), F.lit(None).cast("string").alias("top"), F.col("steps").alias("more"), F.col("at").alias("next"), *[F.col(c).alias("head") for c in path]))
        joined = waiting.join(met, "at").select("code", "parent", "top", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), *[F.concat(h, p).alias(p) for h, p in zip(parts, path, strict=True)], F.col("top").isNotNull().alias("gone"))
        step, seen = counted(joined, f"{label}-{turn}", "gone", **still)
        if seen.left == left:
            return arrived, step.select("code", "parent")
        left = seen.left


def cycles(links: DataFrame, label: str = "cycle") -> DataFrame:
    """(code, root): the rows on a cycle and the smallest code of it, of links that all lead into cycles.

    Pointers double until as many rows are rested on as a round before (then every pointer rests on a cycle, and each row of
    a cycle is rested on) and no minimum over the steps taken has changed (then it is the minimum of the cycle).
    """
    turn, rested = 0, -1
    state = keep(links.select("code", F.col("parent").alias("at"), F.col("code").alias("least")), f"{label}-0")
    while True:
        turn += 1
        step = state.join(state.select(F.col("code").alias("at"), F.col("at").alias("next"), F.col("least").alias("other")), "at")
        step, seen = counted(step.select("code", F.col("next").alias("at"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("changed")), f"{label}-{turn}", changed=F.count_if(F.col("changed")))
        drop(state)
        state = step
        if not seen.changed:
            now = state.agg(F.count_distinct("at")).first()[0]
            if now == rested:
                break
            rested = now
    return state.join(state.select(F.col("at").alias("code")).distinct(), "code", "left_semi").select("code", F.col("least").alias("root"))


def hierarchy(nodes: DataFrame, with_paths: bool = True) -> DataFrame:
    """One row per node: code, parent, kind ('tree', 'orphan', 'on_cycle', 'below_cycle'), root, depth[, path], and nodes' other columns.

    kind 'orphan': the topmost live ancestor (or the node) names a parent that is no node; root is that ancestor and
    depth the steps up to it. 'on_cycle': root is the smallest code of the cycle, depth 0. 'below_cycle': root is the
    smallest code of the cycle that the ancestors lead into, depth the steps up to the cycle. path leads from the
    root (below a cycle: from the row of the cycle) to the node. An empty table gives an empty result.
    """
    nodes = keep(nodes, "nodes")
    known = nodes.select(F.col("code").alias("parent"), F.lit(True).alias("known"))
    links = nodes.select("code", "parent").join(known, "parent", "left").select("code", F.when(F.col("known"), F.col("parent")).alias("parent"), (F.col("parent").isNotNull() & F.col("known").isNull()).alias("lost"))
    links = keep(links, "links")
    arrived, circling = climb(links.select("code", "parent"), with_paths)
    path = ["path"] if with_paths else []
    tops = links.where("lost").select(F.col("code").alias("top"), F.lit("orphan").alias("kind"))
    found = arrived.join(tops, "top", "left").select("code", F.coalesce("kind", F.lit("tree")).alias("kind"), F.col("top").alias("root"), "depth", *path)
    if circling is not None:
        ring = keep(cycles(circling), "ring")
        found = found.unionByName(ring.select("code", F.lit("on_cycle").alias("kind"), "root", F.lit(0).cast("bigint").alias("depth"), *([F.array("code").alias("path")] if with_paths else [])))
        onto = circling.join(ring.select("code", F.lit(True).alias("ring")), "code", "left").select("code", F.when(F.col("ring").isNull(), F.col("parent")).alias("parent"))
        below, _ = climb(onto, with_paths, "below")
        below = below.where("depth > 0").join(ring.select(F.col("code").alias("top"), "root"), "top")
        found = found.unionByName(below.select("code", F.lit("below_cycle").alias("kind"), "root", "depth", *path))
    return nodes.join(found, "code")


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of each pair along a path of ``hierarchy``; as rows, since a root may have any number."""
    steps = F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor")
    return tree.where(F.size("path") > 1).select(F.col("code").alias("descendant"), (F.size("path") - 1).alias("last"), steps).select("ancestor", "descendant", (F.col("last") - F.col("at")).cast("bigint").alias("distance"))


def findings(tree: DataFrame) -> DataFrame:
    """(intent_code, finding, root_code, depth) of the nodes with a wrong place or a wrong or missing level."""
    finding = F.when(F.col("kind") != "tree", F.col("kind")).when(F.col("level").isNull() | (F.col("level") != F.col("depth")), "level")
    return tree.select(F.col("code").alias("intent_code"), finding.alias("finding"), F.col("root").alias("root_code"), F.col("depth").cast("bigint").alias("depth")).where("finding is not null")
