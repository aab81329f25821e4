"""Operations on the trees that ``hierarchy`` resolves: systems, integrity of a selection, order of the whole tree, named paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hierarchy import descendants
from .ordering import numbered

DOMAIN, CATEGORY = 0, 1


def along(tree: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """(code, at, step, *columns): the nodes of each node's path, from the root (at = 0) to itself, with columns of theirs."""
    steps = tree.select("code", F.posexplode("path").alias("at", "step"))
    return steps.join(nodes.select(F.col("code").alias("step"), *columns), "step").select("code", "at", "step", *columns)


def systems(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(code, system): the nearest node on the way up that is a category with no parent or a domain for parent; else the root."""
    steps = along(tree, nodes, "level").select("code", "at", "step", "level")
    before = steps.select("code", (F.col("at") + 1).alias("at"), F.col("level").alias("above"), F.lit(True).alias("_has"))
    both = steps.join(before, ["code", "at"], "left")
    fits = (F.col("level") == CATEGORY) & (F.col("_has").isNull() | F.coalesce(F.col("above") == DOMAIN, F.lit(False)))
    near = F.max_by(F.when(fits, F.col("step")), F.when(fits, F.col("at")))
    return both.groupBy("code").agg(F.coalesce(near, F.min_by("step", "at")).alias("system"))


def blocked(tree: DataFrame, selected: DataFrame, only: Column | None = None) -> DataFrame:
    """(code, blocking): the selected nodes (code) with descendants that are not selected, and how many; these may not be deleted, nor,
    with ``only`` the condition that a descendant is enabled, be disabled."""
    chosen = selected.select("code").distinct()
    pairs = descendants(tree).join(chosen.withColumnRenamed("code", "ancestor"), "ancestor", "left_semi").join(chosen.withColumnRenamed("code", "descendant"), "descendant", "left_anti")
    if only is not None:
        pairs = pairs.join(tree.where(only).select(F.col("code").alias("descendant")), "descendant", "left_semi")
    return pairs.groupBy(F.col("ancestor").alias("code")).agg(F.count("*").alias("blocking"))


def ordered(tree: DataFrame, nodes: DataFrame, order: list[str]) -> DataFrame:
    """(code, depth, place): all nodes of sound trees depth first, children by ``order``, then code; place counts from 1."""
    sound = tree.where("kind = 'tree'")
    steps = along(sound, nodes, *order).select("code", F.struct("at", *order, "step").alias("s"))
    keys = steps.groupBy("code").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: F.struct(*[s[c] for c in order], s["step"])).alias("_key"))
    return numbered(keys.join(sound.select("code", "depth"), "code"), [F.col("_key")], "place").select("code", "depth", "place")


def named_paths(tree: DataFrame, nodes: DataFrame, name: str = "name", separator: str = " > ") -> DataFrame:
    """(code, path): the names from the root to the node."""
    steps = along(tree, nodes, name).groupBy("code").agg(F.sort_array(F.collect_list(F.struct("at", name))).alias("s"))
    return steps.select("code", F.array_join(F.transform("s", lambda s: s[name]), separator).alias("path"))
