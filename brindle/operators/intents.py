"""Scored intents: thresholds, caps, splits by kind and ambiguity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_name

LEAST, PER_QUESTION, IN_ALL, RATIO, OPTIONS = 0.35, 3, 3, 0.8, 6


def cap(scores: DataFrame, least: float = LEAST, each: int = PER_QUESTION, most: int = IN_ALL) -> DataFrame:
    """Of (session, question, item, score): scores of at least ``least``, the best ``each`` per question; then per session the best
    of every question, even if these are more than ``most``, and the best others up to ``most``. Ties by question and item.

    Both rankings limit rows before their shuffle (the second to ``most`` a session), so a session with a third of all rows sends
    no more than that from a task.
    """
    by = Window.partitionBy("session", "question").orderBy(F.col("score").desc(), "item")
    some = scores.where(F.col("score") >= least).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= each)
    best = some.where("rank = 1").select("session", "question", "item", "score", "rank")
    asked = best.groupBy(F.col("session").alias("_session")).agg(F.count("*").alias("questions"))
    others = Window.partitionBy("session").orderBy(F.col("score").desc(), "question", "item")
    more = some.where("rank > 1").withColumn("place", F.row_number().over(others)).where(F.col("place") <= most)
    more = more.join(asked, F.col("session").eqNullSafe(F.col("_session"))).where(F.col("place") <= F.lit(most) - F.col("questions"))
    return best.unionByName(more.select(*best.columns))


def by_kind(scores: DataFrame, least: float = LEAST) -> DataFrame:
    """Adds use: 'tool' for kind 2 with a tool id, 'knowledge' for kind 0 or null; others and low scores are dropped."""
    use = F.when((F.col("kind") == 2) & (F.trim("tool_id") != ""), "tool").when(F.coalesce("kind", F.lit(0)) == 0, "knowledge")
    return scores.where(F.col("score") >= least).withColumn("use", use).where("use is not null")


def system_only(scores: DataFrame) -> DataFrame:
    """(question, system_only): exactly one score, of kind 1."""
    return scores.groupBy("question").agg(((F.count("*") == 1) & (F.coalesce(F.max("kind"), F.lit(-1)) == 1)).alias("system_only"))


def ambiguous(scores: DataFrame, least: float = LEAST, ratio: float = RATIO, options: int = OPTIONS) -> DataFrame:
    """Per question the topic that several systems share, from (question, text, item, name, system, system_name, score).

    Candidates of at least ``least`` are grouped by normalised name; a group counts if its second score is at least ``ratio`` of
    its first and it has more than one system. The group of highest first score (ties by name) gives topic and systems in the order
    of their scores, at most ``options``; questions whose text names one of them (two characters or more, normalised) are left out.
    """
    good = scores.where((F.col("score") >= least) & (F.trim("name") != "")).withColumn("topic", normalize_name(F.col("name")))
    group = Window.partitionBy("question", "topic").orderBy(F.col("score").desc(), "item")
    ranked = good.withColumn("rank", F.row_number().over(group))
    pairs = ranked.where("rank <= 2").groupBy("question", "topic").agg(F.max("score").alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    # IEEE division: 0.72 / 0.9 is below 0.8 and 0.4 / 0.5 is not
    close = pairs.where((F.col("first") > 0) & (F.col("second") / F.col("first") >= ratio))
    systems = ranked.where("system is not null").groupBy("question", "topic", "system").agg(F.min("rank").alias("rank"), F.min_by("system_name", "rank").alias("system_name"), F.max("text").alias("text"))
    several = systems.groupBy("question", "topic").agg(F.count("*").alias("systems")).where("systems > 1")
    best = close.join(several, ["question", "topic"]).withColumn("r", F.row_number().over(Window.partitionBy("question").orderBy(F.col("first").desc(), "topic"))).where("r = 1").select("question", "topic")
    order = F.row_number().over(Window.partitionBy("question").orderBy("rank", "system"))
    chosen = systems.join(best, ["question", "topic"]).withColumn("n", order).where(F.col("n") <= options)
    name = normalize_name(F.col("system_name"))
    named = (F.length(name) >= 2) & F.contains(normalize_name(F.col("text")), name)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "system"))), lambda x: x["system"]), ",")
    return chosen.groupBy("question", "topic").agg(listed.alias("systems"), F.max(F.coalesce(named, F.lit(False))).alias("named")).where("not named").drop("named")
