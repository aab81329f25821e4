"""Operational analytics: windows compared with the one before, rates, nearest-rank percentiles, gap-filled series, shares."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import round1, round_half_up
from .hierarchy import SPACE
from .ordering import numbered

SLOW_MS = 20_000


def within(time: Column, begin: datetime, end: datetime) -> Column:
    """Half-open."""
    return (time >= F.lit(begin).cast("timestamp_ntz")) & (time < F.lit(end).cast("timestamp_ntz"))


def rate(part: Column, whole: Column) -> Column:
    """Per cent to one decimal; 0 of nothing."""
    return F.when(whole > 0, round1(part * 100.0 / whole)).otherwise(0.0)


def change(now: Column, before: Column) -> Column:
    """Per cent of change to one decimal; null if there was nothing before."""
    return F.when(before > 0, round1((now - before) * 100.0 / before))


def compared(rows: DataFrame, time: str, as_of: datetime, hours: int, what: Column | None = None) -> DataFrame:
    """(total, current, previous, delta, delta_pct) in one pass: rows, or distinct values of ``what``, in the window up to as_of and
    in the one before. ``total`` covers all rows."""
    begin, before = as_of - timedelta(hours=hours), as_of - timedelta(hours=2 * hours)
    now, then = within(F.col(time), begin, as_of), within(F.col(time), before, begin)
    if what is None:
        parts = F.count("*").alias("total"), F.count_if(now).alias("current"), F.count_if(then).alias("previous")
    else:
        parts = F.count_distinct(what).alias("total"), F.count_distinct(F.when(now, what)).alias("current"), F.count_distinct(F.when(then, what)).alias("previous")
    return rows.agg(*parts).select("*", (F.col("current") - F.col("previous")).alias("delta"), change(F.col("current"), F.col("previous")).alias("delta_pct"))


def nearest_rank(rows: DataFrame, groups: list[str], value: str, q: float, name: str) -> DataFrame:
    """(*groups, name): the value (a whole number of at least 0) at rank ceil(n * q) of each group, exactly.

    Two passes, each of counts that combine before the shuffle: first of buckets on a logarithmic scale, at most 2,800 a group, which
    tell the bucket that holds the rank; then of the values in that bucket. No task sees the rows of a group.
    """
    rows = rows.where(F.col(value) >= 0).select(*groups, F.col(value).cast("bigint").alias("_v"), F.floor(F.log1p(F.col(value).cast("double")) * 64).cast("int").alias("_b"))
    by = Window.partitionBy(*groups)
    upto = by.orderBy("_b")
    counts = rows.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    placed = counts.select(*groups, "_b", "_n", F.sum("_n").over(upto).alias("_upto"), F.ceil(F.sum("_n").over(by) * q).alias("_rank"))
    holds = placed.where("_rank > _upto - _n and _rank <= _upto").select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_b").alias("_hold"), (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rest"))
    same = F.col("_b") == F.col("_hold")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    values = rows.join(holds, same).groupBy(*groups, "_v", "_rest").agg(F.count("*").alias("_n"))
    ranked = values.withColumn("_upto", F.sum("_n").over(by.orderBy("_v")))
    return ranked.where("_rest > _upto - _n and _rest <= _upto").select(*groups, F.col("_v").alias(name))


def performance(runs: DataFrame, groups: list[str] | None = None, slow_ms: int = SLOW_MS) -> DataFrame:
    """Average (of successes of positive duration, rounded) and 95th percentile, success, error and slow rates of (status, duration_ms).

    Rates are of successes and errors; running ones do not count. The percentile is exact (``nearest_rank``).
    """
    good = (F.col("status") == "SUCCESS") & (F.col("duration_ms") > 0)
    took = F.when(good, F.col("duration_ms"))
    rows = runs.withColumn("_took", took)
    parts = [
        F.coalesce(round_half_up(F.avg("_took")), F.lit(0)).alias("avg_ms"),
        F.count_if(F.col("status") == "SUCCESS").alias("ok"),
        F.count_if(F.col("status") == "ERROR").alias("failed"),
        F.count("_took").alias("timed"),
        F.count_if(F.col("_took") > slow_ms).alias("slow"),
    ]
    keys = groups or []
    made = rows.groupBy(*keys).agg(*parts)
    tail = nearest_rank(rows, keys, "_took", 0.95, "p95_ms").select(*[F.col(g).alias(f"_p_{g}") for g in keys], "p95_ms")
    same = F.lit(True)
    for g in keys:
        same = same & F.col(g).eqNullSafe(F.col(f"_p_{g}"))
    made = made.join(tail, same, "left").withColumn("p95_ms", F.coalesce("p95_ms", F.lit(0)))
    done = F.col("ok") + F.col("failed")
    return made.select(*(groups or []), "avg_ms", "p95_ms", rate(F.col("ok"), done).alias("success_rate"), rate(F.col("failed"), done).alias("error_rate"), rate(F.col("slow"), F.col("timed")).alias("slow_rate"))


def span(as_of: datetime, hours: int, unit: str) -> tuple[datetime, datetime]:
    """The first and the last bucket of a window."""
    if unit == "hour":
        last = as_of.replace(minute=0, second=0, microsecond=0)
        return last + timedelta(hours=1 - hours), last
    day = {"hour": 0, "minute": 0, "second": 0, "microsecond": 0}
    return (as_of - timedelta(hours=hours)).replace(**day), as_of.replace(**day)


def spine(spark: SparkSession, as_of: datetime, hours: int, unit: str) -> DataFrame:
    """(bucket): every hour of the window that ends with the hour of as_of, or every day from the window's first to as_of's."""
    (first, last), step = span(as_of, hours, unit), f"1 {unit}"
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"), F.expr(f"interval {step}"))).alias("bucket"))


def trend(rows: DataFrame, time: str, as_of: datetime, hours: int, unit: str, value: Column) -> DataFrame:
    """(bucket, value): an aggregate per hour or day, 0 for empty buckets. The spine is as long as the window and is broadcast; rows
    outside its buckets are left out at the scan."""
    frame = spine(rows.sparkSession, as_of, hours, unit)
    first, last = span(as_of, hours, unit)
    counted = rows.where(within(F.col(time), first, last + timedelta(**{f"{unit}s": 1}))).groupBy(F.date_trunc(unit, F.col(time)).cast("timestamp_ntz").alias("bucket")).agg(value.alias("value"))
    return counted.join(F.broadcast(frame), "bucket", "right").select("bucket", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


def reply_rate(answers: DataFrame, reply: str) -> DataFrame:
    """(answers, no_document_rate): per cent of the answers (id, content), once per id, that are the reply, outer white space aside."""
    hit = F.coalesce(F.regexp_replace("content", SPACE, "") == reply, F.lit(False))
    rows = answers.select("id", hit.alias("hit")).dropDuplicates(["id"])
    return rows.agg(F.count("*").alias("answers"), F.count_if(F.col("hit")).alias("n")).select("answers", rate(F.col("n"), F.col("answers")).alias("no_document_rate"))


def tone(value: Column, good: float, warning: float, high: bool) -> Column:
    """'good', 'warning' or 'bad' by two steps; ``high`` if more is better."""
    if high:
        return F.when(value >= good, "good").when(value >= warning, "warning").otherwise("bad")
    return F.when(value <= good, "good").when(value <= warning, "warning").otherwise("bad")


def shares(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(*by, amount, share, rank): sums per group, per cent of all to two decimals, rank by amount then group."""
    sums = numbered(rows.groupBy(*by).agg(F.sum(value).alias("amount")), [F.col("amount").desc(), *map(F.col, by)], "rank")
    whole = sums.agg(F.sum("amount").alias("whole"))  # one row
    return sums.crossJoin(F.broadcast(whole)).select(*by, F.round("amount", 2).alias("amount"), F.round(F.col("amount") / F.col("whole") * 100, 2).alias("share"), "rank")
