"""Structured Streaming: event de-duplication, last-writer-wins feedback, windowed trends, circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def distinct_stream(events: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """The first delivery of each key within the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def trend_stream(events: DataFrame, time: str, window: str, delay: str, *groups: str) -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, window), *groups).agg(F.count("*").alias("n"))


VOTE = "message_id string, user_id string, vote int, submit_time bigint"


def latest_vote_stream(events: DataFrame) -> DataFrame:
    """(message_id, user_id, vote, submit_time): a row whenever the vote that counts changes; late ones with an earlier submit
    time change nothing. Of equal submit times the first counts."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        changed = False
        for rows in batches:
            for vote, at in zip(rows["vote"], rows["submit_time"], strict=True):
                if best is None or at > best[1]:
                    best, changed = (None if pd.isna(vote) else int(vote), int(at)), True
        if changed:
            state.update(best)
            yield pd.DataFrame({"message_id": [key[0]], "user_id": [key[1]], "vote": pd.array([best[0]], dtype="Int32"), "submit_time": [best[1]]})

    return events.groupBy("message_id", "user_id").applyInPandasWithState(update, VOTE, "vote int, submit_time bigint", "update", GroupStateTimeout.NoTimeout)


def breaker(outcomes: list[tuple[int, bool]], threshold: int = 2, open_ms: int = 30_000) -> list[tuple[int, bool, str]]:
    """(time, allowed, state after) of calls (time in ms, whether it would succeed) in order: closed until so many failures in a row,
    then open; after open_ms one probe is allowed, whose outcome closes or opens again."""
    state, failures, until, out = "CLOSED", 0, 0, []
    for at, good in outcomes:
        if state == "OPEN" and at < until:
            out.append((at, False, state))
            continue
        probe = state == "OPEN"
        failures = 0 if good else failures + 1
        if good:
            state = "CLOSED"
        elif probe or failures >= threshold:
            state, until, failures = "OPEN", at + open_ms, 0
        out.append((at, True, state))
    return out


def breaker_states(calls: DataFrame, key: str, threshold: int = 2, open_ms: int = 30_000) -> DataFrame:
    """(key, at_ms, call_id, allowed, state) of calls (key, at_ms, call_id, ok): a state machine per key, over calls sorted by the
    shuffle, one batch at a time; a key's calls are inherently one sequence, but they are never held together."""
    schema = T.StructType([calls.schema[key], T.StructField("at_ms", T.LongType()), calls.schema["call_id"], T.StructField("allowed", T.BooleanType()), T.StructField("state", T.StringType())])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = object()
        state, failures, until = "CLOSED", 0, 0
        for rows in batches:
            allowed, states = [], []
            for k, at, good in zip(rows[key], rows["at_ms"], rows["ok"], strict=True):
                if k != now:
                    now, state, failures, until = k, "CLOSED", 0, 0
                free = not (state == "OPEN" and at < until)
                if free:
                    probe = state == "OPEN"
                    failures = 0 if good else failures + 1
                    if good:
                        state = "CLOSED"
                    elif probe or failures >= threshold:
                        state, until, failures = "OPEN", at + open_ms, 0
                allowed.append(free)
                states.append(state)
            yield rows[[key, "at_ms", "call_id"]].assign(allowed=allowed, state=states)

    return calls.select(key, "at_ms", "call_id", "ok").repartition(key).sortWithinPartitions(key, "at_ms", "call_id").mapInPandas(walk, schema)


def claims(waiting: DataFrame, permits: int, request: str = "request_id", order: str = "seq") -> DataFrame:
    """(request, rank, claimed): the first ``permits`` in line may go on; rank is given up to there only, by a limit."""
    first = waiting.orderBy(order, request).limit(permits).select(request, F.lit(True).alias("_in"))
    return waiting.join(F.broadcast(first), request, "left").select(request, order, F.coalesce("_in", F.lit(False)).alias("claimed"))


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """For tests: all that is there, then end."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
