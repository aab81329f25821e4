"""Percentiles with bounded error by dyadic Count-sketches.

A value is encoded in BITS bits that keep its order: its exponent and 26 bits of its mantissa, so that a code gives the value back to
within 2**-26. Each level of the binary tree over the codes holds the counts of its nodes: exactly where the level has at most
EXACT nodes, otherwise as a signed Count-sketch of DEPTH rows. A map task fills one array of counters per group and level as it
reads; merging is addition, deletion is addition of negative counts, so partitions, days and corrections combine freely. A rank is
inverted by descending the levels; of two children the estimates are set right by their parent's.

Error: a counter of a row of ``width`` counters estimates a node's count with variance of at most F2 / width, where F2 is the sum of
the squared counts of the level's nodes, and the median of DEPTH rows exceeds three times its root in fewer than 1 of 10,000 cases.
A rank is therefore off by at most the sum over the estimated levels of ``bound`` (the exact levels add nothing). The size of a
sketch does not depend on the number of rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rolling import mix

#: Levels are numbered by the bits of their nodes, from 0 (the root) to BITS (the codes).
BITS, EXACT, DEPTH = 32, 10, 5
#: Counters per row: the coarsest estimated levels have the largest counts and get the most.
WIDEST, NARROWEST = 512, 64
#: Groups that a map task fills at once before it passes on what it has.
HELD = 500
MERGES = 64


def width(level: int) -> int:
    """Counters of a row of a level: all nodes of an exact one, half as many for each two levels below it."""
    return 1 << level if level <= EXACT else max(NARROWEST, WIDEST >> (level - EXACT - 1) // 2)


def size(level: int) -> int:
    return width(level) * (1 if level <= EXACT else DEPTH)


BEGINS = np.concatenate([[0], np.cumsum([size(level) for level in range(BITS + 1)])])


def encode(values: np.ndarray) -> np.ndarray:
    """The codes of values of at least 0."""
    bits = (values.astype(np.float64) + 1).view(np.int64) - (1023 << 52)
    return np.minimum(bits >> (52 - 26), (1 << BITS) - 1)


def decode(code: int) -> float:
    """The smallest whole value of a code, or the code's lower end if it holds none."""
    low, high = (float(np.int64((c << 26) + (1023 << 52)).view(np.float64)) - 1 for c in (code, code + 1))
    return float(np.ceil(low)) if np.ceil(low) < high else low


def spots(nodes: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter and the sign of each node in a row of an estimated level."""
    with np.errstate(over="ignore"):
        h = mix(nodes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level * DEPTH + row + 1))
    return (h & np.uint64(width(level) - 1)).astype(np.int64) + row * width(level), 1 - 2 * (h >> np.uint64(63)).astype(np.int64)


def bound(f2: float, level: int) -> float:
    """How far the count of a node of a level is off, of whose nodes the squared counts sum up to f2."""
    return 0.0 if level <= EXACT else 3 * float(np.sqrt(f2 / width(level)))


def _schema(df: DataFrame, groups: list[str]) -> T.StructType:
    return T.StructType([*(T.StructField(g, df.schema[g].dataType) for g in groups), T.StructField("level", T.IntegerType()), T.StructField("counters", T.ArrayType(T.LongType()))])


def sketch(rows: DataFrame, groups: list[str], value: str, sign: str | None = None) -> DataFrame:
    """(*groups, level, counters) of the values per group. Null and negative values are not counted; ``sign`` names a column of
    weights (-1 deletes). A group with a third of all rows sends one array a level from a task."""
    weight = F.col(sign).cast("bigint") if sign else F.lit(1).cast("bigint")
    schema, many = _schema(rows, groups), len(groups)

    def fill(batches):
        known: dict[tuple, int] = {}
        table = np.zeros((0, BEGINS[-1]), np.int64)

        def out():
            for key, place in known.items():
                counters = [table[place, a:b] for a, b in zip(BEGINS[:-1], BEGINS[1:], strict=True)]
                columns = [pa.array([part] * (BITS + 1), kind) for part, kind in zip(key, kinds, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(BEGINS.astype(np.int32)), pa.array(np.concatenate(counters)))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(BITS + 1, dtype=np.int32)), lists], names=[*groups, "level", "counters"])

        for batch in batches:
            kinds = [c.type for c in batch.columns[:many]]
            if not batch.num_rows:
                continue
            codes, weights = encode(batch.column(many).to_numpy(zero_copy_only=False)), batch.column(many + 1).to_numpy(zero_copy_only=False)
            keys = list(zip(*[c.to_pylist() for c in batch.columns[:many]], strict=True)) if many else [()] * batch.num_rows
            if len(known) > HELD:
                yield from out()
                known, table = {}, table[:0]
            at = np.array([known.setdefault(key, len(known)) for key in keys])
            if len(known) > len(table):
                table = np.concatenate([table, np.zeros((max(len(known), 2 * len(table)) - len(table), BEGINS[-1]), np.int64)])
            flat = table.reshape(-1)
            for level in range(BITS + 1):
                nodes, base = codes >> (BITS - level), at * BEGINS[-1] + BEGINS[level]
                if level <= EXACT:
                    np.add.at(flat, base + nodes, weights)
                    continue
                for row in range(DEPTH):
                    place, signs = spots(nodes, level, row)
                    np.add.at(flat, base + place, signs * weights)
        if known:
            yield from out()

    return rows.where(F.col(value) >= 0).select(*groups, F.col(value).cast("bigint"), weight.alias("_n")).mapInArrow(fill, schema)


def _added(parts: DataFrame, groups: list[str]) -> DataFrame:
    """The sum of the arrays of each group and level: first of MERGES shares of the tasks, then of these, a running sum at a time."""

    def add(batches):
        now, total, like = None, None, None
        for batch in batches:
            keys = list(zip(*[c.to_pylist() for c in batch.columns[:-1]], strict=True))
            lists = batch.column(batch.num_columns - 1)
            for i, key in enumerate(keys):
                counters = lists[i].values.to_numpy(zero_copy_only=False)
                if key == now:
                    total += counters
                    continue
                if now is not None:
                    yield row(now, total, like)
                now, total, like = key, counters.copy(), batch.schema
        if now is not None:
            yield row(now, total, like)

    def row(key, total, like):
        lists = pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))
        return pa.RecordBatch.from_arrays([*[pa.array([k], f.type) for k, f in zip(key, like, strict=False)], lists], schema=pa.schema([*list(like)[:-1], pa.field("counters", lists.type)]))

    shares = parts.select(*groups, "level", F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("_share"), "counters")
    first = shares.repartition(*groups, "level", "_share").sortWithinPartitions(*groups, "level", "_share").mapInArrow(add, T.StructType([*_schema(parts, groups).fields[:-1], T.StructField("_share", T.IntegerType()), T.StructField("counters", T.ArrayType(T.LongType()))]))
    second = first.drop("_share").repartition(*groups, "level").sortWithinPartitions(*groups, "level")
    return second.mapInArrow(add, _schema(parts, groups))


def merge(*sketches: DataFrame) -> DataFrame:
    """The sum of sketches over the same groups."""
    together = reduce(DataFrame.unionByName, sketches)
    return _added(together, [c for c in together.columns if c not in ("level", "counters")])


def negated(cells: DataFrame) -> DataFrame:
    """A sketch whose addition deletes."""
    return cells.withColumn("counters", F.transform("counters", lambda x: -x))


def roll_up(cells: DataFrame, groups: list[str]) -> DataFrame:
    """The sketch of coarser groups, such as all days of a name."""
    return _added(cells.select(*groups, "level", "counters"), groups)


def count(counters: np.ndarray, level: int, node: int) -> float:
    """The (estimated) count of a node."""
    if level <= EXACT:
        return float(counters[node])
    found = []
    for row in range(DEPTH):
        place, sign = spots(np.array([node]), level, row)
        found.append(counters[place[0]] * sign[0])
    return float(np.median(found))


def invert(levels: list[np.ndarray], rank: float) -> int:
    """The code at a rank."""
    node, parent = 0, float(levels[0][0])
    for level in range(1, BITS + 1):
        left, right = (max(0.0, count(levels[level], level, 2 * node + side)) for side in (0, 1))
        left = min(parent, max(0.0, (left + parent - right) / 2))  # both estimates and their sum agree best here
        node *= 2
        if rank > left and parent > left:
            rank, node, parent = rank - left, node + 1, parent - left
        else:
            parent = left
    return node


def quantiles(cells: DataFrame, groups: list[str], percents: list[int]) -> DataFrame:
    """(*groups, q, n, value) for each percent q: the value at rank ceil(n*q/100), to within the sketch's error.

    One task sees the arrays of a group, whose size is fixed. Groups with no rows left give none. ``cells`` may come from
    ``sketch`` or from sums of such.
    """
    schema = T.StructType([*(cells.schema[g] for g in groups), T.StructField("q", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("value", T.DoubleType())])

    def descend(frame: pd.DataFrame) -> pd.DataFrame:
        levels = [np.asarray(c) for c in frame.sort_values("level").counters]
        n = int(levels[0][0])
        ranks = {q: max(1, -(-n * q // 100)) for q in percents} if n > 0 else {}
        return pd.DataFrame([(*(frame[g].iloc[0] for g in groups), q, n, decode(invert(levels, rank))) for q, rank in ranks.items()], columns=schema.names)

    return _added(cells, groups).groupBy(*groups).applyInPandas(descend, schema)


def ranks(found: DataFrame, rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(*groups, q, n, below, upto): for each row of ``quantiles`` how many values of its group are less, and not more, than its value."""
    both = rows.where(F.col(value) >= 0).join(found.groupBy(*groups).agg(F.collect_list(F.struct("q", "n", "value")).alias("_f")), groups)
    each = both.select(*groups, value, F.explode("_f").alias("_f"))
    return each.groupBy(*groups, "_f.q", "_f.n").agg(F.count_if(F.col(value) < F.col("_f.value")).alias("below"), F.count_if(F.col(value) <= F.col("_f.value")).alias("upto"))


LIMITS = {50: 5000, 95: 20000}


def successful(runs: DataFrame) -> DataFrame:
    """(trace_day, trace_name, duration_ms) of the runs that count, once per trace_id (of several rows the earliest start,
    then the shortest); rows without a trace_id count each. Null days and names are groups of their own."""
    good = runs.where((F.col("deleted") == 0) & (F.col("duration_ms") >= 0) & (F.upper(F.regexp_replace("status", r"^\s+|\s+$", "")) == "SUCCESS"))
    good = good.select("trace_id", F.struct("start_time", "duration_ms", "trace_name").alias("r"))
    once = good.where("trace_id is not null").groupBy("trace_id").agg(F.min("r").alias("r")).select("r").unionByName(good.where("trace_id is null").select("r"))
    return once.select(F.date_format("r.start_time", "yyyy-MM-dd").alias("trace_day"), "r.trace_name", "r.duration_ms")


def found(runs: DataFrame) -> DataFrame:
    """(trace_day, trace_name, q) of the groups whose median or 95th percentile exceeds its limit."""
    groups = ["trace_day", "trace_name"]
    over = None
    for q, limit in LIMITS.items():
        test = (F.col("q") == q) & (F.col("value") > limit)
        over = test if over is None else over | test
    return quantiles(sketch(successful(runs), groups, "duration_ms"), groups, [*LIMITS]).where(over).select(*groups, "q")
