import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from brindle.llm import quantiles as q


def exact(values, p):
    values = sorted(values)
    return values[max(1, -(-len(values) * p // 100)) - 1]


def test_error_merge_and_delete(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "a", "a", None]), d, int(rng.lognormvariate(8, 2))) for d in (1, 2) for _ in range(6000)]
    df = spark.createDataFrame(data, "g string, day int, v bigint")
    cells = [q.sketch(df.where(F.col("day") == d), ["g"], "v") for d in (1, 2)]
    merged = q.quantiles(q.merge(*cells), ["g"], [5, 50, 95]).collect()
    for r in merged:
        mine = [v for g, _, v in data if g == r.g]
        assert r.n == len(mine)
        low, high = exact(mine, max(1, r.q - 1)), exact(mine, min(100, r.q + 1))
        assert low * 0.98 - 1 <= r.value <= high * 1.02 + 1, r
    left = q.quantiles(q.merge(*cells, q.negated(cells[1])), ["g"], [50]).collect()
    alone = q.quantiles(cells[0], ["g"], [50]).collect()
    assert sorted(map(str, left)) == sorted(map(str, alone))
    assert q.quantiles(q.roll_up(q.merge(*cells).withColumn("h", F.lit(1)), ["h"]), ["h"], [50]).first().n == len(data)
    assert q.quantiles(q.merge(cells[0], q.negated(cells[0])), ["g"], [50]).count() == 0


def allowed(values):
    """The sum over the estimated levels of the stated error."""
    codes, total = q.encode(np.array(values)), 0.0
    for level in range(q.BITS + 1):
        _, n = np.unique(codes >> (q.BITS - level), return_counts=True)
        total += q.bound(float((n.astype(float) ** 2).sum()), level)
    return total


def test_rank_error_on_estimated_levels(spark):
    """Far more distinct codes than any level has counters; the stated bound holds and is of use."""
    rng = np.random.default_rng(4)
    kinds = {"wide": np.exp(rng.random(40000) * 30), "narrow": rng.lognormal(8, 0.4, 40000), "third": np.where(rng.random(40000) < 0.34, 7777, rng.lognormal(8, 1, 40000)), "even": np.arange(40000) + 1_000_000}
    data = {g: np.floor(v).astype(np.int64) for g, v in kinds.items()}
    df = spark.createDataFrame(pd.DataFrame({"g": np.repeat(list(data), 40000), "v": np.concatenate(list(data.values()))}))
    assert len(np.unique(q.encode(data["even"]))) == 40000 > q.BEGINS[-1]
    got = q.quantiles(q.sketch(df, ["g"], "v"), ["g"], [1, 10, 25, 50, 75, 90, 99])
    for r in q.ranks(got, df, ["g"], "v").collect():
        rank, most = -(-r.n * r.q // 100), allowed(data[r.g])
        assert r.n == 40000 and r.below - most < rank <= r.upto + most, r
        assert r.below - 0.01 * r.n < rank <= r.upto + 0.01 * r.n, r


def test_codes():
    values = np.array([0, 1, 2, 3, 1000, 65535, 2**26 - 2, 2**40 + 12345, 2**62])
    codes = q.encode(values)
    assert (np.diff(codes) > 0).all() and codes.max() < 2**q.BITS
    for v, c in zip(values.tolist(), codes.tolist(), strict=True):
        assert q.decode(c) == v if v < 2**26 else abs(q.decode(c) / v - 1) < 2**-25


def test_edges(spark):
    df = spark.createDataFrame([("a", 0), ("a", None), ("a", -5), ("b", 2**62)], "g string, v bigint")
    got = {r.g: (r.n, r.value) for r in q.quantiles(q.sketch(df, ["g"], "v"), ["g"], [50]).collect()}
    assert got["a"] == (1, 0.0) and abs(got["b"][1] / 2**62 - 1) < 0.02
    assert q.quantiles(q.sketch(df.where("false"), ["g"], "v"), ["g"], [50]).count() == 0


def test_runs(spark):
    rows = spark.sql("""SELECT * FROM VALUES ('t', 'n', ' Success', TIMESTAMP_NTZ '2026-01-01 01:00:00', 6000L, 0), ('t', 'n', 'SUCCESS', TIMESTAMP_NTZ '2026-01-02 01:00:00', 1L, 0),
      (NULL, 'n', 'SUCCESS', TIMESTAMP_NTZ '2026-01-01 01:00:00', 6000L, 0), ('u', 'n', 'ERROR', NULL, 1L, 0), ('v', 'n', 'SUCCESS', TIMESTAMP_NTZ '2026-01-01 01:00:00', -1L, 0), ('w', 'n', NULL, NULL, NULL, 1)
      AS t(trace_id, trace_name, status, start_time, duration_ms, deleted)""")
    assert q.successful(rows).count() == 2
    assert [tuple(r) for r in q.found(rows).collect()] == [("2026-01-01", "n", 50)]
