import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from brindle.functions import parsing, periods
from brindle.operators import analytics, documents, engine, intents, ordering


def test_nearest_rank(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([0, 5, 5, rng.randrange(10**6), 2**40, -3, None])) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    for q in (0.01, 0.5, 0.95, 1.0):
        want = {}
        for g in ("a", "b", None):
            mine = sorted(v for k, v in rows if k == g and v is not None and v >= 0)
            want[g] = mine[max(1, -(-len(mine) * round(q * 100) // 100)) - 1]
        assert {r.g: r.p for r in analytics.nearest_rank(df, ["g"], "v", q, "p").collect()} == want
    assert analytics.nearest_rank(df, [], "v", 0.5, "p").count() == 1
    assert analytics.nearest_rank(df.where("false"), ["g"], "v", 0.5, "p").count() == 0


def test_places_over_all_rows(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, i int").repartition(5)
    got = {r.i: r.place for r in ordering.numbered(df, [F.col("a").desc(), F.col("i")], "place").collect()}
    assert got == {i: n + 1 for n, (_, i) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert ordering.numbered(df.where("false"), [F.col("a")], "place").count() == 0


def test_cap_of_a_hot_session(spark):
    rows = [("s", f"q{i % 2}", f"i{i}", 0.9 - i / 100) for i in range(9)] + [("t", f"q{i}", "x", 0.5) for i in range(5)] + [("t", "q0", "y", 0.4), ("u", "q", "z", 0.1), (None, "q", "a", 0.6), (None, "q", "b", 0.5)]
    got = sorted((str(r.session), r.question, r["item"]) for r in intents.cap(spark.createDataFrame(rows, "session string, question string, item string, score double")).collect())
    assert got == [("None", "q", "a"), ("None", "q", "b"), ("s", "q0", "i0"), ("s", "q0", "i2"), ("s", "q1", "i1"), *[("t", f"q{i}", "x") for i in range(5)]]


def test_a_failing_channel_is_empty(spark):
    requests = spark.createDataFrame([("r",)], "request string")

    def fails(asked):
        return asked.selectExpr("request", "'k' as key", "'i' as id", "1 as position", "cast(raise_error('down') as double) as score")

    good = engine.Channel("A", 2, lambda asked: asked.selectExpr("request", "'k' as key", "'i' as id", "1 as position", "0.5 as score"))
    found = engine.retrieve(requests, [good, engine.Channel("B", 1, fails), engine.Channel("C", 1, lambda a: a.select("nothing"))], [lambda rows: rows.select("nothing"), lambda rows: rows.where("score > 0.1")])
    assert [(r.channel, r.id) for r in found.collect()] == [("A", "i")]
    assert engine.retrieve(requests, [], []).count() == 0


def test_parsed_answers(spark):
    raws = ['```json\n{"rewrite": " a ", "sub_questions": ["x", 3, null, " "]}\n```', '{"rewrite": "a", "sub_questions": "x"}', "[1]", "no json", None, "", '{"rewrite": " "}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = {r.i: r.r and (r.r.rewrite, list(r.r.sub_questions)) for r in df.select("i", parsing.rewritten(F.col("raw")).alias("r")).collect()}
    assert got == {0: ("a", ["x"]), 1: ("a", ["a"]), **dict.fromkeys(range(2, 7))}
    ids = spark.createDataFrame([('{"results": [{"id": "a", "score": 0.1}, {"id": 7, "score": 0.5}, {"id": "c"}, 4]}',), ("{}",), (None,)], "raw string").select(parsing.scored_ids(F.col("raw")).alias("s")).collect()
    assert [[(e.id, e.score) for e in r.s] for r in ids] == [[("7", 0.5), ("a", 0.1)], [], []]
    made = spark.createDataFrame([('{"a": null, "b": 2, "z": 1}',), ("[]",)], "raw string").select(parsing.tool_parameters(F.col("raw"), {"a": "1", "b": "9", "c": None}).alias("m")).collect()
    assert [r.m for r in made] == [{"a": "1", "b": "2"}, {"a": "1", "b": "9"}]


def test_documents(spark):
    rows = spark.createDataFrame([("1", "x", [1.0, 2.0]), ("2", "y", None), ("3", " ", None), ("4", None, None)], "id string, content string, embedding array<float>")
    got = {r.id: r.embedding for r in documents.embedded(rows, lambda texts: [[9.0, 9.0]] * len(texts), 2).collect()}
    assert got == {"1": [1.0, 2.0], "2": [9.0, 9.0], "3": None, "4": None}
    with pytest.raises(Exception, match="one vector of 2 numbers"):
        documents.embedded(rows, lambda texts: [[9.0]] * len(texts), 2).collect()
    assert documents.missing_keys('{"a": 1}', {"a": 0, "b": 0}) == ["b"] and documents.missing_keys("x", {"a": 0}) == ["a"] and documents.missing_keys(None, {}) == []
    last = documents.page(rows.select("id"), [F.col("id")], 2, 3).collect()
    assert [(r.id, r.total, r.pages) for r in last] == [("4", 4, 2)]


def test_periods():
    today = date(2026, 2, 10)
    assert periods.period("本月", today) == (date(2026, 2, 1), today) and periods.period("上月", today) == (date(2026, 1, 1), date(2026, 1, 31))
    assert periods.period("本季度", today) == (date(2026, 1, 1), today) and periods.period("上季度", today) == (date(2025, 10, 1), date(2025, 12, 31)) and periods.period("本年", today) == (date(2026, 1, 1), today)
