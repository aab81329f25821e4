import pytest
from pyspark.sql import functions as F

from brindle.functions import text as t
from brindle.functions import vectors as v


def values(spark, column, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"x{n} string" for n in range(len(rows[0]))))
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_tokens_and_lengths(spark):
    rows = [("abcde",), ("你好",), ("héllo",), ("  \n",), (None,), ("a😀b",), ("　",), ("",)]
    assert values(spark, t.token_count(F.col("x0")), *rows) == [2, 2, 2, 0, 0, 2, 0, 0]
    assert values(spark, t.utf16_length(F.col("x0")), ("a😀b",), ("abc",), (None,)) == [4, 3, None]


def test_cleanup(spark):
    assert values(spark, t.cleanup(F.col("x0")), ("﻿a  \n\n\n\nb ",), (None,), ("\t",)) == ["a\n\nb", None, ""]
    assert values(spark, t.strip_fence(F.col("x0")), ("```json\n{}\n```",), ("plain",)) == ["{}", "plain"]
    assert values(spark, t.json_span(F.col("x0")), ('x {"a": [1]} y',), ("no",)) == ['{"a": [1]}', None]


def test_questions(spark):
    assert values(spark, t.split_questions(F.col("x0")), ("A？B；C",), ("？？",), ("x? y",)) == [["A？", "B？", "C？"], ["？？"], ["x？", "y？"]]


def test_terms(spark):
    assert values(spark, t.map_term(F.col("x0"), "阿里", "阿里巴巴"), ("阿里和阿里巴巴",), ("阿里巴巴好",), (None,)) == ["阿里巴巴和阿里巴巴", "阿里巴巴好", None]
    rules = [{"source": "a", "target": "b", "priority": 1}, {"source": "b", "target": "c", "priority": None}, {"source": "", "target": "z"}, {"source": "q", "target": "r", "match_type": 2}]
    assert values(spark, t.map_terms(F.col("x0"), rules), ("abq",)) == ["bcq"]  # the rule without priority goes first


def test_names_and_files(spark):
    assert values(spark, t.normalize_name(F.col("x0")), (" OA-系统 ",), (None,)) == ["oa系统", None]
    both = t.file_type(F.col("x0"), F.col("x1"))
    assert values(spark, both, ("a/b.MD", None), ("x", "text/markdown; charset=x"), ("x.zip", None), (None, "image/png"), (None, None), ("x.", None)) == ["markdown", "markdown", "zip", "image/png", "", ""]
    name = t.file_name(F.col("x0"), F.col("x1"))
    assert values(spark, name, ('attachment; filename="a%20b.pdf"', "http://h/x"), (None, "http://h/p/q.txt?z=1"), (None, "http://h/")) == ["a b.pdf", "q.txt", None]


def test_rounding_and_windows(spark):
    assert spark.range(1).select(t.round1(F.lit(-2.25)), t.round1(F.lit(2.25)), t.round_half_up(F.lit(2.5))).first()[:] == (-2.2, 2.3, 3)
    assert [t.window_hours(x) for x in ("24h", "7d", "", None, "x", "0h")] == [24, 168, 24, 24, 24, 24]
    assert [t.granularity(*x) for x in ((None, 48), (None, 49), ("DAY", 1))] == ["hour", "day", "day"]
    assert values(spark, t.rechunk(F.col("x0"), 2), ("ab\nc😀",), ("",), (None,)) == [["ab", "\nc", "😀"], [], None]
    assert values(spark, t.fill_template("{a}-{{a}}-{b}", {"a": F.col("x0")}), ("1",), (None,)) == ["1-1-{b}", "--{b}"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(v.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None, None]
    assert [r[0] for r in df.select(v.l2_normalize(F.col("a"))).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0], [1.0], None]
