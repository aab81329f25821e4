import pytest
from pyspark.sql import types as T

from brindle.functions.conditions import compile_condition

FIELDS = {"x": T.StringType(), "n": T.LongType(), "tags": T.ArrayType(T.StringType())}
CASES = [
    (None, True), (True, True), (False, False), ({}, True), ({"all": []}, True), ({"any": []}, False), ({"all": 1}, True), ({"not": {"any": []}}, True), ({"field": " "}, True),
    ({"field": "x", "value": " a "}, True), ({"field": "x", "operator": "ne", "value": "a"}, False), ({"field": "x", "operator": "??", "value": "a"}, True),
    ({"field": "n", "operator": "gte", "value": 5}, True), ({"field": "n", "operator": "gt", "value": "5"}, False), ({"field": "n", "operator": "lt", "value": 6}, True),
    ({"field": "no", "operator": "gte", "value": 1}, True), ({"field": "no", "operator": "gt", "value": 1}, False), ({"field": "x", "operator": "lte", "value": 1}, True), ({"field": "n", "operator": "gte", "value": "z"}, True),
    ({"field": "no", "operator": "exists"}, False), ({"field": "no", "operator": "not_exists"}, True), ({"field": "x", "operator": "exists"}, True), ({"field": "no", "value": None}, True),
    ({"field": "x", "operator": "regex", "value": "[a-c] *"}, True), ({"field": "x", "operator": "regex", "value": "b"}, False), ({"field": "x", "operator": "contains", "value": "a"}, True),
    ({"field": "tags", "operator": "contains", "value": "t"}, True), ({"field": "tags", "operator": "in", "value": "u"}, False), ({"field": "n", "operator": "in", "value": [4, 5]}, True), ({"field": "n", "operator": "in", "value": ["5"]}, False),
    ("n > 4", True), ("n > 9", False), ('{"field": "n", "value": 5}', True), ({"any": [{"field": "n", "value": 1}, {"field": "n", "value": 5}]}, True),
]


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([("a ", 5, ["t"])], "x string, n bigint, tags array<string>")
    return df.select(*[compile_condition(c, FIELDS).alias(f"c{i}") for i, (c, _) in enumerate(CASES)]).first()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(results, i):
    assert results[i] is CASES[i][1], CASES[i][0]
