"""The field-condition language of pipelines, compiled to a column.

{"all": [...]}, {"any": [...]}, {"not": c}, {"field": f, "operator": o, "value": v}; booleans; a string is a SQL expression
(errors and null count as false). Kept as they are: an unknown operator means eq; eq and ne trim strings; comparing a missing or
non-numeric value by size counts as equal, so gte and lte hold and gt and lt do not; a missing field is null; regex must match
the whole text; an object without any of these keys, and a rule without a field, hold.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import trim_control


def compile_condition(condition, fields: Mapping[str, T.DataType]) -> Column:
    """``fields`` are the columns that a condition may read, with their types."""
    if isinstance(condition, str) and condition[:1] in "{[":
        condition = json.loads(condition)
    if condition is None:
        return F.lit(True)
    if isinstance(condition, bool):
        return F.lit(condition)
    if isinstance(condition, str):
        return F.coalesce(F.expr(condition).cast("boolean"), F.lit(False))
    if not isinstance(condition, dict):
        return F.lit(True)
    if "all" in condition:
        return reduce(lambda a, b: a & b, [compile_condition(c, fields) for c in condition["all"]], F.lit(True)) if isinstance(condition["all"], list) else F.lit(True)
    if "any" in condition:
        return reduce(lambda a, b: a | b, [compile_condition(c, fields) for c in condition["any"]], F.lit(False)) if isinstance(condition["any"], list) else F.lit(True)
    if "not" in condition:
        return ~compile_condition(condition["not"], fields)
    if not str(condition.get("field") or "").strip():
        return F.lit(True)
    return _rule(condition["field"], str(condition.get("operator", "eq")).lower(), condition.get("value"), fields)


def _same(left: Column, kind: T.DataType, value) -> Column:
    """Equality of values of one kind; different kinds are never equal."""
    if isinstance(kind, T.StringType):
        return trim_control(left).eqNullSafe(F.lit(value.strip())) if isinstance(value, str) else left.isNull() if value is None else F.lit(False)
    if isinstance(value, str) or isinstance(value, bool) != isinstance(kind, T.BooleanType) and value is not None:
        return F.lit(False)
    return left.eqNullSafe(F.lit(value)) if value is not None else left.isNull()


def _rule(field: str, operator: str, value, fields: Mapping[str, T.DataType]) -> Column:
    known = field in fields
    left, kind = (F.col(field), fields[field]) if known else (F.lit(None).cast("string"), T.StringType())
    listed = isinstance(kind, T.ArrayType)
    if operator == "ne":
        return ~_same(left, kind, value)
    if operator == "exists":
        return left.isNotNull()
    if operator == "not_exists":
        return left.isNull()
    if operator == "in":
        if isinstance(value, list):
            same = [left.eqNullSafe(F.lit(v)) for v in value if v is None or isinstance(v, str) == isinstance(kind, T.StringType)]
            return reduce(lambda a, b: a | b, same, F.lit(False))
        return F.coalesce(F.array_contains(left, F.lit(value)), F.lit(False)) if listed and value is not None else _same(left, kind, value)
    if operator == "contains":
        if value is None or not known:
            return F.lit(False)
        if listed:
            return F.coalesce(F.array_contains(left, F.lit(value)), F.lit(False))
        return F.coalesce(F.contains(left, F.lit(str(value))), F.lit(False)) if isinstance(kind, T.StringType) else F.lit(False)
    if operator == "regex":
        return F.coalesce(left.cast("string").rlike(f"^(?:{value})$"), F.lit(False)) if value is not None and not listed else F.lit(False)
    if operator in ("gt", "gte", "lt", "lte"):
        try:
            right = float(value)
        except (TypeError, ValueError):
            right = None
        number = F.lit(None).cast("double") if listed else left.try_cast("double")
        equal = operator in ("gte", "lte")
        if right is None:
            return F.lit(equal)
        test = {"gt": number > right, "gte": number >= right, "lt": number < right, "lte": number <= right}[operator]
        return F.coalesce(test, F.lit(equal))
    return _same(left, kind, value)
