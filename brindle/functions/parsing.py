"""What a language model returns, parsed leniently: fences are stripped, what is no JSON of the expected kind gives null or nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, strip_fence, trim_control


def parsed(raw: Column) -> Column:
    """The answer as a variant; null if it is no JSON."""
    return F.try_parse_json(strip_fence(raw))


def is_kind(value: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def rewritten(raw: Column) -> Column:
    """struct(rewrite, sub_questions) of {rewrite, sub_questions: [...]}; null if there is no rewrite. Only texts count as
    sub-questions; without any the rewrite is the only one."""
    value = parsed(raw)
    text = trim_control(F.try_variant_get(value, "$.rewrite", "string"))
    every = F.coalesce(F.try_variant_get(value, "$.sub_questions", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(F.filter(every, lambda v: is_kind(v, "STRING")), lambda v: trim_control(F.try_variant_get(v, "$", "string")))
    asked = F.filter(texts, lambda t: ~is_blank(t))
    made = F.struct(text.alias("rewrite"), F.when(F.size(asked) > 0, asked).otherwise(F.array(text)).alias("sub_questions"))
    return F.when(is_kind(value, "OBJECT") & ~is_blank(text), made)


def scored_ids(raw: Column) -> Column:
    """array<struct<id, score>> of an array of {id, score}, or of {results: [...]}, highest score first; entries without both are left out."""
    value = parsed(raw)
    listed = F.when(is_kind(value, "ARRAY"), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.try_variant_get(value, "$.results", "array<variant>"))
    pairs = F.transform(F.coalesce(listed, F.array().cast("array<variant>")), lambda v: F.struct(F.try_variant_get(v, "$.id", "string").alias("id"), F.try_variant_get(v, "$.score", "double").alias("score")))
    good = F.filter(pairs, lambda p: p["id"].isNotNull() & p["score"].isNotNull())
    ordered = F.array_sort(F.transform(good, lambda p: F.struct((-p["score"]).alias("s"), p["id"].alias("id"))))
    return F.transform(ordered, lambda p: F.struct(p["id"].alias("id"), (-p["s"]).alias("score")))


def tool_parameters(raw: Column, declared: dict[str, str | None]) -> Column:
    """map of the declared parameters that the answer's object has and that are not null, as text; defaults fill missing ones."""
    value = parsed(raw)
    entries = F.array(*[F.struct(F.lit(name).alias("key"), F.coalesce(F.when(is_kind(value, "OBJECT"), F.try_variant_get(value, f"$['{name}']", "string")), F.lit(default)).alias("value")) for name, default in declared.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
