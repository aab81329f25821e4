"""Document pipelines: a chain of nodes, each a function from table to table, with conditions, and a log row per document and node.

A document is a row; its ``status`` is 'running', 'failed' or 'completed'. A node whose condition does not hold for a document
leaves it as it is ('skipped'); after a failure no further node touches it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import compile_condition
from ..functions.text import cleanup, is_blank
from . import chunking

_WORDS = re.compile("[a-z]{3,}")

#: settings -> {column: value}, the error of a document (null for none), and perhaps the name of an array column to be counted in the log.
Node = Callable[[DataFrame, dict], tuple]


@dataclass
class Step:
    id: str
    kind: str
    next: str | None = None
    settings: dict = field(default_factory=dict)
    condition: object = None


def node_kind(name: str) -> str:
    """Trimmed, lower case, with underscores."""
    return name.strip().lower().replace("-", "_")


def order(steps: list[Step]) -> list[Step]:
    """The chain from the one step that no other names. Ids must be unique, named steps exist, and there must be no circle."""
    by = {s.id: s for s in steps}
    if len(by) != len(steps):
        raise ValueError("step ids must be unique")
    missing = {s.next for s in steps if s.next} - set(by)
    if missing:
        raise ValueError(f"unknown next steps: {sorted(missing)}")
    heads = [s for s in steps if s.id not in {x.next for x in steps}]
    if steps and not heads:
        raise ValueError("the chain is a circle")
    chain, at = [], heads[0] if heads else None
    while at is not None:
        if at in chain:
            raise ValueError("the chain is a circle")
        chain.append(at)
        at = by.get(at.next) if at.next else None
    return chain


def parse(rows: DataFrame, settings: dict) -> tuple[dict[str, Column], Column]:
    """raw_text from text, cleaned; allowed types by ``types``."""
    allowed = settings.get("types")
    wrong = ~F.coalesce(F.lower("file_type").isin([t.lower() for t in allowed]), F.lit(False)) if allowed and "ALL" not in allowed else F.lit(False)
    return {"raw_text": cleanup(F.col("text"))}, F.when(wrong, F.lit("type not allowed")).when(F.col("text").isNull(), F.lit("no content"))


def _frequent(text: str, most: int) -> list[str]:
    """The most frequent words of three letters or more, ties in order of the alphabet."""
    return [w for w, _ in sorted(Counter(_WORDS.findall(text.lower())).items(), key=lambda x: (-x[1], x[0]))[:most]]


def keywords(text: Column, most: int) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _frequent(t, most) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def keywords_each(contents: Column, most: int) -> Column:
    """Keywords of each text of an array, joined by commas."""

    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [",".join(_frequent(c, most)) for c in x] for x in lists.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(contents)


def enhance(rows: DataFrame, settings: dict) -> tuple[dict[str, Column], Column]:
    """A stand-in for a language model: ``keywords`` are the most frequent words, and with ``context`` enhanced_text is the raw text
    behind a line of these. Pass ``using`` (column -> {name: column}) to plug one in."""
    using = settings.get("using")
    if using:
        return using(F.col("raw_text")), F.lit(None).cast("string")
    words = keywords(F.col("raw_text"), int(settings.get("most", 5)))
    made = {"keywords": words}
    if settings.get("context"):
        made["enhanced_text"] = F.when(~is_blank(F.col("raw_text")), F.concat(F.array_join(words, " "), F.lit("\n"), F.col("raw_text")))
    return made, F.lit(None).cast("string")


def chunks(rows: DataFrame, settings: dict) -> tuple[dict[str, Column], Column, str]:
    """The contents of the chunks of the enhanced text, or else of the raw one."""
    text = F.col("raw_text")
    if "enhanced_text" in rows.columns:
        text = F.when(is_blank(F.col("enhanced_text")), text).otherwise(F.col("enhanced_text"))
    if settings.get("strategy", "fixed_size") == "fixed_size":
        size, overlap = settings.get("size") or 512, settings.get("overlap", 128)
        made = chunking.pieces(text, "fixed_size", chunk_size=size if size > 0 else 512, overlap_size=overlap if overlap >= 0 else 128)
    else:
        made = chunking.pieces(text, settings["strategy"], **settings.get("options", {}))
    return {"chunks": made}, F.when(is_blank(text), F.lit("no text to chunk")), "chunks"


def enrich(rows: DataFrame, settings: dict) -> tuple[dict[str, Column], Column, str]:
    """chunk_metadata: per chunk its keywords (the same stand-in) and, unless ``attach`` is false, the fields ``document``."""
    own = [x for c in settings.get("document", []) if settings.get("attach", True) for x in (F.lit(c), F.col(c).cast("string"))]
    made = F.transform(keywords_each(F.col("chunks"), int(settings.get("most", 3))), lambda w: F.create_map(*own, F.lit("keywords"), w))
    return {"chunk_metadata": made}, F.lit(None).cast("string"), "chunk_metadata"


def index(rows: DataFrame, settings: dict) -> tuple[dict[str, Column], Column, str]:
    """indexed: per chunk its number, its content of at most 65,535 UTF-16 units and its metadata, as they are to be written.
    Vectors come from a model and are not made here, nor their length checked."""
    contents = chunking.clipped(F.col("chunks"), 65_535)
    none = F.create_map().cast("map<string,string>")

    def row(content: Column, i: Column) -> Column:
        own = F.get(F.col("chunk_metadata"), i) if "chunk_metadata" in rows.columns else none
        return F.struct(i.alias("chunk_index"), content.alias("content"), indexed_metadata(none, own, settings.get("fields", []), {"doc_id": F.col("doc_id"), "chunk_index": i}).alias("metadata"))

    empty = F.coalesce(F.size("chunks"), F.lit(0)) <= 0
    return {"indexed": F.transform(contents, row)}, F.when(empty, F.lit("no chunks to index")), "indexed"


def chunk_count(rows: DataFrame, settings: dict) -> tuple[dict[str, Column], Column]:
    """Only how many pieces of ``size`` code points the raw text would give."""
    size = int(settings.get("size", 512))
    return {"chunks": F.ceil(F.length("raw_text") / size).cast("int")}, F.when(is_blank(F.col("raw_text")), F.lit("no text to chunk"))


NODES: dict[str, Node] = {"parser": parse, "enhancer": enhance, "chunker": chunks, "enricher": enrich, "indexer": index}


def run(documents: DataFrame, steps: list[Step], nodes: dict[str, Node] | None = None) -> DataFrame:
    """The documents with the columns that nodes add, status, error, and logs: array of (node, outcome, message) in order."""
    nodes = nodes or NODES
    logs = F.array().cast("array<struct<node: string, outcome: string, message: string>>")
    rows = documents.withColumns({"status": F.lit("running"), "error": F.lit(None).cast("string"), "logs": logs})
    for step in order(steps):
        kind = node_kind(step.kind)
        if kind not in nodes:
            raise ValueError(f"unknown node: {step.kind}")
        values, error, *counted = nodes[kind](rows, step.settings)
        wanted = compile_condition(step.condition, {f.name: f.dataType for f in rows.schema.fields})
        rows = rows.withColumns({"_on": (F.col("status") == "running"), "_go": F.coalesce(wanted, F.lit(False)), "_error": error})
        acts = F.col("_on") & F.col("_go")
        fine = acts & F.col("_error").isNull()
        present = set(rows.columns)
        made = {c: F.when(fine, v).otherwise(F.col(c)) if c in present else F.when(fine, v) for c, v in values.items()}
        rows = rows.withColumns(made)  # a projection of its own: the log counts what it made
        outcome = F.when(~F.col("_go"), "skipped").when(F.col("_error").isNull(), "success").otherwise("failed")
        message = F.when(~F.col("_go"), "Skipped: condition not met").when(F.col("_error").isNotNull(), F.col("_error"))
        if counted:
            message = message.otherwise(F.concat(F.greatest(F.coalesce(F.size(counted[0]), F.lit(0)), F.lit(0)).cast("string"), F.lit(" chunks")))
        entry = F.struct(F.lit(step.id).alias("node"), outcome.alias("outcome"), message.alias("message"))
        made = {}
        made["logs"] = F.when(F.col("_on"), F.concat("logs", F.array(entry))).otherwise(F.col("logs"))
        made["error"] = F.when(acts & F.col("_error").isNotNull(), F.col("_error")).otherwise(F.col("error"))
        made["status"] = F.when(acts & F.col("_error").isNotNull(), "failed").otherwise(F.col("status"))
        rows = rows.withColumns(made).drop("_on", "_go", "_error")
    return rows.withColumn("status", F.when(F.col("status") == "running", "completed").otherwise(F.col("status")))


def node_logs(done: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, step, node, outcome, message), a row per document and node that was reached, with more columns of the document."""
    rows = done.select("doc_id", *more, F.posexplode("logs").alias("step", "log"))
    return rows.select("doc_id", "step", "log.*", *[c for c in rows.columns if c not in ("doc_id", "step", "log")])


def indexed_metadata(document: Column, chunk: Column, allowed: list[str], base: dict[str, Column]) -> Column:
    """JSON of the whitelisted document and chunk fields (maps of strings; the chunk's win, nulls left out) and the base fields,
    which always win. Keys come in order of the alphabet."""
    keep = F.lit(allowed).cast("array<string>") if allowed else F.array().cast("array<string>")
    empty = F.create_map().cast("map<string,string>")
    low = F.map_filter(F.coalesce(document, empty), lambda k, v: F.array_contains(keep, k) & v.isNotNull())
    high = F.map_filter(F.coalesce(chunk, empty), lambda k, v: F.array_contains(keep, k) & v.isNotNull())
    fixed = F.create_map(*[x for k, v in base.items() for x in (F.lit(k), v.cast("string"))])
    under = F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k) & ~F.map_contains_key(fixed, k))
    middle = F.map_filter(high, lambda k, v: ~F.map_contains_key(fixed, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(under, middle, fixed)))))
