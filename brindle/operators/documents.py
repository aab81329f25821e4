"""State of documents, chunks and conversations as functions from tables to tables, and their guards.

As in ``state``, callers write what is returned to a new place. Vectors that fall away and documents to be embedded again are returned
as tables of ids, for the vector sink.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, token_count
from .state import patch

#: Fixed value: rows of one call of an embedding model.
BATCH = 32


def updated_documents(documents: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Changes patch the documents that are not RUNNING; mode 'chunk' clears the pipeline, 'pipeline' the chunk strategy."""
    running = documents.where("status = 'RUNNING'").select(key)
    done = patch(documents, changes.join(running, key, "left_anti"), key)
    mode = F.lower(F.col("process_mode"))
    cleared = {"pipeline_id": F.when(~F.coalesce(mode == "chunk", F.lit(False)), F.col("pipeline_id")), "chunk_strategy": F.when(~F.coalesce(mode == "pipeline", F.lit(False)), F.col("chunk_strategy"))}
    return done.withColumns(cleared)


def switched(documents: DataFrame, chunks: DataFrame, flags: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, gone, embed) after the flags (doc_id, enabled): the flag goes to all chunks of a document; gone are the
    ids of chunks whose vectors fall away (of documents that were on), embed those to be embedded (of documents that were off)."""
    new = flags.select(key, F.col("enabled").alias("_new"))
    changed = documents.join(new, key).where("enabled <> _new").select(key, "_new")
    set_to = lambda rows: rows.join(new, key, "left").withColumn("enabled", F.coalesce("_new", "enabled")).drop("_new")
    own = chunks.join(changed, key)
    return set_to(documents), set_to(chunks), own.where("_new = 0").select("id"), own.where("_new = 1").select("id")


def edited_chunks(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """The chunks with new contents (id, content): hash, characters and tokens are counted again, ``edited`` marks what must be
    embedded again. Equal or blank contents change nothing."""
    joined = chunks.join(changes.select("id", F.col("content").alias("_new")), "id", "left")
    edited = F.coalesce((F.col("_new") != F.col("content")) & ~is_blank(F.col("_new")), F.lit(False))
    content = F.when(edited, F.col("_new")).otherwise(F.col("content"))
    made = {"content_hash": F.sha2(F.encode(content, "UTF-8"), 256), "char_count": F.length(content), "token_count": token_count(content)}
    return joined.select(*[content.alias("content") if c == "content" else F.when(edited, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in chunks.columns], edited.alias("edited"))


def flagged_chunks(chunks: DataFrame, documents: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, gone, rebuild) after the flags (id, enabled), of documents that are enabled only: gone are the ids of chunks turned
    off, rebuild the documents of chunks turned on, whose vectors are all made again."""
    on = documents.where("enabled = 1").select("doc_id")
    new = flags.select("id", F.col("enabled").alias("_new")).join(chunks.join(on, "doc_id", "left_semi").select("id"), "id", "left_semi")
    joined = chunks.join(new, "id", "left")
    changed = joined.where("_new <> enabled")
    done = joined.withColumn("enabled", F.coalesce("_new", "enabled")).drop("_new")
    return done, changed.where("_new = 0").select("id"), changed.where("_new = 1").select("doc_id").distinct()


def rebuilt(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, id, content, chunk_index) of the enabled chunks of the documents to be embedded again, in the order of their index."""
    rows = chunks.where("enabled = 1").join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.select("doc_id", "id", "content", "chunk_index").repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index", "id")


def token_backfill(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("token_count", F.coalesce("token_count", token_count(F.col("content"))))


def missing_keys(config: str | None, defaults: dict) -> list[str]:
    """The default keys that a chunk configuration lacks; all of them if it is no JSON object. Runs on the driver."""
    try:
        given = json.loads(config or "")
    except ValueError:
        given = None
    return [k for k in defaults if not isinstance(given, dict) or k not in given]


def stage_times(logs: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """Adds other_ms: what the total of a log leaves beside the stages of its mode (not below 0); null stages count 0."""
    rest = F.col("total_ms")
    for mode, names in parts.items():
        rest = F.when(F.col("process_mode") == mode, F.col("total_ms") - sum((F.coalesce(F.col(n), F.lit(0)) for n in names), F.lit(0))).otherwise(rest)
    return logs.withColumn("other_ms", F.greatest(rest, F.lit(0)))


def touched(conversations: DataFrame, asked: DataFrame, title: Callable[[Column], Column]) -> DataFrame:
    """(conversation_id, user_id, title, last_time) after the questions (conversation_id, user_id, content, create_time): known
    conversations get a later last_time, unknown ones are made, with a title from their first question."""
    key = ["conversation_id", "user_id"]
    new = asked.groupBy(*key).agg(F.max("create_time").alias("_last"), F.min(F.struct("create_time", "content"))["content"].alias("_first"))
    old = conversations.select(*key, "title", "last_time", F.lit(True).alias("_known"))
    both = old.join(new, key, "full_outer")
    return both.select(*key, F.when(F.col("_known"), F.col("title")).otherwise(title(F.col("_first"))).alias("title"), F.greatest("last_time", "_last").alias("last_time"))


def allowed_feedback(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """The feedback on an assistant's message that exists and belongs to the same user."""
    own = messages.where("role = 'assistant'").select(F.col("id").alias("message_id"), "user_id")
    return feedback.join(own, ["message_id", "user_id"], "left_semi")


def rejected(questions: DataFrame, reply: str) -> DataFrame:
    """Two rows for each question that was turned away: the user's, and the fixed reply after it."""
    both = F.array(F.struct(F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("content")), F.struct(F.lit(1).alias("seq"), F.lit("assistant").alias("role"), F.lit(reply).alias("content")))
    return questions.select("conversation_id", "user_id", F.explode(both).alias("m")).select("conversation_id", "user_id", "m.seq", "m.role", "m.content")


def matching(**values: object) -> Column:
    """Equality with every value that is given; None and blank texts set no condition."""
    out = F.lit(True)
    for name, value in values.items():
        if value is not None and not (isinstance(value, str) and not value.strip()):
            out = out & (F.col(name) == value)
    return out


def like_any(keyword: str | None, *columns: str) -> Column:
    """Any of the columns holds the keyword, whose % and _ keep their meaning; true without a keyword."""
    if not keyword or not keyword.strip():
        return F.lit(True)
    out = F.lit(False)
    for name in columns:
        out = out | F.coalesce(F.col(name).like(f"%{keyword.strip()}%"), F.lit(False))
    return out


def page(rows: DataFrame, order: list[Column], current: int, size: int) -> DataFrame:
    """The rows of a page (from 1), with total and pages, which are counted apart."""
    total = rows.agg(F.count("*").alias("total"))
    some = rows.orderBy(*order).offset((max(1, current) - 1) * size).limit(size)
    return some.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size).cast("bigint"))  # one row


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int = BATCH) -> DataFrame:
    """(id, content, embedding): vectors that rows (id, content, embedding) have stay, the others are made by ``embed``, which takes
    up to ``batch`` texts at once and must give one vector of ``dim`` numbers for each; a blank text has none."""
    have = rows.select("id", "content", "embedding")
    need = have.where(F.col("embedding").isNull() & ~is_blank(F.col("content"))).select("id", "content")

    def make(batches):
        for part in batches:
            texts, out = part.column(1).to_pylist(), []
            for low in range(0, len(texts), batch):
                made = embed(texts[low : low + batch])
                if len(made) != len(texts[low : low + batch]) or any(len(v) != dim for v in made):
                    raise ValueError(f"the model must give one vector of {dim} numbers for each text")
                out += made
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.list_(pa.float32()))], names=["id", "content", "embedding"])

    made = need.mapInArrow(make, "id string, content string, embedding array<float>")
    return have.where(F.col("embedding").isNotNull() | is_blank(F.col("content"))).unionByName(made)
