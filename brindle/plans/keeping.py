"""Conversation memory, feedback, lookups, refresh and pipelines over whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import conversation, ingest, state
from ..operators.hierarchy import SPACE
from ..sources import vectors
from ..streaming import streams
from ..tables import active, table
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query
AS_OF = datetime(2026, 1, 5)
_NOW = "TIMESTAMP '2026-01-05 00:00:00'"

_M = """
WITH m AS (SELECT id, conversation_id, user_id, create_time, CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'bot', 'ai') THEN 'assistant' ELSE r END AS role FROM (
  SELECT *, lower(regexp_replace(role, '^\\s+|\\s+$', '', 'g')) AS r, row_number() OVER (PARTITION BY id ORDER BY update_time DESC) AS rn FROM t_message WHERE deleted = 0) WHERE rn = 1)
"""


def _messages(spark, folder):
    name = F.lower(F.regexp_replace("role", r"^\s+|\s+$", ""))
    role = F.when(name.isin("user", "human"), "user").when(name.isin("assistant", "bot", "ai"), "assistant").otherwise(name)
    rows = active(table(spark, folder, "t_message", "id", "conversation_id", "user_id", "create_time", "role", "deleted"))
    return rows.select("id", "conversation_id", "user_id", "create_time", role.alias("role")).dropDuplicates(["id"])


_HISTORY = """, l AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY create_time DESC, id DESC) AS back FROM m WHERE role IN ('user', 'assistant'))"""


@query(_M + _HISTORY + "SELECT conversation_id, id, role, back FROM l WHERE back <= 4")
def history_last_turns(spark, folder):
    return conversation.last_turns(_messages(spark, folder).where(F.col("role").isin("user", "assistant")), 4).select("conversation_id", "id", "role", "back")


@query(_M + _HISTORY + """, b AS (SELECT *, bool_or(role = 'user') OVER (PARTITION BY conversation_id ORDER BY back DESC ROWS UNBOUNDED PRECEDING) AS begun FROM l WHERE back <= 4)
SELECT conversation_id, id, role, row_number() OVER (PARTITION BY conversation_id ORDER BY back DESC) AS seq FROM b WHERE begun""")
def history_strip_leading_assistant(spark, folder):
    return conversation.history(_messages(spark, folder), 2).select("conversation_id", "id", "role", "seq")


_SUMMARIES = ", s AS (SELECT conversation_id, min(id) AS last_message_id FROM m GROUP BY 1 HAVING count(*) > 6)"


@query(_M + _SUMMARIES + """, u AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY create_time DESC, id DESC) AS back, count(*) OVER (PARTITION BY conversation_id) AS asked FROM m WHERE role = 'user'),
c AS (SELECT conversation_id, id AS before_id FROM u WHERE back = 2 AND asked >= 3), p AS (SELECT c.conversation_id, before_id, last_message_id AS after_id FROM c LEFT JOIN s ON c.conversation_id = s.conversation_id)
SELECT p.conversation_id, after_id, before_id, count(*) AS rows FROM m JOIN p ON m.conversation_id = p.conversation_id WHERE m.id < before_id AND (after_id IS NULL OR m.id > after_id) GROUP BY 1, 2, 3""")
def compaction_range(spark, folder):
    rows = _messages(spark, folder)
    summaries = rows.groupBy("conversation_id").agg(F.min("id").alias("last_message_id"), F.count("*").alias("n")).where("n > 6")
    return conversation.compaction(rows, summaries, 3, 2)


_VOTES = """
v AS (SELECT message_id, user_id, vote, reason, submit_time FROM (SELECT regexp_replace(message_id, '^\\s+|\\s+$', '', 'g') AS message_id, regexp_replace(user_id, '^\\s+|\\s+$', '', 'g') AS user_id, vote, reason, submit_time,
  row_number() OVER (PARTITION BY regexp_replace(message_id, '^\\s+|\\s+$', '', 'g'), regexp_replace(user_id, '^\\s+|\\s+$', '', 'g') ORDER BY submit_time DESC, received_at, delivery_id) AS rn FROM message_feedback_event) WHERE rn = 1)
"""


@query("WITH " + _VOTES + "SELECT * FROM v")
def feedback_upsert(spark, folder):
    return conversation.latest_votes(table(spark, folder, "message_feedback_event"))


@query(_M + "," + _VOTES + "SELECT m.id, m.user_id, CASE WHEN role = 'assistant' THEN vote END AS vote FROM m LEFT JOIN v ON m.id = v.message_id AND m.user_id = v.user_id")
def messages_with_votes(spark, folder):
    votes = conversation.latest_votes(table(spark, folder, "message_feedback_event"))
    return conversation.with_votes(_messages(spark, folder), votes).select("id", "user_id", "vote")


@query("SELECT user_id, conversation_id, last_time, rank FROM (SELECT user_id, conversation_id, max(last_time) AS last_time, row_number() OVER (PARTITION BY user_id ORDER BY max(last_time) DESC NULLS LAST, conversation_id) AS rank FROM t_conversation WHERE deleted = 0 GROUP BY 1, 2) WHERE rank <= 20")
def conversation_page(spark, folder):
    """The first page of every user's list."""
    from pyspark.sql import Window

    rows = active(table(spark, folder, "t_conversation", "user_id", "conversation_id", "last_time", "deleted")).groupBy("user_id", "conversation_id").agg(F.max("last_time").alias("last_time"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("last_time").desc_nulls_last(), "conversation_id"))
    return rows.withColumn("rank", rank).where("rank <= 20")


@query("WITH g AS (SELECT DISTINCT conversation_id FROM t_conversation WHERE deleted = 1) SELECT id, update_time, CASE WHEN g.conversation_id IS NULL THEN deleted ELSE 1 END AS deleted FROM t_message m LEFT JOIN g ON m.conversation_id = g.conversation_id")
def cascade_delete(spark, folder):
    gone = table(spark, folder, "t_conversation", "conversation_id", "deleted").where("deleted = 1")
    return state.soft_delete(table(spark, folder, "t_message", "id", "update_time", "conversation_id", "deleted"), gone, "conversation_id").select("id", "update_time", "deleted")


@query("SELECT b.id, b.name, coalesce(n, 0) AS documents FROM t_knowledge_base b LEFT JOIN (SELECT kb_id, count(*) AS n FROM documents GROUP BY 1) d ON b.id = d.kb_id")
def kb_document_counts(spark, folder):
    return state.recount(table(spark, folder, "t_knowledge_base", "id", "name"), table(spark, folder, "documents", "kb_id"), "id", "kb_id", "documents")


@query("SELECT doc_id, doc_name, create_time FROM documents WHERE doc_name LIKE '%wiki%' AND file_type IS NOT NULL ORDER BY create_time DESC, doc_id LIMIT 10 OFFSET 20")
def docs_keyword_page(spark, folder):
    rows = table(spark, folder, "documents", "doc_id", "doc_name", "file_type", "create_time").where(F.col("doc_name").like("%wiki%") & F.col("file_type").isNotNull())
    return rows.orderBy(F.col("create_time").desc(), "doc_id").offset(20).limit(10).select("doc_id", "doc_name", "create_time")


@query("SELECT d.doc_id, b.name AS kb_name FROM documents d LEFT JOIN t_knowledge_base b ON d.kb_id = b.id AND b.deleted = 0")
def documents_with_base(spark, folder):
    bases = active(table(spark, folder, "t_knowledge_base", "id", "name", "deleted")).select(F.col("id").alias("kb_id"), F.col("name").alias("kb_name"))
    return table(spark, folder, "documents", "doc_id", "kb_id").join(bases, "kb_id", "left").select("doc_id", "kb_name")


@query("""
WITH i AS (SELECT doc_id, id, (metadata->>'chunk_index')::INT AS i FROM (SELECT id, metadata->>'doc_id' AS doc_id, any_value(metadata) AS metadata FROM t_knowledge_vector GROUP BY 1, 2)),
n AS (SELECT doc_id, id, CASE WHEN i % 3 = 0 THEN NULL ELSE i END AS i FROM i)
SELECT doc_id, id, coalesce(i, coalesce(max(i) OVER (PARTITION BY doc_id), -1) + row_number() OVER (PARTITION BY doc_id, i IS NULL ORDER BY id))::INT AS chunk_index FROM n""")
def chunk_auto_index(spark, folder):
    number = F.get_json_object("metadata", "$.chunk_index").cast("int")
    rows = table(spark, folder, "t_knowledge_vector", "id", "metadata").select(F.get_json_object("metadata", "$.doc_id").alias("doc_id"), "id", F.when(number % 3 != 0, number).alias("chunk_index")).dropDuplicates(["id"])
    return state.number(rows, "doc_id", "chunk_index", ["id"])


_SCHEDULE = f"SELECT id, enabled, CASE WHEN length(name) % 5 = 0 THEN NULL ELSE update_time END AS next_run_time, CASE WHEN length(name) % 3 = 0 THEN create_time + INTERVAL 3 DAY END AS lock_until FROM t_intent_node"


@query(f"SELECT id, next_run_time FROM ({_SCHEDULE}) WHERE enabled = 1 AND (next_run_time IS NULL OR next_run_time <= {_NOW}) AND (lock_until IS NULL OR lock_until < {_NOW})")
def due_schedules(spark, folder):
    rows = table(spark, folder, "t_intent_node", "id", "name", "enabled", "update_time", "create_time")
    rows = rows.select("id", "enabled", F.when(F.length("name") % 5 != 0, F.col("update_time")).alias("next_run_time"), F.when(F.length("name") % 3 == 0, F.col("create_time") + F.expr("interval 3 days")).alias("lock_until"))
    return state.due(rows, AS_OF).select("id", "next_run_time")


_SOURCES = """
WITH c AS (SELECT doc_id, md5(coalesce(doc_name, '')) AS etag, create_time AS last_modified, sha256(text) AS content_hash, length(text) AS n FROM documents),
p AS (SELECT doc_id, CASE WHEN n % 7 = 0 THEN etag ELSE 'x' END AS etag, CASE WHEN n % 11 = 0 THEN last_modified END AS last_modified, CASE WHEN n % 2 = 0 THEN content_hash ELSE 'x' END AS content_hash FROM c WHERE n % 5 > 0)
"""


@query(_SOURCES + """SELECT c.doc_id, CASE WHEN p.doc_id IS NULL THEN 'new' WHEN coalesce(c.etag = p.etag, false) OR coalesce(c.last_modified = p.last_modified, false) OR coalesce(c.content_hash = p.content_hash, false)
THEN 'unchanged' ELSE 'changed' END AS decision FROM c LEFT JOIN p ON c.doc_id = p.doc_id""")
def refresh_change_detect(spark, folder):
    now = table(spark, folder, "documents", "doc_id", "doc_name", "create_time", "text").select("doc_id", F.md5(F.coalesce("doc_name", F.lit(""))).alias("etag"), F.col("create_time").alias("last_modified"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"), F.length("text").alias("n"))
    before = now.where("n % 5 > 0").select("doc_id", F.when(F.col("n") % 7 == 0, F.col("etag")).otherwise("x").alias("etag"), F.when(F.col("n") % 11 == 0, F.col("last_modified")).alias("last_modified"), F.when(F.col("n") % 2 == 0, F.col("content_hash")).otherwise("x").alias("content_hash"))
    return state.refresh(now.drop("n"), before, "doc_id")


_STATUS = "upper(regexp_replace(status, '^\\s+|\\s+$', '', 'g'))"


@query(f"SELECT id, CASE WHEN {_STATUS} = 'RUNNING' AND start_time < {_NOW} - INTERVAL 30 MINUTE THEN 'FAILED' ELSE {_STATUS} END AS status FROM t_rag_trace_run")
def stuck_recovery(spark, folder):
    rows = table(spark, folder, "t_rag_trace_run", "id", "status", "start_time").select("id", F.upper(F.regexp_replace("status", SPACE, "")).alias("status"), F.col("start_time").alias("update_time"))
    return state.recover(rows, AS_OF, 30).select("id", "status")


CONDITION = {"all": [{"field": "lang", "operator": "in", "value": ["zh", "en"]}, {"any": [{"field": "n_chars", "operator": "gte", "value": 500}, {"field": "source", "operator": "regex", "value": "wiki-.*"}]}, {"not": {"field": "kb_id", "operator": "not_exists"}}]}


@query("SELECT doc_id FROM documents WHERE lang IN ('zh', 'en') AND (n_chars >= 500 OR n_chars IS NULL OR regexp_full_match(source, 'wiki-.*')) AND kb_id IS NOT NULL")
def condition_filter(spark, folder):
    from ..functions.conditions import compile_condition

    rows = table(spark, folder, "documents", "doc_id", "lang", "n_chars", "source", "kb_id")
    return rows.where(compile_condition(CONDITION, {f.name: f.dataType for f in rows.schema.fields})).select("doc_id")


STEPS = [
    ingest.Step("read", "parser", "enrich", {"types": ["md", "pdf", "docx"]}),
    ingest.Step("enrich", "enhancer", "cut", {"most": 1}, {"field": "lang", "operator": "eq", "value": "none"}),
    ingest.Step("cut", "chunker", None, {"size": 512}),
]

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\x{FEFF}', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_BLANK = r"regexp_replace(coalesce(c, ''), '[\t\n\x0B\f\r\x1C-\x1F \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]+', '', 'g') = ''"


@query(f"""
WITH d AS (SELECT doc_id, text, lang, {_CLEAN} AS c, CASE WHEN NOT coalesce(lower(file_type) IN ('md', 'pdf', 'docx'), false) THEN 'type not allowed' WHEN text IS NULL THEN 'no content' END AS e FROM documents),
l AS (SELECT doc_id, 0 AS step, 'read' AS node, CASE WHEN e IS NULL THEN 'success' ELSE 'failed' END AS outcome, e AS message FROM d
  UNION ALL SELECT doc_id, 1, 'enrich', CASE WHEN lang = 'none' THEN 'success' ELSE 'skipped' END, CASE WHEN coalesce(lang, '') <> 'none' THEN 'Skipped: condition not met' END FROM d WHERE e IS NULL
  UNION ALL SELECT doc_id, 2, 'cut', CASE WHEN {_BLANK} THEN 'failed' ELSE 'success' END, CASE WHEN {_BLANK} THEN 'no text to chunk' END FROM d WHERE e IS NULL)
SELECT doc_id, step::INT AS step, node, outcome, message FROM l""")
def pipeline_conditions(spark, folder):
    """Only which nodes act and which don't: no document meets the enhancer's condition, and chunks are counted, not made."""
    nodes = ingest.NODES | {"chunker": ingest.chunk_count}
    return ingest.node_logs(ingest.run(table(spark, folder, "documents", "doc_id", "text", "lang", "file_type"), STEPS, nodes))


WHOLE = [
    ingest.Step("read", "parser", "enhance", {"types": ["md", "pdf", "docx"]}),
    ingest.Step("enhance", "enhancer", "cut", {"most": 5, "context": True}, {"field": "lang", "operator": "in", "value": ["en", "de", "fr", "es"]}),
    ingest.Step("cut", "chunker", "enrich", {"size": 512, "overlap": 128}),
    ingest.Step("enrich", "enricher", "write", {"most": 3, "document": ["lang", "kb_id"]}),
    ingest.Step("write", "indexer", None, {"fields": ["keywords", "lang", "kb_id"]}),
]


@query()
def pipeline_node_log(spark, folder):
    """The log of the whole chain; ``made`` is a digest of the rows to be indexed of the document."""
    done = ingest.run(table(spark, folder, "documents", "doc_id", "text", "lang", "kb_id", "file_type"), WHOLE)
    return ingest.node_logs(done, F.md5(F.to_json("indexed")).alias("made"))


@query("""
WITH d AS (SELECT doc_id, lang, source, kb_id FROM documents)
SELECT doc_id, '{' || '"chunk_index":"0","doc_id":"' || doc_id || '"' || CASE WHEN kb_id IS NOT NULL THEN ',"kb_id":"' || kb_id || '"' ELSE '' END || coalesce(',"source":"' || source || '"', '') || '}' AS metadata FROM d""")
def indexer_metadata(spark, folder):
    rows = table(spark, folder, "documents", "doc_id", "lang", "source", "kb_id")
    document = F.create_map(F.lit("source"), F.lit("?"), F.lit("kb_id"), F.col("kb_id"), F.lit("lang"), F.col("lang"))
    chunk = F.create_map(F.lit("source"), F.col("source"), F.lit("doc_id"), F.lit("?"))
    made = ingest.indexed_metadata(document, chunk, ["source", "kb_id", "doc_id"], {"doc_id": F.col("doc_id"), "chunk_index": F.lit(0)})
    return rows.select("doc_id", made.alias("metadata"))


@query("SELECT id, metadata->>'doc_id' AS doc_id, '9' AS chunk_index, metadata->>'keywords' IS NOT NULL AS has_keywords FROM t_knowledge_vector WHERE metadata IS NOT NULL")
def metadata_assembly(spark, folder):
    rows = table(spark, folder, "t_knowledge_vector", "id", "metadata").where("metadata is not null")
    own = F.from_json("metadata", "map<string,string>")
    made = vectors.assembled(own, own["collection_name"], own["doc_id"], F.lit(9))
    return rows.select("id", made.alias("m")).select("id", F.col("m")["doc_id"].alias("doc_id"), F.col("m")["chunk_index"].alias("chunk_index"), F.col("m")["keywords"].isNotNull().alias("has_keywords"))


@query()
def breaker_states(spark, folder):
    """Calls of each trace_name: runs in order of start."""
    runs = active(table(spark, folder, "t_rag_trace_run", "id", "trace_name", "status", "start_time", "deleted"))
    at = F.timestamp_diff("MILLISECOND", F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz"), F.col("start_time"))
    calls = runs.where("start_time is not null").select("trace_name", at.alias("at_ms"), F.col("id").alias("call_id"), (F.upper(F.regexp_replace("status", SPACE, "")) != "ERROR").alias("ok"))
    return streams.breaker_states(calls, "trace_name")


@query("SELECT delivery_id, submit_time, row_number() OVER (ORDER BY submit_time, delivery_id) <= 50 AS claimed FROM message_feedback_event")
def queue_claim_window(spark, folder):
    return streams.claims(table(spark, folder, "message_feedback_event", "delivery_id", "submit_time"), 50, "delivery_id", "submit_time")


QUERIES, SQL = REGISTRY.QUERIES, REGISTRY.SQL
