"""The retrieval engine, parsed answers, operations on trees, and state of documents and chunks, over whole tables.

Answers of a model are put together from columns, scores and flags from hashes of ids, the same in both engines.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.vectors import norm
from ..operators import documents, engine, hierarchy, retrieval, trees
from ..tables import active, table
from .general import _NODES
from .keeping import _M, _messages
from .registry import Registry
from .retrieving import hashed

REGISTRY = Registry()
query = REGISTRY.query
_HASH = "round(('0x' || md5({})[:4])::INT / 65535.0::DOUBLE, 4)"

_ENGINE = f"""
WITH u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM (SELECT id, metadata->>'collection_name' AS c, CAST(any_value(embedding) AS DOUBLE[]) AS e FROM t_knowledge_vector WHERE len(embedding) = 64 GROUP BY 1, 2)),
b AS (SELECT collection_name AS c, min(length(name)) % 3 AS top_k FROM t_knowledge_base WHERE deleted = 0 GROUP BY 1),
q AS (SELECT u.c AS request, arg_min(e, id) AS qe, any_value(top_k) AS top_k, {_HASH.format('u.c')} AS s FROM u JOIN b ON u.c = b.c WHERE n > 0 GROUP BY u.c),
a AS (SELECT request, s, top_k, u.c, id, round(CASE WHEN n = 0 THEN 0 ELSE list_dot_product(e, qe) / n / sqrt(list_dot_product(qe, qe)) END, 6) AS score FROM u, q WHERE u.c IN (SELECT c FROM b)),
r AS (SELECT *, row_number() OVER (PARTITION BY request, c ORDER BY score DESC, id) AS position FROM a),
f AS (SELECT request, id, score, position, 1 AS p FROM r WHERE c = request AND s >= 0.4 AND position <= (CASE WHEN top_k > 0 THEN top_k ELSE 2 END) * 2
  UNION ALL SELECT request, id, score, position, 3 FROM r WHERE s < 0.6 AND position <= 3),
d AS (SELECT request, id, max(score) AS score, min(row(p, position, id)) AS first FROM f GROUP BY 1, 2),
s AS (SELECT request, id, score, row_number() OVER (PARTITION BY request ORDER BY first, id) AS slot FROM d)
"""


def _engine(spark, folder):
    vectors = table(spark, folder, "t_knowledge_vector", "id", "metadata", "embedding")
    bases = active(table(spark, folder, "t_knowledge_base", "collection_name", "name", "deleted")).groupBy("collection_name").agg((F.min(F.length("name")) % 3).alias("top_k"))
    usable = vectors.where((F.size("embedding") == 64) & (norm(F.col("embedding")) > 0)).select("id", "embedding", retrieval.metadata("collection_name").alias("collection_name"))
    probes = usable.groupBy("collection_name").agg(F.min_by(F.col("embedding").cast("array<double>"), "id").alias("vector")).join(bases, "collection_name")
    requests = probes.select(F.col("collection_name").alias("request"), "vector", "top_k", hashed(F.col("collection_name")).alias("best"))
    intents = requests.select("request", F.col("request").alias("item"), F.col("request").alias("collection_name"), "top_k", F.col("best").alias("score"))

    def broken(_: DataFrame) -> DataFrame:
        raise RuntimeError("not reachable")

    channels = [
        engine.Channel("VECTOR_GLOBAL", 3, engine.everywhere(vectors, bases, 1), F.col("best") < engine.GLOBAL_BELOW),
        engine.Channel("KEYWORD_ES", 2, broken),
        engine.Channel("INTENT_DIRECTED", 1, engine.directed(vectors, intents, 2), F.col("best") >= engine.DIRECTED_LEAST),
    ]
    return requests, engine.retrieve(requests, channels, [retrieval.deduplicate, broken, partial(retrieval.rerank_noop, top=5)])


@query(_ENGINE + "SELECT request, id AS key, id, score, slot FROM s WHERE slot <= 5")
def retrieve_engine(spark, folder):
    """Two channels and one that fails, then de-duplication, a processor that fails, and the first five of each request."""
    return _engine(spark, folder)[1]


@query(_ENGINE + f""", i AS (SELECT request AS question, 'x' || t AS item, ({_HASH.format("request || t")}) AS score, top_k + t AS top_k FROM q, range(3) AS x(t)),
k AS (SELECT question, coalesce(max(top_k) FILTER (score >= 0.35 AND top_k > 0), 10) AS k FROM i GROUP BY 1),
o AS (SELECT question, item FROM i WHERE score >= 0.35)
SELECT s.request AS question, coalesce(o.item, 'multi_channel') AS item, s.id, s.slot FROM s JOIN k ON s.request = k.question AND slot <= k LEFT JOIN o ON s.request = o.question WHERE slot <= 5""")
def question_rows(spark, folder):
    """Rows of the engine for questions of three intents each."""
    requests, rows = _engine(spark, folder)
    each = requests.select(F.col("request").alias("question"), "top_k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t"))
    intents = each.select("question", F.concat(F.lit("x"), "t").alias("item"), hashed(F.concat("question", F.col("t").cast("string"))).alias("score"), (F.col("top_k") + F.col("t")).alias("top_k"), F.when(F.col("t") == 1, 0).alias("kind"))
    return engine.for_questions(intents, rows.select(F.col("request").alias("question"), "id", "slot"))


@query("""
WITH i AS (SELECT conversation_id AS question, id AS item, CASE WHEN md5(id) < '6' THEN 2 WHEN md5(id) < 'b' THEN 0 END AS kind, CASE WHEN md5(id) LIKE '%a' THEN 'own ' || id ELSE ' ' END AS template, md5(id) LIKE '%7' OR md5(id) LIKE '%a' AS has
  FROM (SELECT DISTINCT conversation_id, id FROM t_message WHERE deleted = 0)),
s AS (SELECT *, coalesce(kind = 2, false) OR has AS stays FROM i)
SELECT question, CASE WHEN bool_or(stays AND coalesce(kind, 0) = 0) AND bool_or(stays AND coalesce(kind, 0) = 2) THEN 'MIXED' WHEN bool_or(stays AND coalesce(kind, 0) = 0) THEN 'KB_ONLY' WHEN bool_or(stays AND coalesce(kind, 0) = 2) THEN 'MCP_ONLY' ELSE 'EMPTY' END AS scene,
  CASE WHEN count(*) FILTER (stays) = 1 THEN max(template) FILTER (stays AND trim(template) <> '') END AS template FROM s GROUP BY 1""")
def prompt_plan(spark, folder):
    rows = active(table(spark, folder, "t_message", "conversation_id", "id", "deleted")).select(F.col("conversation_id").alias("question"), F.col("id").alias("item")).distinct()
    h = F.md5("item")
    intents = rows.select("question", "item", F.when(h < "6", 2).when(h < "b", 0).alias("kind"), F.when(h.endswith("a"), F.concat(F.lit("own "), "item")).otherwise(" ").alias("template"))
    return engine.plan_of_prompt(intents, rows.where(h.endswith("7") | h.endswith("a")))


_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@query(f"""
WITH d AS (SELECT DISTINCT id, {_TRIM.format('title')} AS t, {_TRIM.format('user_id')} AS u, md5(id)[1] AS h FROM t_conversation)
SELECT id, CASE WHEN h NOT IN ('4', '5', '6') AND t <> '' THEN t END AS rewrite, CASE WHEN h NOT IN ('4', '5', '6') AND t <> '' THEN 1 + (u IS NOT NULL)::INT END AS asked, CASE WHEN h NOT IN ('4', '5', '6') AND t <> '' THEN coalesce(u, t) END AS first FROM d""")
def rewrite_parse(spark, folder):
    """Answers of a rewriting model: plain, fenced, broken off, or an array where an object is due."""
    rows = table(spark, folder, "t_conversation", "id", "title", "user_id").distinct()
    body, h = F.to_json(F.struct(F.col("title").alias("rewrite"), F.array("user_id", F.lit("  "), "title").alias("sub_questions"))), F.substring(F.md5("id"), 1, 1)
    raw = F.when(h < "4", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(h < "6", F.substring(body, 2, 9999)).when(h == "6", F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    made = rows.select("id", parsing.rewritten(raw).alias("r"))
    return made.select("id", "r.rewrite", F.when(F.col("r").isNotNull(), F.size("r.sub_questions")).alias("asked"), F.get("r.sub_questions", F.lit(0)).alias("first"))


@query(_NODES + f""", n AS (SELECT DISTINCT intent_code AS code, parent_code AS p FROM latest)
SELECT code AS question, code AS id, {_HASH.format('code')} AS score FROM n UNION ALL SELECT n.code, m.code, {_HASH.format('m.code')} FROM n JOIN n m ON n.p = m.code""")
def intent_parse(spark, folder):
    """Scored ids of an answer, joined with the nodes that are known: its own, its parent's as it is spelled, one without a score, and one that is none."""
    nodes = hierarchy.live_nodes(table(spark, folder, "t_intent_node", "id", "intent_code", "parent_code", "update_time", "deleted"), keep_columns=("parent_code",))
    entry = lambda id_, score: F.struct(id_.alias("id"), score.alias("score"))
    listed = F.array(entry(F.col("code"), hashed(F.col("code"))), entry(F.col("parent_code"), hashed(F.col("parent_code"))), entry(F.lit("no such node"), F.lit(0.9)), entry(F.col("code"), F.lit(None).cast("double")))
    raw = F.when(F.md5("code") < "8", F.to_json(listed)).otherwise(F.to_json(F.struct(listed.alias("results"))))
    scores = nodes.select(F.col("code").alias("question"), F.explode(parsing.scored_ids(raw)).alias("s")).select("question", "s.id", "s.score")
    return scores.join(nodes.select(F.col("code").alias("id")), "id").select("question", "id", "score")


@query("""SELECT DISTINCT id, metadata->>'doc_id' AS doc_id, coalesce(metadata->>'chunk_index', '0') AS chunk_index, coalesce(metadata->>'top_k', '5') AS top_k FROM t_knowledge_vector""")
def tool_parameters(spark, folder):
    rows = table(spark, folder, "t_knowledge_vector", "id", "metadata").select("id", parsing.tool_parameters(F.col("metadata"), {"doc_id": None, "chunk_index": "0", "top_k": "5"}).alias("m"))
    return rows.select("id", F.col("m")["doc_id"].alias("doc_id"), F.col("m")["chunk_index"].alias("chunk_index"), F.col("m")["top_k"].alias("top_k")).distinct()


def _nodes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "t_intent_node", "id", "intent_code", "parent_code", "level", "update_time", "deleted", "name", "sort_order", "enabled")
    nodes = hierarchy.live_nodes(rows, keep_columns=("level", "name", "sort_order", "enabled")).withColumn("sort_order", F.coalesce("sort_order", F.lit(0)))
    tree = hierarchy.hierarchy(nodes)
    return tree, tree.select("code", "level", "name", "sort_order", "enabled")


_STEPS = _NODES + """, u AS (SELECT code, kind, depth, i, path[i] AS step FROM (SELECT code, kind, depth, path, unnest(range(1, len(path) + 1)) AS i FROM tree)),
l AS (SELECT u.*, n.level, n.name, coalesce(n.sort_order, 0) AS sort_order, lag(n.level) OVER (PARTITION BY u.code ORDER BY i) AS above FROM u JOIN latest n ON u.step = n.intent_code)"""


@query(_STEPS + "SELECT code, coalesce(arg_max(step, i) FILTER (level = 1 AND (i = 1 OR above = 0)), arg_min(step, i)) AS system FROM l GROUP BY 1")
def system_node(spark, folder):
    return trees.systems(*_nodes(spark, folder))


@query(_STEPS + "SELECT code, string_agg(name, ' > ' ORDER BY i) AS path FROM l GROUP BY 1")
def named_path(spark, folder):
    return trees.named_paths(*_nodes(spark, folder)).select("code", F.when(F.col("path") != "", F.col("path")).alias("path"))


@query(_STEPS + ", k AS (SELECT code, any_value(depth) AS depth, list(row(sort_order, step) ORDER BY i) AS key FROM l WHERE kind = 'tree' GROUP BY 1) SELECT code, depth, row_number() OVER (ORDER BY key) AS place FROM k")
def tree_order(spark, folder):
    return trees.ordered(*_nodes(spark, folder), ["sort_order"])


_PAIRS = _NODES + ", c AS (SELECT path[i] AS a, code AS d FROM (SELECT code, path, unnest(range(1, len(path))) AS i FROM tree)), s AS (SELECT a, d FROM c WHERE md5(a) < '8' AND md5(d) >= '8')"


@query(_PAIRS + "SELECT a AS code, count(*) AS blocking FROM s GROUP BY 1")
def delete_blocked(spark, folder):
    tree, _ = _nodes(spark, folder)
    return trees.blocked(tree, tree.where(F.md5("code") < "8"))


@query(_PAIRS + "SELECT a AS code, count(*) AS blocking FROM s JOIN latest ON d = intent_code WHERE enabled = 1 GROUP BY 1")
def disable_blocked(spark, folder):
    tree, _ = _nodes(spark, folder)
    return trees.blocked(tree, tree.where(F.md5("code") < "8"), F.col("enabled") == 1)


_STATE = """
WITH d AS (SELECT doc_id::VARCHAR AS doc_id, (file_type IS NOT NULL)::INT AS enabled FROM documents),
c AS (SELECT id, metadata->>'doc_id' AS doc_id, any_value(content) AS content, any_value((metadata->>'chunk_index')::INT) AS i FROM t_knowledge_vector GROUP BY 1, 2)
"""


def _state(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "file_type").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("file_type").isNotNull().cast("int").alias("enabled"))
    rows = table(spark, folder, "t_knowledge_vector", "id", "metadata", "content").select("id", retrieval.metadata("doc_id").alias("doc_id"), "content", retrieval.metadata("chunk_index").cast("int").alias("chunk_index"))
    chunks = rows.groupBy("id", "doc_id").agg(F.first("content").alias("content"), F.first("chunk_index").alias("chunk_index"))
    return docs, chunks.withColumn("enabled", (F.col("chunk_index") % 2).cast("int"))


@query(_STATE + """, f AS (SELECT doc_id, (md5('x' || doc_id) < '8')::INT AS new FROM d WHERE md5(doc_id) < '4'), x AS (SELECT d.doc_id, new FROM d JOIN f ON d.doc_id = f.doc_id WHERE enabled <> new)
SELECT CASE WHEN new = 0 THEN 'gone' ELSE 'embed' END AS what, id FROM c JOIN x ON c.doc_id = x.doc_id""")
def document_switch(spark, folder):
    docs, chunks = _state(spark, folder)
    flags = docs.where(F.md5("doc_id") < "4").select("doc_id", (F.md5(F.concat(F.lit("x"), "doc_id")) < "8").cast("int").alias("enabled"))
    _, _, gone, embed = documents.switched(docs, chunks, flags)
    return gone.select(F.lit("gone").alias("what"), "id").unionByName(embed.select(F.lit("embed").alias("what"), "id"))


@query(_STATE + """, f AS (SELECT id, (md5('y' || id) < '8')::INT AS new FROM c WHERE md5(id) < '6'),
x AS (SELECT c.id, c.doc_id, new FROM c JOIN f ON c.id = f.id JOIN d ON c.doc_id = d.doc_id WHERE d.enabled = 1 AND new <> i % 2)
SELECT 'gone' AS what, id FROM x WHERE new = 0 UNION ALL SELECT DISTINCT 'rebuild', doc_id FROM x WHERE new = 1""")
def chunk_switch(spark, folder):
    docs, chunks = _state(spark, folder)
    flags = chunks.where(F.md5("id") < "6").select("id", (F.md5(F.concat(F.lit("y"), "id")) < "8").cast("int").alias("enabled"))
    _, gone, rebuild = documents.flagged_chunks(chunks, docs, flags)
    return gone.select(F.lit("gone").alias("what"), "id").unionByName(rebuild.select(F.lit("rebuild").alias("what"), F.col("doc_id").alias("id")))


@query(_STATE + "SELECT c.doc_id, c.id, c.i AS chunk_index, length(content) AS chars FROM c JOIN d ON c.doc_id = d.doc_id WHERE c.i % 2 = 1 AND md5(d.doc_id) < '5'")
def rebuild_vectors(spark, folder):
    docs, chunks = _state(spark, folder)
    return documents.rebuilt(chunks, docs.where(F.md5("doc_id") < "5")).select("doc_id", "id", "chunk_index", F.length("content").alias("chars"))


@query(_STATE + """, n AS (SELECT id, content, CASE WHEN md5(id) < '3' THEN content || '!' WHEN md5(id) < '6' THEN content WHEN md5(id) < '9' THEN ' ' END AS new FROM c),
e AS (SELECT id, CASE WHEN md5(id) < '3' AND content IS NOT NULL THEN new ELSE content END AS content, coalesce(md5(id) < '3' AND content IS NOT NULL, false) AS edited FROM n)
SELECT id, edited, CASE WHEN edited THEN sha256(content) ELSE 'old' END AS content_hash, CASE WHEN edited THEN length(content) ELSE -1 END AS char_count FROM e""")
def chunk_edit(spark, folder):
    _, chunks = _state(spark, folder)
    h = F.md5("id")
    changes = chunks.select("id", F.when(h < "3", F.concat("content", F.lit("!"))).when(h < "6", F.col("content")).when(h < "9", F.lit(" ")).alias("content"))
    rows = chunks.select("id", "content", F.lit("old").alias("content_hash"), F.lit(-1).alias("char_count"))
    return documents.edited_chunks(rows, changes).select("id", "edited", "content_hash", F.col("char_count").cast("bigint").alias("char_count"))


@query("""
WITH d AS (SELECT doc_id, CASE WHEN md5(doc_id::VARCHAR) < '3' THEN 'RUNNING' ELSE 'DONE' END AS status, 'p' AS pipeline_id, 's' AS chunk_strategy, 'chunk' AS process_mode, source FROM documents),
n AS (SELECT *, status <> 'RUNNING' AND doc_id % 2 = 0 AS hit FROM d)
SELECT doc_id, CASE WHEN hit THEN 'pipeline' ELSE process_mode END AS process_mode, CASE WHEN hit THEN 'new' ELSE source END AS source, CASE WHEN hit THEN pipeline_id END AS pipeline_id, CASE WHEN NOT hit THEN chunk_strategy END AS chunk_strategy FROM n""")
def document_update(spark, folder):
    rows = table(spark, folder, "documents", "doc_id", "source").select("doc_id", "source", F.when(F.md5(F.col("doc_id").cast("string")) < "3", "RUNNING").otherwise("DONE").alias("status"), F.lit("p").alias("pipeline_id"), F.lit("s").alias("chunk_strategy"), F.lit("chunk").alias("process_mode"))
    changes = rows.where("doc_id % 2 = 0").select("doc_id", F.lit("pipeline").alias("process_mode"), F.lit("new").alias("source"), F.lit(None).cast("string").alias("pipeline_id"))
    return documents.updated_documents(rows, changes).select("doc_id", "process_mode", "source", "pipeline_id", "chunk_strategy")


@query("SELECT id, entry_method, greatest(CASE entry_method WHEN 'api' THEN duration_ms - length(trace_name) * 10 - coalesce(length(user_id), 0) WHEN 'web' THEN duration_ms - length(trace_name) * 10 ELSE duration_ms END, 0) AS other_ms FROM t_rag_trace_run WHERE duration_ms IS NOT NULL")
def stage_durations(spark, folder):
    rows = table(spark, folder, "t_rag_trace_run", "id", "entry_method", "trace_name", "user_id", "duration_ms").where("duration_ms is not null")
    logs = rows.select("id", "entry_method", F.col("entry_method").alias("process_mode"), F.col("duration_ms").alias("total_ms"), (F.length("trace_name") * 10).alias("parse_ms"), F.length("user_id").alias("cut_ms"))
    return documents.stage_times(logs, {"api": ["parse_ms", "cut_ms"], "web": ["parse_ms"]}).select("id", "entry_method", "other_ms")


@query(_M + """, c AS (SELECT conversation_id, user_id, min(title) AS title, max(last_time) AS last_time FROM t_conversation WHERE md5(conversation_id) >= '5' GROUP BY 1, 2),
n AS (SELECT conversation_id, user_id, max(create_time) AS last, arg_min(id, row(create_time, id)) AS first FROM m WHERE role = 'user' GROUP BY 1, 2)
SELECT coalesce(c.conversation_id, n.conversation_id) AS conversation_id, coalesce(c.user_id, n.user_id) AS user_id, CASE WHEN c.conversation_id IS NULL THEN first[:20] ELSE title END AS title, greatest(last_time, last) AS last_time
FROM c FULL JOIN n ON c.conversation_id = n.conversation_id AND c.user_id = n.user_id""")
def conversation_touch(spark, folder):
    """A third of the conversations is missing and made anew; ids stand for the words of a question."""
    old = table(spark, folder, "t_conversation", "conversation_id", "user_id", "title", "last_time").where(F.md5("conversation_id") >= "5").groupBy("conversation_id", "user_id").agg(F.min("title").alias("title"), F.max("last_time").alias("last_time"))
    asked = _messages(spark, folder).where("role = 'user'").withColumn("content", F.col("id"))
    return documents.touched(old, asked, lambda c: F.substring(c, 1, 20))


@query(_M + """SELECT DISTINCT f.message_id, f.user_id FROM message_feedback_event f JOIN m ON f.message_id = m.id AND f.user_id = m.user_id WHERE role = 'assistant'""")
def feedback_guard(spark, folder):
    return documents.allowed_feedback(table(spark, folder, "message_feedback_event", "message_id", "user_id"), _messages(spark, folder)).distinct()


@query(_M + "SELECT conversation_id, user_id, s AS seq, CASE s WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE s WHEN 0 THEN id ELSE 'busy' END AS content FROM m, (SELECT unnest([0, 1])::INT AS s) WHERE role = 'user'")
def rejected_chat(spark, folder):
    return documents.rejected(_messages(spark, folder).where("role = 'user'").withColumn("content", F.col("id")), "busy")


@query("""WITH d AS (SELECT doc_id, create_time FROM documents WHERE lang = 'zh' AND (doc_name LIKE '%e%' OR source LIKE '%e%'))
SELECT doc_id, create_time, (SELECT count(*) FROM d) AS total, ((SELECT count(*) FROM d) + 9) // 10 AS pages FROM d ORDER BY create_time DESC, doc_id LIMIT 10 OFFSET 20""")
def page_totals(spark, folder):
    rows = table(spark, folder, "documents", "doc_id", "create_time", "lang", "kb_id", "doc_name", "source")
    rows = rows.where(documents.matching(lang="zh", kb_id=" ", source=None) & documents.like_any("e", "doc_name", "source"))
    return documents.page(rows.select("doc_id", "create_time"), [F.col("create_time").desc(), F.col("doc_id")], 3, 10)


def _embed(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: lengths and sums of code points."""
    return [[float(len(t)), float(sum(map(ord, t)) % 997), 1.0] for t in texts]


@query(r"SELECT id, count(*) AS rows, min(CASE WHEN embedding IS NOT NULL THEN len(embedding) WHEN regexp_matches(content, '\S') THEN 3 ELSE -1 END)::BIGINT AS size FROM t_knowledge_vector GROUP BY 1")
def embed_missing(spark, folder):
    made = documents.embedded(table(spark, folder, "t_knowledge_vector", "id", "content", "embedding"), _embed, 3)
    return made.groupBy("id").agg(F.count("*").alias("rows"), F.min(F.when(F.col("embedding").isNull(), -1).otherwise(F.size("embedding"))).cast("bigint").alias("size"))


QUERIES, SQL = REGISTRY.QUERIES, REGISTRY.SQL
