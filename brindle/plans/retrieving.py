"""Vector search, channels and intents over whole tables.

Scores of items that would come from a model are taken from hashes of ids, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm
from ..operators import hierarchy, intents, retrieval
from ..tables import active, table
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

CHANNELS = ["INTENT_DIRECTED", "KEYWORD_ES", "VECTOR_GLOBAL", "OTHER"]


def hashed(column, places: int = 4):
    """0 to 1, from the first four digits of a hash."""
    return F.round(F.conv(F.substring(F.md5(column), 1, 4), 16, 10).cast("double") / 65535, places)


def probe(vectors) -> tuple[list[float], str]:
    """The usable vector of smallest id, as the query, and its collection."""
    row = vectors.where((F.size("embedding") == 64) & (norm(F.col("embedding")) > 0)).select("id", "embedding", retrieval.metadata("collection_name").alias("c")).orderBy("id").limit(1).collect()
    return (list(row[0].embedding), row[0].c) if row else ([0.0] * 64, "")


_PROBE = """
WITH v AS (SELECT id, metadata->>'collection_name' AS collection_name, CAST(embedding AS DOUBLE[]) AS e FROM t_knowledge_vector WHERE len(embedding) = 64),
q AS (SELECT e AS qe, collection_name AS qc FROM v WHERE list_dot_product(e, e) > 0 ORDER BY id LIMIT 1),
s AS (SELECT id, collection_name, max(round(CASE WHEN list_dot_product(e, e) = 0 THEN 0 ELSE list_dot_product(e, qe) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(qe, qe)) END, 6)) AS score
  FROM v, q GROUP BY 1, 2)
"""


@query(_PROBE + "SELECT id, collection_name, score FROM s WHERE collection_name = (SELECT qc FROM q) ORDER BY score DESC, id LIMIT 10")
def vector_topk(spark, folder):
    vectors = table(spark, folder, "t_knowledge_vector", "id", "metadata", "embedding")
    vector, collection = probe(vectors)
    return retrieval.search(vectors, vector, 10, collection)


@query(_PROBE + """, k AS (SELECT collection_name, min(length(name)) % 3 + 1 AS k FROM t_knowledge_base WHERE deleted = 0 GROUP BY 1),
r AS (SELECT s.collection_name, id, score, k, row_number() OVER (PARTITION BY s.collection_name ORDER BY score DESC, id) AS rank FROM s JOIN k ON s.collection_name = k.collection_name)
SELECT collection_name, id, score, rank FROM r WHERE rank <= k""")
def vector_topk_per_collection(spark, folder):
    vectors = table(spark, folder, "t_knowledge_vector", "id", "metadata", "embedding")
    bases = active(table(spark, folder, "t_knowledge_base", "collection_name", "name", "deleted")).groupBy("collection_name").agg((F.min(F.length("name")) % 3 + 1).alias("k"))
    return retrieval.search_each(vectors, probe(vectors)[0], 3, bases)


@query("""
SELECT metadata->>'collection_name' AS collection_name, count(DISTINCT id) AS vectors, count(*) FILTER (len(embedding) <> 64) AS odd,
  count(*) FILTER (list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0) AS zero, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS norm
FROM t_knowledge_vector WHERE embedding IS NOT NULL GROUP BY 1""")
def vector_norms(spark, folder):
    rows = table(spark, folder, "t_knowledge_vector", "id", "metadata", "embedding").where("embedding is not null").select("id", retrieval.metadata("collection_name").alias("collection_name"), norm(F.col("embedding")).alias("n"), F.size("embedding").alias("len"))
    return rows.groupBy("collection_name").agg(F.count_distinct("id").alias("vectors"), F.count_if(F.col("len") != 64).alias("odd"), F.count_if(F.col("n") == 0).alias("zero"), F.round(F.avg("n"), 5).alias("norm"))


@query("""
WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id, c.label, round(list_cosine_similarity(embedding::DOUBLE[], centre), 6) AS score FROM embeddings e, c)
SELECT vec_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM s WHERE score >= 0.35) WHERE rank <= 5""")
def knn_classifier_threshold(spark, folder):
    """Labels by cosine to their centres (one row per label): a score of 0.35 at least, the best five."""
    rows = table(spark, folder, "embeddings")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centre"))
    listed = F.broadcast(centres.agg(F.collect_list(F.struct("label", "centre")).alias("centres")))  # a row with as many centres as labels
    best = F.transform("centres", lambda c: F.struct(F.round(cosine(F.col("embedding"), c["centre"]), 6).alias("score"), c["label"].alias("label")))
    order = F.array_sort(F.filter(F.transform(best, lambda s: F.struct((-s["score"]).alias("s"), s["label"].alias("label"))), lambda s: s["s"] <= -0.35))
    return rows.crossJoin(listed).select("vec_id", F.posexplode(F.slice(order, 1, 5)).alias("p", "b")).select("vec_id", "b.label", (-F.col("b.s")).alias("score"), (F.col("p") + 1).alias("rank"))


_SCORES = "SELECT user_id AS session, conversation_id AS question, id AS item, round(('0x' || md5(id)[:4])::INT / 65535.0::DOUBLE, 4) AS score FROM t_message WHERE deleted = 0 GROUP BY 1, 2, 3"


def _scores(spark, folder):
    rows = active(table(spark, folder, "t_message", "user_id", "conversation_id", "id", "deleted"))
    return rows.select(F.col("user_id").alias("session"), F.col("conversation_id").alias("question"), F.col("id").alias("item")).distinct().withColumn("score", hashed(F.col("item")))


@query(f"""
WITH s AS ({_SCORES}), b AS (SELECT question AS request, max(score) AS best FROM s GROUP BY 1)
SELECT request, best >= 0.4 AS directed_on, best AS directed_confidence, best < 0.6 AS global_on, 0.7::DOUBLE AS global_confidence FROM b""")
def channel_gate(spark, folder):
    return retrieval.gates(_scores(spark, folder).withColumnRenamed("question", "request"))


@query(f"""
WITH s AS ({_SCORES}), k AS (SELECT *, row_number() OVER (PARTITION BY session, question ORDER BY score DESC, item) AS rank FROM s WHERE score >= 0.35),
c AS (SELECT *, count(*) FILTER (rank = 1) OVER (PARTITION BY session) AS qs, row_number() OVER (PARTITION BY session, rank = 1 ORDER BY score DESC, question, item) AS place FROM k WHERE rank <= 3)
SELECT session, question, item, score, rank FROM c WHERE rank = 1 OR place <= 3 - qs""")
def intent_cap(spark, folder):
    return intents.cap(_scores(spark, folder))


_CANDIDATES = """
SELECT metadata->>'collection_name' AS request, metadata->>'doc_id' AS key, id, ['INTENT_DIRECTED', 'KEYWORD_ES', 'VECTOR_GLOBAL', 'OTHER'][1 + (metadata->>'chunk_index')::INT % 4] AS channel,
  (metadata->>'chunk_index')::INT AS position, round(('0x' || md5(id)[:4])::INT / 65535.0::DOUBLE, 4) AS score, any_value(content) AS text FROM t_knowledge_vector WHERE metadata->>'chunk_index' IS NOT NULL GROUP BY ALL"""
_DEDUP = f"""
WITH c AS ({_CANDIDATES}), p AS (SELECT *, CASE channel WHEN 'INTENT_DIRECTED' THEN 1 WHEN 'KEYWORD_ES' THEN 2 WHEN 'VECTOR_GLOBAL' THEN 3 ELSE 99 END AS p FROM c),
d AS (SELECT request, key, min(row(p, position, id)) AS first, arg_min(id, row(-score, p, position, id)) AS id, max(score) AS score FROM p GROUP BY 1, 2),
s AS (SELECT request, key, id, score, row_number() OVER (PARTITION BY request ORDER BY first, key) AS slot FROM d)
"""


def _candidates(spark, folder):
    number = retrieval.metadata("chunk_index").cast("int")
    rows = table(spark, folder, "t_knowledge_vector", "id", "metadata").select(retrieval.metadata("collection_name").alias("request"), retrieval.metadata("doc_id").alias("key"), "id", number.alias("position")).where("position is not null").distinct()
    return rows.select("request", "key", "id", F.element_at(F.array(*map(F.lit, CHANNELS)), F.col("position") % 4 + 1).alias("channel"), "position", hashed(F.col("id")).alias("score"))


@query(f"WITH c AS ({_CANDIDATES}) SELECT request, channel, count(*) AS candidates, count(DISTINCT key) AS keys, max(score) AS best FROM c GROUP BY 1, 2")
def multi_channel_union(spark, folder):
    rows = _candidates(spark, folder)
    united = retrieval.union_channels([rows.where(F.col("channel") == c) for c in CHANNELS])
    return united.groupBy("request", "channel").agg(F.count("*").alias("candidates"), F.count_distinct("key").alias("keys"), F.max("score").alias("best"))


@query(_DEDUP + "SELECT request, key, id, score, slot FROM s")
def dedup_priority_max(spark, folder):
    return retrieval.deduplicate(_candidates(spark, folder))


@query(_DEDUP + "SELECT request, key, id, score, slot FROM s WHERE slot <= 5")
def rerank_noop_topn(spark, folder):
    return retrieval.rerank_noop(retrieval.deduplicate(_candidates(spark, folder)), 5)


@query(_DEDUP + """, m AS (SELECT *, CASE WHEN score > 0.5 THEN round(1.5 - score, 4) END AS model_score FROM s),
r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY request) <= 5 THEN slot ELSE row_number() OVER (PARTITION BY request ORDER BY model_score DESC NULLS LAST, slot) END AS rank FROM m)
SELECT request, key, id, slot, rank FROM r WHERE rank <= 5""")
def rerank_backfill(spark, folder):
    rows = retrieval.deduplicate(_candidates(spark, folder)).withColumn("model_score", F.when(F.col("score") > 0.5, F.round(1.5 - F.col("score"), 4)))
    return retrieval.rerank(rows, 5).select("request", "key", "id", "slot", "rank")


@query(_DEDUP + "SELECT s.request, md5(string_agg(text, chr(10) ORDER BY slot)) AS context FROM s JOIN c ON s.id = c.id AND s.request = c.request WHERE slot <= 5 GROUP BY 1")
def kb_context(spark, folder):
    top = retrieval.rerank_noop(retrieval.deduplicate(_candidates(spark, folder)), 5)
    texts = table(spark, folder, "t_knowledge_vector", "id", "content").join(top.select("id"), "id", "left_semi").dropDuplicates(["id"]).withColumnRenamed("content", "text")
    return retrieval.contexts(top.join(texts, "id")).select("request", F.md5("context").alias("context"))


_AMB = """
WITH n AS (SELECT id, any_value(intent_code) AS item, any_value(name) AS name, any_value(kb_id) AS system FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY update_time DESC) AS rn FROM t_intent_node) WHERE rn = 1 AND deleted = 0 GROUP BY 1),
c AS (SELECT collection_name AS question, n.* FROM n JOIN (SELECT id AS kb, collection_name FROM t_knowledge_base) b ON n.system = b.kb),
s AS (SELECT name[:2] AS question, CASE WHEN md5(name[:2]) < '4' THEN name[:2] || min(system) OVER (PARTITION BY name[:2]) ELSE name[:2] END AS text, item, name[1:2] AS label, system, system AS system_name, round(('0x' || md5(item)[:4])::INT / 65535.0::DOUBLE, 4) AS score FROM n),
g AS (SELECT *, lower(label) AS topic FROM s WHERE score >= 0.35 AND trim(label) <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY question, topic ORDER BY score DESC, item) AS rank FROM g),
p AS (SELECT question, topic, max(score) AS first, max(score) FILTER (rank = 2) AS second FROM r WHERE rank <= 2 GROUP BY 1, 2),
y AS (SELECT question, topic, system, min(rank) AS rank FROM r WHERE system IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT question, topic FROM (SELECT p.*, row_number() OVER (PARTITION BY p.question ORDER BY first DESC, p.topic) AS rn FROM p JOIN (SELECT question, topic FROM y GROUP BY 1, 2 HAVING count(*) > 1) w ON p.question = w.question AND p.topic = w.topic WHERE second / first >= 0.8) WHERE rn = 1),
o AS (SELECT y.*, row_number() OVER (PARTITION BY y.question ORDER BY rank, system) AS n FROM y JOIN b ON y.question = b.question AND y.topic = b.topic)
SELECT o.question, topic, string_agg(system, ',' ORDER BY n) AS systems FROM o JOIN (SELECT question, max(text) AS text FROM s GROUP BY 1) x ON x.question = o.question
WHERE n <= 6 GROUP BY 1, 2 HAVING NOT bool_or(contains(text, system))"""


@query(_AMB)
def intent_ambiguity(spark, folder):
    """Questions are the first two signs of node names, topics too; systems are knowledge bases, of which some questions name one."""
    nodes = hierarchy.live_nodes(table(spark, folder, "t_intent_node", "id", "intent_code", "parent_code", "update_time", "deleted", "name", "kb_id"), keep_columns=("name", "kb_id"))
    asked = F.substring("name", 1, 2)
    first = nodes.groupBy(asked.alias("question")).agg(F.min("kb_id").alias("first"))
    text = first.select("question", F.when(F.md5("question") < "4", F.concat("question", "first")).otherwise(F.col("question")).alias("text"))
    nodes = nodes.withColumn("question", asked).join(text, "question")
    rows = nodes.select("question", "text", F.col("code").alias("item"), F.substring("name", 1, 2).alias("name"), F.col("kb_id").alias("system"), F.col("kb_id").alias("system_name"), hashed(F.col("code")).alias("score"))
    return intents.ambiguous(rows)


QUERIES, SQL = REGISTRY.QUERIES, REGISTRY.SQL
