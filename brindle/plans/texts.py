"""Text functions and chunking over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chunking
from ..sources import files
from ..tables import table
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query
_WS = t.WHITE
_TRIM = r"'^[\x00-\x20]+|[\x00-\x20]+$'"

_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\x{{FEFF}}', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_TRIM}, '', 'g')"


@query(f"SELECT doc_id, md5(c) AS cleaned, length(c)::BIGINT AS chars FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)")
def cleanup_text(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", t.cleanup(F.col("text")).alias("c")).select("doc_id", F.md5("c").alias("cleaned"), F.length("c").cast("bigint").alias("chars"))


@query(rf"""
WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}+', '', 'g') AS s FROM documents),
n AS (SELECT doc_id, s, length(regexp_replace(s, '[^\x00-\x7F]+', '', 'g')) AS a, length(regexp_replace(s, '{t.others(t.CJK)}+', '', 'g')) AS c,
  length(s) + length(regexp_replace(s, '[\x00-\x{{FFFF}}]+', '', 'g')) AS u FROM s)
SELECT doc_id, (CASE WHEN s = '' THEN 0 ELSE greatest((a + 3) // 4 + c + (u - a - c + 1) // 2, 1) END)::BIGINT AS tokens FROM n""")
def token_count(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", t.token_count(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id, (length(text) + length(regexp_replace(text, '[\x00-\x{FFFF}]+', '', 'g')))::BIGINT AS units, sha256(text) AS content_hash FROM documents")
def content_hash(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", t.utf16_length(F.col("text")).cast("bigint").alias("units"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))


@query(rf"""
WITH q AS (SELECT id, content, update_time, list_filter(list_transform(string_split_regex(content, '[?？。；;\n]+'), lambda p: regexp_replace(p, {_TRIM}, '', 'g')), lambda p: p <> '') AS parts FROM t_message WHERE content IS NOT NULL),
a AS (SELECT id, update_time, CASE WHEN len(parts) > 0 THEN list_transform(parts, lambda p: CASE WHEN regexp_matches(p, '[?？]$') THEN p ELSE p || '？' END) ELSE [content] END AS asked FROM q)
SELECT id, update_time, i::INT AS no, asked[i] AS question FROM (SELECT id, update_time, asked, unnest(range(1, len(asked) + 1)) AS i FROM a)""")
def question_split(spark, folder):
    parts = F.posexplode(t.split_questions(F.col("content"))).alias("pos", "question")
    return table(spark, folder, "t_message", "id", "content", "update_time").where("content is not null").select("id", "update_time", parts).select("id", "update_time", (F.col("pos") + 1).alias("no"), "question")


TERMS = [
    {"source": "审计", "target": "审计室", "priority": 2},
    {"source": "ticket", "target": "work order", "priority": 1},
    {"source": "用印", "target": "用印申请", "priority": None},
    {"source": "off", "target": "on", "priority": 9, "enabled": 0},
]


@query("""
WITH a AS (SELECT id, update_time, regexp_replace(content, '用印申请|用印', '用印申请', 'g') AS c FROM t_message WHERE content IS NOT NULL)
SELECT id, update_time, md5(replace(regexp_replace(c, '审计室|审计', '审计室', 'g'), 'ticket', 'work order')) AS mapped FROM a""")
def term_mapping(spark, folder):
    return table(spark, folder, "t_message", "id", "content", "update_time").where("content is not null").select("id", "update_time", F.md5(t.map_terms(F.col("content"), TERMS)).alias("mapped"))


@query(rf"SELECT id, update_time, regexp_replace(lower(name), '[!-/:-@\[-`{{-~]+|{_WS}+', '', 'g') AS normal FROM t_intent_node")
def normalize_name(spark, folder):
    return table(spark, folder, "t_intent_node", "id", "update_time", "name").select("id", "update_time", t.normalize_name(F.col("name")).alias("normal"))


@query(r"""
WITH e AS (SELECT doc_id, file_type, lower(regexp_extract(doc_name, '\.([^.]+)$', 1)) AS ext FROM documents)
SELECT doc_id, CASE WHEN ext IN ('pdf', 'doc', 'docx') THEN ext WHEN ext IN ('md', 'markdown') THEN 'markdown' WHEN ext <> '' THEN ext ELSE coalesce(file_type, '') END AS detected FROM e""")
def file_type_detect(spark, folder):
    return table(spark, folder, "documents", "doc_id", "doc_name", "file_type").select("doc_id", t.file_type(F.col("doc_name"), F.col("file_type")).alias("detected"))


@query(r"""
WITH e AS (SELECT doc_id, coalesce(lower(regexp_extract(doc_name, '\.([^.]+)$', 1)), '') AS ext FROM documents)
SELECT doc_id, CASE WHEN ext IN ('md', 'markdown') THEN 'markdown' WHEN ext IN ('html', 'htm') THEN 'html' WHEN ext IN ('txt', 'log', 'csv') THEN 'text' ELSE 'binary' END AS parser,
  ext IN ('md', 'markdown', 'pdf') AS allowed FROM e""")
def mime_rule(spark, folder):
    none = F.lit(None).cast("string")
    return table(spark, folder, "documents", "doc_id", "doc_name").select("doc_id", files.parser_for(F.col("doc_name"), none).alias("parser"), files.rule_allows(F.col("doc_name"), none, ["markdown", "pdf"]).alias("allowed"))


@query("SELECT id, update_time, ceil(length(content) / 20.0)::BIGINT AS packets, coalesce(content[1 + (ceil(length(content) / 20.0)::BIGINT - 1) * 20 :], '') AS last FROM t_message WHERE content <> ''")
def stream_rechunk(spark, folder):
    packets = t.rechunk(F.col("content"), 20)
    return table(spark, folder, "t_message", "id", "update_time", "content").where("content <> ''").select("id", "update_time", F.size(packets).cast("bigint").alias("packets"), F.element_at(packets, -1).alias("last"))


@query("SELECT id, update_time, CASE WHEN length(title) > 12 THEN title[:12] || '...' ELSE title END AS short, 'About ' || coalesce(title, '') || ' by ' || coalesce(user_id, '') AS line FROM t_conversation")
def title_lines(spark, folder):
    line = t.fill_template("About {title} by {{user}}", {"title": F.col("title"), "user": F.col("user_id")})
    return table(spark, folder, "t_conversation", "id", "update_time", "title", "user_id").select("id", "update_time", t.truncate(F.col("title"), 12, "...").alias("short"), line.alias("line"))


@query(rf"""
WITH d AS (SELECT doc_id, replace(text, chr(13), '') AS s FROM documents),
c AS (SELECT doc_id, s[1 + 512 * i : 512 * (i + 1)] AS content, i FROM (SELECT doc_id, s, unnest(range(0, ceil(length(s) / 512.0)::BIGINT)) AS i FROM d))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, md5(content) AS content FROM c WHERE regexp_replace(content, '{_WS}+', '', 'g') <> ''""")
def chunk_code_points(spark, folder):
    """Not the fixed strategy: code points, nothing rejoined."""
    return chunking.chunk_plain(table(spark, folder, "documents", "doc_id", "text"), 512).select("doc_id", "chunk_index", F.md5("content").alias("content"))


@query(rf"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, {_TRIM}, '', 'g')) AS lines FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i, regexp_replace(array_to_string(lines[6 * i + 1 : 6 * i + 6], chr(10)), {_TRIM}, '', 'g') AS content FROM (SELECT doc_id, lines, unnest(range(0, ceil(len(lines) / 6.0)::BIGINT)) AS i FROM l))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, md5(content) AS content FROM g WHERE content <> ''""")
def chunk_lines(spark, folder):
    return chunking.chunk_lines(table(spark, folder, "documents", "doc_id", "text"), 6).select("doc_id", "chunk_index", F.md5("content").alias("content"))


@query()
def chunk_fixed_no_overlap(spark, folder):
    return chunking.chunk(table(spark, folder, "documents", "doc_id", "text"), "fixed_size", chunk_size=512, overlap_size=0).select("doc_id", "chunk_index", F.md5("content").alias("content"))


@query()
def chunk_fixed_overlap(spark, folder):
    return chunking.chunk(table(spark, folder, "documents", "doc_id", "text"), "fixed_size", chunk_size=512, overlap_size=128)


@query()
def chunk_structure(spark, folder):
    return chunking.chunk(table(spark, folder, "documents", "doc_id", "text"), "structure_aware")


QUERIES, SQL = REGISTRY.QUERIES, REGISTRY.SQL
