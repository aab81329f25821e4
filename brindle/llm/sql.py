"""SQL over the same tables, for the operators that it can express."""

_TURNS = r"""
WITH m AS (
  SELECT id, conversation_id, create_time, lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) AS spelled,
    NOT coalesce(regexp_matches(content, '[\p{L}\p{N}]'), false) AS blank
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY create_time) AS rn FROM t_message WHERE deleted = 0) WHERE rn = 1),
r AS (SELECT *, CASE WHEN spelled IN ('user', 'human') THEN 'user' WHEN spelled IN ('assistant', 'bot', 'ai') THEN 'assistant' END AS part FROM m WHERE coalesce(spelled, '') <> 'system'),
t AS (SELECT *, lag(part) OVER w AS before, row_number() OVER w - 1 AS turn FROM r WINDOW w AS (PARTITION BY conversation_id ORDER BY create_time, id)),
f AS (
  SELECT conversation_id, bool_and(blank) AS blank, bool_or(part IS NULL OR (part = 'assistant' AND (turn = 0 OR coalesce(before, '') = 'assistant'))) AS broken,
    count(*) FILTER (part = 'user') AS asked, count(*) FILTER (part = 'assistant' AND before = 'user' AND NOT blank) AS answered FROM t GROUP BY 1),
v AS (
  SELECT c.conversation_id, CASE WHEN coalesce(f.blank, true) THEN 'empty' WHEN f.broken THEN 'broken' WHEN asked > answered THEN 'missing_reply' END AS reason
  FROM (SELECT DISTINCT conversation_id FROM t_conversation WHERE deleted = 0 AND conversation_id IS NOT NULL) c LEFT JOIN f ON c.conversation_id = f.conversation_id)
"""

_RUNS = r"""
WITH g AS (
  SELECT strftime(start_time, '%Y-%m-%d') AS trace_day, trace_name, duration_ms FROM (
    SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, duration_ms, trace_name) AS rn FROM t_rag_trace_run
    WHERE deleted = 0 AND duration_ms >= 0 AND upper(regexp_replace(status, '^\s+|\s+$', '', 'g')) = 'SUCCESS') WHERE rn = 1)"""

SQL = {
    "p1_found": r"""
WITH d AS (SELECT DISTINCT sdoc_id, text, sections FROM structured_document),
i AS (SELECT sdoc_id, 0 AS section_no, text AS x FROM d WHERE coalesce(len(sections), 0) = 0
  UNION ALL SELECT sdoc_id, i::INT, coalesce(s.content, text[s.start_offset + 1 : s.end_offset]) FROM (SELECT sdoc_id, text, unnest(sections) AS s, generate_subscripts(sections, 1) AS i FROM d)),
m AS (SELECT sdoc_id, section_no, regexp_replace(regexp_replace(x, '([\n\r。！？；])', '\1' || chr(1), 'g'), '([.!?;])([\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}])', '\1' || chr(1) || '\2', 'g') AS marked
  FROM i WHERE length(x) > 1000)
SELECT sdoc_id, section_no, CASE WHEN list_max(list_transform(string_split(marked, chr(1)), lambda p: length(p))) > 900 THEN 'forced' ELSE 'natural' END AS cut FROM m""",
    "p6_found": """
WITH v AS (SELECT id, any_value(embedding::DOUBLE[]) AS e FROM t_knowledge_vector WHERE len(embedding) = 64 AND id IS NOT NULL GROUP BY id),
n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
p AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS c FROM n a JOIN n b ON a.id <> b.id),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rank FROM p WHERE c >= 0.9)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE rank <= 5""",
    "p5_found": _RUNS + r""",
p AS (SELECT trace_day, trace_name, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95 FROM g GROUP BY 1, 2)
SELECT trace_day, trace_name, 50 AS q FROM p WHERE p50 > 5000 UNION ALL SELECT trace_day, trace_name, 95 AS q FROM p WHERE p95 > 20000""",
    "p5_bounds": _RUNS + " SELECT trace_name, q::INT AS q, n, true AS within FROM (SELECT trace_name, count(*) AS n FROM g WHERE trace_name IS NOT NULL GROUP BY 1), unnest([5, 25, 50, 75, 95, 99]) AS u(q)",
    "p7_found": _TURNS + "SELECT conversation_id, reason FROM v WHERE reason IS NOT NULL",
    "p7_conversations": _TURNS + "SELECT conversation_id, turn, part AS role, id FROM t WHERE conversation_id IN (SELECT conversation_id FROM v WHERE reason IS NULL)",
}
