"""DuckDB SQL for the queries of ``governance``; patterns are written out here, so that each side has its own."""

from __future__ import annotations

from tessera.jobs.oracles import _FILES, _ITEMS, _OPERATIONAL, _SEARCH

_RULES = {
    "Email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}", "Link": r"https?://[^\s<>]+", "Phone": r"\+[0-9][0-9 ().-]{6,}[0-9]",
    "Address": r"([0-9]{1,3}\.){3}[0-9]{1,3}", "Number": r"[0-9]{4,}",
}
_HITS = " UNION ALL ".join(f"SELECT doc_id, source, {i} AS rule, '{c}' AS category, regexp_split_to_array(text, '{p}') AS p, regexp_extract_all(text, '{p}') AS h FROM documents" for i, (c, p) in enumerate(_RULES.items()))

ORACLE_SQL = {
    "protected_documents": f"""WITH RECURSIVE hits AS (SELECT doc_id, source, rule, category, p, h, unnest(h) AS value, unnest(range(1, len(h) + 1)) AS i FROM ({_HITS})),
spans AS (SELECT doc_id, source, rule, category, value, (coalesce(list_sum(list_transform(p[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: len(x))), 0))::BIGINT AS s, len(value) AS n FROM hits),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, rule, n DESC) AS k FROM spans),
walk AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, 0::BIGINT AS past, false AS taken FROM ordered UNION ALL SELECT o.doc_id, o.k, CASE WHEN o.s >= past THEN o.s + o.n ELSE past END, o.s >= past FROM walk w JOIN ordered o ON o.doc_id = w.doc_id AND o.k = w.k + 1),
chosen AS (SELECT o.* FROM ordered o JOIN walk w ON w.doc_id = o.doc_id AND w.k = o.k AND w.taken),
firsts AS (SELECT source, category, lower(value) AS v, min({{'d': doc_id, 's': -s}}) AS f FROM chosen GROUP BY ALL),
named AS (SELECT source, category, v, category || '-' || CASE WHEN r < 10 THEN '0' ELSE '' END || r AS token FROM (SELECT *, row_number() OVER (PARTITION BY source, category ORDER BY f) AS r FROM firsts)),
placed AS (SELECT c.doc_id, c.s, c.n, token, coalesce(lag(c.s + c.n) OVER (PARTITION BY c.doc_id ORDER BY c.s), 0) AS past FROM chosen c JOIN named m ON m.source = c.source AND m.category = c.category AND m.v = lower(c.value)),
rebuilt AS (SELECT doc_id, count(*) AS n, string_agg(token, ',' ORDER BY s) AS tokens, string_agg(substring(text, past + 1, s - past) || token, '' ORDER BY s) || substring(any_value(text), max(s + placed.n) + 1) AS t FROM placed JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n > 0 THEN 'requires_review' ELSE 'ready_for_review' END AS status, coalesce(n, 0)::INTEGER AS n_findings, coalesce(tokens, '') AS pseudonyms, sha256(coalesce(t, text)) AS sha256 FROM documents d LEFT JOIN rebuilt USING (doc_id)""",
    "review_states": """WITH f AS (SELECT DISTINCT l_orderkey AS a, l_linenumber AS n FROM lineitem WHERE l_quantity > 25),
d AS (SELECT l_orderkey AS a, l_linenumber AS n, min({'s': l_partkey, 'd': CASE l_returnflag WHEN 'R' THEN 'replace' WHEN 'A' THEN 'keep' ELSE 'change_category' END}).d AS d FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
c AS (SELECT o_orderkey AS artifact_id, count(f.n) AS n_findings, count(d) AS n_decided, count(*) FILTER (WHERE d = 'keep') AS n_kept FROM orders LEFT JOIN f ON f.a = o_orderkey LEFT JOIN d ON d.a = f.a AND d.n = f.n GROUP BY 1)
SELECT *, CASE WHEN n_findings = n_decided THEN 'ready_for_confirmation' WHEN n_decided > 0 THEN 'review_in_progress' ELSE 'requires_review' END AS state FROM c""",
    "item_states": """WITH log AS (SELECT user_id * 100 + event_id % 100 AS id, event_id AS seq, CASE event_type WHEN 'click' THEN 'confirm' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'duplicate' END AS action FROM events),
e AS (SELECT id, min(seq) FILTER (WHERE action <> 'confirm') AS ended, arg_min(action, seq) FILTER (WHERE action <> 'confirm') AS last FROM log GROUP BY id)
SELECT id, CASE WHEN last = 'edit' THEN 'superseded' WHEN last IS NOT NULL THEN 'rejected' WHEN bool_or(action = 'confirm') THEN 'confirmed' ELSE 'requires_review' END AS status, last IS NULL AS current, count(*) FILTER (WHERE action IS NOT NULL AND seq > ended) AS n_late
FROM log JOIN e USING (id) GROUP BY id, last""",
    "item_lifecycles": """WITH i AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey - o_orderkey % 3 END AS old, o_orderstatus FROM orders)
SELECT a.id, CASE WHEN count(b.id) > 0 THEN 'superseded' WHEN any_value(a.o_orderstatus) = 'F' THEN 'retired' ELSE 'active' END AS lifecycle, coalesce(string_agg(b.id::VARCHAR, ',' ORDER BY b.id), '') AS successors FROM i a LEFT JOIN i b ON b.old = a.id GROUP BY a.id""",
    "competing_proposals": f"""WITH {_OPERATIONAL} SELECT id, scope_ref, kind, subject_ref, CASE WHEN min(value) OVER w < max(value) OVER w THEN 'needs_clarification' ELSE 'requires_decision' END AS card FROM items WHERE confirmation = 'proposed' WINDOW w AS (PARTITION BY scope_ref, kind, subject_ref)""",
    "linked_items": """SELECT lang AS workspace_id, 'fact' AS item_type, min(doc_id) FILTER (WHERE doc_id % 2 = 0) AS id, min(doc_id) FILTER (WHERE doc_id % 2 = 1) AS seq, count(DISTINCT source) AS n_sources,
CASE WHEN bool_and(doc_id % 2 = 1) THEN 'new' WHEN bool_and(doc_id % 2 = 0) THEN 'kept' ELSE 'linked' END AS outcome FROM documents GROUP BY lang, replace(lower(trim(coalesce(text, ''))), 'ß', 'ss')""",
    "material_progress": """WITH e AS (SELECT c_nationkey AS n, min(c_custkey) AS c FROM customer WHERE c_acctbal > 0 GROUP BY 1), s AS (SELECT o_custkey AS c, min(o_orderkey) AS o FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
r AS (SELECT l_orderkey AS o, bool_and(l_linestatus = 'F') AS done FROM lineitem GROUP BY 1)
SELECT 'source:' || n_nationkey AS source_id, n_name AS created_at, 'sanitized:' || o AS sanitized_id, CASE WHEN done IS NULL THEN 'not_started' WHEN done THEN 'confirmed' ELSE 'requires_review' END AS review_state
FROM nation LEFT JOIN e ON e.n = n_nationkey LEFT JOIN s USING (c) LEFT JOIN r USING (o)""",
    "file_integrity": """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'orphan' WHEN doc_id % 5 = 0 THEN 'changed' WHEN doc_id % 2 = 0 OR text = 'x' THEN 'intact' ELSE 'changed' END AS status FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 3 <> 0""",
    "refused_files": """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'unsupported' WHEN doc_id % 4 < 2 AND len(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> '' AND ord(c) < 32 AND ord(c) NOT IN (9, 10, 13))) > 0 THEN 'not_text' ELSE '' END AS reason FROM documents""",
    "candidate_pages": """WITH p AS (SELECT page_id, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^https?://', '') AS path FROM pages)
SELECT page_id, (path LIKE '%.html' OR path LIKE '%.htm') AND path NOT LIKE '%1.html' AND '/' || path || '/' NOT LIKE '%/fr/%' AND '/' || path || '/' NOT LIKE '%/tmp/%' AND path NOT LIKE '%/.%' AS candidate FROM p""",
    "indexed_orders": """SELECT o_orderkey, o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' OR o_orderkey % 7 <> 0 AND (o_orderpriority = '5-LOW' OR o_totalprice > 400000) AS indexed FROM orders""",
    "project_health": f"""WITH {_FILES}, f AS (SELECT project, split_part(path, '/', 1) AS folder FROM files), s AS (SELECT 'P' || (doc_id % 4) AS project, count(*) AS n, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY 1),
names AS (SELECT project FROM f UNION SELECT project FROM s),
rows AS (SELECT project, 'critical' AS severity, 'missing folders' AS title, 6 - count(DISTINCT folder) AS n FROM names LEFT JOIN f USING (project) GROUP BY 1 HAVING count(DISTINCT folder) < 6
  UNION ALL SELECT project, 'warning', 'few source summaries', count(*) FILTER (WHERE folder = '50_Sources') FROM names JOIN s USING (project) LEFT JOIN f USING (project) GROUP BY 1 HAVING count(*) FILTER (WHERE folder = '50_Sources') <= 1
  UNION ALL SELECT project, 'info', 'unmentioned sources', fr FROM s WHERE fr > 0) SELECT * FROM rows""",
    "planned_summaries": """SELECT source AS package, lang || (n_chars % 50) AS context, arg_min(doc_id::VARCHAR, doc_id) AS first_name, count(*) AS n_files, CASE WHEN count(*) > 1 THEN 'merge' ELSE 'create' END AS operation FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY 1, 2""",
    "gated_items": r"""WITH t AS (SELECT doc_id AS seq, lang, array_to_string(string_split(split_part(text, chr(10), 1), ' ')[1:1 + doc_id % 5], ' ') AS title, doc_id % 2 = 1 AND NOT n_chars > 500 AS thin FROM documents),
r AS (SELECT *, lang || '/' || lower(title) AS target FROM t)
SELECT seq, target, CASE WHEN target IS NOT NULL AND row_number() OVER (PARTITION BY target ORDER BY seq) > 1 THEN 'duplicate' WHEN len(regexp_split_to_array(trim(title), '\s+')) > 3 OR regexp_matches(trim(title), '^([0-9a-f]{8,}|[0-9_-]*)$') OR thin THEN 'quality_blocked' ELSE 'planned' END AS status FROM r""",
    "document_terms": """WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-zА-Яа-яЁё0-9_]+'), lambda x: left(x, 20)) AS l FROM documents),
u AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:12] AS l FROM w) SELECT doc_id, array_to_string(l, ' ') AS terms, len(l)::INTEGER AS n_terms FROM u""",
    "document_excerpts": r"""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
b AS (SELECT *, greatest(coalesce(list_min([nullif(instr(lower(t), 'tion'), 0), nullif(instr(lower(t), 'ungen'), 0)]), 1) - 101, 0) AS b FROM c)
SELECT doc_id, CASE WHEN len(t) <= 300 THEN t ELSE CASE WHEN b > 0 THEN '... ' ELSE '' END || trim(substring(t, b + 1, 300)) || CASE WHEN b + 300 < len(t) THEN ' ...' ELSE '' END END AS excerpt FROM b""",
    "document_keyword_lines": r"""WITH c AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: contains(lower(s), 'tion') OR contains(lower(s), 'mente')), lambda s: CASE WHEN len(s) > 220 THEN rtrim(left(s, 217)) || '...' ELSE s END) AS l FROM documents),
u AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:3] AS l FROM c) SELECT doc_id, array_to_string(l, chr(10)) AS lines, len(l)::INTEGER AS n_lines FROM u""",
    "event_payloads": """WITH k AS (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN json_extract(props, '$.k')::INTEGER END AS k FROM events) SELECT *, CASE WHEN k BETWEEN 0 AND 49 THEN 'low' WHEN k BETWEEN 50 AND 99 THEN 'high' ELSE 'invalid' END AS grade FROM k""",
    "stale_events": "SELECT event_id FROM events WHERE event_id % 10 <> 0 AND date_trunc('second', ts) <= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY",
    "page_summary": f"WITH {_ITEMS} SELECT count(*) AS total, least(greatest(count(*) - 5, 0), 20) AS returned, count(*) - 5 > 20 AS has_more FROM eligible WHERE na <> '' AND {_SEARCH[0]}",
    "chosen_documents": "SELECT doc_id AS id, item_id AS pos, lang, n_chars FROM benchmark JOIN documents ON doc_id = item_id * 3 ORDER BY pos",
    "heading_stacks": r"""WITH t AS (SELECT conv_id, string_split(string_agg(CASE WHEN turn % 5 = 3 THEN '```' || chr(10) ELSE '' END || repeat('#', (1 + turn % 3)::INTEGER) || ' ' || role || ' ' || turn || chr(10) || coalesce(text, '') || CASE WHEN turn % 5 = 4 THEN chr(10) || '```' ELSE '' END, chr(10) ORDER BY turn), chr(10)) AS l FROM conversations GROUP BY 1),
n AS (SELECT conv_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS line FROM t),
f AS (SELECT *, count(*) FILTER (WHERE regexp_matches(s, '^[ \t]{0,3}```')) OVER (PARTITION BY conv_id ORDER BY line) % 2 = 1 AS inside FROM n),
h AS (SELECT *, CASE WHEN NOT inside THEN len(regexp_extract(s, '^(#{1,6})\s+\S', 1)) ELSE 0 END AS level, trim(regexp_replace(s, '^#{1,6}\s+|\s+$', '', 'g')) AS title FROM f),
a AS (SELECT conv_id, line, last_value(CASE WHEN level = 1 THEN {'at': line, 't': title} END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN level = 2 THEN {'at': line, 't': title} END IGNORE NULLS) OVER w AS b, last_value(CASE WHEN level = 3 THEN {'at': line, 't': title} END IGNORE NULLS) OVER w AS c
  FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, line::INTEGER AS line, concat_ws(' > ', a.t, CASE WHEN b.at > coalesce(a.at, 0) THEN b.t END, CASE WHEN c.at > greatest(coalesce(a.at, 0), coalesce(b.at, 0)) THEN c.t END) AS stack FROM a""",
}
