"""DuckDB SQL for the library's own queries."""

from __future__ import annotations

# Written out here, so that each side has its own.
TOKEN = "[A-Za-zА-Яа-яЁё0-9]{3,}|[A-ZА-ЯЁ]{2,}"
_STOP = (
    "'для', 'или', 'что', 'как', 'при', 'это', 'если', 'над', 'под', 'без', 'про', 'the', 'and', 'with', 'from', 'this', 'that', 'его', 'она', 'они', 'нужно', 'проект', 'задача', 'анализ', 'ответ', 'данные', "
    "'дай', 'дать', 'кратко', 'краткий', 'краткая', 'краткую', 'сводка', 'сводку', 'расскажи', 'покажи', 'найди', 'какие', 'какой', 'какая', 'какую', 'есть', 'известно', 'информация', 'вопрос', 'вопросу', 'теме', 'темы'"
)
_TERMS = "'that', 'les', 'und', 'mit', 'que', 'dans', 'como', 'assistant'"
MASKS = {"EMAIL": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "CARD": r"\b\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{4}\b", "PHONE": r"\+\d[\d \-().]{8,}\d", "IP": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"}
TOPICS = r"(?i)\b(password|passport|token|secret|паспорт|пароль|снилс|инн)\b"


def _tokens(column: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({column}, ''), '{TOKEN}'), lambda t: lower(t)), lambda t: t NOT IN ({_STOP}) AND NOT regexp_matches(t, '^[0-9]+$'))))"


def _norm(column: str) -> str:
    return f"trim(regexp_replace(replace(replace(lower(coalesce({column}, '')), 'ё', 'е'), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_ITEMS = f"""labelled AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
items AS (SELECT d.doc_id::VARCHAR AS id, source AS workspace_id, n_chars > 0 AS current, doc_id AS seq,
  CASE WHEN quality IS NULL THEN 'requires_review' WHEN toxic = 1 THEN 'conflicted' WHEN quality = 0 THEN 'rejected' ELSE 'confirmed' END AS status,
  (['requirement', 'decision', 'risk', 'open_question', 'action'])[1 + n_chars % 5] AS item_type, split_part(text, chr(10), 1) AS title, text AS statement,
  CASE WHEN toxic = 0 THEN upper(lang) ELSE '' END AS actor_ref, CASE WHEN n_chars > 1000 THEN '2026-02-' || lpad((1 + n_chars % 28)::VARCHAR, 2, '0') ELSE '' END AS deadline,
  CASE WHEN n_chars > 3000 THEN 'high' ELSE '' END AS priority, '2026-01-' || lpad((1 + n_chars % 28)::VARCHAR, 2, '0') AS updated_at, coalesce(quality = 1, false) AS has_related
  FROM documents d LEFT JOIN labelled USING (doc_id)),
eligible AS (SELECT *, {_norm('title')} AS nt, {_norm('statement')} AS ns, {_norm('actor_ref')} AS na, {_norm('deadline')} AS nd, {_norm('priority')} AS np FROM items WHERE status = 'confirmed' AND current)"""

_FILES = """files AS (SELECT 'P' || (count(*) % 3) AS project, (['10_Branches', '20_Decisions', '30_Open_Questions', '40_Risks', '50_Sources'])[1 + count(*) % 5] || '/' || conv_id || '.md' AS path,
  string_split(string_agg('# ' || role || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn), chr(10)) AS lines FROM conversations GROUP BY conv_id),
lined AS (SELECT project, path, lines, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM files),
heads AS (SELECT *, regexp_extract(line, '^(#{1,6})\\s+(.+?)\\s*$', 2) AS heading FROM lined WHERE regexp_matches(line, '^(#{1,6})\\s+(.+?)\\s*$')),
cut AS (SELECT project, path, heading, n AS line_start, coalesce(lead(n) OVER (PARTITION BY path ORDER BY n) - 1, len(lines)) AS line_end, lines FROM heads),
sections AS (SELECT project, path, heading, line_start, line_end, regexp_replace(array_to_string(lines[line_start:line_end], chr(10)), '^\\s+|\\s+$', '', 'g') AS text,
  left(sha256(concat_ws(chr(10), project, path, heading, line_start, line_end)), 16) AS section_id FROM cut)"""

_SCORED = f"""{_FILES},
tokened AS (SELECT *, len(list_intersect({_tokens("heading || chr(10) || text || chr(10) || regexp_extract(path, '([^/]*)[.]md$', 1)")}, [{_TERMS}])) AS matches, len(list_intersect({_tokens('heading')}, [{_TERMS}])) AS h FROM sections),
scored AS (SELECT *, CASE WHEN matches = 0 AND h = 0 THEN 0 ELSE matches + 3 * h + CASE left(path, 2) WHEN '10' THEN 5 WHEN '20' THEN 4 WHEN '30' THEN 3 WHEN '40' THEN 3 ELSE 10 + CASE WHEN h > 0 THEN 12 ELSE 0 END END END AS score FROM tokened)"""


def _match(term: str, field: str) -> str:
    if len(term) < 5:
        return f"list_contains(string_split({field}, ' '), '{term}')"
    m = f"least(len(w), {len(term)}) - 2"
    return f"(contains({field}, '{term}') OR len(list_filter(string_split({field}, ' '), lambda w: len(w) >= 5 AND left(w, {m}) = left('{term}', {m}))) > 0)"


def _score(query: str) -> tuple[str, str]:
    """The SQL of a query's filter and score."""
    fields = ("nt", "ns", "na", "nd", "np")
    where = " AND ".join("(" + " OR ".join(_match(t, f) for f in fields) + ")" for t in query.split())
    points = [f"CASE WHEN nt = '{query}' THEN 1000 ELSE 0 END"]
    points += [f"CASE WHEN {_match(t, f)} THEN {p} ELSE 0 END" for t in query.split() for f, p in zip(fields, (100, 50, 10, 10, 10), strict=True)]
    return where, " + ".join(points)


_SEARCH, _MATCHES = _score("that stion"), _score("les ment")


def _masked() -> str:
    """Each kind's places are numbered in order of appearance, one kind after another."""
    ctes, before = [], "SELECT doc_id, text AS t FROM documents"
    for i, (kind, pattern) in enumerate(MASKS.items()):
        p = pattern.replace("'", "''")
        ctes.append(f"""m{i} AS (SELECT doc_id, (SELECT string_agg(CASE WHEN k = 1 THEN part ELSE '[{kind}_' || (k - 1) || ']' || part END, '' ORDER BY k) FROM (SELECT unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS k)) AS t
  FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS parts FROM ({before})))""")
        before = f"SELECT doc_id, t FROM m{i}"
    return f"WITH {', '.join(ctes)} SELECT doc_id, sha256(t) AS masked_sha256 FROM m{len(MASKS) - 1}"


_OBJECTS = """objects AS (SELECT 'source:' || n_nationkey AS id, 'source' AS kind, NULL AS parent_id FROM nation
  UNION ALL SELECT 'extraction:' || c_custkey, 'extraction', 'source:' || c_nationkey FROM customer
  UNION ALL SELECT 'sanitized:' || o_orderkey, 'sanitized', 'extraction:' || o_custkey FROM orders
  UNION ALL SELECT DISTINCT 'context:' || l_orderkey || ':' || l_linenumber, 'context', 'sanitized:' || l_orderkey FROM lineitem)"""

_OPERATIONAL = """items AS (SELECT o_orderkey AS id, o_custkey AS scope_ref, o_orderpriority AS kind, o_orderstatus AS subject_ref, o_totalprice AS value,
  CASE WHEN year(o_orderdate) >= 1994 THEN 'active' ELSE 'retired' END AS lifecycle, CASE WHEN o_totalprice > 50000 THEN 'confirmed' ELSE 'proposed' END AS confirmation,
  CASE WHEN o_totalprice > 400000 THEN 'restricted' ELSE 'standard' END AS sensitivity FROM orders)"""

_CONCRETE = "|".join(f"(?:{p})" for p in MASKS.values())
_COUNTS = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}'))::INTEGER AS n_{k.lower()}" for k, p in MASKS.items())

ORACLE_SQL = {
    "section_scan": f"WITH {_FILES} SELECT project, path, heading, line_start::INTEGER AS line_start, line_end::INTEGER AS line_end, section_id, len(text)::INTEGER AS n_chars FROM sections",
    "section_scores": f"WITH {_SCORED} SELECT section_id, matches::INTEGER AS matches, score::INTEGER AS score, matches >= 2 AS covered FROM scored",
    "section_selection": f"""WITH RECURSIVE {_SCORED},
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, path, line_start) AS rank FROM scored WHERE matches >= 2 AND score > 0) WHERE rank <= 24),
fit AS (SELECT project, 0::BIGINT AS rank, 0::BIGINT AS used, false AS taken FROM (SELECT DISTINCT project FROM ranked)
  UNION ALL SELECT r.project, r.rank, f.used + CASE WHEN f.used + len(r.text) <= 6000 THEN len(r.text) ELSE 0 END, f.used + len(r.text) <= 6000 FROM fit f JOIN ranked r ON r.project = f.project AND r.rank = f.rank + 1)
SELECT project, path, line_start::INTEGER AS line_start, rank::INTEGER AS rank, score::INTEGER AS score, len(text)::INTEGER AS n_chars FROM ranked JOIN fit USING (project, rank) WHERE taken""",
    "document_tokens": f"SELECT doc_id, len(t)::INTEGER AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256, n::INTEGER AS token_bound FROM (SELECT doc_id, {_tokens('text')} AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents)",
    "item_search": f"""WITH {_ITEMS}, found AS (SELECT *, {_SEARCH[1]} AS score FROM eligible WHERE na <> '' AND {_SEARCH[0]})
SELECT position::INTEGER AS position, id, item_type, title, score::INTEGER AS score, updated_at, 1 AS source_count, has_related FROM (SELECT *, row_number() OVER (ORDER BY score DESC, nt, id) AS position FROM found) WHERE position > 5 AND position <= 25""",
    "item_matches": f"WITH {_ITEMS} SELECT id, item_type, ({_MATCHES[1]})::INTEGER AS score FROM eligible WHERE nd <> '' AND {_MATCHES[0]}",
    "item_facets": f"""WITH {_ITEMS} SELECT 'type' AS facet, t AS value, count(id) AS count FROM (SELECT unnest(['requirement', 'decision', 'risk', 'open_question', 'action']) AS t) LEFT JOIN eligible ON item_type = t GROUP BY t
UNION ALL SELECT 'actor', arg_min(trim(actor_ref), seq), count(*) FROM eligible WHERE na <> '' GROUP BY na""",
    "item_overview": f"""WITH {_ITEMS}, now AS (SELECT * FROM items WHERE current), done AS (SELECT * FROM now WHERE status = 'confirmed')
SELECT (SELECT count(*) FROM done) AS confirmed, (SELECT count(*) FROM now WHERE status = 'requires_review') AS requires_review, (SELECT count(*) FROM now WHERE status = 'conflicted') AS conflicted,
(SELECT count(*) FROM now WHERE status IN ('requires_review', 'conflicted')) AS pending_total, {', '.join(f"(SELECT count(*) FROM done WHERE item_type = '{t}') AS {t}" for t in ('requirement', 'decision', 'risk', 'open_question', 'action'))},
(SELECT count(*) FROM done WHERE item_type = 'action' AND actor_ref = '') AS actions_without_actor, (SELECT count(*) FROM done WHERE item_type = 'action' AND deadline = '') AS actions_without_deadline, (SELECT count(*) FROM done WHERE has_related) AS related""",
    "item_highlights": f"""WITH {_ITEMS} SELECT item_type, rank::INTEGER AS rank, id, updated_at, deadline FROM (SELECT *, row_number() OVER (PARTITION BY item_type ORDER BY CASE WHEN item_type = 'action' AND deadline = '' THEN 1 ELSE 0 END, updated_at DESC, nt, id) AS rank FROM eligible)
WHERE rank <= CASE item_type WHEN 'decision' THEN 3 WHEN 'requirement' THEN 0 ELSE 5 END""",
    "intake_duplicates": "SELECT source AS workspace_id, doc_id AS id, sha256(coalesce(text, '')) AS checksum, first_value(doc_id) OVER w AS object_id, doc_id <> first_value(doc_id) OVER w AS duplicate FROM documents WINDOW w AS (PARTITION BY source, sha256(coalesce(text, '')) ORDER BY doc_id)",
    "object_versions": "SELECT o_custkey AS owner, o_orderkey AS id, lag(o_orderkey) OVER w AS previous_id, (row_number() OVER w)::INTEGER AS version, lead(o_orderkey) OVER w IS NULL AS current, CASE WHEN lead(o_orderkey) OVER w IS NULL THEN 'ready' ELSE 'superseded' END AS status FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "object_lineage": f"""WITH RECURSIVE {_OBJECTS}, way AS (SELECT id, id AS root_id, 0 AS depth, id AS path FROM objects
  UNION ALL SELECT w.id, p.id, depth + 1, path || '>' || p.id FROM way w JOIN objects o ON o.id = w.root_id JOIN objects p ON p.id = o.parent_id)
SELECT id, arg_max(root_id, depth) AS root_id, max(depth)::INTEGER AS depth, arg_max(path, depth) AS path FROM way GROUP BY id""",
    "object_kind_counts": f"WITH {_OBJECTS} SELECT kind, count(*) AS n, count(*) FILTER (WHERE parent_id IS NULL AND kind <> 'source') AS without_parents FROM objects GROUP BY kind",
    "latest_events": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props, count(*) AS events FROM events GROUP BY 1, 2",
    "absent_inserts": "SELECT DISTINCT o_custkey AS id, 'order' AS origin FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "expired_files": "SELECT event_id AS id, floor(epoch(ts))::DOUBLE AS mtime FROM events WHERE floor(epoch(ts)) < 1706572800.0 - 10 * 86400.0",
    "recent_log": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 100",
    "candidate_merge": """SELECT min(doc_id) AS seq, lang AS item_type, CASE max(CASE WHEN n_chars > 2000 THEN 2 WHEN n_chars > 500 THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, count(DISTINCT source) AS blocks, count(*) AS merged
FROM documents GROUP BY lang, replace(lower(trim(coalesce(text, ''))), 'ß', 'ss')""",
    "item_conflicts": """WITH rows AS (SELECT doc_id AS id, source, CASE WHEN lang = 'en' THEN 'decision' ELSE 'risk' END AS item_type, replace(lower(trim(split_part(coalesce(text, ''), chr(10), 1))), 'ß', 'ss') AS title, coalesce(text, '') AS said FROM documents)
SELECT id, item_type, n AS n_other, CASE WHEN n = 0 THEN 'clear' WHEN item_type = 'decision' THEN 'conflicted' ELSE 'possible_duplicate' END AS mark
FROM (SELECT id, item_type, count(*) OVER (PARTITION BY source, item_type, title) - count(*) OVER (PARTITION BY source, item_type, title, said) AS n FROM rows)""",
    "span_overlaps": """WITH a AS (SELECT o_orderkey AS key, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS s FROM orders), b AS (SELECT l_orderkey AS key, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS s, l_linenumber * 5 AS n FROM lineitem)
SELECT a.key, a.s AS a_start, a.s + 60 AS a_end, b.s AS b_start, b.s + n AS b_end FROM a JOIN b USING (key) WHERE a.s < b.s + n AND a.s + 60 > b.s""",
    "sensitive_flags": f"SELECT doc_id, coalesce(regexp_matches(text, '{_CONCRETE}'), false) AS concrete, coalesce(regexp_matches(text, '{TOPICS}'), false) AS topic, {_COUNTS} FROM documents",
    "masked_documents": _masked(),
    "strictest_handling": f"""WITH {_OPERATIONAL}, levels AS (SELECT scope_ref, CASE WHEN sensitivity = 'restricted' THEN 2 WHEN lifecycle = 'retired' THEN 1 ELSE 0 END AS l FROM items)
SELECT scope_ref, (['standard', 'unknown', 'restricted'])[1 + max(l)] AS handling, max(l) = 0 AS external_allowed FROM levels GROUP BY 1""",
    "authority_items": f"""WITH {_OPERATIONAL}, why AS (SELECT *, CASE WHEN lifecycle <> 'active' THEN 'not_active' WHEN confirmation <> 'confirmed' THEN 'not_confirmed' WHEN kind NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'unsupported_kind' WHEN sensitivity <> 'standard' THEN 'sensitivity_denied' ELSE '' END AS reason FROM items)
SELECT id, reason, CASE WHEN reason <> '' THEN 'excluded' WHEN count(*) FILTER (WHERE reason = '') OVER (PARTITION BY scope_ref, kind, subject_ref) > 1 THEN 'ambiguous' ELSE 'eligible' END AS verdict FROM why""",
    "sound_scopes": f"WITH {_OPERATIONAL} SELECT scope_ref, count(*) AS n FROM items GROUP BY 1 HAVING bool_and(value > 2000)",
    "conversation_summaries": r"""SELECT conv_id, coalesce(right(string_agg('- ' || role || ': ' || left(t, 260), chr(10) ORDER BY turn) FILTER (WHERE nth <= 20 AND t <> ''), 2400), '') AS summary, count(*) AS n_turns
FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations) GROUP BY conv_id""",
    "latest_user_turns": "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' AND trim(coalesce(text, '')) <> '' GROUP BY conv_id",
    "item_sections": f"WITH {_ITEMS} SELECT id, item_type, status, actor_ref, deadline, updated_at FROM eligible WHERE NOT has_related AND deadline <> ''",
    "context_queries": r"""WITH spoken AS (SELECT conv_id, turn, max(text) AS text FROM conversations WHERE role = 'user' AND trim(coalesce(text, '')) <> '' GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth, lead(text) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS prior FROM spoken),
worded AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text || ' ' || coalesce(prior, '')), '[A-Za-zА-Яа-яЁё0-9_]+'), lambda w: w NOT IN ('of', 'to', 'und', 'les')) AS w FROM placed WHERE nth = 1)
SELECT conv_id, turn, list_reduce(list_concat([''], w), lambda acc, t: CASE WHEN acc = '' THEN left(t, 200) WHEN len(string_split(acc, ' ')) < 16 AND len(acc) + 1 + len(t) <= 200 THEN acc || ' ' || t ELSE acc END) AS query FROM worded""",
    "group_projects": "SELECT r_name AS title, count(n_nationkey) AS projects FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name",
    "document_units": r"""WITH blocks AS (SELECT doc_id, regexp_extract_all(text, '(?s).*?(?:\n\s*\n|\z)') AS b FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, unnest(b) AS t, unnest(list_transform(range(1, len(b) + 1), lambda i: coalesce(list_sum(list_transform(b[1:i - 1], lambda x: len(x))), 0))) AS base FROM blocks),
cut AS (SELECT doc_id, base, list_filter(string_split(regexp_replace(t, '(?m)^([ \t]*(?:[-*+]|\d+[.)])\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> '') AS p FROM placed WHERE regexp_replace(t, '\s', '', 'g') <> '' AND NOT regexp_matches(t, '(?s)\A\s*#{1,6}\s+\S[^\n]*\s*\z')),
parts AS (SELECT doc_id, unnest(p) AS t, base + unnest(list_transform(range(1, len(p) + 1), lambda i: coalesce(list_sum(list_transform(p[1:i - 1], lambda x: len(x))), 0))) AS base FROM cut),
pieces AS (SELECT doc_id, t, base, unnest(range(0, len(t), 4000)) AS a FROM parts WHERE regexp_replace(t, '\s', '', 'g') <> '')
SELECT doc_id, (base + a)::INTEGER AS start, (base + a + len(t[a + 1:a + 4000]))::INTEGER AS "end", CASE WHEN len(t) > 4000 THEN 'cut' WHEN regexp_matches(t, '\A[ \t]*(?:[-*+]|\d+[.)])\s') THEN 'list_item' ELSE 'paragraph' END AS boundary, sha256(t[a + 1:a + 4000]) AS sha256 FROM pieces""",
    "errors_after_clicks": """SELECT e.event_id, e.user_id, c.event_id AS click FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) c ON e.user_id = c.user_id AND e.ts >= c.ts""",
    "open_inbox": """SELECT d.doc_id AS id, n_chars AS mtime, CASE WHEN q IS NULL THEN 'new' WHEN q = 0 THEN 'ignored' ELSE 'seen' END AS status FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) l USING (doc_id)
WHERE (q IS NULL OR q <> 0) AND source <> 'src0' ORDER BY n_chars DESC, d.doc_id LIMIT 200""",
    "hourly_events": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "compact_texts": """SELECT doc_id, len(s)::INTEGER AS n_chars, sha256(s) AS sha256, left(sha256(concat_ws(chr(10), source, lang, text)), 16) AS item_id
FROM (SELECT *, CASE WHEN len(text) <= 600 THEN text ELSE left(text, 395) || chr(10) || '[...]' || chr(10) || right(text, 198) END AS s FROM documents)""",
}
