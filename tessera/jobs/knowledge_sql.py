"""DuckDB SQL for the queries of ``knowledge``; patterns and values are written out here, so that each side has its own."""

from __future__ import annotations

_WORDS = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-zА-Яа-яЁё0-9]{{3,}}|[A-ZА-ЯЁ]{{2,}}'), lambda t: lower(t)))"
_FOCUS = "['les', 'und', 'ing', 'tion', 'que', 'mit', 'los', 'des']"

_MEMORY = f"""base AS (SELECT source AS project, doc_id::VARCHAR AS section_id, (['10_Branches', '20_Decisions', '30_Open_Questions', '40_Risks', '50_Sources', 'Исходники', '00_Core'])[1 + n_chars % 7] AS folder,
  split_part(text, chr(10), 1) AS heading, doc_id AS line_start, regexp_replace(text, '([A-Z][a-z]{{7,}})', '[[\\1]]', 'g') AS text FROM documents),
tokened AS (SELECT *, folder || '/' || section_id || '.md' AS path, len(list_intersect({_WORDS.format("heading || chr(10) || text || chr(10) || section_id")}, {_FOCUS})) AS m, len(list_intersect({_WORDS.format("heading")}, {_FOCUS})) AS h FROM base),
scored AS (SELECT * EXCLUDE (text), text, CASE WHEN m = 0 AND h = 0 THEN 0 ELSE m + 3 * h + CASE folder WHEN '10_Branches' THEN 5 WHEN '20_Decisions' THEN 4 WHEN '30_Open_Questions' THEN 3 WHEN '40_Risks' THEN 3
    WHEN '50_Sources' THEN 10 + CASE WHEN h > 0 THEN 12 ELSE 0 END WHEN 'Исходники' THEN 6 ELSE 0 END END AS score,
  CASE folder WHEN '00_Core' THEN 42 WHEN '20_Decisions' THEN 42 WHEN '50_Sources' THEN 36 WHEN 'Исходники' THEN 24 ELSE 28 END AS authority, m >= 2 AS covered FROM tokened),
direct AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score + authority // 4 DESC, authority DESC, line_start, path) AS r FROM scored WHERE covered AND score > 0),
titles AS (SELECT DISTINCT project, lower(trim(unnest(regexp_extract_all(text, '\\[\\[([^\\]|#]+)', 1)))) AS title FROM direct WHERE r <= 3),
linked AS (SELECT DISTINCT s.project, s.section_id FROM scored s JOIN titles t ON t.project = s.project AND title <> '' AND (contains(lower(heading), title) OR contains(s.section_id, title))),
related AS (SELECT s.project, s.section_id, CASE WHEN l.section_id IS NULL THEN score ELSE greatest(score, 8) END AS score, l.section_id IS NOT NULL AS linked
  FROM scored s LEFT JOIN linked l USING (project, section_id) WHERE l.section_id IS NOT NULL OR folder IN ('10_Branches', '20_Decisions', '30_Open_Questions', '40_Risks') AND score > 0)"""


def _placed(column: str) -> str:
    """Where each piece of a list begins."""
    return f"unnest(list_transform(range(1, len({column}) + 1), lambda i: coalesce(list_sum(list_transform({column}[1:i - 1], lambda x: len(x))), 0)))"


_SPLIT = "replace(replace({}, chr(10), chr(10) || chr(10)), ', ', ',' || chr(10) || '- ')"
_BRIEFS = f"""briefs AS (SELECT doc_id, '# ' || lang || chr(10) || chr(10) AS h1, '## Риски' || chr(10) || chr(10) || {_SPLIT.format("split_part(text, chr(10), 1)")} || chr(10) || chr(10) AS h2,
  'Действия:' || chr(10) || chr(10) AS h3, '### ' || source || chr(10) || chr(10) || {_SPLIT.format("array_to_string(string_split(text, chr(10))[2:], chr(10))")} AS h4, lang, source FROM documents),
whole AS (SELECT doc_id, h1 || h2 || h3 || h4 AS text, lang, source, len(h1) AS p2, len(h1 || h2) AS p3, len(h1 || h2 || h3) AS p4 FROM briefs)"""


def _chunks(limit: int) -> str:
    """Units of the briefs with the place of their paragraph."""
    return rf"""{_BRIEFS},
blocks AS (SELECT doc_id, regexp_extract_all(text, '(?s).*?(?:\n\s*\n|\z)') AS b FROM whole),
paragraphs AS (SELECT doc_id, unnest(b) AS t, {_placed('b')} AS block FROM blocks),
cut AS (SELECT doc_id, block, list_filter(string_split(regexp_replace(t, '(?m)^([ \t]*(?:[-*+]|\d+[.)])\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> '') AS p FROM paragraphs
  WHERE regexp_replace(t, '\s', '', 'g') <> '' AND NOT regexp_matches(t, '(?s)\A\s*#{{1,6}}\s+\S[^\n]*\s*\z') AND trim(t, chr(10)) <> 'Действия:'),
parts AS (SELECT doc_id, block, unnest(p) AS t, block + {_placed('p')} AS base FROM cut),
sentences AS (SELECT doc_id, block, t, base, CASE WHEN len(t) > {limit} THEN regexp_extract_all(t, '[^.!?\n]+[.!?]?\s*|\n+|[.!?]+\s*') ELSE [t] END AS s FROM parts WHERE regexp_replace(t, '\s', '', 'g') <> ''),
pieces AS (SELECT doc_id, block, len(t) > {limit} AS long, regexp_matches(t, '\A[ \t]*(?:[-*+]|\d+[.)])\s') AS item, unnest(s) AS t, base + {_placed('s')} AS base FROM sentences),
cuts AS (SELECT doc_id, block, long, item, base, t, unnest(range(0, len(t), {limit})) AS a FROM pieces),
units AS (SELECT doc_id, block, base + a AS start, base + a + len(t[a + 1:a + {limit}]) AS "end", CASE WHEN len(t) > {limit} THEN 'character' WHEN long THEN 'sentence' WHEN item THEN 'list_item' ELSE 'paragraph' END AS boundary, t[a + 1:a + {limit}] AS t FROM cuts),
chunks AS (SELECT u.doc_id, row_number() OVER (PARTITION BY u.doc_id ORDER BY start) - 1 AS index, start, "end", boundary, t,
  CASE WHEN block > p4 THEN 'Действия: > ' || source WHEN block > p3 THEN 'Действия:' WHEN block > p2 THEN lang || ' > Риски' WHEN block > 0 THEN lang ELSE '' END AS stack,
  CASE WHEN block > p3 THEN 'action' WHEN block > p2 THEN 'risk' END AS type_hint FROM units u JOIN whole USING (doc_id))"""


_SPANS = rf"""{_chunks(1500)},
each AS (SELECT doc_id, index, start, t, type_hint, regexp_matches(t, '\A[ \t]*(?:[-*+]|\d+[.)])\s') AS item, regexp_extract_all(t, '[^.!?\n]+[.!?]?|[.!?\n]+') AS p FROM chunks),
spread AS (SELECT doc_id, index, unnest(p) AS x, {_placed('p')} AS place FROM each WHERE NOT item),
sound AS (SELECT doc_id, index, place + len(x) - len(regexp_replace(x, '\A\s+', '')) AS s, place + len(regexp_replace(x, '\s+\z', '')) AS e FROM spread WHERE regexp_matches(x, '[^.!?\n]') AND regexp_matches(x, '\S')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, index ORDER BY s) - 1 AS k, count(*) OVER (PARTITION BY doc_id, index) AS n FROM sound),
joined AS (SELECT doc_id, index, k // ((n + 11) // 12) AS g, min(s) AS s, max(e) AS e FROM numbered GROUP BY 1, 2, 3),
alone AS (SELECT doc_id, index, 0 AS g, len(t) - len(regexp_replace(t, '\A\s+', '')) AS s, len(regexp_replace(t, '\s+\z', '')) AS e FROM each WHERE item OR regexp_matches(t, '\S') AND (doc_id, index) NOT IN (SELECT (doc_id, index) FROM sound)),
spans AS (SELECT a.doc_id, a.index, 'E' || (g + 1) AS id, g, start + s AS s, start + e AS e, t[s + 1:e] AS x, type_hint FROM (FROM joined UNION ALL FROM alone) a JOIN each USING (doc_id, index))"""

_INPUTS = """inputs AS (SELECT o_custkey AS package_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'authority' WHEN '2-HIGH' THEN 'ambiguity' WHEN '3-MEDIUM' THEN 'memory' ELSE 'session' END AS layer, o_orderkey AS seq,
  o_orderkey::VARCHAR AS ref, floor(o_totalprice / 10)::BIGINT AS cost, CASE o_orderstatus WHEN 'F' THEN 'standard' WHEN 'O' THEN 'restricted' ELSE 'unknown' END AS handling FROM orders
  UNION ALL SELECT c_custkey, 'request', 0, c_name, CASE WHEN c_acctbal < -800 THEN 60001 ELSE len(c_name) END, 'standard' FROM customer),
ordered AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY list_position(['request', 'authority', 'ambiguity', 'memory', 'session'], layer), seq) AS k FROM inputs),
walk AS (SELECT DISTINCT package_id, 0::BIGINT AS k, 0::BIGINT AS used, false AS taken FROM ordered
  UNION ALL SELECT o.package_id, o.k, CASE WHEN used + cost <= 60000 THEN used + cost ELSE used END, used + cost <= 60000 FROM walk w JOIN ordered o ON o.package_id = w.package_id AND o.k = w.k + 1),
refused AS (SELECT package_id FROM inputs WHERE layer = 'request' GROUP BY 1 HAVING sum(cost) > 60000),
met AS (SELECT o.*, taken AND r.package_id IS NULL AS taken, used, r.package_id IS NOT NULL AS no FROM ordered o JOIN walk w USING (package_id, k) LEFT JOIN refused r ON r.package_id = o.package_id)"""

_ODD = lambda n: f"floor(o_totalprice)::BIGINT % {n} = 0"
_OPERATIONS = f"""o AS (SELECT 'c' || o_custkey AS scope_ref, o_orderkey::VARCHAR AS id, NOT ({_ODD(151)}) AND NOT ({_ODD(157)}) AS sound, {_ODD(167)} AS missing, {_ODD(163)} OR {_ODD(173)} OR {_ODD(179)} AS differs FROM orders),
parts AS (SELECT 'project' AS scope, scope_ref, count(*) AS n_items, count(*) FILTER (WHERE NOT missing) AS n_evidence, count(*) FILTER (WHERE NOT sound OR missing OR differs) AS n_bad FROM o GROUP BY 1, 2)"""
_ADMISSION = """u AS (SELECT coalesce(lang, '') AS w, lang AS workspace_id, doc_id AS seq, doc_id::VARCHAR AS upload_id, source || '-' || n_chars % 40 || CASE WHEN n_chars % 9 = 0 THEN '.exe' ELSE '.txt' END AS name, sha256(coalesce(text, '')) AS checksum,
  CASE WHEN n_chars % 9 = 0 THEN 'unsupported' WHEN regexp_matches(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]') THEN 'not_text' ELSE '' END AS refusal, source IN ('src0', 'src3') AS early FROM documents),
one AS (SELECT *, row_number() OVER (PARTITION BY w, checksum ORDER BY seq) AS r FROM u WHERE early AND refusal = ''),
known AS (SELECT * FROM one WHERE r = 1),
late AS (SELECT * FROM u WHERE (w, upload_id) NOT IN (SELECT (w, upload_id) FROM known)),
two AS (SELECT *, row_number() OVER (PARTITION BY w, checksum ORDER BY seq) = 1 AND (w, checksum) NOT IN (SELECT (w, checksum) FROM known) AS fresh FROM late WHERE refusal = ''),
standing AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY w, name ORDER BY seq DESC) = 1),
chain AS (SELECT *, lag(checksum) OVER c AS prior, lead(checksum) OVER c IS NULL AS current FROM (SELECT w, workspace_id, upload_id, seq, checksum, name, 0 AS n FROM standing UNION ALL SELECT w, workspace_id, upload_id, seq, checksum, name, 1 FROM two WHERE fresh) WINDOW c AS (PARTITION BY w, name ORDER BY n, seq)),
ids AS (SELECT *, 'src-' || left(sha256(w || chr(10) || checksum), 16) AS source_id, 'src-' || left(sha256(w || chr(10) || prior), 16) AS supersedes_id FROM chain)"""


_PROJECTS = """files AS (SELECT source AS project, lang, n_chars AS n, CASE n_chars % 8 WHEN 0 THEN 'K' || n_chars % 3 || ' - Память.md' WHEN 1 THEN 'Память.md' WHEN 2 THEN 'Память_Graph/20_Decisions/' || doc_id || '.md' WHEN 3 THEN 'Память_Graph/90_Archive/' || doc_id || '.md'
    WHEN 4 THEN 'Исходники/' || doc_id || '.TXT' WHEN 5 THEN 'Транскрипции/a/' || doc_id || '.exe' WHEN 6 THEN 'K0 - Источники.md' ELSE 'project.json' END AS path, doc_id, text,
  CASE WHEN n_chars % 7 = 0 THEN '{bad' ELSE '{"title": "' || CASE WHEN n_chars % 5 = 0 THEN '' ELSE lang END || '", "status": "' || CASE n_chars % 3 WHEN 0 THEN 'archived' WHEN 1 THEN 'active' ELSE 'odd' END || '", "group_code": " ' || lang || '"' || CASE WHEN n_chars % 2 = 0 THEN ', "context_inheritance": false' ELSE '' END || '}' END AS meta FROM documents),
each_ AS (SELECT project, min(path) FILTER (WHERE n % 8 = 0) AS marked, bool_or(n % 8 = 1) AS plain, max(meta) FILTER (WHERE n % 8 = 7) AS meta FROM files GROUP BY 1),
parsed AS (SELECT *, coalesce(marked, 'Память.md') AS memory_path, meta = '{bad' AS bad, CASE WHEN meta <> '{bad' THEN meta::JSON END AS m FROM each_ WHERE marked IS NOT NULL OR plain),
all_ AS (SELECT project, memory_path, CASE WHEN marked IS NOT NULL THEN left(marked, 2) ELSE upper(left(project, 1)) END AS code, coalesce(nullif(m->>'title', ''), project) AS title, coalesce(m->>'status', 'active') AS status, coalesce(trim(m->>'group_code'), '') AS group_code,
  coalesce(m->>'context_inheritance', 'true') = 'true' AS inherits, coalesce(bad, false) AS bad, marked FROM parsed),
records AS (SELECT project, memory_path, code, title, status, group_code, CASE WHEN group_code IN (SELECT DISTINCT lang FROM documents WHERE lang <> 'es') THEN upper(group_code) ELSE '' END AS group_title, inherits,
  CASE WHEN bad THEN 'meta' WHEN len(code) < 2 THEN 'code' WHEN status = 'odd' THEN 'status' ELSE '' END AS fault, marked FROM all_),
corpus AS (SELECT DISTINCT f.project, path, CASE WHEN path = memory_path THEN 0 WHEN n % 8 = 6 AND left(marked, 2) = 'K0' THEN 1 WHEN n % 8 = 2 THEN 5 WHEN n % 8 = 4 THEN 6 END AS place, CASE n % 8 WHEN 6 THEN 'registry' WHEN 2 THEN 'graph' WHEN 4 THEN 'source' ELSE 'project' END AS scope
  FROM files f JOIN records r ON r.project = f.project AND status <> 'archived')"""

ORACLE_SQL = {
    "related_sections": f"WITH {_MEMORY} SELECT * FROM related",
    "merged_candidates": f"""WITH {_MEMORY}, both_ AS (SELECT project, section_id, max(score) AS score FROM (SELECT project, section_id, score FROM direct UNION ALL SELECT project, section_id, score FROM related) GROUP BY 1, 2)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY b.score + authority // 4 DESC, authority DESC, line_start, path) AS rank, section_id, b.score, authority FROM both_ b JOIN scored s USING (project, section_id) QUALIFY rank <= 40""",
    "evidence_plan": f"""WITH {_MEMORY},
selected AS (SELECT * FROM direct WHERE r <= 5),
one AS (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY authority DESC, line_start, r) AS n FROM selected WHERE folder = 'Исходники'),
tiers AS (SELECT project, section_id, path, text, 1 AS tier, -authority AS a, line_start AS b, r AS c FROM one WHERE n = 1
  UNION ALL SELECT project, section_id, path, text, 2, -score, -authority, line_start FROM scored s WHERE folder = 'Исходники' AND covered AND (project, path) NOT IN (SELECT (project, path) FROM one)
  UNION ALL SELECT project, section_id, path, text, 3, r, 0, 0 FROM selected WHERE folder = '50_Sources' UNION ALL SELECT project, section_id, path, text, 4, 0, 0, 0 FROM selected WHERE r = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY tier, a, b, c, path, section_id) AS nth FROM tiers),
clean AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM ranked WHERE nth <= 3 AND (tier < 4 OR nth = 1)),
begun AS (SELECT *, greatest(coalesce(list_min(list_filter(list_transform({_FOCUS}, lambda w: instr(lower(t), w)), lambda p: p > 0)), 1) - 1 - 466, 0) AS s FROM clean),
out_ AS (SELECT project, nth, tier, section_id, path, CASE WHEN len(t) <= 1400 THEN t ELSE CASE WHEN s > 0 THEN '... ' ELSE '' END || trim(t[s + 1:s + 1400]) || CASE WHEN s + 1400 < len(t) THEN ' ...' ELSE '' END END AS x FROM begun
  UNION ALL SELECT project, 1, 0, '', '', '' FROM (SELECT DISTINCT source AS project FROM documents UNION SELECT 'none') WHERE project NOT IN (SELECT project FROM selected))
SELECT project, nth, tier, ['missing', 'confirmed', 'confirmed', 'partial', 'partial'][tier + 1] AS status, ['nothing_selected', 'selected_primary', 'found_primary', 'source_summary', 'memory_only'][tier + 1] AS reason, section_id, path, sha256(x) AS sha256 FROM out_""",
    "memory_selection": f"""WITH RECURSIVE {_MEMORY.replace("m >= 2 AS covered", "cov AS covered").replace("AS h FROM base)", "AS h, len(list_intersect({0}, ['les', 'und'])) > 0 OR len(list_intersect({0}, ['ing', 'tion', 'que'])) >= 2 AS cov FROM base)".format(_WORDS.format("heading || chr(10) || text || chr(10) || section_id")))},
sizes AS (SELECT project, section_id, path, line_start, authority, folder, CASE WHEN len(text) <= 14000 THEN len(text) ELSE len(rtrim(left(text, 14000))) + 25 END AS size FROM scored),
both_ AS (SELECT project, section_id, max(score) AS score FROM (SELECT project, section_id, score FROM direct UNION ALL SELECT project, section_id, score FROM related) WHERE project IN (SELECT project FROM direct) GROUP BY 1, 2),
ranked AS (SELECT b.*, size, row_number() OVER (PARTITION BY project ORDER BY score + authority // 4 DESC, authority DESC, line_start, path) AS k FROM both_ b JOIN sizes USING (project, section_id) WHERE score > 0),
walk AS (SELECT DISTINCT project, 0::BIGINT AS k, 0::BIGINT AS used, 0 AS n, false AS taken FROM ranked
  UNION ALL SELECT r.project, r.k, CASE WHEN n < 6 AND used < 9000 AND (n = 0 OR used + size <= 9000) THEN used + size ELSE used END, CASE WHEN n < 6 AND used < 9000 AND (n = 0 OR used + size <= 9000) THEN n + 1 ELSE n END, n < 6 AND used < 9000 AND (n = 0 OR used + size <= 9000)
  FROM walk w JOIN ranked r ON r.project = w.project AND r.k = w.k + 1),
first_ AS (SELECT project, n AS rank, section_id, score, size FROM walk JOIN ranked USING (project, k) WHERE taken),
ended AS (SELECT project, max(used) AS used, max(n) AS n FROM walk GROUP BY 1),
core AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY nth) AS k FROM (SELECT project, section_id, size, row_number() OVER (PARTITION BY project ORDER BY line_start, path) AS nth FROM sizes WHERE folder = '00_Core') WHERE nth <= 2 AND (project, section_id) NOT IN (SELECT (project, section_id) FROM first_)),
fill AS (SELECT project, 0::BIGINT AS k, used, n, false AS taken FROM ended
  UNION ALL SELECT c.project, c.k, CASE WHEN n < 6 AND used < 9000 AND (n = 0 OR used + size <= 9000) THEN used + size ELSE used END, CASE WHEN n < 6 AND used < 9000 AND (n = 0 OR used + size <= 9000) THEN n + 1 ELSE n END, n < 6 AND used < 9000 AND (n = 0 OR used + size <= 9000)
  FROM fill f JOIN core c ON c.project = f.project AND c.k = f.k + 1)
SELECT project, rank, section_id, score, size AS n_chars FROM first_ UNION ALL SELECT project, n, section_id, 2, size FROM fill JOIN core USING (project, k) WHERE taken""",
    "unindexed_sources": "SELECT DISTINCT item_id AS source_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE left(b.text, 40) <> '' AND contains(d.text, left(b.text, 40)) OR right(b.text, 40) <> '' AND contains(d.text, right(b.text, 40)))",
    "context_chunks": f"""WITH {_chunks(120)}
SELECT doc_id, index, start, "end", boundary, CASE WHEN contains(stack, ' > ') THEN split_part(stack, ' > ', 2) ELSE stack END AS heading, stack, type_hint, sha256(t) AS sha256 FROM chunks""",
    "packed_chunks": r"""WITH RECURSIVE blocks AS (SELECT doc_id, regexp_extract_all(text, '(?s).*?(?:\n\s*\n|\z)') AS b FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, unnest(b) AS t, unnest(list_transform(range(1, len(b) + 1), lambda i: coalesce(list_sum(list_transform(b[1:i - 1], lambda x: len(x))), 0))) AS base FROM blocks),
cut AS (SELECT doc_id, base, list_filter(string_split(regexp_replace(t, '(?m)^([ \t]*(?:[-*+]|\d+[.)])\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> '') AS p FROM placed WHERE regexp_replace(t, '\s', '', 'g') <> '' AND NOT regexp_matches(t, '(?s)\A\s*#{1,6}\s+\S[^\n]*\s*\z')),
parts AS (SELECT doc_id, unnest(p) AS t, base + unnest(list_transform(range(1, len(p) + 1), lambda i: coalesce(list_sum(list_transform(p[1:i - 1], lambda x: len(x))), 0))) AS base FROM cut),
pieces AS (SELECT doc_id, t, base, unnest(range(0, len(t), 400)) AS a FROM parts WHERE regexp_replace(t, '\s', '', 'g') <> ''),
units AS (SELECT doc_id, base + a AS s, base + a + len(t[a + 1:a + 400]) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY base + a) AS k FROM pieces),
ends AS (SELECT u.doc_id, u.k, u.s, max(v.k) AS last FROM units u JOIN units v ON v.doc_id = u.doc_id AND v.k >= u.k AND v.k < u.k + 12 AND (v.e <= u.s + 1500 OR v.k = u.k) GROUP BY 1, 2, 3),
steps AS (SELECT n.doc_id, n.k, n.s, l.e, n.last, max(n.last) OVER (PARTITION BY n.doc_id) AS top FROM ends n JOIN units l ON l.doc_id = n.doc_id AND l.k = n.last),
nexts AS (SELECT t.doc_id, t.k, t.s, t.e, t.last, t.top, greatest(t.k + 1, least(t.last + 1, coalesce(min(v.k), t.last + 1))) AS next FROM steps t LEFT JOIN units v ON v.doc_id = t.doc_id AND v.s >= t.e - 300 AND v.k <= t.last GROUP BY t.doc_id, t.k, t.s, t.e, t.last, t.top),
walk AS (SELECT doc_id, k, s, e, last, top, next, 0 AS chunk FROM nexts WHERE k = 1 UNION ALL SELECT n.doc_id, n.k, n.s, n.e, n.last, n.top, n.next, w.chunk + 1 FROM walk w JOIN nexts n ON n.doc_id = w.doc_id AND n.k = w.next WHERE w.last < w.top)
SELECT doc_id, chunk, s AS start, e AS "end", last - k + 1 AS n_units FROM walk""",
    "evidence_spans": f"""WITH {_SPANS} SELECT c.doc_id, c.index, count(id) AS n_spans, coalesce(string_agg(id || ':' || s || ':' || e, ',' ORDER BY g), '') AS places, sha256(coalesce(string_agg(x, '|' ORDER BY g), '')) AS sha256
FROM chunks c LEFT JOIN spans s ON s.doc_id = c.doc_id AND s.index = c.index GROUP BY 1, 2""",
    "grounded_spans": f"""WITH {_SPANS} SELECT c.doc_id, c.index, w || '-1' AS candidate_id, CASE WHEN s.id IS NULL THEN 'evidence_id_unknown' ELSE 'grounded' END AS outcome, CASE WHEN s.id IS NOT NULL THEN coalesce(s.type_hint, 'fact') END AS type, s.s AS start, s.e AS "end"
FROM (SELECT *, unnest(['E1', 'E3']) AS w FROM chunks) c LEFT JOIN spans s ON s.doc_id = c.doc_id AND s.index = c.index AND s.id = w""",
    "supporting_evidence": r"""WITH words AS (SELECT *, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-zА-Яа-яЁё0-9]{3,}'), lambda t: lower(t))) AS w FROM conversations),
ready AS (SELECT conv_id, turn::VARCHAR AS evidence_id, regexp_replace(text, '\A\s+|\s+\z', '', 'g') AS text, w FROM words WHERE role = 'user' AND turn % 5 <> 4),
says AS (SELECT conv_id, turn::VARCHAR AS context_id, text, w, turn % 4 = 3 AS named, turn FROM words WHERE role = 'assistant'
  UNION ALL SELECT conv_id, 'q' || turn, text[5:34], list_distinct(list_transform(regexp_extract_all(coalesce(text[5:34], ''), '[A-Za-zА-Яа-яЁё0-9]{3,}'), lambda t: lower(t))), false, turn FROM words WHERE role = 'user')
SELECT s.conv_id AS extraction_id, context_id, evidence_id, 'explicit_reference' AS support FROM says s JOIN ready r ON r.conv_id = s.conv_id AND evidence_id = (turn - 1)::VARCHAR WHERE named
UNION ALL SELECT s.conv_id, context_id, evidence_id, CASE WHEN s.text <> '' AND contains(r.text, s.text) THEN 'exact_fragment' ELSE 'shared_terms' END FROM says s JOIN ready r USING (conv_id)
WHERE NOT named AND (s.text <> '' AND contains(r.text, s.text) OR len(list_intersect(s.w, r.w)) >= 3)""",
    "grounded_candidates": r"""WITH d AS (SELECT doc_id, text, trim(split_part(text, chr(10), 1)) AS f1, array_to_string(list_filter(list_transform(string_split(text[50:109], chr(10)), lambda s: trim(s)), lambda s: s <> ''), ' ') AS f2, n_chars % 5 <> 0 AS ok FROM documents),
p AS (SELECT *, CASE WHEN f1 = '' THEN 0 ELSE instr(text, f1) END AS a1, CASE WHEN f2 = '' THEN 0 ELSE instr(text, f2) END AS a2, instr(text, 'nowhere in it') AS a3 FROM d),
o AS (SELECT *, CASE WHEN a1 = 0 THEN 'unavailable' ELSE 'grounded' END AS o1, CASE WHEN NOT ok THEN 'unsupported' WHEN a2 = 0 THEN 'unavailable' ELSE 'grounded' END AS o2, CASE WHEN a3 = 0 THEN 'unavailable' ELSE 'grounded' END AS o3,
  'p1:' || (a1 - 1) || ':' || (a1 - 1 + len(f1)) AS b1, 'p2:' || (a2 - 1) || ':' || (a2 - 1 + len(f2)) AS b2, 'p3:' || (a3 - 1) || ':' || (a3 + 12) AS b3 FROM p),
c AS (SELECT doc_id, 'c1' AS candidate_id, o1 AS outcome, b1 AS b FROM o UNION ALL SELECT doc_id, 'c2', CASE WHEN o1 <> 'grounded' THEN o1 ELSE o2 END, b1 || ',' || b2 FROM o UNION ALL SELECT doc_id, 'c3', CASE WHEN o2 <> 'grounded' THEN o2 ELSE o3 END, b2 || ',' || b3 FROM o
  UNION ALL SELECT doc_id, 'c4', 'unbacked', '' FROM o UNION ALL SELECT doc_id, 'c5', CASE WHEN o1 <> 'grounded' THEN o1 ELSE 'unknown' END, '' FROM o UNION ALL SELECT doc_id, 'c6', CASE WHEN o1 <> 'grounded' THEN o1 ELSE 'modality' END, '' FROM o
  UNION ALL SELECT doc_id, 'c7', 'unsupported', '' FROM o)
SELECT doc_id AS sanitized_id, candidate_id, outcome, CASE WHEN outcome = 'grounded' THEN b ELSE '' END AS places FROM c""",
    "context_packages": f"""WITH RECURSIVE {_INPUTS} SELECT package_id, CASE WHEN bool_or(no) THEN 'refused' ELSE 'composed' END AS status, coalesce(max(used) FILTER (WHERE taken), 0) AS used,
  ['standard', 'unknown', 'restricted'][max(list_position(['standard', 'unknown', 'restricted'], handling))] AS handling, count(*) FILTER (WHERE taken) AS n_included, count(*) FILTER (WHERE NOT taken) AS n_omitted, bool_and(handling = 'standard') AS external_allowed FROM met GROUP BY 1""",
    "omitted_inputs": f"WITH RECURSIVE {_INPUTS} SELECT package_id, layer, ref, handling FROM met WHERE NOT taken",
    "dialogue_contexts": """WITH c AS (SELECT doc_id, coalesce(text, '') AS t, 2000 - least(len(coalesce(text, '')), 1400) AS room FROM documents),
i AS (SELECT l_orderkey AS d, floor(l_quantity * 20)::BIGINT AS cost, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, floor(l_quantity * 20)) AS k FROM lineitem QUALIFY k <= 3),
p AS (SELECT doc_id, t, room, coalesce(max(cost) FILTER (WHERE k = 1), room + 1) AS a, coalesce(max(cost) FILTER (WHERE k = 2), room + 1) AS b, coalesce(max(cost) FILTER (WHERE k = 3), room + 1) AS c, count(k) AS n FROM c LEFT JOIN i ON d = doc_id GROUP BY 1, 2, 3),
x AS (SELECT *, CASE WHEN a <= room THEN a ELSE 0 END AS u1 FROM p), y AS (SELECT *, CASE WHEN u1 + b <= room THEN u1 + b ELSE u1 END AS u2 FROM x), z AS (SELECT *, CASE WHEN u2 + c <= room THEN u2 + c ELSE u2 END AS u3 FROM y)
SELECT doc_id AS package_id, sha256(left(t, 2000 - u3)) AS sha256, len(left(t, 2000 - u3)) AS memory_chars, u3 AS context_chars, n AS n_selected, (a <= room)::INTEGER + (u1 + b <= room)::INTEGER + (u2 + c <= room)::INTEGER AS n_included FROM z""",
    "closed_partitions": f"WITH {_OPERATIONS} SELECT *, CASE WHEN n_bad > 0 THEN 'closed' ELSE 'open' END AS state FROM parts",
    "partition_items": f"WITH {_OPERATIONS} SELECT scope_ref, id FROM o JOIN parts USING (scope_ref) WHERE n_bad = 0",
    "admitted_files": f"""WITH {_ADMISSION} SELECT workspace_id, upload_id, source_id, current FROM ids UNION ALL
SELECT workspace_id, upload_id, 'src-' || left(sha256(w || chr(10) || checksum), 16), false FROM known WHERE (w, upload_id) NOT IN (SELECT (w, upload_id) FROM ids)""",
    "admission_outcomes": f"""WITH {_ADMISSION} SELECT workspace_id, upload_id, CASE WHEN prior IS NULL THEN 'accepted' ELSE 'new_version' END AS outcome, source_id, supersedes_id FROM ids WHERE n = 1
UNION ALL SELECT workspace_id, upload_id, 'duplicate', 'src-' || left(sha256(w || chr(10) || checksum), 16), NULL FROM two WHERE NOT fresh UNION ALL SELECT workspace_id, upload_id, refusal, NULL, NULL FROM late WHERE refusal <> ''""",
    "resolved_conflicts": """WITH RECURSIVE log AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'click' THEN 'confirm' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'choose_current' WHEN 'signup' THEN 'keep_both' ELSE CASE WHEN event_id % 3 = 0 THEN 'keep_open' ELSE 'edit' END END AS a FROM events),
touched AS (SELECT id, seq, a, true AS own FROM log WHERE a IN ('confirm', 'reject', 'edit') OR id % 7 > 0 UNION ALL SELECT id + k, seq, a, false FROM log, (SELECT unnest([1, 2]) AS k) WHERE id % 7 > 0 AND a IN ('choose_current', 'keep_both')),
steps AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM touched WHERE id IN (SELECT id FROM log)),
walk AS (SELECT DISTINCT id, 0::BIGINT AS k, 'requires_review' AS status, true AS current FROM log UNION ALL
SELECT w.id, s.k, CASE a WHEN 'choose_current' THEN CASE WHEN own THEN 'confirmed' ELSE 'superseded' END WHEN 'keep_both' THEN 'confirmed' WHEN 'keep_open' THEN 'conflicted' ELSE CASE WHEN NOT w.current THEN w.status WHEN a = 'confirm' THEN 'confirmed' WHEN a = 'reject' THEN 'rejected' ELSE 'superseded' END END,
  CASE a WHEN 'choose_current' THEN own WHEN 'keep_both' THEN true WHEN 'keep_open' THEN w.current ELSE w.current AND a = 'confirm' END FROM walk w JOIN steps s ON s.id = w.id AND s.k = w.k + 1)
SELECT id, status, current FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1""",
    "answer_faults": """SELECT event_id, CASE WHEN n % 5 = 3 THEN 'no_object' WHEN n % 19 = 0 THEN 'evidence_id_missing' WHEN n % 31 = 0 THEN 'schema_unknown_field' WHEN n % 17 = 0 THEN 'unknown_type'
WHEN n % 13 = 0 OR n % 23 = 0 OR n % 29 = 0 THEN 'schema_field' WHEN n % 3 = 0 THEN 'evidence_id_unknown' ELSE '' END AS fault FROM (SELECT event_id, event_id AS n FROM events)""",
    "fragment_metadata": """SELECT doc_id, CASE WHEN n_chars % 3 <> 1 THEN '[' || source || ']' END AS actor_ref, CASE n_chars % 3 WHEN 0 THEN 'до 5 марта 2026 года' WHEN 1 THEN 'к концу месяца' END AS deadline,
CASE WHEN n_chars % 3 = 0 THEN lang END AS status, CASE WHEN n_chars % 3 = 1 THEN lang END AS priority FROM documents""",
    "project_records": f"WITH {_PROJECTS} SELECT * EXCLUDE (marked) FROM records",
    "project_corpus": f"WITH {_PROJECTS} SELECT * FROM corpus WHERE place IS NOT NULL",
    "source_sections": f"""WITH {_PROJECTS} SELECT project, path, doc_id::VARCHAR AS heading, greatest(1, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END) AS line_end, scope,
sha256('# ' || doc_id || chr(10) || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS sha256 FROM corpus JOIN files USING (project, path) WHERE place = 6 AND regexp_matches(text, '\\S')""",
    "inherited_sections": f"WITH {_PROJECTS} SELECT DISTINCT r.group_code, project, source || '.md' AS path, 'group' AS scope FROM records r JOIN documents d ON d.lang = r.group_code WHERE inherits AND group_title <> '' AND status <> 'archived'",
    "document_slugs": r"""SELECT doc_id, replace(trim(regexp_replace(replace(replace(lower(coalesce(split_part(text, chr(10), 1), '')), 'ё', 'е'), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ', '-') AS slug FROM documents""",
    "dictionary_findings": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_-]+') AS w FROM documents),
n AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('les', 'und', 'with', 'license'))) AS n, len(list_filter(w, lambda x: x = 'license')) AS m FROM w) SELECT doc_id, CASE WHEN n > 0 THEN 'requires_review' ELSE 'ready_for_review' END AS status, n AS n_findings, m AS n_names FROM n""",
}
