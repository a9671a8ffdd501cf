"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.collocations import collocations
from tessera.llm.decontaminate import contamination
from tessera.llm.html_extract import main_text
from tessera.llm.langid import identify
from tessera.llm.lexical import search
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.pii import find_personal_data
from tessera.llm.quality import judge
from tessera.llm.scratch import Scratch
from tessera.llm.token_counts import TokenLedger, count_tokens
from tessera.llm.token_files import read_ids, write_ids
from tessera.llm.warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals after four batches over all documents and one that comes again.

    All documents come in; then those of one source in the languages that a
    second model labels anew are revised; exact later copies are deleted; and the
    revision is sent a second time.
    """
    docs = _table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "token-counts")
    counts = scratch.save(count_tokens(docs), "counts")
    ledger = TokenLedger(spark, scratch.path("ledger"))
    ledger.apply(1, counts)
    revised = counts.where("source = 'src1'").withColumns({"lang": F.concat("lang", F.lit("-2")), "n_tokens": F.col("n_tokens") + 1})
    ledger.apply(2, revised)
    text = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    first = docs.groupBy(text.alias("digest")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = scratch.save(first.select("digest", "first"), "firsts")
    copies = scratch.save(docs.select("doc_id", text.alias("digest")), "digests").join(first, "digest").where("doc_id <> first")
    ledger.apply(3, copies.select("doc_id", F.lit("word_bpe_49k").alias("tokenizer")), deleted=True)
    ledger.apply(2, revised)
    return ledger.totals()


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages")).drop("payload", "url")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op9_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped", "dropped")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    path = scratch.path("files")
    write_ids(_table(spark, sf_dir, "documents"), path, scratch=scratch)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


ORACLE_SQL = {
    "op2_benchmark_decontamination": r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS s FROM items WHERE len(w) > 0),
places AS (
  SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS pos, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS s
  FROM cut, (SELECT DISTINCT l FROM windows) WHERE len(w) >= l),
found AS (SELECT doc_id, pos, p.l, item_id FROM places p JOIN windows x ON p.s = x.s AND p.l = x.l),
hit AS (SELECT doc_id, count(DISTINCT pos + k) AS n_hit FROM (SELECT doc_id, pos, unnest(range(0, l)) AS k FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY 1)
SELECT c.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cut c LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op7_warc_revisits": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
digits AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1), '' ORDER BY i) AS d
  FROM (SELECT DISTINCT h FROM p), range(32) r(i) GROUP BY h),
latest AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN digits USING (h) JOIN latest USING (h)
""",
    "op10_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, w.doc_id = min(r.b) AS kept
FROM words w JOIN reach r ON r.a = w.doc_id LEFT JOIN sizes z ON z.doc_id = w.doc_id GROUP BY w.doc_id
""",
    "op12_lexical_search": r"""
WITH cut AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT d, doc_id, w, len(w) AS n FROM cut WHERE len(w) > 0),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM docs),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM docs) GROUP BY 1, 2),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, totals GROUP BY t),
scores AS (
  SELECT item_id, d, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM wanted JOIN tf USING (t) JOIN weights USING (t) JOIN docs USING (d), totals GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores JOIN docs USING (d) WHERE score > 0
QUALIFY rank <= 50
""",
    "op13_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
cut AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
f AS (
  SELECT lang, m, phrase, count(*)::BIGINT AS f
  FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS phrase FROM cut, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)
  GROUP BY 1, 2, 3),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
candidates AS (SELECT lang, m, phrase, f AS a FROM f WHERE m > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, a, k, phrase[1:k] AS x, phrase[k + 1:m] AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, a, k, p.f AS l, q.f AS r, ((2000000::HUGEINT * a) // (p.f::HUGEINT + q.f))::BIGINT AS score
  FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = x JOIN f q ON q.lang = c.lang AND q.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, phrase[i:i + s - 1] AS phrase, a FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates))),
held AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY 1, 2),
kept AS (
  SELECT b.lang, array_to_string(b.phrase, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
""",
}
