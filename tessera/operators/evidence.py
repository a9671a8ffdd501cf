"""Evidence for statements: fragments that support them, and candidates that evidence must cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms that a statement and a fragment share at least, if neither holds the other.
SHARED = 3
#: Rows of one key that a block holds of either side.
SALT = 1_000
#: Kinds of evidence that can confirm a candidate.
MODALITIES = ("text", "image", "table")


def terms(text: Column) -> Column:
    """The distinct words of three letters or digits and more, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-zА-Яа-яЁё0-9]{3,}"), F.lit(0)), F.lower))


def _blocks(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides (keys..., id, ...) shuffled by key and block (_l, _r), so that two rows of a key stand in one block together.

    Keys of up to ``SALT`` rows a side are one block. Of a larger one, blocks hold
    about that many of either side, and a row is in one for each part of the
    other side; only the sizes of such keys are broadcast.
    """
    sizes = left.groupBy(*keys).agg(F.count("*").alias("_nl")).join(right.groupBy(*keys).agg(F.count("*").alias("_nr")), keys).where((F.col("_nl") > SALT) | (F.col("_nr") > SALT))
    sizes = F.broadcast(sizes.select(*keys, (F.floor(F.col("_nl") / SALT) + 1).alias("_nl"), (F.floor(F.col("_nr") / SALT) + 1).alias("_nr")))
    one = F.lit(1).cast("long")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        out = rows.join(sizes, keys, "left").withColumn(own, F.pmod(F.xxhash64("id"), F.coalesce(f"_n{own[1]}", one)))
        return out.withColumn(other, F.explode(F.sequence(one - 1, F.coalesce(f"_n{other[1]}", one) - 1))).drop("_nl", "_nr").repartition(*keys, "_l", "_r")

    return dealt(left, "_l", "_r"), dealt(right, "_r", "_l")


def _shares(left: str, right: str) -> Column:
    """Whether two arrays of distinct terms have ``SHARED`` in common."""
    return (F.size(left) >= SHARED) & (F.size(right) >= SHARED) & (F.size(F.array_intersect(left, right)) >= SHARED)


def sharing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., left_id, right_id): rows (keys..., id, terms array) of either side with ``SHARED`` terms in common.

    The rows of a key are compared within the join, block by block: no more than
    the rows themselves are shuffled, however many terms they share. ids are
    distinct within keys.
    """
    left, right = _blocks(left.select(*keys, "id", "terms"), right.select(*keys, "id", "terms"), keys)
    left, right = left.withColumnsRenamed({"id": "left_id", "terms": "_left"}), right.withColumnsRenamed({"id": "right_id", "terms": "_right"})
    return left.join(right, [*keys, "_l", "_r"]).where(_shares("_left", "_right")).select(*keys, "left_id", "right_id")


def supporting_evidence(contexts: DataFrame, evidence: DataFrame, key: str = "extraction_id") -> DataFrame:
    """(key, context_id, evidence_id, support) of contexts (key, context_id, text, explicit array) and evidence (key, evidence_id, state, text).

    A context that names evidence is supported by what it names
    (``explicit_reference``); any other by the fragments of its key that hold its
    text (``exact_fragment``) or share three terms with it (``shared_terms``). Only
    ready evidence supports; null texts support nothing by their words. ids are
    distinct within a key.
    """
    ready = evidence.where("state = 'ready'").select(key, "evidence_id", F.regexp_replace("text", r"\A\s+|\s+\z", "").alias("text"))
    named = contexts.where(F.size("explicit") > 0).select(key, "context_id", F.explode(F.array_distinct("explicit")).alias("evidence_id"))
    explicit = named.join(ready.select(key, "evidence_id"), [key, "evidence_id"]).select(key, "context_id", "evidence_id", F.lit("explicit_reference").alias("support"))
    others = contexts.where(F.coalesce(F.size("explicit"), F.lit(0)) <= 0).where("text is not null").select(key, F.col("context_id").alias("id"), "text")
    texts = ready.where("text is not null").select(key, F.col("evidence_id").alias("id"), "text")
    # Only texts are shuffled; their terms are found where they are compared.
    said, held = _blocks(others, texts, [key])
    said = said.select(key, "_l", "_r", F.col("id").alias("context_id"), F.col("text").alias("_said"), terms(F.col("text")).alias("_left"))
    held = held.select(key, "_l", "_r", F.col("id").alias("evidence_id"), F.col("text").alias("_held"), terms(F.col("text")).alias("_right"))
    exact = (F.col("_said") != "") & F.contains("_held", "_said")
    found = said.join(held, [key, "_l", "_r"]).where(exact | _shares("_left", "_right"))
    # "exact_fragment" stands before "shared_terms" in the alphabet, too.
    found = found.select(key, "context_id", "evidence_id", F.when(exact, "exact_fragment").otherwise("shared_terms").alias("support")).groupBy(key, "context_id", "evidence_id").agg(F.min("support").alias("support"))
    return explicit.unionByName(found)


def fragment(text: Column) -> Column:
    """A fragment as it stands in a cleaned text: its lines trimmed, blank ones left out, joined by spaces."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda s: F.regexp_replace(s, r"\A\s+|\s+\z", ""))
    return F.array_join(F.filter(lines, lambda s: s != ""), " ")


def grounded_candidates(candidates: DataFrame, evidence: DataFrame, bodies: DataFrame, key: str = "sanitized_id") -> DataFrame:
    """(key, candidate_id, outcome, blocks) of candidates (key, candidate_id, evidence_ids array, required array).

    evidence: (key, evidence_id, state, modality, text); bodies: (key, body). Every
    piece that a candidate names must be known (else ``unknown``), ready and of a
    kind that can confirm (``unsupported``), and stand literally in the body
    (``unavailable``); the first that fails decides. Together they must be of all
    required modalities (``modality``). blocks: (evidence_id, modality, start, end)
    in the candidate's order, offsets of the first occurrence in code points, half
    open; empty unless ``grounded``. A candidate that names none is ``unbacked``.
    Places are found once for each piece, whoever names it.
    """
    pieces = evidence.dropDuplicates([key, "evidence_id"]).withColumn("_fragment", fragment(F.col("text")))
    usable = (F.col("state") == "ready") & F.col("modality").isin(*MODALITIES)
    at = F.when(F.col("_fragment") == "", 0).otherwise(F.coalesce(F.expr("locate(_fragment, body)"), F.lit(0)))
    placed = pieces.join(bodies.select(key, "body"), key, "left").select(key, "evidence_id", "modality", F.coalesce(usable, F.lit(False)).alias("_usable"), at.alias("_at"), F.length("_fragment").alias("_n"))
    named = candidates.select(key, "candidate_id", F.posexplode("evidence_ids").alias("_nth", "evidence_id"))
    met = named.join(placed, [key, "evidence_id"], "left")
    wrong = F.when(F.col("_usable").isNull(), "unknown").when(~F.col("_usable"), "unsupported").when(F.col("_at") == 0, "unavailable")
    block = F.struct("_nth", "evidence_id", "modality", (F.col("_at") - 1).alias("start"), (F.col("_at") - 1 + F.col("_n")).alias("end"))
    each = met.groupBy(key, "candidate_id").agg(F.min(F.when(wrong.isNotNull(), F.struct("_nth", wrong.alias("why")))).alias("_wrong"), F.array_sort(F.collect_list(block)).alias("_blocks"))
    out = candidates.select(key, "candidate_id", F.coalesce("required", F.array().cast("array<string>")).alias("_required")).join(each, [key, "candidate_id"], "left")
    missing = F.size(F.array_except("_required", F.coalesce(F.transform("_blocks", lambda b: b["modality"]), F.array().cast("array<string>")))) > 0
    outcome = F.when(F.col("_blocks").isNull(), "unbacked").when(F.col("_wrong").isNotNull(), F.col("_wrong.why")).when(missing, "modality").otherwise("grounded")
    out = out.withColumn("outcome", outcome)
    blocks = F.when(F.col("outcome") == "grounded", F.transform("_blocks", lambda b: F.struct(b["evidence_id"], b["modality"], b["start"], b["end"])))
    return out.select(key, "candidate_id", "outcome", F.coalesce(blocks, F.array().cast("array<struct<evidence_id:string,modality:string,start:int,end:int>>")).alias("blocks"))


def ground_spans(candidates: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, index, candidate_id, outcome, type, start, end) of candidates (key, index, candidate_id, evidence_id, type) that name a span of their chunk.

    chunks: as ``evidence_spans`` gives them. The section's type, where it has
    one, takes the place of the candidate's; an unknown span is ``evidence_id_unknown``.
    """
    spans = chunks.select(key, "index", "type_hint", F.explode("spans").alias("_s"))
    spans = spans.select(key, "index", "type_hint", F.col("_s.id").alias("evidence_id"), F.col("_s.global_start").alias("start"), F.col("_s.global_end").alias("end")).distinct()
    out = candidates.join(spans, [key, "index", "evidence_id"], "left")
    known = F.col("start").isNotNull()
    return out.select(key, "index", "candidate_id", F.when(known, "grounded").otherwise("evidence_id_unknown").alias("outcome"), F.when(known, F.coalesce("type_hint", "type")).alias("type"), "start", "end")


# How a fragment names who answers for something, a date, a state and a priority.
ACTOR, DUTY = r"\[[^\]\n]{1,120}\]", r"(?iU)(?:ответственн\w*|владельц\w*|назнач\w*|долж\w*)"
NOBODY = r"(?iU)ответственн\w*(?:\s+\[[^\]\n]+\])?\s+(?:пока\s+)?не\s+(?:назначен|определ[её]н)"
CALENDAR = r"(?iU)\bдо\s+\d{1,2}\s+[а-яё]+\s+\d{4}\s+года\b|\bназначен\w*\s+на\s+\d{1,2}\s+[а-яё]+\s+\d{4}\s+года\b"
SPOKEN = (
    r"(?iU)\b(?:до\s+конца|к\s+концу)\s+(?:января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря|недели|месяца|квартала|года)\b"
    r"|\bк\s+следующей\s+встрече\b"
    r"|\bв\s+течение\s+(?:\d+|[а-яё]+)\s+(?:рабоч\w*\s+)?(?:дн\w*|день)\b"
    r"|\bза\s+(?:\d+|[а-яё]+)\s+(?:рабоч\w*\s+)?(?:дн\w*|день)\s+до\s+[^\n.,;:!?]{1,120}(?=[\n.,;:!?]|$)"
    r"|\bдо\s+старта\s+[^\n.,;:!?]{1,120}(?=[\n.,;:!?]|$)"
)
NOT_SET = r"(?iU)\bне\s+назначен\w*\s+на\s+\d{1,2}\s+[а-яё]+\s+\d{4}\s+года\b"
STATUS, PRIORITY = r"(?iU)\bСтатус:\s*([^\n.;]+)", r"(?iU)\bПриоритет:\s*([^\n.;]+)"


def metadata(text: Column) -> Column:
    """What a fragment itself says: struct (actor_ref, deadline, status, priority), each null if it doesn't.

    A name in brackets counts where the fragment speaks of a duty and not of
    nobody having it; a calendar date goes before a spoken one, and neither counts
    where a date is said not to be set. A null text says nothing.
    """
    text = F.coalesce(text, F.lit(""))
    first = lambda pattern, group=0: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    trimmed = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    actor = F.when(text.rlike(DUTY) & ~text.rlike(NOBODY), first(ACTOR))
    deadline = F.when(~text.rlike(NOT_SET), F.coalesce(first(CALENDAR), first(SPOKEN)))
    return F.struct(actor.alias("actor_ref"), deadline.alias("deadline"), trimmed(first(STATUS, 1)).alias("status"), trimmed(first(PRIORITY, 1)).alias("priority"))
