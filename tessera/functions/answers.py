"""Answers of models as JSON: lenient readers and the contract of candidates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import once

# Types and confidences of candidates, their fields, and bounds.
TYPES, CONFIDENCES = ("requirement", "decision", "risk", "open_question", "action"), ("low", "medium", "high")
REQUIRED = ("type", "title", "statement", "evidence_id", "confidence", "requires_review")
OPTIONAL = ("reason", "consequence", "actor_ref", "deadline", "status", "priority")
EXTRA = ("relations", "material_evidence_ids", "material_evidence_modalities", "oc_subject")
MODALITIES = ("text", "image", "table")
TITLE, STATEMENT, LISTED, ENTRY = 160, 1200, 8, 160


def _valid(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else: as the only element of a list, since what follows a value alone is passed over."""
    listed = F.concat(F.lit("["), text, F.lit("]"))
    return F.coalesce(F.try_parse_json(listed).isNotNull() & (F.size(F.from_json(listed, "array<string>")) == 1), F.lit(False))


def _object(text: Column) -> Column:
    """A text if it is a JSON object, else null."""
    return F.when(_valid(text) & F.json_object_keys(text).isNotNull(), text)


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def fenced_object(answer: Column) -> Column:
    """The JSON object of an answer: all of it without a code fence, else what stands between its first and last brace; null if neither is one.

    An answer that is JSON but no object has none. An object that repeats a key
    isn't one; a null answer has none.
    """
    stripped = _trim(answer)
    bare = F.when(F.startswith(stripped, F.lit("```")), _trim(F.regexp_replace(F.regexp_replace(stripped, r"\A```(?:json)?\s*", ""), r"\s*```\z", ""))).otherwise(stripped)
    return once(bare, lambda b: F.when(_valid(b), _object(b)).otherwise(_object(F.nullif(F.regexp_extract(b, r"(?s)\{.*\}", 0), F.lit("")))))


def braced_object(answer: Column) -> Column:
    """The JSON object from an answer's first opening to its last closing brace, whatever stands around it; null if that isn't one."""
    return once(F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit("")), _object)


def _strings(item: Column, field: str, most: int) -> Column:
    """Whether a field is a list of one to ``most`` different texts that aren't blank or too long."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(item), f"$.{field}", "variant"))
    values = F.from_json(item, f"`{field}` array<string>")[field]
    sound = F.forall(values, lambda v: (_trim(v) != "") & (F.length(v) <= ENTRY))
    return F.coalesce((kind == "ARRAY<STRING>") & F.size(values).between(1, most) & (F.size(F.array_distinct(values)) == F.size(values)) & sound, F.lit(False))


def candidate_fault(item: Column, evidence_ids: Column) -> Column:
    """What a candidate (a JSON text) breaks first, or an empty text.

    In this order: schema_candidate, evidence_id_missing, schema_required_fields,
    schema_unknown_field, unknown_type, schema_field, evidence_id_unknown,
    schema_optional_field, schema_relations, schema_material_evidence,
    schema_material_evidence_modalities.
    """
    def kind(field: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(item), f"$.{field}", "variant")), F.lit(""))

    def said(field: str) -> Column:
        return F.get_json_object(item, f"$.{field}")

    def fault(keys: Column) -> Column:
        has = lambda field: F.array_contains(keys, field)
        text = lambda field, most: (kind(field) == "STRING") & F.length(said(field)).between(1, most)
        fields = text("title", TITLE) & text("statement", STATEMENT) & (kind("confidence") == "STRING") & said("confidence").isin(*CONFIDENCES) & (kind("requires_review") == "BOOLEAN") & (said("requires_review") == "true")
        optional = F.lit(True)
        for field in OPTIONAL:
            optional = optional & (~has(field) | (kind(field) == "STRING"))
        relations = F.from_json(item, "relations array<string>")["relations"]
        sound = kind("relations").isin("ARRAY<STRING>", "ARRAY<VOID>") & (F.size(relations) <= LISTED) & F.forall(relations, lambda v: F.coalesce((_trim(v) != "") & (F.length(v) <= ENTRY), F.lit(False)))
        modalities = F.from_json(item, "material_evidence_modalities array<string>")["material_evidence_modalities"]
        known = has("material_evidence_ids") & _strings(item, "material_evidence_modalities", len(MODALITIES)) & F.forall(modalities, lambda v: v.isin(*MODALITIES))
        return (
            F.when(keys.isNull(), "schema_candidate").when(~has("evidence_id"), "evidence_id_missing")
            .when(F.size(F.array_except(F.lit(list(REQUIRED)), keys)) > 0, "schema_required_fields").when(F.size(F.array_except(keys, F.lit([*REQUIRED, *OPTIONAL, *EXTRA]))) > 0, "schema_unknown_field")
            .when(~((kind("type") == "STRING") & said("type").isin(*TYPES)), "unknown_type").when(~F.coalesce(fields, F.lit(False)), "schema_field")
            .when(~F.coalesce((kind("evidence_id") == "STRING") & F.array_contains(evidence_ids, said("evidence_id")), F.lit(False)), "evidence_id_unknown").when(~optional, "schema_optional_field")
            .when(has("relations") & ~F.coalesce(sound, F.lit(False)), "schema_relations").when(has("material_evidence_ids") & ~_strings(item, "material_evidence_ids", LISTED), "schema_material_evidence")
            .when(has("material_evidence_modalities") & ~F.coalesce(known, F.lit(False)), "schema_material_evidence_modalities").otherwise("")
        )

    return once(F.json_object_keys(item), fault)


def answer_fault(answer: Column, evidence_ids: Column, most: int = 16, length: int = 20_000) -> Column:
    """What an answer (a JSON text) breaks first: schema_top_level, schema_candidates, result_too_large, or the first fault of its candidates in order; else empty."""
    items = F.from_json(answer, "candidates array<string>")["candidates"]
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(answer), "$.candidates", "variant")), F.lit(""))
    first = F.coalesce(F.get(F.filter(F.transform(items, lambda i: candidate_fault(i, evidence_ids)), lambda f: f != ""), F.lit(0)), F.lit(""))
    top = F.coalesce(F.json_object_keys(answer) == F.array(F.lit("candidates")), F.lit(False)) & _valid(answer)
    return F.when(~top, "schema_top_level").when(~F.startswith(kind, F.lit("ARRAY<")) | (F.size(items) > most), "schema_candidates").when(F.length(answer) > length, "result_too_large").otherwise(first)
