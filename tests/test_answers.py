"""Lenient JSON readers and the contract of candidates."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from tessera.functions import answers

GOOD = {"type": "risk", "title": "T", "statement": "S", "evidence_id": "E1", "confidence": "low", "requires_review": True}


def fenced_by_loop(text):
    text = (text or "").strip()
    if text.startswith("```"):
        text = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text)).strip()
    try:
        found = json.loads(text)
    except ValueError:
        try:
            found = json.loads(re.search(r"(?s)\{.*\}", text)[0])
        except (ValueError, TypeError):
            return None
    return found if isinstance(found, dict) else None


def test_readers(spark):
    said = ['{"a": 1}', ' \n{"a": [1, {"b": "}"}]} ', '```json\n{"a": 1}\n```', "```\n{\"a\": 1}\n``` ", 'Here: {"a": 1} done', '{"a": 1} and {"b": 2}', "[1, 2]", '"text"', "no", "", None, "{", '{"a": }', 'x {"é": "中"} y', "{}", "null", '[{"a": 1}]', "```json\n[1]\n```", 'pre ```json\n{"a": 1}\n``` post']
    df = spark.createDataFrame([(t,) for t in said], "t string")
    load = lambda x: None if x is None else json.loads(x)
    got = df.select(answers.fenced_object(F.col("t")).alias("f"), answers.braced_object(F.col("t")).alias("b")).collect()
    assert [load(r["f"]) for r in got] == [fenced_by_loop(t) for t in said]
    want = [re.search(r"(?s)\{.*\}", t or "") for t in said]
    for r, m in zip(got, want, strict=True):
        try:
            assert load(r["b"]) == (json.loads(m[0]) if m else None)
        except ValueError:
            assert r["b"] is None


def test_candidates(spark):
    without = lambda *keys: {k: v for k, v in GOOD.items() if k not in keys}
    cases = [
        (GOOD, ""), (GOOD | {"relations": [], "deadline": "d", "material_evidence_ids": ["a", "b"], "material_evidence_modalities": ["text"], "oc_subject": {"x": 1}}, ""), (GOOD | {"relations": ["a", "a"]}, ""),
        ("text", "schema_candidate"), ([1], "schema_candidate"), (without("evidence_id", "title"), "evidence_id_missing"), (without("title") | {"odd": 1}, "schema_required_fields"), (GOOD | {"odd": 1, "type": "x"}, "schema_unknown_field"),
        (GOOD | {"type": "wish", "title": ""}, "unknown_type"), (GOOD | {"type": None}, "unknown_type"), (GOOD | {"type": 5}, "unknown_type"), (GOOD | {"title": ""}, "schema_field"), (GOOD | {"title": "x" * 161}, "schema_field"), (GOOD | {"title": 7}, "schema_field"), (GOOD | {"title": "é" * 160, "statement": "x" * 1200}, ""),
        (GOOD | {"statement": None}, "schema_field"), (GOOD | {"confidence": "sure"}, "schema_field"), (GOOD | {"requires_review": False}, "schema_field"), (GOOD | {"requires_review": "true"}, "schema_field"), (GOOD | {"evidence_id": "E9", "deadline": 1}, "evidence_id_unknown"), (GOOD | {"evidence_id": 1}, "evidence_id_unknown"),
        (GOOD | {"deadline": 1, "relations": 1}, "schema_optional_field"), (GOOD | {"priority": None}, "schema_optional_field"), (GOOD | {"relations": "a"}, "schema_relations"), (GOOD | {"relations": [" "]}, "schema_relations"), (GOOD | {"relations": ["a"] * 9}, "schema_relations"), (GOOD | {"relations": ["a", 1]}, "schema_relations"),
        (GOOD | {"material_evidence_ids": []}, "schema_material_evidence"), (GOOD | {"material_evidence_ids": ["a", "a"]}, "schema_material_evidence"), (GOOD | {"material_evidence_ids": ["x" * 161]}, "schema_material_evidence"),
        (GOOD | {"material_evidence_modalities": ["text"]}, "schema_material_evidence_modalities"), (GOOD | {"material_evidence_ids": ["a"], "material_evidence_modalities": ["sound"]}, "schema_material_evidence_modalities"),
    ]
    df = spark.createDataFrame([(json.dumps(c, ensure_ascii=False), w) for c, w in cases], "item string, want string")
    for r in df.select("*", answers.candidate_fault(F.col("item"), F.array(F.lit("E1"))).alias("got")).collect():
        assert r["got"] == r["want"], r["item"][:200]


def test_answers(spark):
    whole = lambda *items: json.dumps({"candidates": list(items)})
    cases = [
        (whole(), ""), (whole(GOOD, GOOD), ""), (whole(GOOD, GOOD | {"type": "x"}, "y"), "unknown_type"), (whole(*[GOOD] * 17), "schema_candidates"), (whole(GOOD | {"statement": "x" * 1000}, *[GOOD | {"statement": "y" * 1100}] * 15), ""),
        ("[]", "schema_top_level"), ("", "schema_top_level"), (None, "schema_top_level"), ('{"candidates": [], "more": 1}', "schema_top_level"), ('{"candidates": {}}', "schema_candidates"), ('{"candidates": null}', "schema_candidates"), ('{"candidates": [}', "schema_top_level"), (whole(3), "schema_candidate"),
    ]
    df = spark.createDataFrame(cases, "answer string, want string")
    for r in df.select("*", answers.answer_fault(F.col("answer"), F.array(F.lit("E1"))).alias("got")).collect():
        assert r["got"] == r["want"], (r["answer"] or "")[:200]
    long = df.limit(2).select(answers.answer_fault(F.col("answer"), F.array(F.lit("E1")), length=30).alias("got")).collect()
    assert [r["got"] for r in long] == ["", "result_too_large"]
