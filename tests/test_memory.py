"""The whole selection from memory against a plain loop, and the points of sections."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import SYNONYMS, expand_terms, tokenize, words_for
from tessera.operators import memory

SECTION = "project string, section_id string, path string, heading string, line_start int, text string"


def points(spark, terms, path, heading, text):
    return memory.with_scores(spark.createDataFrame([("p", "a", path, heading, 1, text)], SECTION), set(terms)).first()["score"]


def test_points_of_kinds_and_intents(spark):
    both = ["персональн", "хранение"]
    assert memory.intents(set(both)) == {"privacy_storage", "architecture"} and memory.intents({"поле", "бф"}) == set() and memory.intents({"поле", "бф", "до", "статус"}) == {"field_mapping", "status"}
    assert points(spark, ["alpha"], "x/a.md", "Alpha", "beta") == 4 and points(spark, ["alpha"], "x/a.md", "Graph Links ", "alpha") == 0 and points(spark, ["zeta"], "40_Risks/a.md", "Alpha", "beta") == 0
    assert points(spark, ["alpha"], "50_Sources/a.md", "Alpha", "") == 1 + 3 + 22 and points(spark, ["alpha"], "50_Sources/a.md", "Beta", "alpha") == 11 and points(spark, ["alpha"], "50_Sources/a.md", "Карта источников", "alpha") == 1
    assert points(spark, ["alpha"], "10_Branches/a.md", "b", "alpha") == 6 and points(spark, ["alpha"], "Исходники/a.md", "b", "alpha") == 7
    assert points(spark, both, "Исходники/Паспорт.md", "b", "хранение") == 1 + 24 and points(spark, both, "20_Decisions/a.md", "b", "хранение") == 1 + 4 + 8 and points(spark, both, "x/a.md", "Отчет по переписке", "хранение") == 1
    fields = ["поле", "бф", "до"]
    said = "БФ и ДО: поле БФ, источник в ДО"
    assert points(spark, fields, "x/a.md", "b", "БФ ДО поле") - points(spark, ["поле"], "x/a.md", "b", "БФ ДО поле") == 2 + 24
    assert points(spark, fields, "x/a.md", "b", said) - points(spark, fields, "x/a.md", "b", "БФ ДО поле") == 18
    assert points(spark, fields, "x/статус.md", "b", said) == points(spark, fields, "x/a.md", "b", said) - 18 == points(spark, [*fields, "статус"], "x/статус.md", "b", said) - 18 - 1


def test_coverage(spark):
    df = memory.with_scores(spark.createDataFrame([("p", "a", "x/a.md", "alpha beta", 1, "mvp2 gamma")], SECTION), {"alpha"})
    met = lambda *terms: df.select(memory.covers(set(terms))).first()[0]
    assert not met() and met("alpha", "zeta") and not met("zeta") and not met("alpha", "x1", "x2") and met("alpha", "beta", "x1") and met("mvp2", "x1", "x2")


def by_loop(rows, base, rewrite, context, max_chars, most):
    """rows: (project, section_id, path, heading, line_start, text, tokens, score, authority)."""
    terms, out = base | rewrite | context, []

    def covers(tokens, wanted):
        met = tokens & wanted
        return bool(wanted) and (bool(met) if len(wanted) <= 2 else len(met) >= 2)

    for project in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == project]
        key = lambda x: (-(x[0] + x[1][8] // 4), -x[1][8], x[1][4], x[1][2], x[1][1])
        if base | rewrite:
            direct = sorted([(r[7], r) for r in mine if r[7] > 0 and (covers(r[6], base) or covers(r[6], rewrite))], key=key)
            if not direct:
                continue
            titles = {t.split("]]")[0].split("|")[0].split("#")[0].strip().lower() for _, r in direct[:3] for t in r[5].split("[[")[1:]} - {""}
            best = {r[1]: s for s, r in direct}
            for r in mine:
                linked = any(t in r[3].lower() or t in r[2].split("/")[-1].split(".")[0].lower() for t in titles)
                if linked or r[2].split("/")[0] in ("10_Branches", "20_Decisions", "30_Open_Questions", "40_Risks") and r[7] > 0:
                    best[r[1]] = max(best.get(r[1], 0), max(r[7], 8) if linked else r[7])
            ranked = sorted([(best[r[1]], r) for r in mine if r[1] in best], key=key)
        else:
            ranked = sorted([(r[7], r) for r in mine if r[7] > 0], key=lambda x: (-x[0], x[1][4], x[1][2], x[1][1]))
        core = sorted([(2 * (r[2].startswith("00_Core/")) + 4 * ("индекс памяти" in r[3].lower()), r) for r in mine], key=lambda x: (-x[0], x[1][4], x[1][2], x[1][1]))
        taken, used = [], 0
        for score, r in ranked + [c for c in core if c[0] > 0][: min(2, most)]:
            if score <= 0 or r[1] in taken or len(taken) >= most or used >= max_chars or taken and used + len(r[5]) > max_chars:
                continue
            taken.append(r[1])
            used += len(r[5])
            out.append((project, len(taken), r[1], score, len(r[5])))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_selection_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "[[note]]", "[[ Zeta |x]]"]
    folders = ["10_Branches", "40_Risks", "50_Sources", "Исходники", "00_Core", "x", "20_Decisions"]
    rows = [(f"p{i % 3}", f"s{i}", f"{rng.choice(folders)}/n{i % 9}.md", rng.choice(["Note", "Zeta", "Индекс памяти", "Other alpha"]), rng.randrange(9), " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(45)]
    df = spark.createDataFrame(rows, SECTION)
    base, rewrite, context = [({"alpha"}, set(), set()), ({"beta", "gamma", "delta"}, {"eps"}, {"zeta"}), (set(), set(), {"gamma"}), ({"nowhere"}, set(), {"alpha"})][seed]
    known = {r["section_id"]: (set(r["tokens"]), r["score"], r["authority"]) for r in memory.with_scores(df, base | rewrite | context).collect()}
    for max_chars, most in ((120, 5), (10_000, 8)):
        got = sorted(map(tuple, memory.select_memory(df, base, rewrite, context, max_chars, most).collect()))
        assert got == by_loop([(*r, *known[r[1]]) for r in rows], base, rewrite, context, max_chars, most), (max_chars, most)
    assert memory.select_memory(df.limit(0), {"alpha"}).collect() == []


def test_words_for_terms_are_enough(spark):
    """Terms are found among the words that can make them as among all; other words aren't cut."""
    terms = ["les", "бф", "mvp2", "мвп7", "заявк", "договор", "хранение", "персональн", "контур", "для", "12", "c++", "нет", "a1b"]
    rng = random.Random(8)
    words = ["les", "Les", "LES", "files", "les9", "leſ", "бф", "БФ", "БФ1", "mvp2", "МВП2", "mvp7", "mvp22", "заявками", "Заявкой", "заявка", "договоры", "договорить", "Договоров", "сохранить", "персональному", "контурный", "подконтурный", "систему", "пдн", "для", "12", "c++", "a1b", "ёлка", "_les_", "нет", "é"]
    texts = [rng.choice([" ", "-", "_", ""]).join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(300)] + words + [g for _, group in SYNONYMS for g in group] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for some in (terms, terms[:1], ["c++", "a"], []):
        wanted = F.array(*map(F.lit, some)).cast("array<string>")
        whole, few = expand_terms(tokenize(F.col("text"))), words_for(F.col("text"), some)
        for r in df.select("text", F.array_intersect(whole, wanted).alias("a"), F.array_intersect(expand_terms(tokenize(few)), wanted).alias("b")).collect():
            assert r["a"] == r["b"], (r["text"], some)
    assert df.select(words_for(F.lit("a long text of files, les and LES"), ["les"])).first()[0] == "les LES"
    assert memory.with_scores(spark.createDataFrame([("p", "a", "x/a.md", "alpha beta", 1, "mvp2 gamma")], SECTION), {"alpha"}, whole=False).first()["tokens"] == ["alpha"]
