"""Memory, chunks, evidence and packages: against brute force, with nulls, repeated rows, ties and empty tables."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tessera.jobs import knowledge, knowledge_sql
from tessera.operators import chunks, containment, evidence, memory, packages


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("piece", [1, 3, 6])
def test_contained_equals_comparing_all(spark, piece):
    rng = random.Random(piece)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    needles = [(rng.choice("xy"), word(rng.randint(0, 9))) for _ in range(60)] + [("x", None), (None, "a"), ("x", "a" * 40), ("x", "é中")]
    texts = [(rng.choice("xy"), i // 2, word(rng.randint(0, 60))) for i in range(60)] + [("x", 7, None), (None, 8, "abc"), ("x", 90, "a" * 39), ("x", 91, "zé中z")]
    got = containment.contained(spark.createDataFrame(needles, "k string, needle string"), spark.createDataFrame([(*t, 1) for t in texts], "k string, id int, text string, n int"), ["k"], piece)
    want = {(k, n, i) for k, n in needles for q, i, t in texts if k and k == q and n and t is not None and n in t}
    assert rows(got, "k", "needle", "id") == sorted(want, key=repr) and want


def test_containment_of_nothing(spark):
    none = spark.createDataFrame([], "needle string")
    texts = spark.createDataFrame([(1, "a")], "id int, text string")
    assert containment.contained(none, texts).collect() == [] and containment.contained(spark.createDataFrame([("a",)], "needle string"), texts.limit(0)).collect() == []


def test_unindexed_sources(spark):
    sources = [(1, ["abc", "nowhere"]), (2, ["nope"]), (3, []), (4, None), (2, ["lmn"]), (None, ["gone"]), (5, ["nope2", None, ""])]
    texts = [(1, "xx abc"), (1, "klmno"), (2, None)]
    got = containment.unindexed(spark.createDataFrame(sources, "source_id int, needles array<string>"), spark.createDataFrame(texts, "id int, text string"))
    assert rows(got, "source_id") == [(3,), (4,), (5,), (None,)]


def test_authority_order(spark):
    paths = [("Исходники/Паспорт системы.md", "x", 50), ("00_Core/a.md", "x", 42), ("p/a.md", "Архитектурные решения", 42), ("50_Sources/a.md", "x", 36), ("50_Sources/a.md", "Карта источников", 16), ("40_Risks/a.md", "x", 28), ("Транскрипции/a.md", "x", 24), ("p/Журнал.md", "x", 10), ("p/Источники.md", "x", 18), ("p/a.md", "x", 16)]
    got = spark.createDataFrame(paths, "path string, heading string, want int").select(memory.authority(F.col("path"), F.col("heading")).alias("a"), "want").collect()
    assert all(r["a"] == r["want"] for r in got)


SECTIONS = "project string, section_id string, path string, heading string, line_start int, score int, authority int, primary boolean, matches int, text string"


def test_related_sections(spark):
    all_ = [
        ("p", "a", "x/a.md", "Start", 1, 30, 16, False, 3, "see [[ Risk log ]] and [[b#part]] [[|]]"), ("p", "b", "x/b.md", "Nothing", 1, 0, 16, False, 0, ""), ("p", "c", "x/c.md", "The RISK LOG of it", 1, 9, 16, False, 0, ""),
        ("p", "d", "40_Risks/q.md", "Other", 1, 2, 28, False, 1, ""), ("p", "e", "40_Risks/z.md", "Other", 1, 0, 28, False, 0, ""), ("q", "f", "x/b.md", "Risk log", 1, 1, 16, False, 1, "[[x]]"), ("p", "g", "x/g.md", "Late", 9, 1, 16, False, 3, "[[Other]]"),
    ]
    df = spark.createDataFrame(all_, SECTIONS)
    got = memory.related_sections(df.drop("text"), df.where("section_id in ('a', 'f')"), 1)
    assert rows(got, "project", "section_id", "score", "linked") == [("p", "b", 8, True), ("p", "c", 9, True), ("p", "d", 2, False)]
    assert rows(memory.merged(df, got), "section_id", "score") == [("a", 30), ("b", 8), ("c", 9), ("d", 2), ("e", 0), ("f", 1), ("g", 1)]


def plan(spark, all_, selected):
    df = spark.createDataFrame([(p, i, path, "h", n, s, a, "Исходники" in path, m, f"text {i}") for p, i, path, n, s, a, m in all_], SECTIONS)
    chosen = spark.createDataFrame(selected, "project string, section_id string, rank int")
    projects = spark.createDataFrame([(p,) for p in "pqr"], "project string")
    out = memory.evidence_plan(projects, df, chosen, F.col("matches") >= 2, ["text"])
    return [tuple(r) for r in out.orderBy("project", "nth").select("project", "nth", "status", "reason", "section_id").collect()]


def test_evidence_falls_back_tier_by_tier(spark):
    all_ = [
        ("p", "a", "Исходники/1.md", 5, 9, 24, 2), ("p", "b", "Исходники/1.md", 2, 9, 24, 2), ("p", "c", "Исходники/2.md", 1, 30, 24, 2), ("p", "d", "Исходники/1.md", 1, 50, 24, 3), ("p", "e", "50_Sources/s.md", 1, 9, 36, 0), ("p", "f", "Исходники/3.md", 1, 40, 24, 1),
        ("q", "g", "x/g.md", 1, 1, 16, 2), ("q", "h", "x/h.md", 1, 1, 16, 2), ("r", "i", "Исходники/9.md", 1, 1, 24, 5),
    ]
    got = plan(spark, all_, [("p", "a", 1), ("p", "b", 2), ("p", "e", 3), ("q", "h", 1), ("q", "g", 2)])
    # Of the path of a and b the earlier line counts, and none of that path is found again; c was not selected; then the summary.
    assert got == [("p", 1, "confirmed", "selected_primary", "b"), ("p", 2, "confirmed", "found_primary", "c"), ("p", 3, "partial", "source_summary", "e"), ("q", 1, "partial", "memory_only", "h"), ("r", 1, "missing", "nothing_selected", "")]


TEXT = "# Head\nIntro line. More.\n\nТребования:\n- one\n- two\n  wrapped\n\n## Sub\n\npara one. para two! three?\nx\n\n```\n# no\n```\n\nafter code " + "word " * 30 + ". tail...\n\n ## Решения :  \n\n1. first 2) not\n2. sec"


def test_chunks_are_exact_pieces_of_their_texts(spark):
    docs = [(1, TEXT), (1, TEXT), (1, "other\n\n\n \n\ntwo"), (None, TEXT.replace("\n", "\r\n")), (None, "a"), (3, ""), (4, None), (5, "x" * 5000), (6, "é中😀 " * 60 + "\n\n" + "- ü\n" * 5)]
    df = spark.createDataFrame([(*d, 9, "s") for d in docs], "doc_id long, text string, start int, stack string")
    got = chunks.context_chunks(df, 60).collect()
    assert all(any(t is not None and t[r["start"] : r["end"]] == r["text"] for d, t in docs if d == r["doc_id"]) and 0 < len(r["text"]) <= 60 for r in got)
    one = sorted((r for r in got if r["doc_id"] == 1 and r["text"] not in ("other\n\n\n \n\n", "two")), key=lambda r: r["start"])
    assert [r["index"] for r in one[::2]] == [r["index"] for r in one[1::2]] == list(range(len(one) // 2))  # each row of a repeated document
    by = {r["text"].strip(): (r["boundary"], r["heading"], r["stack"], r["type_hint"]) for r in one}
    assert by["- two\n  wrapped"] == ("list_item", "Head", ["Head"], None)  # its own block's first line counts from the next block on
    assert by["para one. para two! three?\nx"] == ("paragraph", "Sub", ["Требования:", "Sub"], "requirement")
    assert by["tail."] == ("sentence", "Sub", ["Требования:", "Sub"], "requirement")
    assert by["2. sec"][1:] == ("Sub", ["Требования:", "Sub"], "requirement") or by["2. sec"][3] == "decision"
    assert {r["text"] for r in got if r["doc_id"] == 5} == {"x" * 60, "x" * 20}
    assert chunks.context_chunks(df.limit(0), 60).collect() == []
    with pytest.raises(ValueError):
        chunks.context_chunks(df, 0)


def test_units_take_linear_time(spark):
    def took(n):
        df = spark.createDataFrame([(1, "a para.\n\n" * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert chunks.context_chunks(df, 100).count() == n
        return time.perf_counter() - began

    took(10)
    assert took(60_000) < 40


def brute_packs(units, limit, most, overlap):
    out, at = [], 0
    while at < len(units):
        past = at + 1
        while past < len(units) and past - at < most and units[past][1] - units[at][0] <= limit:
            past += 1
        out.append((units[at][0], units[past - 1][1], past - at))
        if past == len(units):
            break
        start = past
        while overlap and start - 1 > at and units[start - 1][0] >= units[past - 1][1] - overlap:
            start -= 1
        at = start
    return out


def test_packed_chunks(spark):
    rng = random.Random(2)
    docs = {}
    for d in range(8):
        at, docs[d] = 0, []
        for _ in range(rng.randint(1, 40)):
            at += rng.randint(0, 3)
            end = at + rng.randint(1, 50)
            docs[d].append((at, end))
            at = end
    df = spark.createDataFrame([(d, *u, "t") for d, us in docs.items() for u in us] + [(None, 0, 500, "t")], "doc_id long, start int, end int, text string")
    for limit, most, overlap in ((60, 5, 0), (100, 3, 40), (40, 99, 39), (1000, 1, 10)):
        got = chunks.packed_chunks(df, limit, most, overlap)
        want = [(d, i, *c) for d, us in docs.items() for i, c in enumerate(brute_packs(us, limit, most, overlap))] + [(None, 0, 0, 500, 1)]
        assert rows(got, "doc_id", "chunk", "start", "end", "n_units") == sorted(want, key=repr)
    for bad in ((0, 1, 0), (5, 0, 0), (5, 1, 5), (5, 1, -1)):
        with pytest.raises(ValueError):
            chunks.packed_chunks(df, *bad)


def test_evidence_spans(spark):
    texts = [" - item one. Two!\n  more ", "One. Two! Three?\nfour", "...", "  \n ", "".join(f"S{i}. " for i in range(25)), "no end", "a.b", None]
    df = spark.createDataFrame([(i, 100, t) for i, t in enumerate(texts)], "n int, start int, text string")
    got = {r["n"]: r["spans"] for r in chunks.evidence_spans(df).collect()}
    said = {n: [s["text"] for s in spans] for n, spans in got.items()}
    assert said[0] == ["- item one. Two!\n  more"] and said[1] == ["One.", "Two!", "Three?", "four"] and said[2] == ["..."] and said[3] == [] and said[7] == []
    assert len(said[4]) == 9 and said[4][0] == "S0. S1. S2." and said[4][-1] == "S24." and said[5] == ["no end"] and said[6] == ["a.", "b"]
    for n, spans in got.items():
        for k, s in enumerate(spans):
            assert texts[n][s["start"] : s["end"]] == s["text"] and s["global_start"] == 100 + s["start"] and s["id"] == f"E{k + 1}"


def test_sharing_equals_comparing_all(spark, monkeypatch):
    monkeypatch.setattr(evidence, "SALT", 3)
    rng = random.Random(4)
    make = lambda: list({rng.choice("abcdefghijkl")[0] if rng.random() < 0.8 else f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 9))})
    left, right = [("k", i, make()) for i in range(40)] + [("z", 1, ["a", "b", "c"])], [("k", i, make()) for i in range(50)] + [(None, 9, ["a", "b", "c"])]
    got = evidence.sharing(*(spark.createDataFrame(x, "k string, id int, terms array<string>") for x in (left, right)), ["k"])
    want = sorted(((k, i, j) for k, i, x in left for q, j, y in right if k == q and len(set(x) & set(y)) >= 3), key=repr)
    assert rows(got, "k", "left_id", "right_id") == want and want


def test_supporting_evidence(spark):
    contexts = [("e", "named", "x", ["1", "3", "9", "1"]), ("e", "exact", "b c", []), ("e", "shared", "Alpha beta GAMMA", None), ("e", "two", "alpha beta", []), ("e", "null", None, []), ("e", "empty", "", []), (None, "lost", "alpha beta gamma", [])]
    pieces = [("e", "1", "ready", " a b c d "), ("e", "2", "failed", "alpha beta gamma"), ("e", "3", "ready", "gamma, alpha; beta"), ("e", "4", "ready", None), (None, "5", "ready", "alpha beta gamma"), ("f", "6", "ready", "alpha beta gamma")]
    got = evidence.supporting_evidence(spark.createDataFrame(contexts, "extraction_id string, context_id string, text string, explicit array<string>"), spark.createDataFrame(pieces, "extraction_id string, evidence_id string, state string, text string"))
    assert rows(got, "context_id", "evidence_id", "support") == [("exact", "1", "exact_fragment"), ("named", "1", "explicit_reference"), ("named", "3", "explicit_reference"), ("shared", "3", "shared_terms")]


def test_support_keeps_no_table_beyond_its_input(spark, monkeypatch):
    monkeypatch.setattr(evidence, "SALT", 3)
    kept = []
    for module in (evidence, containment):
        monkeypatch.setattr(module, "saved", lambda df: kept.append(df.count()) or df.persist(), raising=False)
    rng = random.Random(8)
    words = [f"word{i}" for i in range(30)]
    said = [("e", f"c{i}", " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(20)] + [("f", "c", "word1 word2 word3")]
    held = [("e", f"p{i}", " ".join(rng.choices(words, k=12))) for i in range(17)] + [("g", "p", "word1 word2 word3")]
    contexts = spark.createDataFrame([(*r, []) for r in said], "extraction_id string, context_id string, text string, explicit array<string>")
    got = evidence.supporting_evidence(contexts, spark.createDataFrame([(k, i, "ready", t) for k, i, t in held], "extraction_id string, evidence_id string, state string, text string"))
    kind = lambda a, b: "exact_fragment" if a in b else "shared_terms" if len(set(a.split()) & set(b.split())) >= 3 else None
    want = sorted((i, j, kind(a, b)) for k, i, a in said for q, j, b in held if k == q and kind(a, b))
    assert rows(got, "context_id", "evidence_id", "support") == want and {w[2] for w in want} == {"exact_fragment", "shared_terms"}
    assert sum(kept) <= len(said) + len(held)


def test_grounded_candidates(spark):
    bodies = [("s", "one two  three one"), ("t", None)]
    pieces = [("s", "a", "ready", "text", " one \n\n two "), ("s", "b", "ready", "image", "three"), ("s", "c", "failed", "text", "one"), ("s", "d", "ready", "sound", "one"), ("s", "e", "ready", "text", "two three"), ("s", "f", "ready", "text", " \n"), ("s", "g", "ready", "text", None), ("t", "a", "ready", "text", "one")]
    asks = {"1": (["a", "b"], ["text", "image"]), "2": (["a"], ["image"]), "3": (["c", "zz"], []), "4": (["a", "zz"], []), "5": (["d"], []), "6": (["e"], []), "7": (["f"], []), "8": (["g"], []), "9": ([], []), "A": (None, None), "B": (["b", "a", "b"], None)}
    wanted = [("s", c, e, r) for c, (e, r) in asks.items()] + [("t", "C", ["a"], []), ("u", "D", ["a"], [])]
    got = evidence.grounded_candidates(
        spark.createDataFrame(wanted, "sanitized_id string, candidate_id string, evidence_ids array<string>, required array<string>"),
        spark.createDataFrame(pieces, "sanitized_id string, evidence_id string, state string, modality string, text string"), spark.createDataFrame(bodies, "sanitized_id string, body string"),
    )
    outcome = {r["candidate_id"]: r["outcome"] for r in got.collect()}
    blocks = {r["candidate_id"]: [(b["evidence_id"], b["start"], b["end"]) for b in r["blocks"]] for r in got.collect()}
    assert outcome == {"1": "grounded", "2": "modality", "3": "unsupported", "4": "unknown", "5": "unsupported", "6": "unavailable", "7": "unavailable", "8": "unavailable", "9": "unbacked", "A": "unbacked", "B": "grounded", "C": "unavailable", "D": "unknown"}
    assert blocks["1"] == [("a", 0, 7), ("b", 9, 14)] and blocks["B"] == [("b", 9, 14), ("a", 0, 7), ("b", 9, 14)] and not any(blocks[c] for c in "23456789ACD")


def test_spans_ground_candidates(spark):
    docs = spark.createDataFrame([(1, "Риски:\n\nOne. Two."), (1, "Риски:\n\nOne. Two.")], "doc_id long, text string")
    units = chunks.evidence_spans(chunks.context_chunks(docs, 100))
    wanted = spark.createDataFrame([(1, 0, "c", "E2", "fact"), (1, 0, "d", "E3", "fact")], "doc_id long, index int, candidate_id string, evidence_id string, type string")
    assert rows(evidence.ground_spans(wanted, units), "candidate_id", "outcome", "type", "start", "end") == [("c", "grounded", "risk", 13, 17), ("d", "evidence_id_unknown", None, None, None)]


def test_packages_equal_a_plain_loop(spark):
    rng = random.Random(6)
    inputs = [(p, layer, seq, f"{layer}{seq}", rng.choice([0, 1, 5, 20, 60, 101, None]), rng.choice(["standard", "standard", "unknown", "restricted", None])) for p in [1, 2, 3, None] for layer in ("session", "memory", "request", "authority", "ambiguity", "odd") for seq in range(rng.randint(0, 5))]
    df = spark.createDataFrame(inputs, "package_id long, layer string, seq long, ref string, cost long, handling string")
    got, omitted = packages.context_packages(df, 100)
    order = ["request", "authority", "ambiguity", "memory", "session", "odd"]
    want, left = [], []
    for p in [1, 2, 3, None]:
        mine = sorted((r for r in inputs if r[0] == p), key=lambda r: (order.index(r[1]), r[2]))
        used, kept = 0, []
        for r in mine:
            if used + (r[4] or 0) <= 100:
                used += r[4] or 0
                kept.append(r)
        refused = sum(r[4] or 0 for r in mine if r[1] == "request") > 100
        kept, used = ([], 0) if refused else (kept, used)
        worst = max([0, *({"standard": 0, "unknown": 1, "restricted": 2}.get(r[5], 2) for r in mine)])
        if mine:
            want.append((p, "refused" if refused else "composed", used, ["standard", "unknown", "restricted"][worst], len(kept), len(mine) - len(kept), worst == 0))
        left += [(p, r[1], r[3]) for r in mine if r not in kept]
    assert rows(got, "package_id", "status", "used", "handling", "n_included", "n_omitted", "external_allowed") == sorted(want, key=repr)
    assert rows(omitted, "package_id", "layer", "ref") == sorted(left, key=repr)


def test_dialogue_contexts(spark):
    texts = spark.createDataFrame([(1, "x" * 100), (2, None), (3, "y" * 10), (4, "z" * 100)], "package_id long, text string")
    items = spark.createDataFrame([(1, 1, 25), (1, 2, 30), (1, 3, 5), (2, 1, 101), (2, 2, None), (3, 1, 90), (3, 2, 1), (9, 1, 1)], "package_id long, seq int, cost int")
    got = packages.dialogue_contexts(texts, items, 100, 30, 2)
    assert rows(got, "package_id", "memory_chars", "context_chars", "n_selected", "n_included") == [(1, 75, 25, 2, 1), (2, 0, 0, 2, 1), (3, 10, 90, 2, 1), (4, 100, 0, 0, 0)]


def test_metadata_of_fragments(spark):
    import re

    said = [
        "Ответственный [Сотрудник-01] до 5 марта 2026 года. Статус: в работе; Приоритет: высокий.", "Ответственный [A] пока не назначен", "Владельцы: [A] и [B], к концу месяца", "[A] говорит", "не назначена на 3 мая 2026 года", "назначено на 3 мая 2026 года",
        "в течение пяти рабочих дней", "за 3 дня до выпуска версии, потом", "до старта проекта", "СТАТУС:  готово \nдальше", "К следующей встрече [X] должен прийти", "", None, "до 5 марта 2026 годами", "Статус: ;", "ответственна [" + "x" * 121 + "]",
    ]

    def by_loop(t):
        t = t or ""
        find = lambda p: re.search(p.replace("(?iU)", ""), t, re.I)
        actor, deadline = find(evidence.ACTOR), find(evidence.CALENDAR) or find(evidence.SPOKEN)
        status, priority = find(evidence.STATUS), find(evidence.PRIORITY)
        return (actor[0] if actor and find(evidence.DUTY) and not find(evidence.NOBODY) else None, deadline[0] if deadline and not find(evidence.NOT_SET) else None, status[1].strip() if status else None, priority[1].strip() if priority else None)

    got = spark.createDataFrame([(t,) for t in said], "t string").select(evidence.metadata(F.col("t")).alias("m")).collect()
    assert [tuple(r["m"]) for r in got] == [by_loop(t) for t in said]


def test_blank_chunks_have_no_span(spark, tmp_path):
    """A sentence whose last piece of 1,500 characters is blank: the piece is a chunk without spans, in the SQL too."""
    import duckdb

    text = "a" * 1499 + "!" + " " * 3 + "b."
    spark.createDataFrame([(1, text, "x", "src")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("evidence_spans", "grounded_spans"):
        got = knowledge.queries()[name](spark, str(tmp_path))
        want = con.execute(knowledge_sql.ORACLE_SQL[name]).fetchdf()
        assert rows_of(got.toPandas()) == rows_of(want[got.columns])
        if name == "evidence_spans":
            assert rows(got.where("n_spans = 0"), "places") == [("",)]


def test_units_are_cut_once(spark):
    """One sort by document gives units their number and headings: their texts are shuffled once, and no join takes them."""
    docs = spark.createDataFrame([(1, "# a\n\nОткрытые  вопросы :\n\nx, y.\n\n```\n# no\n```\n\n ## b\n\n## c\n\nz")], "doc_id long, text string")
    out = chunks.context_chunks(docs, 100)
    assert rows(out, "index", "stack", "type_hint", "text")[0] == (0, ["Открытые  вопросы :"], "open_question", "x, y.\n\n") and rows(out, "index", "heading")[-1] == (2, "c")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(text") == 1


def test_documents_are_packed_many_at_a_time(spark):
    units = spark.createDataFrame([(k, s, s + 10) for k in (1, None) for s in range(0, 100, 10)] * 2, "doc_id long, start int, end int")
    out = chunks.packed_chunks(units, 40, 3, 10)
    want = [(c, s, min(s + 30, 100), min(3, (100 - s) // 10)) for c, s in enumerate((0, 20, 40, 60, 80))][:5]
    want = [w for w in want if w[2] - w[1] > 10 and (w[1] == 0 or w[1] + 10 < 100)]
    got = rows(out, "doc_id", "chunk", "start", "end", "n_units")
    assert [g[1:] for g in got if g[0] == 1] == [g[1:] for g in got if g[0] is None] == want
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_packages_are_fitted_many_at_a_time(spark):
    """Nulls come first, a null key is a package, and no package is a call of its own."""
    costs = [(k, s, c) for k in (1, 2, None) for s, c in ((None, 4), (1, 5), (2, 2), (3, 1), (4, 11))]
    out = packages.fitted(spark.createDataFrame(costs, "package_id long, seq int, cost long"), 10, ["seq"])
    want = [(None, True, 4), (1, True, 9), (2, False, 9), (3, True, 10)]
    assert [tuple(r) for r in out.where("package_id is null").select("seq", "included", "used").collect()] == want and out.count() == 12
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
