"""Masking, protection, partitions, admission, conflicts and excerpts: against plain loops, with nulls, repeats and ties."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tessera.functions import excerpts
from tessera.operators import conflicts, masking, protection, records

RUSSIAN = [
    "Иванов Пётр Сергеевич, ИНН: 7701234567, паспорт 4510 123456; адрес: г. Москва, ул. Мира, д. 5. Договор № АБ-12/3",
    "тел. 8 (912) 345-67-89, +7 912 345 67 89 и 123456789012345; телефон: восемь девять один два три четыре пять шесть семь",
    "Петров И. С. и Сидорова А.Б. из PROJ-123, mail: a.b+c@пример.рф, x@y.zz-q", "ОГРН 1027700132195 и СНИЛС 112-233-445 95, персональные данные клиента", "согласие на обработку", "паспорт клиента", "Договор поставки и контракт N 77/А",
    "bearer abc.def, API-key: zz9, password=hunter2 token", "127.0.0.1 и 10.20.30.40:80 https://a.b/c?d <x>", "0a1b2c3d-0000-1111-2222-0123456789ab 112-233-445 95 1234567890 4510 123456 заявка №А-77б счёт: 40817810099910004312",
    "улица Ленина, дом 5 кв. 7", "", None, "ПДн", "АБВГД_42 Ёлки-00 ab-12",
]


def mask_by_loop(text):
    counts = Counter()
    out = text or ""
    for category, pattern in masking.PATTERNS + (masking.INTERNAL,):
        def token(_, c=category):
            counts[c] += 1
            return f"[{c}_{counts[c]}]"

        out = re.sub(pattern, token, out, flags=0 if category == "INTERNAL_ID" else re.I)
    return out, dict(counts)


def verdict(text, total, on, reviewed):
    concrete = any(re.search(p, text, re.I) for p in masking.CONCRETE)
    suspected = concrete or any(re.search(p, text, re.I) for p in masking.TOPICS)
    if not text:
        return "empty", False, False, False
    if not on:
        return "unavailable", suspected, suspected, False
    unresolved = concrete and total == 0
    if reviewed:
        return "needs_check_after_review", suspected, True, False
    by_hand = suspected and not unresolved
    if unresolved:
        return "needs_check", suspected, True, by_hand
    return ("needs_look" if by_hand and not total else "done" if total else "nothing_found"), suspected, False, by_hand


def test_masking_equals_a_loop(spark):
    texts = RUSSIAN + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    rows = [(i % 50, t, i % 7 != 0 if i % 20 else None, i % 5 == 0, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, on boolean, again boolean, total int").drop("total")
    got = masking.masking_report(df.withColumn("n", F.monotonically_increasing_id()), reviewed=F.col("again"), available=F.col("on")).orderBy("n").collect()
    for (_, text, on, again, _), r in zip(rows, got, strict=True):
        want, counts = mask_by_loop(text)
        if not on:
            want, counts = text or "", {}
        assert (r["masked"], r["counts"], r["total"]) == (want, counts, sum(counts.values())), text
        assert (r["status"], r["suspected"], r["unresolved"], r["by_hand"]) == verdict(text or "", r["total"], bool(on), again), text
    assert {r["status"] for r in got} == set(masking.STATES)


def test_masking_without_rules(spark):
    df = spark.createDataFrame([("a@b.cc",), (None,)], "text string")
    assert [(r["masked"], r["counts"], r["status"]) for r in masking.masking_report(df, []).collect()] == [("a@b.cc", {}, "needs_check"), ("", {}, "empty")]


def test_rules_are_passed_by_where_a_text_lacks_what_they_need(spark, monkeypatch):
    texts = [*RUSSIAN, "д\u1c82говор № 15", "ИНН 1234567890", "a@b.cc", "ABCD-12 and 8 (912) 345-67-89", "١٢٣ ٤٥٦ ٧٨ ٩٠", "plain words", "pıi and PII", "Abcd_٣٤", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rules = masking.RULES + masking.DIALOGUE_RULES + [masking.Rule("ИМЯ", "plain")] + masking.RULES[:1]
    both = lambda: [(masking.masked(df, r).select("masked", "counts").collect(), masking.masking_report(df, r).select("masked", "status", "suspected").collect()) for r in (None, rules)]
    got = both()
    monkeypatch.setattr(masking, "NEEDS", dict.fromkeys(masking.NEEDS, "^"))
    monkeypatch.setattr(masking, "CYRILLIC", "^")
    assert got == both()
    monkeypatch.setattr(masking, "NEEDS", dict.fromkeys(masking.NEEDS, "(?!)"))
    assert [r["masked"] for r in masking.masked(df).collect()] == [t or "" for t in texts]


def protect_by_loop(docs, rules):
    """Of (key, workspace, text): (key, text, pseudonyms), documents in order of their keys, null ones first."""
    numbers, out, known = Counter(), [], {}
    spans_of = []
    for key, workspace, text in docs:
        found = [(m.start(), i, -(m.end() - m.start()), c) for i, (c, p, ignore) in enumerate(rules) for m in re.finditer(p, text or "", ignore)]
        kept = []
        for start, i, n, c in sorted(found):
            if all(start >= e for _, e, _ in kept):
                kept.append((start, start - n, c))
        spans_of.append(kept)
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    seen = {}
    for i in order:
        key, workspace, text = docs[i]
        for start, end, c in spans_of[i]:
            v = (workspace or "", c, text[start:end].lower())
            place = (-(2**62) if key is None else key, -start, v[2])
            seen[v] = min(seen.get(v, place), place)
    for v in sorted(seen, key=lambda v: seen[v]):
        numbers[v[:2]] += 1
        known[v] = f"{v[1]}-{numbers[v[:2]]:02d}"
    for (key, workspace, text), kept in zip(docs, spans_of, strict=True):
        names = [known[workspace or "", c, text[s:e].lower()] for s, e, c in kept]
        for (s, e, _), name in zip(reversed(kept), reversed(names), strict=True):
            text = text[:s] + name + text[e:]
        out.append((key, text, names))
    return sorted(out, key=repr)


def test_protection_equals_a_loop(spark):
    texts = RUSSIAN + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(60).collect()]
    docs = [(i if i % 6 else None, "ab"[i % 2] if i % 5 else None, t) for i, t in enumerate(texts)]
    got = protection.protect(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, spans int"), protection.RULES).collect()
    rules = [(c, p, re.I if c in ("Секрет", "Реквизит", "Адрес") else 0) for c, p in protection.PATTERNS]
    assert sorted(((r["doc_id"], r["text"], [f["pseudonym"] for f in r["findings"]]) for r in got), key=repr) == protect_by_loop(docs, rules)
    assert {f["category"] for r in got for f in r["findings"]} == {c for c, _ in protection.PATTERNS}


def test_rows_without_or_with_one_key_keep_their_own_places(spark):
    email = [protection.Rule("Email", r"[a-z]+@[a-z]+\.[a-z]+", True)]
    docs = [(7, "s", "mail a@b.io now"), (7, "s", "other text, none here"), (None, "s", "x@y.io"), (None, "s", None), (7, "s", "mail a@b.io now"), (7, None, "q@z.io"), (7, "s", "z@z.io a@b.io")]
    got = protection.protect(spark.createDataFrame(docs, "doc_id long, source string, text string"), email).collect()
    said = sorted(((r["doc_id"], r["text"], r["status"]) for r in got), key=repr)
    names = {r["text"] for r in got}
    assert len(got) == 7 and "other text, none here" in names and not any("@" in (t or "") for t in names)
    assert [r for r in said if r[0] is None] == [(None, "Email-01", "requires_review"), (None, None, "ready_for_review")]
    assert sum(t == "mail Email-02 now" or t == "mail Email-03 now" for _, t, _ in said) == 2


ITEM = "scope string, scope_ref string, id string, kind string, subject_ref string, value string, reference string, source_ref string, candidate_ref string, lifecycle string, confirmation string, confirmation_ref string, sensitivity string, supersedes_id string, created_at string, updated_at string"
PROOF = "scope string, scope_ref string, id string, action string, target_item_id string, actor_ref string, source_ref string, candidate_ref string, created_at string"


def item(ref, id_, **other):
    row = {"scope": "project", "scope_ref": ref, "id": id_, "kind": "risk", "subject_ref": "s", "value": "v", "reference": None, "source_ref": None, "candidate_ref": "c", "lifecycle": "active", "confirmation": "confirmed", "confirmation_ref": f"e{id_}", "sensitivity": "standard", "supersedes_id": None, "created_at": "x", "updated_at": "y"}
    return tuple((row | other).values())


def proof(ref, id_, **other):
    row = {"scope": "project", "scope_ref": ref, "id": f"e{id_}", "action": "promotion", "target_item_id": id_, "actor_ref": "a", "source_ref": "", "candidate_ref": "c", "created_at": "x"}
    return tuple((row | other).values())


BAD_ITEMS = [{"kind": "wish"}, {"kind": "action", "scope": "system"}, {"value": " ", "reference": ""}, {"subject_ref": "a b"}, {"candidate_ref": "", "source_ref": None}, {"lifecycle": None}, {"sensitivity": "odd"}, {"confirmation": "proposed"}, {"created_at": ""}, {"supersedes_id": "old"}, {"reference": "a b"}, {"id": "-x"}]
BAD_PROOFS = [{"action": "replacement"}, {"action": "odd"}, {"target_item_id": "z"}, {"candidate_ref": "d"}, {"source_ref": "s"}, {"actor_ref": ""}, {"created_at": None}, {"id": "other"}, {"scope_ref": "elsewhere"}]


def test_one_bad_record_closes_its_partition(spark):
    items, proofs = [], []
    for n, bad in enumerate(BAD_ITEMS):
        items += [item(f"i{n}", "a"), item(f"i{n}", "b", **bad)]
        proofs += [proof(f"i{n}", "a", **({"scope": bad["scope"]} if "scope" in bad else {})), proof(f"i{n}", bad.get("id", "b"))]
    for n, bad in enumerate(BAD_PROOFS):
        items.append(item(f"p{n}", "a"))
        proofs.append(proof(f"p{n}", "a", **bad))
    items += [item("good", "a"), item("good", "b", supersedes_id="a", lifecycle="retired"), item("retired", "r"), item(None, "n")]
    proofs += [proof("good", "a"), proof("good", "b", action="replacement"), proof("retired", "r"), proof("retired", "r2", action="retirement", candidate_ref=None), proof("alone", "q")]
    got = {(r["scope"], r["scope_ref"]): r for r in records.partitions(spark.createDataFrame(items, ITEM), spark.createDataFrame(proofs, PROOF)).collect()}
    state = lambda ref: got["project", ref]["state"]
    assert all(state(f"i{n}") == "closed" or "closed" in {got[k]["state"] for k in got if k[1] == f"i{n}"} for n in range(len(BAD_ITEMS)))
    assert [n for n in range(len(BAD_PROOFS)) if state(f"p{n}") != "closed"] == []
    assert (state("good"), state("retired"), state("alone"), state(None)) == ("open", "open", "open", "closed")
    assert got["project", "good"]["n_items"] == 2 and got["project", "retired"]["n_evidence"] == 2
    kept = records.open_items(spark.createDataFrame(items, ITEM), spark.createDataFrame(proofs, PROOF)).collect()
    assert sorted((r["scope_ref"], r["id"]) for r in kept) == [("good", "a"), ("good", "b"), ("retired", "r")]


def admit_by_loop(known, uploads):
    known, outcomes = [dict(k) for k in known], []
    applied = {(k["w"], k["u"]) for k in known}
    for w, u, seq, name, content, refusal in sorted(uploads, key=lambda x: (x[2], x[1])):
        if (w, u) in applied:
            continue
        if refusal:
            outcomes.append((w, u, refusal, None))
        elif any(k["w"] == w and k["c"] == (content or "") for k in known):
            outcomes.append((w, u, "duplicate", None))
        else:
            prior = [k for k in known if k["w"] == w and k["name"] == name and k["current"]]
            for k in prior:
                k["current"] = False
            known.append({"w": w, "u": u, "c": content or "", "name": name, "current": True})
            outcomes.append((w, u, "new_version" if prior else "accepted", prior[0]["u"] if prior else None))
    return known, outcomes


def test_admission_equals_a_loop_and_is_idempotent(spark):
    rng = random.Random(8)
    schema = "workspace_id string, upload_id string, seq long, filename string, content string, refusal string"
    make = lambda base: [(rng.choice(["w", "v", None]), f"{base}{i}", rng.randrange(15), rng.choice(["a.txt", "b.txt"]), rng.choice([None, "", *map(str, range(25))]), rng.choice(["", "", "", None, "unsupported"])) for i in range(40)]
    none = spark.createDataFrame([], "workspace_id string, upload_id string, seq long, source_id string, checksum string, name_key string, current boolean")
    first, second = make("x"), make("y")
    snapshot, outcomes = records.admit(none, spark.createDataFrame(first, schema))
    known, want = admit_by_loop([], first)
    for uploads in (None, second):
        if uploads:
            snapshot, outcomes = records.admit(snapshot, spark.createDataFrame(uploads, schema))
            known, want = admit_by_loop(known, uploads)
        rows = snapshot.collect()
        assert sorted((r["workspace_id"] or "", r["upload_id"], r["current"]) for r in rows) == sorted((k["w"] or "", k["u"], k["current"]) for k in known)
        owner = {r["source_id"]: r["upload_id"] for r in rows}
        got = sorted(((r["workspace_id"], r["upload_id"], r["outcome"], owner.get(r["supersedes_id"])) for r in outcomes.collect()), key=repr)
        assert got == sorted(want, key=repr)
    # What was admitted is passed by when it comes again; what was refused is refused again.
    again, repeated = records.admit(snapshot, spark.createDataFrame(second, schema))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, snapshot.collect()), key=repr)
    assert {r["outcome"] for r in repeated.collect()} <= {"duplicate", "unsupported"}


def conflicts_by_loop(items, events, relations):
    state = {i: ("requires_review", True) for i in items}
    for item_, _, action in sorted(events, key=lambda e: e[1]):
        near = {b for a, b in relations if a == item_ and b is not None and b != a}
        if action in conflicts.DECISIONS:
            if item_ in state and state[item_][1]:
                state[item_] = conflicts.DECISIONS[action]
        elif action in conflicts.RESOLUTIONS and near:
            own, others = conflicts.RESOLUTIONS[action]
            for who, mark in [(item_, own)] + [(o, others) for o in near]:
                if mark and who in state:
                    state[who] = (mark[0], state[who][1] if mark[1] is None else mark[1])
    return sorted((i, *s) for i, s in state.items())


def history(seed):
    rng = random.Random(seed)
    items = list(range(12))
    relations = [(rng.randrange(12), rng.randrange(14)) for _ in range(14)] + [(3, 3), (None, 1), (1, None)]
    actions = ["confirm", "reject", "edit", "duplicate", "choose_current", "keep_both", "keep_open", "odd"]
    events = [(rng.randrange(13), s, rng.choice(actions)) for s in range(60)]
    return items, events, relations


@pytest.mark.parametrize("seed", range(4))
def test_resolved_conflicts_equal_a_loop(spark, seed):
    items, events, relations = history(seed)
    got = conflicts.resolved_conflicts(spark.createDataFrame([(i,) for i in items], "id long"), spark.createDataFrame(events, "id long, seq long, action string"), spark.createDataFrame(relations, "id long, related_id long"))
    assert sorted(map(tuple, got.collect())) == conflicts_by_loop(items, events, relations)


def test_the_stream_ends_as_the_batch_does(spark, tmp_path):
    items, events, relations = history(9)
    schema = "id long, seq long, action string"
    for n in range(3):  # in order of seq
        spark.createDataFrame(events[20 * n : 20 * n + 20], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{n}")
    links = spark.createDataFrame(relations, "id long, related_id long")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    states = {}

    def keep(batch, _):
        states.update({r["id"]: (r["seq"], r["status"], r["current"]) for r in batch.collect()})

    conflicts.followed_conflicts(stream, links).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = sorted((i, *states.get(i, (0, *conflicts.FIRST))[1:]) for i in items)
    assert got == conflicts_by_loop(items, events, relations)


def focus_by_loop(text, keywords, limit, least, most):
    text, size, windows, seen = text or "", max(least, min(most, limit // 4)), [], set()
    low, notice = text.lower(), "\n[...]\n"
    for word in keywords:
        at = low.find(word)
        while at >= 0:
            key = max(0, at - size // 2), min(len(text), at + size // 2)
            if key not in seen:
                seen.add(key)
                windows.append(text[key[0] : key[1]].strip())
                break
            at = low.find(word, at + len(word))
        if len(notice.join(windows)) >= limit:
            break
    out = notice.join(windows) if windows else text
    if len(out) <= limit:
        return out
    head = max(0, limit - len(notice)) // 2
    tail = max(0, limit - len(notice)) - head
    return f"{out[:head].rstrip()}{notice}{out[len(out) - tail:].lstrip()}"


def test_focused_excerpts_equal_a_loop(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()] + [None, "", "x TION y", "tionbot " * 300, "a.b " * 400, "\n " * 900]
    words = ["tion", "bot", "eux", "a.b", "tionbot", "und"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for limit, least, most in ((1200, 100, 400), (200, 60, 300), (4000, 700, 1400)):
        got = [r["x"] for r in df.select(excerpts.focused(F.col("text"), words, limit, least, most).alias("x")).collect()]
        assert got == [focus_by_loop(t, words, limit, least, most) for t in texts]
    assert [r["x"] for r in df.select(excerpts.focused(F.col("text"), [], 50).alias("x")).collect()] == [focus_by_loop(t, [], 50, 1, 1) for t in texts]
