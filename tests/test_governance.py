"""Protection, reviews, projects and excerpts on small inputs with nulls, ties, repeats and empty tables."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import excerpts
from tessera.operators import chunks, projects, protection, reviews, search

EMAIL = protection.Rule("Email", r"[a-z]+@[a-z]+\.[a-z]+", True)
NUMBER = protection.Rule("Number", r"[0-9]{4,}")
DOCS = "doc_id long, source string, text string"


def protected(spark, rows, rules):
    return {r.doc_id: r for r in protection.protect(spark.createDataFrame(rows, DOCS), rules).collect()}


def test_pseudonyms_are_the_workspaces(spark):
    rows = [(1, "a", "x@y.zz then q@y.zz, X 12345"), (2, "a", "Q: q@y.zz"), (3, "b", "q@y.zz"), (4, "a", None), (5, None, "12345"), (6, "a", "")]
    got = protected(spark, rows, [EMAIL, NUMBER])
    # In a document the last new value comes first.
    assert got[1].text == "Email-02 then Email-01, X Number-01" and got[2].text == "Q: Email-01" and got[3].text == "Email-01" and got[5].text == "Number-01"
    assert got[4].text is None and got[4].status == "ready_for_review" and got[6].text == "" and got[6].findings == []
    assert [f.pseudonym for f in got[1].findings] == ["Email-02", "Email-01", "Number-01"]


def test_leftmost_rule_and_length_decide(spark):
    rules = [protection.Rule("A", "bc"), protection.Rule("B", "abc"), protection.Rule("C", "abcd"), protection.Rule("D", "d")]
    assert protected(spark, [(1, "s", "abcd abcd")], rules)[1].text == "B-01D-01 B-01D-01"


def test_dictionary_takes_whole_words(spark):
    rules = protection.dictionary_rules({"Name": ["ann", "a.b", " "]})
    got = protected(spark, [(1, "s", "ann anna pre-ann ann. a.b axb")], rules)
    assert got[1].text == "Name-02 anna pre-ann Name-02. Name-01 axb"


def test_failed_rules(spark):
    got = protected(spark, [(1, "s", "plain")], [protection.Rule("Odd", "("), protection.Rule("Empty", "x*"), EMAIL])
    assert got[1].status == "requires_review" and got[1].text == "plain"
    with pytest.raises(ValueError, match="Odd"):
        protection.usable(spark, [protection.Rule("Odd", "(", True)])


def test_numbers_over_several_blocks(spark):
    rows = spark.range(0, 3 * protection.BLOCK, 10_001).select("id", F.lit("k").alias("k"), F.struct("id").alias("order"))
    got = [r.number for r in protection.numbered(rows, ["k"], "id", "order").orderBy("id").collect()]
    assert got == list(range(1, len(got) + 1))


def test_review_states(spark):
    artifacts = spark.createDataFrame([(1,), (2,), (3,), (4,)], "artifact_id long")
    findings = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (3, 1), (None, 1)], "artifact_id long, finding_id long")
    decisions = spark.createDataFrame([(1, 1, 5, "keep"), (1, 1, 2, "replace"), (2, 1, 1, "keep"), (3, 9, 1, "keep")], "artifact_id long, finding_id long, seq long, decision string")
    got = {r.artifact_id: tuple(r)[1:] for r in reviews.review_states(artifacts, findings, decisions).collect()}
    assert got == {1: (2, 1, 0, "review_in_progress"), 2: (1, 1, 1, "ready_for_confirmation"), 3: (1, 0, 0, "requires_review"), 4: (0, 0, 0, "ready_for_confirmation")}
    assert reviews.review_states(artifacts, findings.limit(0), decisions.limit(0)).count() == 4


def test_item_states(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    log = [(1, 1, "confirm"), (2, 1, "confirm"), (2, 2, "edit"), (2, 3, "confirm"), (3, 1, "duplicate"), (3, 2, "edit"), (4, 1, "look"), (9, 1, "reject"), (5, 1, None)]
    got = {r.id: tuple(r)[1:] for r in reviews.item_states(items, spark.createDataFrame(log, "id long, seq long, action string")).collect()}
    want = {1: ("confirmed", True, 0), 2: ("superseded", False, 1), 3: ("rejected", False, 1), 4: ("requires_review", True, 0), 5: ("requires_review", True, 0)}
    assert got == want


def test_links_and_materials_of_nothing(spark):
    old = spark.createDataFrame([("w", "t", " A ", 7, "s1"), ("w", "t", "b", 8, "s1")], "workspace_id string, item_type string, statement string, id long, source string")
    new = spark.createDataFrame([("w", "t", "a", 1, "s2"), ("w", "t", "c", 3, None), ("w", "t", "C", 2, "s2")], "workspace_id string, item_type string, statement string, seq long, source string")
    got = {(r.id, r.seq, r.n_sources, r.outcome) for r in reviews.linked_or_new(old, new).collect()}
    assert got == {(7, 1, 2, "linked"), (8, None, 1, "kept"), (None, 2, 1, "new")}
    objects = spark.createDataFrame([("s", "source", None, True, 1, "now"), ("e2", "extraction", "s", True, 2, ""), ("e1", "extraction", "s", False, 1, ""), ("t", "sanitized", "e2", True, 1, "")], "id string, kind string, parent_id string, current boolean, seq long, created_at string")
    reviewed = spark.createDataFrame([], "artifact_id string, state string")
    assert [tuple(r) for r in reviews.materials(objects, reviewed).collect()] == [("s", "now", "t", "not_started")]


def test_headings_skip_fences(spark):
    said = "# A\n```\n# hidden\n~~~\n```\n### B  \ntext\n## C\n~~~\n# open to the end"
    docs = spark.createDataFrame([(1, said), (2, None), (3, ""), (4, "#no\n####### seven")], "doc_id long, text string")
    heads = chunks.headings(docs)
    assert [(r.line, r.level, r.title) for r in heads.orderBy("doc_id", "line").collect()] == [(1, 1, "A"), (6, 3, "B"), (8, 2, "C")]
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 7), (1, 9), (4, 1)], "doc_id long, line int")
    got = {(r.doc_id, r.line): r.stack for r in chunks.heading_stacks(rows, heads).collect()}
    assert got == {(1, 1): [], (1, 2): ["A"], (1, 7): ["A", "B"], (1, 9): ["A", "C"], (4, 1): []}


def test_files_and_rows(spark):
    rows = spark.createDataFrame([("a.TXT", "x"), ("b", None), (None, "x"), ("c.md", "\x00"), ("d.pdf", "\x00")], "name string, content string")
    assert [r[0] for r in rows.select(projects.refusal(F.col("name"), F.col("content"))).collect()] == ["", "unsupported", "unsupported", "not_text", ""]
    paths = spark.createDataFrame([("in/a.md",), ("in/.a.md",), ("tmp/a.md",), ("a.log",), ("x - index.md",), (None,)], "path string")
    assert [r[0] for r in paths.select(projects.is_candidate(F.col("path"), ("md",), ("tmp",), ("index.md",))).collect()] == [True, False, False, False, False, False]
    cells = spark.createDataFrame([("| a | only |",), ("| a | b | c | none | d |",), ("a | b | done",), ("| a | b | c |  | see [[x]] |",), (None,), ("",)], "row string")
    assert [r[0] for r in cells.select(projects.registry_row(F.col("row"), "only", "none", "done", ("see [[",))).collect()] == [True, False, True, True, False, False]


def test_gate_and_plans(spark):
    rows = [(1, "t", "one two three four", "decision", True), (2, "t", "ok", "decision", True), (3, None, "ok", "decision", None), (4, "u", "deadbeef01", "source_summary", None), (5, "v", "fine", "source_summary", None)]
    got = {r.seq: r.status for r in projects.quality_gate(spark.createDataFrame(rows, "seq long, target string, title string, category string, durable boolean")).collect()}
    assert got == {1: "quality_blocked", 2: "duplicate", 3: "quality_blocked", 4: "quality_blocked", 5: "planned"}
    files = spark.createDataFrame([("p", 2, "c", "b", "x"), ("p", 1, "c", "a", "x"), ("p", 0, "c", " ", "x"), ("p", 3, None, "d", "x")], "package string, seq long, context string, name string, text string")
    assert {tuple(r) for r in projects.plan_groups(files).collect()} == {("p", "c", "a", 2, "merge"), ("p", None, "d", 1, "create")}


def test_excerpts(spark):
    row = spark.createDataFrame([("aa  " * 100 + "KEY " + "b " * 100, [" x ", None, "x", "", "yyyy"], 'so: {"k": {"j": 1}} end', "no")], "t string, l array<string>, j string, d string")
    got = row.select(
        excerpts.window(F.col("t"), ["key", "none"], 30).alias("w"), excerpts.clean_list(F.col("l"), 2, 3).alias("l"), excerpts.json_object(F.col("j")).alias("j"), excerpts.json_object(F.col("d")).alias("d"),
        excerpts.window(F.lit(None).cast("string"), [], 30).alias("n"), excerpts.older_than(F.col("d"), F.current_timestamp(), 1).alias("o"), excerpts.keyword_lines(F.col("t"), ["key"], 3, 20).alias("k"),
    ).first()
    assert got.w == "... aa aa aa KEY b b b b b b b b ..." and got.l == ["x", "yyy"] and got.j == '{"k": {"j": 1}}' and got.d is None and got.n == "" and got.o is None
    assert got.k == ["aa aa aa aa aa aa..."]


def test_unknown_ids_are_errors(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    ask = spark.createDataFrame([(2, 0), (1, 1)], "id long, pos long")
    assert [r.name for r in search.chosen(items, ask).orderBy("pos").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="unknown id 3"):
        search.chosen(items, spark.createDataFrame([(3, 0)], "id long, pos long")).collect()
