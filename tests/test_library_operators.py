"""Small cases of the operators: ties, empties, nulls and the traps of ordering."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import privacy, text
from tessera.operators import authority, candidates, provenance, search, sections

ITEM = "id string, kind string, status string, current boolean, item_type string, title string, statement string, actor_ref string, deadline string, explicit_status string, priority string, updated_at string, source_links array<string>, relation_ids array<string>, seq long"


def item(id_, title="", statement="", item_type="decision", status="confirmed", current=True, actor="", deadline="", updated="2026-07-28", relations=(), kind="context"):
    return (id_, kind, status, current, item_type, title, statement, actor, deadline, "", "", updated, ["s"], list(relations), int(id_))


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_only_confirmed_current_items_are_searched(spark):
    df = items(spark, item("1", "a"), item("2", "a", status="requires_review"), item("3", "a", current=False), item("4", "a", current=None), item("5", "a", kind="sanitized"))
    assert [r["id"] for r in search.page(df, search.Params()).collect()] == ["1"]


def test_normal_forms_and_word_forms(spark):
    df = items(spark, item("1", "Ёлка — маршрут", "Работает локально"), item("2", "Риск"), item("3", "карточки"), item("4", "бронирование переговорной"))
    hits = lambda q: [r["id"] for r in search.page(df, search.Params(q)).collect()]
    assert hits("елка, ЛОКАЛЬНО") == ["1"]
    assert hits("рис") == [] and hits("картошки") == []
    assert hits("бронированию") == ["4"] and hits("переговорная") == ["4"]


def test_pages_filters_and_order(spark):
    df = items(spark, item("1", "b plan", updated="2026-01-01"), item("2", "x", "plan", updated="2026-01-03"), item("3", "plan", actor="Ann", relations=["1"]))
    assert [r["id"] for r in search.page(df, search.Params("plan")).orderBy("position").collect()] == ["3", "1", "2"]
    assert [(r["position"], r["id"]) for r in search.page(df, search.Params("plan", limit=1, offset=1)).collect()] == [(2, "1")]
    assert [r["id"] for r in search.page(df, search.Params(actor="ann")).collect()] == ["3"]
    assert search.page(df, search.Params(related="none", actor_presence="missing")).count() == 2


@pytest.mark.parametrize("bad", [{"query": "x" * 201}, {"query": "a " * 17}, {"types": ("x",)}, {"sort": "x"}, {"actor": "a", "actor_presence": "missing"}, {"limit": 0}, {"limit": 101}, {"offset": -1}, {"related": "x"}])
def test_wrong_parameters(bad):
    with pytest.raises(ValueError):
        search.Params(**bad)


def test_facets_count_types_at_zero_and_merge_actors(spark):
    got = {(r["facet"], r["value"]): r["count"] for r in search.facets(items(spark, item("1", actor=" Ann "), item("2", actor="ANN"), item("3", item_type="risk"))).collect()}
    assert got[("actor", "Ann")] == 2 and got[("type", "decision")] == 2 and got[("type", "action")] == 0


def test_overview_and_highlights_of_nothing(spark):
    none = items(spark, item("1")).limit(0)
    assert search.overview(none).first()["confirmed"] == 0
    assert search.highlights(none, {"risk": 5}).count() == 0


def test_highlights_put_deadlines_first(spark):
    df = items(spark, item("1", item_type="action", updated="2026-05-01"), item("2", item_type="action", deadline="soon", updated="2026-01-01"), item("3", item_type="action", deadline="x", updated=""))
    assert [r["id"] for r in search.highlights(df, {"action": 5}).orderBy("rank").collect()] == ["3", "2", "1"]


def test_stems_and_tokens(spark):
    assert one(spark, text.tokenize(F.lit("Проект Архитектурная и АБ 12345 the mvp"))) == ["mvp", "аб", "архитектурн", "архитектурная"]
    assert one(spark, text.tokenize(F.lit(None).cast("string"))) == []
    assert set(one(spark, text.expand_terms(F.array(F.lit("мвп2"), F.lit("хранить"))))) >= {"mvp2", "мвп2", "хранение"}


def test_head_and_tail(spark):
    assert one(spark, text.head_and_tail(F.lit("ab"), 10)) == "ab"
    cut = one(spark, text.head_and_tail(F.lit("x" * 50 + "y" * 50), 37))
    assert len(cut) == 37 and cut.startswith("x" * 20) and cut.endswith("y" * 10)


FILES = "project string, path string, text string"


def test_sections(spark):
    df = spark.createDataFrame([("p", "a.md", "before\n# One\nx\n## Two\r\ny\n"), ("p", "b.md", "no heading"), ("p", "c.md", "  \n"), ("p", "d.md", None)], FILES)
    got = [(r["path"], r["heading"], r["line_start"], r["line_end"], r["text"]) for r in sections.scan_sections(df).orderBy("path", "line_start").collect()]
    assert got == [("a.md", "One", 2, 3, "# One\nx"), ("a.md", "Two", 4, 6, "## Two\ny"), ("b.md", sections.UNTITLED, 1, 1, "no heading")]


def test_budget_skips_what_would_overflow(spark):
    df = spark.createDataFrame([("p", 1, "a" * 6), ("p", 2, "b" * 6), ("p", 3, "c" * 4), ("q", 1, "d" * 11)], "project string, rank int, text string")
    assert sorted((r["project"], r["rank"]) for r in sections.fit_budget(df, 10).collect()) == [("p", 1), ("p", 3)]


def test_masks_are_numbered_in_order(spark):
    df = spark.createDataFrame([("a@b.io and c@d.io, 10.0.0.1",), (None,), ("",)], "text string")
    assert [r["text"] for r in privacy.mask(df, "text").collect()] == ["[EMAIL_1] and [EMAIL_2], [IP_1]", None, ""]


def test_strictest_never_lowers(spark):
    df = spark.createDataFrame([("a", "standard"), ("a", "odd"), ("b", "unknown"), ("c", "standard")], "k string, h string")
    got = dict(df.groupBy("k").agg(privacy.strictest(F.col("h")).alias("h")).collect())
    assert got == {"a": "restricted", "b": "unknown", "c": "standard"}
    assert df.limit(0).agg(privacy.strictest(F.col("h")).alias("h")).first()["h"] == "standard"


def test_leftmost_spans(spark):
    spans = F.from_json(F.lit('[{"start":5,"end":9,"rule":1},{"start":0,"end":6,"rule":2},{"start":0,"end":4,"rule":1},{"start":9,"end":10,"rule":0}]'), "array<struct<start:int,end:int,rule:int>>")
    assert [(s["start"], s["end"]) for s in one(spark, candidates.leftmost_spans(spans))] == [(0, 4), (5, 9), (9, 10)]


def test_overlaps_equal_brute_force(spark):
    left = [(k, a, a + n) for k in "xy" for a, n in ((0, 10), (5, 700), (300, 1), (900, 30), (50, 0))]
    right = [(k, a, a + n) for k in "xz" for a, n in ((9, 1), (10, 5), (255, 2), (299, 3), (100, 2000))]
    schema = "k string, start long, end long"
    got = sorted(tuple(r) for r in candidates.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"]).collect())
    assert got == sorted((k, a, b, c, d) for k, a, b in left for m, c, d in right if k == m and a < d and b > c and b > a)


def test_lineage_ends_at_missing_parents_and_cycles(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("e", "f"), ("f", "e")], "id string, parent_id string")
    got = {r["id"]: (r["root_id"], r["depth"]) for r in provenance.lineage(spark, df, depth=5).collect()}
    assert got["c"] == ("a", 2) and got["d"] == ("d", 0) and got["e"][1] == 5


def test_lineage_has_no_bound_but_cycles_fail(spark):
    df = spark.createDataFrame([(f"{i:02}", f"{i - 1:02}" if i else None) for i in range(23)], "id string, parent_id string")
    got = {r["id"]: (r["root_id"], r["depth"], len(r["path"])) for r in provenance.lineage(spark, df).collect()}
    assert got["22"] == ("00", 22, 23)
    with pytest.raises(ValueError):
        provenance.lineage(spark, spark.createDataFrame([("a", "b"), ("b", "a")], df.schema))


def test_intake_and_inserts(spark):
    new = spark.createDataFrame([("w", "2", "x", 2), ("w", "1", "x", 1), ("v", "3", "x", 3), ("w", "4", None, 4), ("w", "5", "old", 5)], "workspace_id string, id string, content string, seq int")
    known = spark.createDataFrame([("w", "old", "9")], "workspace_id string, c string, object_id string").select("workspace_id", F.sha2(F.col("c").cast("binary"), 256).alias("checksum"), "object_id")
    got = {r["id"]: (r["object_id"], r["duplicate"]) for r in provenance.intake(new, known).collect()}
    assert got == {"1": ("1", False), "2": ("1", True), "3": ("3", False), "4": ("4", False), "5": ("9", True)}
    table = spark.createDataFrame([(1, "t")], "id int, o string")
    assert sorted(map(tuple, provenance.insert_if_absent(table, spark.createDataFrame([(1, "n"), (2, "z"), (2, "b")], "id int, o string"), ["id"], ["o"]).collect())) == [(1, "t"), (2, "b")]


def test_retention_is_strict(spark):
    df = spark.createDataFrame([("a", 100.0), ("b", 99.0)], "id string, mtime double")
    assert [r["id"] for r in provenance.expired(df, 1, 86500.0).collect()] == ["b"]
    assert provenance.expired(df, 0, 1e12).count() == 0


def test_authority(spark):
    row = lambda i, **k: tuple({"id": i, "scope_ref": "s", "kind": "k", "subject_ref": "x", "value": "v", "lifecycle": "active", "confirmation": "confirmed", "sensitivity": "standard"} | k for _ in (0,))[0]
    rows = [row(1), row(2), row(3, subject_ref="y"), row(4, lifecycle=None), row(5, value=" "), row(6, sensitivity="restricted"), row(7, kind="q"), row(8, confirmation="no")]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id int, scope_ref string, kind string, subject_ref string, value string, lifecycle string, confirmation string, sensitivity string")
    got = {r["id"]: (r["reason"], r["verdict"]) for r in authority.resolve(authority.exclusion(df, ["k"], ["standard"])).collect()}
    assert got == {1: ("", "ambiguous"), 2: ("", "ambiguous"), 3: ("", "eligible"), 4: ("not_active", "excluded"), 5: ("invalid_record", "excluded"), 6: ("sensitivity_denied", "excluded"), 7: ("unsupported_kind", "excluded"), 8: ("not_confirmed", "excluded")}


def test_bounded_terms_skip_what_does_not_fit(spark):
    rows = [(["ab", "abcdef", "c"], ["d"], "ab c d"), (["abcdefghij"], ["x"], "abcdefg"), ([], ["x", "x"], "x x"), ([], [], ""), (["a", "b", "c", "d"], ["e"], "a b c")]
    df = spark.createDataFrame(rows, "p array<string>, s array<string>, want string")
    got = df.select("want", text.bounded_terms(F.col("p"), F.col("s"), 3, 7).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert df.limit(1).select(text.query_terms(F.lit(None).cast("string")).alias("q")).first()["q"] == []


def test_context_queries_take_two_user_turns(spark):
    rows = [(1, 0, "user", "Old"), (1, 1, "user", "The Subject"), (1, 2, "assistant", "no"), (1, 3, "user", "And now?"), (1, 4, "user", " "), (2, 0, "assistant", "x"), (3, 0, "user", "one")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"], r["query"]) for r in authority.context_queries(df, ("the",)).collect()}
    assert got == {(1, 3, "and now subject"), (3, 0, "one")}
    assert authority.context_queries(df.limit(0)).count() == 0


def test_only_parents_walk(spark, monkeypatch):
    """Leaves go on from their parent's way: no level holds them."""
    kept = []
    monkeypatch.setattr(provenance, "saved", lambda df: kept.append(df) or df.persist())
    made = [("a", None), ("b", "a"), ("c", "b")] + [(f"leaf{i}", "c") for i in range(40)] + [("lost", "x")]
    out = provenance.lineage(spark, spark.createDataFrame(made, "id string, parent_id string"))
    got = {r["id"]: (r["root_id"], r["depth"], r["path"]) for r in out.collect()}
    assert got["leaf7"] == ("a", 3, ["leaf7", "c", "b", "a"]) and got["b"] == ("a", 1, ["b", "a"]) and got["lost"] == ("lost", 0, ["lost"]) and len(got) == len(made)
    assert max(df.count() for df in kept if "path" in df.columns) == 3
