"""Projects as tables of files: records with defaults, the files of their memory, sources and what groups hand down."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import corpora

FILES = [
    ("Big Red Dog", "Память.md", "x"), ("Big Red Dog", "AB - Память.md", "y"), ("Big Red Dog", "AA - Память.md", "y"), ("Big Red Dog", "project.json", '{"title": "", "group_code": " g1 ", "more": [1]}'),
    ("Big Red Dog", "AA - Источники.md", ""), ("Big Red Dog", "AB - Источники.md", ""), ("Big Red Dog", "Журнал памяти.md", ""), ("Big Red Dog", "Память_Graph/a/B.md", ""), ("Big Red Dog", "Память_Graph/90_Archive/B.md", ""), ("Big Red Dog", "Память_Graph/a/B.txt", ""),
    ("Big Red Dog", "Исходники/s/Report.PDF", " \nтекст\r\nдва\n"), ("Big Red Dog", "Исходники/s/Report.exe", "z"), ("Big Red Dog", "Транскрипции/blank.txt", " \n"), ("Big Red Dog", "Транскрипции/none.md", None), ("Big Red Dog", "other/x.md", ""), ("Big Red Dog", "Память.md", "x again"),
    ("plain words here", "Память.md", None), ("none", "notes.md", "x"), ("none", "sub/Память.md", "x"), ("bad", "Память.md", ""), ("bad", "project.json", "{"), ("list", "Память.md", ""), ("list", "project.json", "[1]"), ("old", "Память.md", ""), ("old", "project.json", '{"status": "archived", "code": "no code!"}'),
    ("alone", "Память.md", ""), ("alone", "project.json", '{"group_code": "g1", "context_inheritance": false, "title": "a/b", "code": "ok1"}'), ("lost", "Память.md", ""), ("lost", "project.json", '{"group_code": "g9", "status": null, "code": "L1"}'), (None, "Память.md", "x"),
]


def tables(spark):
    return spark.createDataFrame([(*f, 1) for f in FILES], "project string, path string, text string, code int"), spark.createDataFrame([("g1", "Group")], "code string, title string")


def test_records(spark):
    got = {r["project"]: tuple(r)[1:] for r in corpora.projects(*tables(spark), archived=True).collect()}
    assert got["Big Red Dog"] == ("AA - Память.md", "AA", "Big Red Dog", "active", "g1", "Group", True, "")
    assert got["plain words here"] == ("Память.md", "PWH", "plain words here", "active", "", "", True, "")
    assert got["bad"][-1] == got["list"][-1] == "meta" and "none" not in got and got["old"][1:4] == ("no code!", "old", "archived") and got["old"][-1] == "code"
    assert got["alone"] == ("Память.md", "ok1", "a/b", "active", "g1", "Group", False, "title") and got["lost"][4:6] == ("g9", "") and got["lost"][-1] == "status"
    assert {r["project"] for r in corpora.projects(*tables(spark)).collect()} == set(got) - {"old"}


def test_corpus_in_order(spark):
    files, groups = tables(spark)
    members = corpora.corpus(files, corpora.projects(files, groups))
    got = [tuple(r) for r in members.where("project = 'Big Red Dog'").orderBy("place", "path").select("path", "place", "scope").collect()]
    assert got == [("AA - Память.md", 0, "project"), ("AA - Источники.md", 1, "registry"), ("Журнал памяти.md", 4, "journal"), ("Память_Graph/a/B.md", 5, "graph"), ("Исходники/s/Report.PDF", 6, "source"), ("Транскрипции/blank.txt", 6, "source"), ("Транскрипции/none.md", 6, "source")]
    assert [tuple(r) for r in members.where("project = 'plain words here'").select("path", "place").collect()] == [("Память.md", 0)]
    made = corpora.primary_sections(files, members).collect()
    assert [(r["path"], r["heading"], r["line_start"], r["line_end"], r["text"]) for r in made] == [("Исходники/s/Report.PDF", "Report", 1, 3, "# Report\n\nтекст\r\nдва")]
    assert corpora.corpus(files.limit(0), corpora.projects(files, groups)).collect() == []


def test_groups_hand_down(spark):
    sections = spark.createDataFrame([("g1", "a.md"), ("g9", "b.md"), (None, "c.md")], "group_code string, path string")
    got = corpora.inherited(corpora.projects(*tables(spark)), sections).collect()
    assert [(r["project"], r["path"], r["scope"]) for r in got] == [("Big Red Dog", "a.md", "group")]


def test_scopes(spark):
    paths = [("a/Исходники/Источники.md", "registry"), ("Журнал.md", "journal"), ("x/Транскрипции/y.md", "source"), ("Память_Graph/q.md", "graph"), ("Память.md", "project")]
    assert all(r["s"] == r["want"] for r in spark.createDataFrame(paths, "path string, want string").select("*", corpora.scope(F.col("path")).alias("s")).collect())
