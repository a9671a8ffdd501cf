"""Units, as-of rows, the inbox, workbooks and streams."""

import json
import zipfile

from conftest import SMALL

from tessera.operators import chunks
from tessera.sources.workbook import column_number, read_workbooks
from tessera.streaming import events


def test_units_are_exact_places(spark):
    text = "# Head\n\nOne para,\nstill one.\n\n- a\n  more\n- b\n2) c\n\n" + "x" * 25 + "\n\n  \n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "# only\n")], "doc_id long, text string")
    rows = chunks.semantic_units(docs, 18).orderBy("start").collect()
    assert {r["doc_id"] for r in rows} == {1} and all(text[r["start"] : r["end"]] == r["text"] for r in rows)
    assert [(r["boundary"], r["text"].strip()) for r in rows[1:4]] == [("cut", "e."), ("list_item", "- a\n  more"), ("list_item", "- b")]
    assert "".join(r["text"] for r in rows if r["start"] >= text.index("xx")).strip() == "x" * 25


def test_last_before_takes_ties_and_misses(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 9)], "k string, at int")
    marks = spark.createDataFrame([("a", 5, "x"), ("a", 5, "y"), ("a", 6, "z"), ("c", 1, "q")], "k string, at int, m string")
    got = {(r["k"], r["at"]): r["m"] for r in chunks.last_before(rows, marks, ["k"], "at", "m").collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 9): None, (None, 9): None}


def test_inbox_limits_after_filters(spark):
    files = spark.createDataFrame([(1, 3), (2, 9), (3, 9), (4, 8), (5, 1)], "id int, mtime int")
    state = spark.createDataFrame([(2, "ignored")], "id int, status string")
    got = chunks.inbox(files, state, spark.createDataFrame([(4,)], "id int"), ["ignored"], limit=2).collect()
    assert [(r["id"], r["status"]) for r in got] == [(3, "new"), (1, "new")]


def test_workbooks(spark, tmp_path):
    sheet = (
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
        '<row r="1"><c r="A1" t="inlineStr"><is><t>Stage</t></is></c><c r="B1" t="s"><v>0</v></c></row>'
        '<row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3"><f>1+1</f><v>2</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
    )
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Plan" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>State</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    good, bad = read_workbooks(spark, str(tmp_path)).orderBy("path").collect()
    assert (good["name"], good["rows"], good["header"], good["merged"], good["formulas"]) == ("Plan", 2, ["Stage", "State"], ["A1:B1"], ["B3"])
    assert good["sample"] == [["Stage", "State"], ["TRUE", "2"]] and bad["problem"] == "BadZipFile"
    assert [column_number(x) for x in ("A", "Z", "AA", "az")] == [1, 26, 27, 52]


def test_streams_equal_batches(spark, tmp_path):
    batch = spark.read.parquet(f"{SMALL}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.follow(spark, str(tmp_path / "in"), 1)
    query = events.hourly(stream, "100 days").writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda rows: sorted((str(r["hour"]), r["event_type"], r["events"], round(r["total"], 6)) for r in rows)
    assert key(spark.table("hourly").collect()) == key(events.hourly(batch).collect())


def test_log_has_each_event_once(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/events.parquet").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        events.append_log(events.follow(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    lines = [json.loads(x["value"]) for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == len({x["event_id"] for x in lines}) == spark.read.parquet(str(tmp_path / "in")).count() and set(lines[0]) == {"event_id", "ts", "event_type"}
