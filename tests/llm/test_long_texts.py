"""Very long texts in the operators on documents and pages."""

from __future__ import annotations

import time

from tessera.llm import decontaminate, line_dedup, quality, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} w{i}" for i in range(120_000))


def test_long_text_holds_a_passage(spark):
    item = " ".join(f"item{i}" for i in range(14))
    at = LONG.index(" ", len(LONG) // 2)
    docs = spark.createDataFrame([(1, LONG[:at] + " " + item + LONG[at:], "en", "s", 1), (2, LONG, "en", "s", 1)], DOCS)
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["contaminated"]) == (240_014, 14, True) and not got[2]["contaminated"]


def test_long_text_is_judged(spark):
    docs = spark.createDataFrame([(1, LONG, "en", "s", 1), (2, "a b c " * 40_000, "en", "s", 1), (3, "\n".join(["same line"] * 50_000), "en", "s", 1)], DOCS)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert got[1]["n_words"] == 240_000 and not got[1]["base_failed"] and got[2]["base_failed"] and got[3]["n_dup_lines"] == 49_999


def test_long_text_is_counted(spark):
    docs = spark.createDataFrame([(1, LONG, "en", "s", 1), (2, "x" * 300_000, "en", "s", 1)], DOCS)
    once = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs).collect()}
    assert once[1] > 240_000 and once[2] > 0


def test_long_page_goes_through_an_archive(spark):
    html = "<p>" + LONG + "\r\n\r\nWARC/1.1\r\n" + "é" * 1000
    pages = spark.createDataFrame([(1, "http://a", html), (2, "http://b", html), (3, "http://c", "short")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert (got[1]["record_type"], got[1]["refers_to"], got[2]["record_type"], got[2]["payload_bytes"]) == ("revisit", 2, "response", len(html.encode()))


def test_many_lines_of_one_text_take_linear_time(spark, monkeypatch):
    """The step that takes dropped lines out of a text, with half of its lines given as dropped."""
    from pyspark.sql import functions as F

    def took(n):
        lines = [f"a line of words with number {i}" for i in range(n)]
        docs = spark.createDataFrame([(1, "\n".join(lines)), (1, "other"), (2, None)], "doc_id long, text string")
        drops = spark.createDataFrame([(1, i, lines[i]) for i in range(1, n, 2)], "doc_id long, line_no int, l string")
        monkeypatch.setattr(line_dedup, "line_drops", lambda *_: drops.select("doc_id", "line_no", F.xxhash64(F.lit(1), "l").alias("h1"), F.lit(1).alias("component")))
        began = time.perf_counter()
        got = {(r["doc_id"], r["n_lines"]): (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()}
        assert got == {(1, n): ("\n".join(lines[::2]), n // 2), (1, 1): ("other", 0), (2, 0): (None, 0)}
        return time.perf_counter() - began

    took(10)
    assert took(60_000) < 30
