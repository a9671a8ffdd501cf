"""Semantic units with exact offsets, and what was last before a row."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.text import once, placed

# What ends a paragraph, begins a list item, heading or fence, names a typed section, and is a sentence.
BLOCK = r"(?s).*?(?:\n\s*\n|\z)"
ITEM = r"(?md)(?=^[ \t]*(?:[-*+]|\d+[.)])\s)"
TYPES = {"требования": "requirement", "решения": "decision", "риски": "risk", "открытые вопросы": "open_question", "действия": "action"}
OPENS = r"(?mdiu)(?=^[ \t\x0B\f\r]*(?:#|`{3}|~{3}|" + "|".join(re.sub("[её]", "[её]", n.split()[0]) for n in TYPES) + "))"
FENCE = r"^[ \t]{0,3}(`{3,}|~{3,})"
SENTENCE = r"[^.!?\n]+[.!?]?\s*|\n+|[.!?]+\s*"
MARKED = r"\A[ \t]*(?:[-*+]|\d+[.)])\s"
HEADING = r"(?s)\A\s*#{1,6}\s+\S[^\n]*\s*\z"


def semantic_units(docs: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """(key, start, end, boundary, text) of units: paragraphs, their list items each alone, and cuts of those above ``limit``.

    Offsets are half-open and in code points: the text from start to end is the
    unit. Blank paragraphs and those that are only a heading are none. Null texts
    have no units.
    """
    if limit <= 0:
        raise ValueError("limit")
    blocks = docs.where("text is not null").select(key, F.explode(placed(F.regexp_extract_all("text", F.lit(BLOCK), F.lit(0)))).alias("b"))
    blocks = blocks.where(F.col("b.text").rlike(r"\S") & ~F.col("b.text").rlike(HEADING))
    parts = blocks.select(key, F.col("b.start").alias("base"), F.explode(once(F.split("b.text", ITEM), placed)).alias("p"))
    parts = parts.where(F.col("p.text").rlike(r"\S"))
    item = F.col("p.text").rlike(MARKED)
    cuts = parts.select(key, (F.col("base") + F.col("p.start")).alias("start"), F.col("p.text").alias("text"), item.alias("item"), F.explode(F.sequence(F.lit(0), F.length("p.text") - 1, F.lit(limit))).alias("at"))
    text = F.substring("text", F.col("at") + 1, F.lit(limit))
    boundary = F.when(F.length("text") > limit, "cut").when(F.col("item"), "list_item").otherwise("paragraph")
    return cuts.select(key, (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("at") + F.length(text)).alias("end"), boundary.alias("boundary"), text.alias("text"))


def headings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, level, title) of Markdown headings (lines from 1) outside of fenced code; null texts have none.

    A fence is closed by one of the same kind; an open one hides all that follows.
    Only lines that open a heading or a fence are shuffled.
    """
    lines = docs.where("text is not null").select(key, F.posexplode(F.split("text", "\n")).alias("line", "said"))
    fence = F.left(F.regexp_extract("said", FENCE, 1), F.lit(1))
    marker = F.regexp_extract("said", r"^(#{1,6})\s+\S", 1)
    rows = lines.select(key, (F.col("line") + 1).alias("line"), fence.alias("fence"), F.length(marker).alias("level"), F.trim(F.regexp_replace("said", r"^#{1,6}\s+|\s+$", "")).alias("title")).where("fence <> '' or level > 0")
    fenced = rows.where("fence <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "fence"))).alias("fences"))
    none = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate(
        "fences", none,
        lambda acc, f: F.when(acc["open"] == "", F.struct(f["fence"].alias("open"), f["line"].alias("at"), acc["spans"].alias("spans")))
        .when(acc["open"] == f["fence"], F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), f["line"].alias("end"))).alias("spans")))
        .otherwise(acc),
        lambda acc: F.when(acc["open"] == "", acc["spans"]).otherwise(F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), F.lit(2**31 - 1).alias("end")))),
    )
    out = rows.where("level > 0").join(fenced.select(key, spans.alias("spans")), key, "left")
    hidden = F.exists("spans", lambda s: (F.col("line") > s["start"]) & (F.col("line") < s["end"]))
    return out.where(~F.coalesce(hidden, F.lit(False))).select(key, "line", "level", "title")


def opened_headings(line: str, before: WindowSpec) -> dict[str, Column]:
    """Columns _1 to _6: of each level the last heading (line, title) in a window."""
    return {f"_{n}": F.last(F.when(F.col("level") == n, F.struct(F.col(line).alias("line"), "title")), ignorenulls=True).over(before) for n in range(1, 7)}


def open_stack() -> Column:
    """The titles of :func:`opened_headings` that no later one of a smaller level has closed, outermost first."""
    opened = [F.when(F.col(f"_{n}.line") > F.greatest(*(F.coalesce(F.col(f"_{m}.line"), F.lit(-1)) for m in range(1, n)), F.lit(-1), F.lit(-2)), F.col(f"_{n}.title")) for n in range(1, 7)]
    return F.array_compact(F.array(*opened))


def heading_stacks(rows: DataFrame, heads: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows (key, line) with ``stack``: the titles of the headings above a line that are open there, outermost first.

    As-of joins by level in one sort: of each level the last heading before the
    line, unless one of a smaller level came after it.
    """
    both = rows.select(key, "line", F.lit(1).alias("_side"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title"))
    both = both.unionByName(heads.select(key, "line", F.lit(0).alias("_side"), "level", "title"))
    before = Window.partitionBy(key).orderBy("line", F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumns(opened_headings("line", before)).where("_side = 1")
    return out.select(key, "line", open_stack().alias("stack"))


def last_before(rows: DataFrame, marks: DataFrame, key: list[str], at: str, mark: str) -> DataFrame:
    """As-of join: rows with the ``mark`` of the latest of ``marks`` (key..., at, mark) at or before them; null if none.

    Both are sorted together by key and place in one pass; no row meets more than
    one mark. Of marks at one place the largest counts.
    """
    columns = rows.columns
    marks = marks.groupBy(*key, at).agg(F.max(mark).alias("_mark"))
    both = rows.withColumns({"_side": F.lit(1), "_mark": F.lit(None).cast(dict(marks.dtypes)["_mark"])}).unionByName(marks.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy(*key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(mark, F.last("_mark", ignorenulls=True).over(before)).where("_side = 1").select(*columns, mark)


def inbox(files: DataFrame, state: DataFrame, indexed: DataFrame, hidden: list[str], limit: int = 200) -> DataFrame:
    """The newest files (id, mtime) that no index has and whose state (id, status; none is ``new``) isn't hidden.

    The limit holds after all filters; ties go by id.
    """
    rows = files.join(state, "id", "left").withColumn("status", F.coalesce("status", F.lit("new")))
    rows = rows.where(~F.col("status").isin(hidden)).join(indexed.select("id").distinct(), "id", "left_anti")
    return rows.orderBy(F.desc("mtime"), "id").limit(limit)


def section_type(line: Column) -> Column:
    """What a line that is nothing but the name of a typed section stands for, with or without a heading's marks and a colon; else null."""
    named = lambda n: r"(?iu)\A\s*(?:#{1,6}\s*)?" + re.sub("[её]", "[её]", n).replace(" ", r"\s+") + r"\s*:?\s*\z"
    return F.coalesce(*(F.when(line.rlike(named(n)), F.lit(t)) for n, t in TYPES.items()))


def _titles(docs: DataFrame) -> DataFrame:
    """(_doc, line, level, title) of headings: ``line`` is where one begins in its text; the title's type stands before it."""
    # Cut only before lines that may be one: other lines cost nothing but the search.
    lines = docs.select("_doc", F.explode(once(F.split("text", OPENS), placed)).alias("l"))
    said = F.regexp_replace(F.regexp_extract("l.text", r"\A[^\n]*\n?", 0), r"[\r\n]+$", "")
    lines = lines.select("_doc", F.col("l.start").alias("line"), said.alias("said"))
    fence = F.left(F.regexp_extract("said", FENCE, 1), F.lit(1))
    marker, typed = F.regexp_extract("said", r"^(#{1,6})\s+\S", 1), section_type(F.col("said"))
    level = F.when(marker != "", F.length(marker)).when(typed.isNotNull(), 1).otherwise(0)
    rows = lines.select("_doc", "line", fence.alias("fence"), level.alias("level"), F.concat(F.coalesce(typed, F.lit("")), F.lit("\n"), F.trim(F.regexp_replace("said", r"^#{1,6}\s+|\s+$", ""))).alias("title"))
    rows = rows.where("fence <> '' or level > 0").distinct()
    # A fence is open between its first mark and the next of its kind: how many marks of the kind that opened stand before a heading.
    kinds = rows.where("fence <> ''").groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("line", "fence"))).alias("fences"))
    walked = F.aggregate(
        F.col("fences"), F.struct(F.lit("").alias("open"), F.lit(-1).alias("at"), F.lit(False).alias("hid")),
        lambda acc, f: F.when(f["line"] >= F.col("line"), acc).when(acc["open"] == "", F.struct(f["fence"].alias("open"), f["line"].alias("at"), F.lit(True).alias("hid")))
        .when(acc["open"] == f["fence"], F.struct(F.lit("").alias("open"), f["line"].alias("at"), F.lit(False).alias("hid"))).otherwise(acc),
        lambda acc: acc["hid"],
    )
    out = rows.where("level > 0 and fence = ''").join(kinds, "_doc", "left")
    return out.where(F.coalesce(F.when(F.col("fences").isNotNull(), ~walked), F.lit(True))).select("_doc", "line", "level", "title")


def context_chunks(docs: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """(key, index, start, end, boundary, heading, stack, type_hint, text): the units of texts, each with the headings it stands under.

    Paragraphs are units, their list items each alone; those above ``limit`` are
    cut into sentences, and sentences above it into pieces of that many
    characters (boundary: paragraph, list_item, sentence or character). Blank
    paragraphs and those that are only a heading are none. Offsets are half-open,
    in code points: the text from start to end is the unit. Headings count from
    the place after the one where they begin, outside of fenced code; type_hint is
    that of the innermost typed heading. Null texts have no units; rows that
    repeat a key are cut each.
    """
    if limit <= 0:
        raise ValueError("limit")
    docs = docs.where("text is not null").select(key, "text", F.sha2(F.concat_ws("\n", F.coalesce(F.col(key).cast("string"), F.lit("")), "text").cast("binary"), 256).alias("_doc"))
    blocks = docs.select(key, "_doc", F.explode(placed(F.regexp_extract_all("text", F.lit(BLOCK), F.lit(0)))).alias("b"))
    blocks = blocks.where(F.col("b.text").rlike(r"\S") & ~F.col("b.text").rlike(HEADING) & section_type(F.col("b.text")).isNull())
    parts = blocks.select(key, "_doc", F.col("b.start").alias("_block"), F.explode(once(F.split("b.text", ITEM), placed)).alias("p"))
    parts = parts.where(F.col("p.text").rlike(r"\S")).withColumn("start", F.col("_block") + F.col("p.start"))
    long = F.length("p.text") > limit
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("p.text").alias("text")))
    sentences = parts.select(key, "_doc", "_block", "start", long.alias("_long"), F.col("p.text").rlike(MARKED).alias("_item"), F.explode(F.when(long, placed(F.regexp_extract_all("p.text", F.lit(SENTENCE), F.lit(0)))).otherwise(whole)).alias("s"))
    cuts = sentences.select(key, "_doc", "_block", (F.col("start") + F.col("s.start")).alias("start"), "_long", "_item", F.col("s.text").alias("text"), F.explode(F.sequence(F.lit(0), F.length("s.text") - 1, F.lit(limit))).alias("_at"))
    text = F.substring("text", F.col("_at") + 1, F.lit(limit))
    boundary = F.when(F.length("text") > limit, "character").when(F.col("_long"), "sentence").when(F.col("_item"), "list_item").otherwise("paragraph")
    units = cuts.select(key, "_doc", "_block", (F.col("start") + F.col("_at")).alias("start"), (F.col("start") + F.col("_at") + F.length(text)).alias("end"), boundary.alias("boundary"), text.alias("text"))
    # What is open below a heading is found once for each; then units and headings are sorted together.
    # Of rows that repeat a document each unit has the same number.
    through = Window.partitionBy("_doc").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = _titles(docs).withColumns(opened_headings("line", through)).withColumn("stack", open_stack())
    titles = F.transform("stack", lambda t: F.substring_index(t, "\n", -1))
    hints = F.filter(F.transform("stack", lambda t: F.substring_index(t, "\n", 1)), lambda t: t != "")
    under = F.struct(titles.alias("stack"), F.substring_index(F.try_element_at("stack", F.lit(-1)), "\n", -1).alias("heading"), F.try_element_at(hints, F.lit(-1)).alias("hint"))
    both = units.withColumn("_side", F.lit(1)).unionByName(heads.select("_doc", F.col("line").alias("_block"), F.lit(0).alias("_side"), under.alias("_under")), allowMissingColumns=True)
    by = Window.partitionBy("_doc").orderBy("_block", F.desc("_side"), "start")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({"_under": F.last("_under", ignorenulls=True).over(before), "_new": F.coalesce(F.max("start").over(before) < F.col("start"), F.col("start").isNotNull()).cast("int")})
    both = both.withColumn("index", (F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).cast("int"))
    none = F.array().cast("array<string>")
    return both.where("_side = 1").select(key, "index", "start", "end", "boundary", F.coalesce("_under.heading", F.lit("")).alias("heading"), F.coalesce("_under.stack", none).alias("stack"), F.col("_under.hint").alias("type_hint"), "text")


def packed_chunks(units: DataFrame, limit: int, most_units: int, overlap: int = 0, key: str = "doc_id") -> DataFrame:
    """(key, chunk, start, end, n_units): consecutive units (key, start, end) packed into chunks.

    A chunk takes units while it spans at most ``limit`` characters and
    ``most_units`` units; one unit that is longer is a chunk alone. The next chunk
    begins with the first unit that starts at most ``overlap`` characters before
    the end of this one, but after this one's first unit. Only places are
    shuffled; a document's are one row, its chunks are found by one search each,
    many documents at a time.
    """
    if limit <= 0 or most_units <= 0 or not 0 <= overlap < limit:
        raise ValueError("limits")

    def pack(start: np.ndarray, end: np.ndarray) -> tuple[list, list, list]:
        starts, ends, counts, at = [], [], [], 0
        while at < len(start):
            past = max(at + 1, min(int(np.searchsorted(end, start[at] + limit, "right")), at + most_units))
            starts.append(int(start[at]))
            ends.append(int(end[past - 1]))
            counts.append(past - at)
            if past == len(start):
                break
            at = max(at + 1, min(past, int(np.searchsorted(start, end[past - 1] - overlap, "left")))) if overlap else past
        return starts, ends, counts

    @F.pandas_udf("starts array<int>, ends array<int>, counts array<int>")
    def packed(start: pd.Series, end: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pack(a, b) for a, b in zip(start, end)], columns=["starts", "ends", "counts"])

    places = units.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_p"))
    chunks = places.select(key, packed("_p.start", "_p.end").alias("_c"))
    return chunks.select(key, F.posexplode(F.arrays_zip("_c.starts", "_c.ends", "_c.counts")).alias("chunk", "_c")).select(key, "chunk", F.col("_c.starts").alias("start"), F.col("_c.ends").alias("end"), F.col("_c.counts").alias("n_units"))


#: Choices of evidence that a unit offers at most.
SPANS = 12


def evidence_spans(chunks: DataFrame, most: int = SPANS) -> DataFrame:
    """chunks (start, text, ...) with ``spans``: array of (id, start, end, global_start, global_end, text), ``most`` at most.

    A list item is one span, other texts have one for each sentence, without
    outer white space; if there are too many, neighbours are joined, equally many
    to each but the last. What has no sentence is one span; a blank text has none.
    """
    def cut(text: Column) -> Column:
        pieces = F.filter(placed(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]?|[.!?\n]+"), F.lit(0))), lambda p: p["text"].rlike(r"[^.!?\n]") & p["text"].rlike(r"\S"))
        left = lambda t: F.length(t) - F.length(F.regexp_replace(t, r"\A\s+", ""))
        right = lambda t: F.length(F.regexp_replace(t, r"\s+\z", ""))
        one = F.array(F.struct(left(text).alias("start"), right(text).alias("end")))
        spans = F.transform(pieces, lambda p: F.struct((p["start"] + left(p["text"])).alias("start"), (p["start"] + right(p["text"])).alias("end")))
        return F.when(text.rlike(MARKED), one).otherwise(once(spans, lambda s: F.when(F.size(s) == 0, one).otherwise(s)))

    def join(spans: Column) -> Column:
        size = F.ceil(F.size(spans) / most).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(spans) - 1, size), lambda i: F.struct(F.get(spans, i)["start"].alias("start"), F.get(spans, F.least(i + size, F.size(spans)) - 1)["end"].alias("end")))

    bounds = F.when(F.col("text").rlike(r"\S"), once(once(F.col("text"), cut), join)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return chunks.withColumn("_bounds", bounds).withColumn("spans", F.transform("_bounds", lambda b, i: F.struct(
        F.concat(F.lit("E"), (i + 1).cast("string")).alias("id"), b["start"].alias("start"), b["end"].alias("end"), (F.col("start") + b["start"]).alias("global_start"),
        (F.col("start") + b["end"]).alias("global_end"), F.substring("text", b["start"] + 1, b["end"] - b["start"]).alias("text")))).drop("_bounds")
