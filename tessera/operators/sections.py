"""Markdown sections: scan, lexical score, coverage and selection under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import expand_terms, stable_id, tokenize

HEADING = r"^(#{1,6})\s+(.+?)\s*$"
UNTITLED = "Память проекта"
# Points of related folders, and of summaries of sources.
FOLDERS = {"10_Branches": 5, "20_Decisions": 4, "30_Open_Questions": 3, "40_Risks": 3}
SUMMARIES, SUMMARY_POINTS, SUMMARY_HEADING_POINTS, HEADING_POINTS = "50_Sources", 10, 12, 3


def scan_sections(files: DataFrame) -> DataFrame:
    """(project, path, heading, line_start, line_end, text, section_id) of files (project, path, text).

    A section runs from its heading to the line before the next. What comes
    before the first heading is left out; a file without headings is one section,
    a blank one has none. Each file is cut in its row: nothing is shuffled.
    """
    lines = F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")
    files = files.select("project", "path", lines.alias("lines"))
    heads = F.filter(F.transform("lines", lambda line, i: F.when(line.rlike(HEADING), i)), lambda i: i.isNotNull())
    whole = F.exists("lines", lambda line: F.trim(line) != "") & (F.size("heads") == 0)
    rows = files.withColumn("heads", heads).withColumn("heads", F.when(whole, F.array(F.lit(-1))).otherwise(F.col("heads")))
    rows = rows.select("*", F.posexplode("heads").alias("n", "at"))
    begin = F.greatest(F.col("at"), F.lit(0))
    end = F.coalesce(F.get("heads", F.col("n") + 1), F.size("lines"))
    text = F.regexp_replace(F.array_join(F.slice("lines", begin + 1, end - begin), "\n"), r"^\s+|\s+$", "")
    heading = F.when(F.col("at") < 0, UNTITLED).otherwise(F.regexp_extract(F.get("lines", begin), HEADING, 2))
    rows = rows.select("project", "path", heading.alias("heading"), (begin + 1).alias("line_start"), end.alias("line_end"), text.alias("text"))
    return rows.withColumn("section_id", stable_id(*(F.col(c) for c in ("project", "path", "heading", "line_start", "line_end"))))


def folder(path: Column) -> Column:
    """The graph folder that a path lies in, else an empty string."""
    return F.regexp_extract(path, r"(?:^|/)(\d\d_[A-Za-z_]+)/", 1)


def score(sections: DataFrame, terms: list[str]) -> DataFrame:
    """sections with matches and score: shared tokens, three points for each in the heading, and those of the folder."""
    wanted = F.array(*(F.lit(t) for t in sorted(set(terms)))) if terms else F.array().cast("array<string>")
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    all_ = expand_terms(tokenize(F.concat_ws("\n", "heading", "text", stem)))
    rows = sections.withColumns({"matches": F.size(F.array_intersect(all_, wanted)), "_heading": F.size(F.array_intersect(tokenize(F.col("heading")), wanted)), "_folder": folder(F.col("path"))})
    points = F.coalesce(*(F.when(F.col("_folder") == name, p) for name, p in FOLDERS.items()), F.when(F.col("_folder") == SUMMARIES, SUMMARY_POINTS + F.when(F.col("_heading") > 0, SUMMARY_HEADING_POINTS).otherwise(0)), F.lit(0))
    none = (F.col("matches") == 0) & (F.col("_heading") == 0) | (F.lower(F.trim("heading")) == "graph links")
    return rows.withColumn("score", F.when(none, 0).otherwise(F.col("matches") + HEADING_POINTS * F.col("_heading") + points)).drop("_heading", "_folder")


def covered(matches: Column, n_terms: int) -> Column:
    """Whether a section covers a query's focus: any of up to two terms, two of more."""
    return matches >= (2 if n_terms > 2 else 1) if n_terms else F.lit(False)


def best(sections: DataFrame, n: int) -> DataFrame:
    """The n best sections of each project, with their rank: by score, then path and line.

    Ranked within parts first, so that a project with most of the sections isn't
    sorted in one task.
    """
    order = [F.desc("score"), "path", "line_start"]
    rows = sections.where("score > 0").withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("project", "_part").orderBy(*order))).where(F.col("rank") <= n)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(*order))).where(F.col("rank") <= n).drop("_part")


def fit_budget(ranked: DataFrame, capacity: int, key: str = "project", size: Column | None = None) -> DataFrame:
    """Rows (key, rank, text, ...) that fit: taken in order, one that would overflow is skipped and smaller later ones may fit.

    For short ranked lists (see :func:`best`): a key's rows are gathered in one, so
    they should be narrow; texts are better joined to those that stay.
    """
    size = F.length("text") if size is None else size
    lists = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", size.alias("size"), F.struct(*ranked.columns).alias("row")))).alias("rows"))
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))

    def take(acc: Column, row: Column) -> Column:
        fits = acc["used"] + row["size"] <= capacity
        return F.struct(F.when(fits, acc["used"] + row["size"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["taken"], row["rank"])).otherwise(acc["taken"]).alias("taken"))

    taken = lists.select("rows", F.aggregate("rows", state, take, lambda acc: acc["taken"]).alias("taken"))
    kept = F.transform(F.filter("rows", lambda r: F.array_contains("taken", r["rank"])), lambda r: r["row"])
    return taken.select(F.inline(kept))
