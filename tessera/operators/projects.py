"""What projects hold: files that may be taken in, registry rows, health, and plans of what to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The folders of a project's graph.
FOLDERS = ("00_Core", "10_Branches", "20_Decisions", "30_Open_Questions", "40_Risks", "50_Sources")


def refusal(name: Column, content: Column, suffixes: tuple[str, ...] = ("txt", "md"), binary: tuple[str, ...] = ("pdf",)) -> Column:
    """Why a file isn't taken in: ``unsupported`` suffix, or ``not_text`` if a text has control characters; else empty.

    The suffix is what follows the name's last dot, whatever its case. Contents
    of binary suffixes aren't looked at; a null content is an empty text.
    """
    suffix = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./]*)$", 1))
    odd = F.coalesce(content, F.lit("")).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    return F.when(suffix.isin(*binary), "").when(~suffix.isin(*suffixes), "unsupported").when(odd, "not_text").otherwise("")


def is_candidate(path: Column, suffixes: tuple[str, ...], folders: tuple[str, ...], endings: tuple[str, ...]) -> Column:
    """Whether an inbox looks at a path: a suffix of the list, no hidden name, no part in ``folders``, no name with one of ``endings``."""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    ended = [F.endswith(name, F.lit(e)) for e in endings]
    out = F.regexp_extract(name, r"\.([^.]*)$", 1).isin(*suffixes) & ~F.startswith(name, F.lit(".")) & ~F.exists(parts, lambda p: p.isin(*folders))
    for e in ended:
        out = out & ~e
    return F.coalesce(out, F.lit(False))


def registry_row(row: Column, only_source: str, unmentioned: str, done: str, markers: tuple[str, ...]) -> Column:
    """Whether a row of a pipe table (name, mode, masking, memory, comment) counts as indexed: its mode, memory or masking says so, or its comment holds a marker.

    Missing cells are empty; cells are compared in lower case without outer blanks.
    """
    cells = F.transform(F.split(F.regexp_replace(F.trim(F.coalesce(row, F.lit(""))), r"^\||\|$", ""), r"\|"), lambda c: F.lower(F.trim(c)))
    cell = lambda i: F.coalesce(F.get(cells, F.lit(i)), F.lit(""))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(cell(4), F.lit(m))
    return (cell(1) == only_source) | ((cell(3) != "") & (cell(3) != unmentioned)) | (cell(2) == done) | marked


def health(files: DataFrame, sources: DataFrame, unmentioned: str) -> DataFrame:
    """(project, severity, title, n) of what is wrong with projects, once each.

    files: (project, folder), sources: (project, status). Folders without a file
    are ``critical``; sources, but at most one file in 50_Sources, are a
    ``warning``; sources of the status ``unmentioned`` an ``info``.
    """
    counts = files.groupBy("project").agg(*(F.count_if(F.col("folder") == f).alias(f) for f in FOLDERS))
    counted = sources.groupBy("project").agg(F.count("*").alias("_sources"), F.count_if(F.col("status") == unmentioned).alias("_unmentioned"))
    both = counts.join(counted, "project", "full").fillna(0)
    missing = sum((F.col(f"`{f}`") == 0).cast("int") for f in FOLDERS)

    def row(when: Column, severity: str, title: str, n: Column) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(title).alias("title"), n.cast("long").alias("n")))

    rows = F.array_compact(F.array(
        row(missing > 0, "critical", "missing folders", missing), row((F.col("50_Sources") <= 1) & (F.col("_sources") > 0), "warning", "few source summaries", F.col("50_Sources")),
        row(F.col("_unmentioned") > 0, "info", "unmentioned sources", F.col("_unmentioned")),
    ))
    return both.select("project", F.inline(rows))


def plan_groups(files: DataFrame) -> DataFrame:
    """(package, context, first_name, n_files, operation): one planned summary for each context of a package.

    files: (package, seq, context, name, text). Files without a name or text are
    left out; the first by seq names the summary, and several are a ``merge``.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rows = files.where(~blank("name") & ~blank("text"))
    out = rows.groupBy("package", "context").agg(F.min_by("name", F.struct("seq", "name")).alias("first_name"), F.count("*").alias("n_files"))
    return out.withColumn("operation", F.when(F.col("n_files") > 1, "merge").otherwise("create"))


def quality_gate(items: DataFrame, most_words: int = 3) -> DataFrame:
    """items (seq, target, title, category, durable) with ``status``: duplicate, quality_blocked or planned.

    The first item by seq takes a target, blocked or not; later ones are
    duplicates, which counts before all else. Titles of more words, titles that
    are a hash or a number, and items of other categories than source_summary
    without durable content are blocked. Items without a target are no duplicates.
    """
    first = items.where("target is not null").groupBy("target").agg(F.min("seq").alias("_first"))
    title = F.trim(F.coalesce("title", F.lit("")))
    poor = title.rlike(r"^[0-9a-f]{8,}$") | title.rlike(r"^[0-9_-]*$")
    blocked = (F.size(F.split(title, r"\s+")) > most_words) | poor | ((F.col("category") != "source_summary") & ~F.coalesce("durable", F.lit(False)))
    out = items.join(first, "target", "left")
    return out.select("seq", "target", F.when(F.col("seq") > F.col("_first"), "duplicate").when(blocked, "quality_blocked").otherwise("planned").alias("status"))
