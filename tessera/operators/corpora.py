"""Projects as tables of files: their records, the files of their memory, and what groups hand down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.memory import JOURNAL, REGISTRY, is_primary, stem

# Names of a project's files and folders, what may be a source, and what codes and states may be.
MEMORY, MEMORY_MARK, GRAPH, ARCHIVE = "Память.md", " - Память", "Память_Graph", "90_Archive"
REGISTRIES = ("{code} - Источники.md", "{code} - Журнал памяти.md", "Источники.md", "Журнал памяти.md")
SUFFIXES = ("txt", "md", "pdf", "docx", "xlsx")
CODE, STATES = r"^[A-Za-zА-Яа-яЁё0-9][A-Za-zА-Яа-яЁё0-9_-]{1,16}$", ("active", "archived", "draft")
META = "code string, title string, status string, group_code string, context_inheritance boolean"


def memory_code(path: Column) -> Column:
    """The code before the mark of a memory file's name; empty without one."""
    return F.when(F.contains(stem(path), F.lit(MEMORY_MARK)), F.trim(F.substring_index(stem(path), MEMORY_MARK, 1))).otherwise("")


def projects(files: DataFrame, groups: DataFrame, meta_name: str = "project.json", archived: bool = False) -> DataFrame:
    """(project, memory_path, code, title, status, group_code, group_title, inherits, fault) of projects that have a memory file.

    files: (project, path within it, text); groups: (code, title), codes distinct.
    A memory file with a code before its mark goes before one without. What the
    metadata lacks is made up: the code from the memory file's name, else from the
    initials of the project's. fault: ``meta`` if the metadata are no JSON object,
    else ``code``, ``title`` or ``status`` if that can't be one, else empty.
    Archived projects are left out unless asked for. Of a file that comes several
    times one text counts: the last in order.
    """
    marked = F.when(F.col("path").rlike(f"^[^/]*{MEMORY_MARK}\\.md$"), F.col("path"))
    each = files.groupBy("project").agg(F.min(marked).alias("_marked"), F.bool_or(F.col("path") == MEMORY).alias("_plain"), F.max(F.when(F.col("path") == meta_name, F.coalesce("text", F.lit("")))).alias("_meta"))
    rows = each.withColumn("memory_path", F.coalesce("_marked", F.when(F.col("_plain"), MEMORY))).where("memory_path is not null")
    keys = F.json_object_keys("_meta")
    found = rows.withColumns({"_keys": F.coalesce(keys, F.array().cast("array<string>")), "_m": F.from_json("_meta", META), "_bad": F.col("_meta").isNotNull() & (keys.isNull() | F.try_parse_json("_meta").isNull())})
    has = lambda field: F.array_contains("_keys", field)
    parts = F.filter(F.split("project", r"\s+"), lambda p: p != "")
    initials = F.upper(F.left(F.array_join(F.transform(parts, lambda p: F.left(p, F.lit(1))), ""), F.lit(6)))
    inferred = F.coalesce(F.nullif(memory_code(F.col("memory_path")), F.lit("")), F.nullif(initials, F.lit("")), F.upper(F.left("project", F.lit(6))))
    found = found.select(
        "project", "memory_path", F.when(has("code"), F.col("_m.code")).otherwise(inferred).alias("code"), F.coalesce(F.nullif(F.col("_m.title"), F.lit("")), F.col("project")).alias("title"), F.when(has("status"), F.col("_m.status")).otherwise("active").alias("status"),
        F.trim(F.coalesce("_m.group_code", F.lit(""))).alias("group_code"), F.when(has("context_inheritance"), F.coalesce("_m.context_inheritance", F.lit(False))).otherwise(True).alias("inherits"), "_bad",
    )
    sound = lambda c: F.coalesce(c, F.lit(False))
    fault = F.when(F.col("_bad"), "meta").when(~sound(F.trim("code").rlike(CODE)), "code").when(~sound((F.trim("title") != "") & ~F.col("title").rlike(r"[/\\]")), "title").when(~sound(F.col("status").isin(*STATES)), "status").otherwise("")
    found = found.withColumn("fault", fault).drop("_bad")
    named = found.join(groups.select(F.col("code").alias("group_code"), F.col("title").alias("group_title")), "group_code", "left").withColumn("group_title", F.coalesce("group_title", F.lit("")))
    out = named.select("project", "memory_path", "code", "title", "status", "group_code", "group_title", "inherits", "fault")
    return out if archived else out.where(~F.col("status").eqNullSafe(F.lit("archived")))


def scope(path: Column) -> Column:
    """Where a file belongs: registry or journal by its name, source or graph by its folder, else project."""
    name = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    return F.when(F.contains(name, F.lit(REGISTRY)), "registry").when(F.contains(name, F.lit(JOURNAL)), "journal").when(is_primary(path), "source").when(path.rlike(f"(^|/){GRAPH}/"), "graph").otherwise("project")


def corpus(files: DataFrame, records: DataFrame) -> DataFrame:
    """(project, path, place, scope) of the files that make up a project's memory; ``place``, then path, is their order.

    0 is the memory file, 1 to 4 its registers, 5 the Markdown files of the graph
    without the archive, 6 sources with a suffix that can be read. Each file once.
    """
    rows = files.select("project", "path").distinct().join(records.select("project", "memory_path", memory_code(F.col("memory_path")).alias("_code")), "project")
    place = F.when(F.col("path") == F.col("memory_path"), 0)
    for i, name in enumerate(REGISTRIES, 1):
        before, mark, after = name.partition("{code}")
        wanted = F.concat(F.lit(before), F.col("_code"), F.lit(after)) if mark else F.lit(name)
        place = place.when((F.col("path") == wanted) & ((F.col("_code") != "") if mark else F.lit(True)), i)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    graph = F.col("path").rlike(f"^{GRAPH}/.*\\.md$") & ~F.col("path").rlike(f"/{ARCHIVE}/")
    place = place.when(graph, 5).when(F.col("path").rlike("^[^/]+/") & is_primary(F.col("path")) & suffix.isin(*SUFFIXES), 6)
    return rows.withColumn("place", place).where("place is not null").select("project", "path", "place", scope(F.col("path")).alias("scope"))


def primary_sections(files: DataFrame, members: DataFrame) -> DataFrame:
    """(project, path, heading, line_start, line_end, text, scope): each source of a project's memory as one section under its file's name; blank ones are none."""
    sources = members.where("place = 6").select("project", "path", "scope")
    rows = files.join(sources, ["project", "path"]).withColumn("_said", F.regexp_replace(F.coalesce("text", F.lit("")), r"\A\s+|\s+\z", "")).where("_said <> ''")
    lines = F.size(F.split(F.regexp_replace("text", r"\r\n|\r", "\n"), "\n")) - F.when(F.col("text").rlike(r"[\r\n]\z"), 1).otherwise(0)
    return rows.select("project", "path", stem(F.col("path")).alias("heading"), F.lit(1).alias("line_start"), F.greatest(lines, F.lit(1)).alias("line_end"), F.concat(F.lit("# "), stem(F.col("path")), F.lit("\n\n"), "_said").alias("text"), "scope")


def inherited(records: DataFrame, group_sections: DataFrame) -> DataFrame:
    """group_sections (group_code, path, ...) for each project that inherits from a group that exists, with ``project`` and scope ``group``."""
    heirs = records.where((F.col("group_code") != "") & F.col("inherits") & (F.col("group_title") != "")).select("project", "group_code")
    return heirs.join(group_sections, "group_code").withColumn("scope", F.lit("group"))
