"""Selection from project memory: authority, related sections and the evidence for an answer."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import excerpts
from tessera.functions.text import expand_terms, tokenize, words_for
from tessera.operators.containment import contained, saved
from tessera.operators.sections import FOLDERS, SUMMARIES, folder

WIKI_LINK = r"\[\[([^\]|#]+)"
# Folders of primary sources and what marks a section in its heading or file name; authorities from the highest on.
PRIMARY_FOLDERS = ("Исходники", "Транскрипции")
ARCHITECTURE, CORE = ("паспорт", "архитект", "систем", "границ"), ("архитектурные решения", "системы и границы", "ядро проекта")
CORE_FOLDERS, SOURCE_MAP, REGISTRY, JOURNAL = ("00_Core", "20_Decisions"), "карта источников", "источники", "журнал"
AUTHORITY = {"architecture": 50, "core": 42, "summary": 36, "related": 28, "primary": 24, "registry": 18, "journal": 10, "other": 16}
#: Points of a primary source, and the least of a linked section.
PRIMARY_POINTS, LINKED_POINTS = 6, 8
#: Pieces of evidence at most, and characters of an excerpt.
EVIDENCE, EXCERPT = 3, 1400


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    return F.exists(F.lit(list(marks)), lambda m: F.contains(text, m))


def stem(path: Column) -> Column:
    """A path's file name without its ending."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def is_primary(path: Column) -> Column:
    """Whether a path lies in a folder of primary sources."""
    return path.rlike(f"(^|/)({'|'.join(PRIMARY_FOLDERS)})/")


def is_summary(sections_path: Column, heading: Column) -> Column:
    """Whether a section is a summary of a source, other than their map."""
    return (folder(sections_path) == SUMMARIES) & ~F.contains(F.lower(heading), F.lit(SOURCE_MAP))


def authority(path: Column, heading: Column) -> Column:
    """How much a section counts as a source."""
    low, name = F.lower(heading), F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    kinds = {
        "architecture": is_primary(path) & _any(F.lower(F.concat_ws("\n", heading, stem(path))), ARCHITECTURE),
        "core": folder(path).isin(*CORE_FOLDERS) | _any(low, CORE), "summary": is_summary(path, heading), "related": folder(path).isin(*FOLDERS),
        "primary": is_primary(path), "registry": F.contains(name, F.lit(REGISTRY)), "journal": F.contains(name, F.lit(JOURNAL)),
    }
    return F.coalesce(*(F.when(is_, AUTHORITY[kind]) for kind, is_ in kinds.items()), F.lit(AUTHORITY["other"]))


def with_authority(scored: DataFrame) -> DataFrame:
    """Scored sections with ``authority`` and ``primary``; a primary source that matches has six points more."""
    out = scored.withColumns({"authority": authority(F.col("path"), F.col("heading")), "primary": is_primary(F.col("path"))})
    return out.withColumn("score", F.when(F.col("primary") & (F.col("score") > 0), F.col("score") + PRIMARY_POINTS).otherwise(F.col("score")))


def candidate_order() -> list[Column]:
    """By score with a quarter of the authority, then authority, then place; path and id settle ties."""
    return [F.desc(F.col("score") + F.floor(F.col("authority") / 4)), F.desc("authority"), F.asc("line_start"), F.asc("path"), F.asc("section_id")]


def first_of(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "nth", spread: str = "path") -> DataFrame:
    """The first ``n`` rows of each of ``keys`` by ``order``, numbered from 1; found in parts first, so that no task sorts a large key."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(64)))
    for by in ([*keys, "_part"], keys):
        rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return rows.drop("_part")


def related_sections(sections: DataFrame, anchors: DataFrame, top: int = 3) -> DataFrame:
    """(project, section_id, score, linked): sections that the first anchors link to, and those of related folders that match.

    sections: scored, with authority (project, section_id, path, heading, line_start,
    score, authority); anchors: those of them to start from, with text. A link names
    a section if its title, without regard to case, stands in the section's heading
    or file name; a linked section has eight points at least. Links are found by
    :func:`contained`, not by comparing each title with each section.
    """
    start = first_of(anchors, ["project"], candidate_order(), top).select("project", "text")
    titles = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WIKI_LINK), F.lit(1)), lambda t: F.lower(F.trim(t))))
    needles = start.select("project", F.explode(titles).alias("needle"))
    names = sections.select("project", F.col("section_id").alias("id"), F.explode(F.array(F.lower("heading"), F.lower(stem(F.col("path"))))).alias("text"))
    linked = contained(needles, names, ["project"]).select("project", F.col("id").alias("section_id")).distinct().withColumn("linked", F.lit(True))
    out = sections.join(linked, ["project", "section_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    out = out.where(F.col("linked") | folder(F.col("path")).isin(*FOLDERS) & (F.col("score") > 0))
    return out.select("project", "section_id", F.when(F.col("linked"), F.greatest("score", F.lit(LINKED_POINTS))).otherwise(F.col("score")).alias("score"), "linked")


def merged(*groups: DataFrame) -> DataFrame:
    """(project, section_id, score) of groups of candidates: each once, with its highest score."""
    out = groups[0].select("project", "section_id", "score")
    for more in groups[1:]:
        out = out.union(more.select("project", "section_id", "score"))
    return out.groupBy("project", "section_id").agg(F.max("score").alias("score"))


#: Of a tier: what its evidence is.
TIERS = {1: ("confirmed", "selected_primary"), 2: ("confirmed", "found_primary"), 3: ("partial", "source_summary"), 4: ("partial", "memory_only")}


def evidence_plan(projects: DataFrame, sections: DataFrame, selected: DataFrame, covered: Column, terms: list[str]) -> DataFrame:
    """(project, nth, tier, status, reason, section_id, path, heading, excerpt): up to three pieces of evidence for each of projects (project).

    sections: scored, with authority, primary and text; selected: (project,
    section_id, rank). Primary sources among the selected sections that cover the
    query come first, one for each path; then primary sources that weren't
    selected, of other paths; then summaries among the selected. Without any of
    them the first selected section stands in, and a project without selected
    sections has one row: ``missing``. Narrow rows are ranked; the texts of those
    that stay are joined at the end.
    """
    narrow = sections.select("project", "section_id", "path", "heading", "line_start", "score", "authority", "primary", covered.alias("_covered"))
    chosen = narrow.join(selected.select("project", "section_id", F.col("rank").alias("_rank")), ["project", "section_id"])
    none = F.lit(0)
    direct = chosen.where(F.col("primary") & F.col("_covered"))
    direct = first_of(direct, ["project", "path"], [F.desc("authority"), F.asc("line_start"), F.asc("_rank")], 1, "_nth", "section_id").drop("_nth")
    first = direct.withColumns({"tier": F.lit(1), "_a": -F.col("authority"), "_b": F.col("line_start").cast("int"), "_c": F.col("_rank")})
    asked = narrow.join(selected.select("project").distinct(), "project", "left_semi")
    found = asked.where(F.col("primary") & F.col("_covered")).join(direct.select("project", "path").distinct(), ["project", "path"], "left_anti")
    second = found.withColumns({"tier": F.lit(2), "_a": -F.col("score"), "_b": -F.col("authority"), "_c": F.col("line_start").cast("int")})
    third = chosen.where(is_summary(F.col("path"), F.col("heading"))).withColumns({"tier": F.lit(3), "_a": F.col("_rank"), "_b": none, "_c": none})
    last = chosen.where("_rank = 1").withColumns({"tier": F.lit(4), "_a": none, "_b": none, "_c": none})
    columns = ["project", "section_id", "path", "heading", "tier", "_a", "_b", "_c"]
    rows = first.select(*columns).union(second.select(*columns)).union(third.select(*columns)).union(last.select(*columns))
    rows = first_of(rows, ["project"], [F.asc(c) for c in ("tier", "_a", "_b", "_c", "path", "section_id")], EVIDENCE).where((F.col("tier") < 4) | (F.col("nth") == 1))
    rows = rows.join(sections.select("project", "section_id", "text"), ["project", "section_id"])
    rows = rows.select("project", "nth", "tier", "section_id", "path", "heading", excerpts.window(F.col("text"), terms, EXCERPT).alias("excerpt"))
    empty = projects.select("project").distinct().join(selected.select("project").distinct(), "project", "left_anti")
    out = rows.unionByName(empty.select("project", F.lit(1).alias("nth"), F.lit(0).alias("tier"), *(F.lit("").alias(c) for c in ("section_id", "path", "heading", "excerpt"))))
    says = lambda i: F.coalesce(*(F.when(F.col("tier") == t, F.lit(v[i])) for t, v in TIERS.items()), F.lit(("missing", "nothing_selected")[i]))
    return out.withColumns({"status": says(0), "reason": says(1)})


# Words that show what a query is after, marks of kinds of sections, and their points.
PRIVACY_WORDS = ("пдн", "персональн", "персональные", "персональных", "персональным")
STORAGE_WORDS = ("хран", "храним", "хранение", "хранит", "хранится", "хранятся", "сохраняет", "сохраняются")
ARCHITECTURE_WORDS = ("архитектур", "архитектурн", "паспорт", "систем", "границы", "контур", "модель")
MAPPING_WORDS, MAPPED_SYSTEMS = ("поле", "поля", "реквизит", "реквизиты", "маппинг", "совпадают", "совпад", "соответствия"), ("бф", "до")
STATUS_WORDS = ("статус", "статусы", "стадия", "стадии", "состояние", "состояния")
FIELD_MARKS, DIRECT_MARKS, STATUS_MARKS = ("поле", "реквизит", "маппинг", "источник в до"), ("поле бф", "источник в до"), ("статус", "стадия", "состояние")
REPORT_MARK, CORRESPONDENCE_MARKS = "отчет", ("переписк", "исполнител", "коммуникац")
CENTRAL_MARKS, CENTRAL_POINTS, CENTRAL_FOLDER_POINTS = ("ядро проекта", "системы и границы", "архитектурные решения", "индекс памяти", "карта источников"), 4, 2
GRAPH_LINKS, ALIAS = "graph links", r"^(?:mvp|мвп)(\d+)$"
#: Characters of a section that are taken, and what stands for the rest.
SECTION_CHARS, CLIPPED = 14_000, "\n\n[...section clipped...]"


def intents(terms: set[str]) -> set[str]:
    """What a query's terms ask for: ``privacy_storage``, ``architecture``, ``field_mapping``, ``status``."""
    out = set()
    if terms & set(PRIVACY_WORDS) and terms & set(STORAGE_WORDS):
        out |= {"privacy_storage", "architecture"}
    if terms & set(ARCHITECTURE_WORDS):
        out.add("architecture")
    if terms & set(MAPPING_WORDS) and set(MAPPED_SYSTEMS) <= terms:
        out.add("field_mapping")
    if terms & set(STATUS_WORDS):
        out.add("status")
    return out


def with_scores(sections: DataFrame, terms: set[str], whole: bool = True) -> DataFrame:
    """sections (path, heading, text, ...) with tokens, score, authority and primary.

    Unless ``whole``, tokens are those alone that ``terms`` may be among. A point for each shared term, three for each in the heading, those of the
    section's kind, and those of what the query is after. Without a shared term,
    and for link lists, it is 0; deductions leave one point at least.
    """
    wanted = F.array(*map(F.lit, sorted(terms))).cast("array<string>")
    low, names = F.lower("heading"), F.lower(F.concat_ws("\n", "heading", stem(F.col("path"))))
    said, heading = F.concat_ws("\n", "heading", "text", stem(F.col("path"))), F.col("heading")
    if not whole:
        said, heading = words_for(said, terms), words_for(heading, terms)
    rows = sections.withColumns({"_said": said, "_words": heading}).withColumn("tokens", expand_terms(tokenize(F.col("_said"))))
    rows = rows.withColumns({"_m": F.size(F.array_intersect("tokens", wanted)), "_h": F.size(F.array_intersect(tokenize(F.col("_words")), wanted))})
    asked, primary, in_folder = intents(terms), is_primary(F.col("path")), folder(F.col("path"))
    kind = F.when(is_summary(F.col("path"), F.col("heading")), 10 + F.when(F.col("_h") > 0, 12).otherwise(0))
    for name, points in FOLDERS.items():
        kind = kind.when(in_folder == name, points)
    score = F.col("_m") + 3 * F.col("_h") + kind.otherwise(0)
    architecture = primary & _any(names, ARCHITECTURE) if "privacy_storage" in asked else F.lit(False)
    score = score + F.when(architecture, 24).when(primary, PRIMARY_POINTS).otherwise(0)
    if "architecture" in asked:
        score = score + F.when(in_folder.isin(*CORE_FOLDERS) | _any(low, CORE), 8).otherwise(0)
    if "field_mapping" in asked:
        said = F.lower(F.concat_ws("\n", "heading", stem(F.col("path")), F.left("text", F.lit(2000))))
        begin = F.lower(F.left("text", F.lit(2500)))
        mapping = F.array_contains("tokens", MAPPED_SYSTEMS[0]) & F.array_contains("tokens", MAPPED_SYSTEMS[1]) & _any(said, FIELD_MARKS)
        more = score + 24 + F.when(F.contains(begin, F.lit(DIRECT_MARKS[0])) & F.contains(begin, F.lit(DIRECT_MARKS[1])), 18).otherwise(0)
        if "status" not in asked:
            more = F.when(_any(names, STATUS_MARKS), F.greatest(F.lit(1), more - 18)).otherwise(more)
        score = F.when(mapping, more).otherwise(score)
    if "privacy_storage" in asked:
        report = F.contains(names, F.lit(REPORT_MARK)) & _any(names, CORRESPONDENCE_MARKS)
        score = F.when(report, F.greatest(F.lit(1), score - 8)).otherwise(score)
    none = (F.col("_m") == 0) & (F.col("_h") == 0) | (F.trim(low) == GRAPH_LINKS)
    return rows.withColumns({"score": F.when(none, 0).otherwise(score), "authority": authority(F.col("path"), F.col("heading")), "primary": primary}).drop("_m", "_h", "_said", "_words")


def covers(terms: set[str]) -> Column:
    """Whether a section's tokens cover terms: one of up to two; of more two, or one that names a release (``mvp1``)."""
    if not terms:
        return F.lit(False)
    met = F.array_intersect("tokens", F.array(*map(F.lit, sorted(terms))))
    aliases = sorted(t for t in terms if re.match(ALIAS, t))
    if len(terms) <= 2:
        return F.size(met) > 0
    return (F.size(met) >= 2) | (F.arrays_overlap(met, F.array(*map(F.lit, aliases))) if aliases else F.lit(False))


def central(sections: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` most central sections of each project (project, section_id, score, nth), by marks of the heading or file name and the core folder."""
    marked = _any(F.lower("heading"), CENTRAL_MARKS) | _any(F.lower(stem(F.col("path"))), CENTRAL_MARKS)
    points = F.when(marked, CENTRAL_POINTS).otherwise(0) + F.when(folder(F.col("path")) == CORE_FOLDERS[0], CENTRAL_FOLDER_POINTS).otherwise(0)
    rows = sections.select("project", "section_id", "path", "line_start", points.alias("score")).where("score > 0")
    return first_of(rows, ["project"], [F.desc("score"), F.asc("line_start"), F.asc("path"), F.asc("section_id")], min(2, n))


def clip(text: Column) -> Column:
    """A section's text as far as it is taken."""
    return F.when(F.length(text) <= SECTION_CHARS, text).otherwise(F.concat(F.regexp_replace(F.left(text, F.lit(SECTION_CHARS)), r"\s+\z", ""), F.lit(CLIPPED)))


def _take(rows: DataFrame, state: DataFrame, times: int, most: int, max_chars: int) -> tuple[DataFrame, list[DataFrame]]:
    """Up to ``times`` picks a project of rows (project, section_id, score, _o, _size): each the next in order that fits what is left.

    A pick is an aggregate over the project's rows, so they are never gathered.
    """
    picks = []
    for _ in range(times):
        open_ = rows.join(state.where((F.col("_n") < most) & (F.col("_used") < max_chars)), "project")
        fits = ((F.col("_n") == 0) | (F.col("_used") + F.col("_size") <= max_chars)) & (F.col("_last").isNull() | (F.col("_o") > F.col("_last")))
        pick = saved(open_.where(fits).groupBy("project").agg(F.min(F.struct("_o", "section_id", "score", "_size")).alias("_p")))
        picks.append(pick.join(state, "project").select("project", (F.col("_n") + 1).alias("rank"), "_p.section_id", "_p.score", F.col("_p._size").alias("n_chars")))
        after = state.join(pick, "project", "left")
        state = saved(after.select("project", (F.col("_used") + F.coalesce("_p._size", F.lit(0))).alias("_used"), (F.col("_n") + F.col("_p").isNotNull().cast("int")).alias("_n"), F.coalesce("_p._o", "_last").alias("_last")))
    return state, picks


def select_memory(sections: DataFrame, base: set[str], rewrite: set[str] = frozenset(), context: set[str] = frozenset(), max_chars: int = 60_000, max_sections: int = 8) -> DataFrame:
    """(project, rank, section_id, score, n_chars) of the sections of each project that go into a package.

    sections: (project, section_id, path, heading, line_start, text). Sections that
    cover the query's own terms or its rewriting are the anchors; with what they
    link to, and sections of related folders, they are ranked by score and
    authority. In that order each is taken whole if it fits what is left of the
    characters (the first always is) until there are enough; then the most central
    sections fill what remains. A project none of whose sections covers the query
    has no rows. Without query terms all sections that match the context compete
    by score. Long sections count as far as they are taken.
    """
    terms, focus = set(base) | set(rewrite) | set(context), set(base) | set(rewrite)
    scored = with_scores(sections, terms, whole=False).withColumn("_size", F.length(clip(F.col("text"))).cast("long"))
    # Of the texts nothing but their links is read again.
    scored = saved(scored.withColumn("text", F.array_join(F.regexp_extract_all("text", F.lit(WIKI_LINK), F.lit(0)), "|")))
    found = scored.where("score > 0")
    if focus:
        direct = found.where(covers(set(base)) | covers(set(rewrite)))
        ranked = merged(direct, related_sections(scored.drop("text"), direct))
        projects = direct.select("project").distinct()
    else:
        ranked, projects = merged(found), scored.select("project").distinct()
    narrow = scored.select("project", "section_id", "path", "line_start", "authority", "_size")
    place = [-(F.col("score") + F.floor(F.col("authority") / 4)), -F.col("authority")] if focus else [-F.col("score"), F.lit(0)]
    rows = ranked.join(narrow, ["project", "section_id"]).join(projects, "project", "left_semi").where("score > 0")
    rows = saved(rows.select("project", "section_id", "score", F.struct(place[0].cast("long").alias("a"), place[1].cast("long").alias("b"), F.col("line_start").cast("long").alias("c"), "path", F.col("section_id").alias("id")).alias("_o"), "_size"))
    state = saved(projects.select("project", F.lit(0).cast("long").alias("_used"), F.lit(0).alias("_n"), F.lit(None).cast(dict(rows.dtypes)["_o"]).alias("_last")))
    state, picks = _take(rows, state, max_sections, max_sections, max_chars)
    chosen = picks[0]
    for more in picks[1:]:
        chosen = chosen.union(more)
    core = central(scored.drop("score"), max_sections).join(chosen.select("project", "section_id"), ["project", "section_id"], "left_anti").join(narrow.select("project", "section_id", "_size"), ["project", "section_id"])
    core = saved(core.select("project", "section_id", F.col("score").cast("int").alias("score"), F.struct(F.col("nth").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.lit("").alias("path"), F.col("section_id").alias("id")).alias("_o"), "_size"))
    _, fill = _take(core, state.withColumn("_last", F.lit(None).cast(dict(rows.dtypes)["_o"])), min(2, max_sections), max_sections, max_chars)
    for more in fill:
        chosen = chosen.union(more)
    return chosen
