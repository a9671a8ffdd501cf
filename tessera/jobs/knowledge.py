"""Queries on memory, chunks, evidence and packages over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import answers, excerpts, text
from tessera.operators import chunks, conflicts, containment, corpora, evidence, masking, memory, packages, projects, protection, records, sections
from tessera.sources.tables import table

#: What the memory queries ask for.
FOCUS = ["les", "und", "ing", "tion", "que", "mit", "los", "des"]


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections of their source's memory: long capitalised words are links, the folder follows the length."""
    folders = F.array(*(F.lit(f) for f in ("10_Branches", "20_Decisions", "30_Open_Questions", "40_Risks", "50_Sources", "Исходники", "00_Core")))
    path = F.concat(F.get(folders, F.pmod("n_chars", F.lit(7)).cast("int")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project"), F.col("doc_id").cast("string").alias("section_id"), path.alias("path"), F.split("text", "\n")[0].alias("heading"),
        F.col("doc_id").alias("line_start"), F.regexp_replace("text", "([A-Z][a-z]{7,})", "[[$1]]").alias("text"),
    )


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections with scores."""
    return containment.saved(memory.with_authority(sections.score(_sections(spark, sf_dir), FOCUS)))


def _covered() -> Column:
    return sections.covered(F.col("matches"), len(FOCUS))


def related_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _memory(spark, sf_dir)
    return memory.related_sections(scored.drop("text"), scored.where(_covered() & (F.col("score") > 0)))


def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty best of covered and related sections of each project."""
    scored = _memory(spark, sf_dir)
    direct = scored.where(_covered() & (F.col("score") > 0))
    both = memory.merged(direct, memory.related_sections(scored.drop("text"), direct)).join(scored.select("project", "section_id", "path", "line_start", "authority"), ["project", "section_id"])
    return memory.first_of(both, ["project"], memory.candidate_order(), 40, "rank").select("project", "rank", "section_id", "score", "authority")


def evidence_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source, and for one without memory, the evidence behind its five best sections."""
    scored = _memory(spark, sf_dir)
    narrow = scored.where(_covered() & (F.col("score") > 0)).drop("text")
    selected = memory.first_of(narrow, ["project"], memory.candidate_order(), 5, "rank").select("project", "section_id", "rank")
    projects = scored.select("project").union(spark.createDataFrame([("none",)], "project string"))
    out = memory.evidence_plan(projects, scored, selected, _covered(), FOCUS)
    return out.select("project", "nth", "tier", "status", "reason", "section_id", "path", F.sha2(F.col("excerpt").cast("binary"), 256).alias("sha256"))


def memory_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each source's documents goes into a package of 9,000 characters."""
    return memory.select_memory(_sections(spark, sf_dir), {"les", "und"}, {"ing", "tion", "que"}, {"mit", "los", "des"}, 9000, 6)


def unindexed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark whose beginning and end no document holds."""
    ends = F.array(F.left("text", F.lit(40)), F.right("text", F.lit(40)))
    sources = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source_id"), ends.alias("needles"))
    return containment.unindexed(sources, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown with typed sections: each line a paragraph, what follows a comma a list item."""
    lines = F.split("text", "\n")
    items = lambda text: F.replace(F.replace(text, F.lit("\n"), F.lit("\n\n")), F.lit(", "), F.lit(",\n- "))
    rest = F.array_join(F.slice(lines, 2, F.size(lines)), "\n")
    text = F.concat(F.lit("# "), "lang", F.lit("\n\n## Риски\n\n"), items(lines[0]), F.lit("\n\nДействия:\n\n### "), "source", F.lit("\n\n"), items(rest))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def context_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.context_chunks(_briefs(spark, sf_dir), 120)
    return out.select("doc_id", "index", "start", "end", "boundary", "heading", F.array_join("stack", " > ").alias("stack"), "type_hint", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of at most 400 characters packed into chunks of at most 1,500 characters and 12 units, with an overlap of 300."""
    return chunks.packed_chunks(chunks.semantic_units(table(spark, sf_dir, "documents").select("doc_id", "text"), 400), 1500, 12, 300)


def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.evidence_spans(chunks.context_chunks(_briefs(spark, sf_dir), 1500))
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["id"], s["global_start"].cast("string"), s["global_end"].cast("string"))), ",")
    return out.select("doc_id", "index", F.size("spans").alias("n_spans"), places.alias("places"), F.sha2(F.array_join(F.transform("spans", lambda s: s["text"]), "|").cast("binary"), 256).alias("sha256"))


def grounded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that name the first and the third span of each chunk."""
    spans = containment.saved(chunks.evidence_spans(chunks.context_chunks(_briefs(spark, sf_dir), 1500)).select("doc_id", "index", "type_hint", "spans"))
    named = spans.select("doc_id", "index", F.lit("fact").alias("type"), F.explode(F.array(F.lit("E1"), F.lit("E3"))).alias("evidence_id")).withColumn("candidate_id", F.concat("evidence_id", F.lit("-1")))
    return evidence.ground_spans(named, spans)


def supporting_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as materials: the assistant's turns and quotes of the user's as statements, the user's turns as fragments."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "extraction_id")
    none = F.array().cast("array<string>")
    says = turns.where("role = 'assistant'").select("extraction_id", F.col("turn").cast("string").alias("context_id"), "text", F.when(F.pmod("turn", F.lit(4)) == 3, F.array((F.col("turn") - 1).cast("string"), F.lit("x"))).otherwise(none).alias("explicit"))
    quotes = turns.where("role = 'user'").select("extraction_id", F.concat(F.lit("q"), F.col("turn").cast("string")).alias("context_id"), F.substring("text", 5, 30).alias("text"), none.alias("explicit"))
    ready = turns.where("role = 'user'").select("extraction_id", F.col("turn").cast("string").alias("evidence_id"), F.when(F.pmod("turn", F.lit(5)) == 4, "failed").otherwise("ready").alias("state"), "text")
    return evidence.supporting_evidence(says.union(quotes), ready)


def grounded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six candidates of each document that name its first line, a piece across lines, a piece that isn't there, nothing, or something unknown."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "sanitized_id")
    piece = lambda id_, text, modality, state: F.struct(F.lit(id_).alias("evidence_id"), text.alias("text"), F.lit(modality).alias("modality"), state.alias("state"))
    ready, failed = F.lit("ready"), F.when(F.pmod("n_chars", F.lit(5)) == 0, "failed").otherwise("ready")
    pieces = docs.select("sanitized_id", F.inline(F.array(
        piece("p1", F.concat(F.lit("\n  "), F.split("text", "\n")[0], F.lit(" \n\n")), "text", ready), piece("p2", F.substring("text", 50, 60), "image", failed),
        piece("p3", F.lit("nowhere in it"), "table", ready), piece("p4", F.split("text", "\n")[0], "sound", ready))))
    asks = (("c1", ["p1"], ["text"]), ("c2", ["p1", "p2"], ["text", "image"]), ("c3", ["p2", "p3"], []), ("c4", [], []), ("c5", ["p1", "p9"], []), ("c6", ["p1"], ["image"]), ("c7", ["p4"], []))
    ask = lambda a: F.struct(F.lit(a[0]).alias("candidate_id"), F.array(*map(F.lit, a[1])).cast("array<string>").alias("evidence_ids"), F.array(*map(F.lit, a[2])).cast("array<string>").alias("required"))
    wanted = docs.select("sanitized_id", F.inline(F.array(*map(ask, asks))))
    out = evidence.grounded_candidates(wanted, pieces, docs.select("sanitized_id", F.col("text").alias("body")))
    places = F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["evidence_id"], b["start"].cast("string"), b["end"].cast("string"))), ",")
    return out.select("sanitized_id", "candidate_id", "outcome", places.alias("places"))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests; their orders as inputs, the layer by priority, the cost by price, the handling by status."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    layer = F.when(F.col("o_orderpriority") == "1-URGENT", "authority").when(F.col("o_orderpriority") == "2-HIGH", "ambiguity").when(F.col("o_orderpriority") == "3-MEDIUM", "memory").otherwise("session")
    handling = F.when(F.col("o_orderstatus") == "F", "standard").when(F.col("o_orderstatus") == "O", "restricted").otherwise("unknown")
    rows = orders.select(F.col("o_custkey").alias("package_id"), layer.alias("layer"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("ref"), F.floor(F.col("o_totalprice") / 10).alias("cost"), handling.alias("handling"))
    cost = F.when(F.col("c_acctbal") < -800, 60001).otherwise(F.length("c_name")).cast("long")
    return rows.union(customers.select(F.col("c_custkey").alias("package_id"), F.lit("request"), F.lit(0).cast("long"), F.col("c_name"), cost, F.lit("standard")))


def context_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.context_packages(_inputs(spark, sf_dir), 60_000)[0]


def omitted_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.context_packages(_inputs(spark, sf_dir), 60_000)[1]


def dialogue_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memory, the line items of the order with the document's number as context."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("package_id"), "text")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("package_id"), F.col("l_linenumber").alias("seq"), F.floor(F.col("l_quantity") * 20).alias("cost"))
    out = packages.dialogue_contexts(docs, items, 2000, 600, 3)
    return out.select("package_id", F.sha2(F.col("memory_text").cast("binary"), 256).alias("sha256"), "memory_chars", "context_chars", "n_selected", "n_included")


def masking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents masked by the chain of rules; of every eleventh length masking isn't available, of every thirteenth a review found more."""
    docs = table(spark, sf_dir, "documents")
    out = masking.masking_report(docs, reviewed=F.pmod("n_chars", F.lit(13)) == 0, available=F.pmod("n_chars", F.lit(11)) != 0)
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("doc_id", "status", "total", counts.alias("counts"), "suspected", "unresolved", "by_hand", F.sha2(F.col("masked").cast("binary"), 256).alias("sha256"))


def fully_protected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under the whole table of rules."""
    out = protection.protect(table(spark, sf_dir, "documents"), protection.RULES)
    names = F.array_join(F.transform("findings", lambda f: f["pseudonym"]), ",")
    return out.select("doc_id", "status", F.size("findings").alias("n_findings"), names.alias("pseudonyms"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def focused_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", excerpts.focused(F.col("text"), ["license", "tion", "ung", "contact", "eux"], 1200, 100, 400).alias("excerpt"))


def _operations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as records of their customers' partitions, and confirmations of which some disagree with them."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "requirement").when(F.col("o_orderpriority") == "2-HIGH", "decision").when(F.col("o_orderpriority") == "5-LOW", "open_question").otherwise("risk")
    base = orders.select(
        F.lit("project").alias("scope"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("scope_ref"), key.alias("id"), kind.alias("kind"), F.col("o_orderstatus").alias("subject_ref"), F.col("o_totalprice").cast("string").alias("value"),
        F.lit("").alias("reference"), F.lit("").alias("source_ref"), F.concat(F.lit("k"), key).alias("candidate_ref"), F.when(F.col("o_orderstatus") == "F", "retired").otherwise("active").alias("lifecycle"), F.lit("confirmed").alias("confirmation"),
        F.concat(F.lit("e"), key).alias("confirmation_ref"), F.lit("standard").alias("sensitivity"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), key)).otherwise("").alias("supersedes_id"), F.lit("2026-01-01").alias("created_at"), F.lit("2026-01-02").alias("updated_at"), "o_orderkey", "o_totalprice",
    )
    odd = lambda n: F.pmod(F.floor("o_totalprice"), F.lit(n)) == 0
    items = base.withColumns({"kind": F.when(odd(151), "wish").otherwise(F.col("kind")), "subject_ref": F.when(odd(157), "no ref").otherwise(F.col("subject_ref"))}).drop("o_orderkey", "o_totalprice")
    action = F.when((F.col("supersedes_id") != "") != odd(163), "replacement").otherwise("promotion")
    proof = base.where(~odd(167)).select(
        "scope", "scope_ref", F.col("confirmation_ref").alias("id"), action.alias("action"), F.when(odd(173), F.concat("id", F.lit("0"))).otherwise(F.col("id")).alias("target_item_id"), F.lit("actor").alias("actor_ref"),
        F.when(odd(179), "s").otherwise("").alias("source_ref"), "candidate_ref", "created_at",
    )
    return items, proof


def closed_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.partitions(*_operations(spark, sf_dir))


def partition_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of partitions that stay open."""
    return records.open_items(*_operations(spark, sf_dir)).select("scope_ref", "id")


def _admission(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of two sources as what is known, then all documents as uploads: files are named by their length, a workspace is a language."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("-"), F.pmod("n_chars", F.lit(40)).cast("string"), F.when(F.pmod("n_chars", F.lit(9)) == 0, ".exe").otherwise(".txt"))
    uploads = docs.select(F.col("lang").alias("workspace_id"), F.col("doc_id").cast("string").alias("upload_id"), F.col("doc_id").alias("seq"), name.alias("filename"), F.col("text").alias("content"), projects.refusal(name, F.col("text")).alias("refusal"), "source")
    none = spark.createDataFrame([], "workspace_id string, upload_id string, seq long, source_id string, checksum string, name_key string, current boolean")
    first, _ = records.admit(none, uploads.where("source in ('src0', 'src3')"))
    return records.admit(first, uploads)


def admitted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _admission(spark, sf_dir)[0].select("workspace_id", "upload_id", "source_id", "current")


def admission_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _admission(spark, sf_dir)[1]


def resolved_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as items, each in conflict with the next two; their events as decisions and resolutions."""
    log = table(spark, sf_dir, "events")
    users = log.select(F.col("user_id").alias("id")).distinct()
    relations = users.where("id % 7 > 0").select("id", F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("related_id"))
    action = F.when(F.col("event_type") == "click", "confirm").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "purchase", "choose_current").when(F.col("event_type") == "signup", "keep_both").otherwise(F.when(F.col("event_id") % 3 == 0, "keep_open").otherwise("edit"))
    return conflicts.resolved_conflicts(users, log.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), action.alias("action")), relations)


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers of a model with one candidate each: in a fence, among words, or broken, by the number."""
    n = F.col("event_id")
    title = F.when(n % 13 == 0, F.lit("")).otherwise(F.col("event_type"))
    fields = F.struct(
        F.when(n % 17 == 0, "wish").otherwise("risk").alias("type"), title.alias("title"), F.col("event_type").alias("statement"), F.when(n % 19 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("E"), (n % 3).cast("string"))).alias("evidence_id"),
        F.when(n % 23 == 0, "sure").otherwise("low").alias("confidence"), (n % 29 > 0).alias("requires_review"), F.when(n % 31 == 0, "odd").alias("odd"),
    )
    whole = F.concat(F.lit('{"candidates":['), F.to_json(fields), F.lit("]}"))
    said = F.when(n % 5 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(n % 5 == 2, F.concat(F.lit("So: "), whole, F.lit(" ."))).when(n % 5 == 3, F.concat(whole, whole)).otherwise(whole)
    return table(spark, sf_dir, "events").select("event_id", said.alias("answer"))


def answer_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the answers break, of those that hold an object; the first two pieces of evidence are known."""
    found = answers.fenced_object(F.col("answer"))
    rows = _said(spark, sf_dir).select("event_id", found.alias("found"))
    return rows.select("event_id", F.when(F.col("found").isNull(), "no_object").otherwise(answers.answer_fault(F.col("found"), F.array(F.lit("E1"), F.lit("E2")))).alias("fault"))


def fragment_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on documents, of three kinds by length, and what they say of duties, dates, states and priorities."""
    kind, who = F.pmod("n_chars", F.lit(3)), F.concat(F.lit("["), "source", F.lit("]"))
    said = F.when(kind == 0, F.concat(F.lit("Ответственный "), who, F.lit(", до 5 марта 2026 года. Статус: "), "lang", F.lit("; дальше"))).when(kind == 1, F.concat(F.lit("Ответственный "), who, F.lit(" пока не назначен, к концу месяца.\nПРИОРИТЕТ: "), "lang"))
    said = said.otherwise(F.concat(F.lit("Встреча не назначена на 3 мая 2026 года, должен быть "), who))
    return table(spark, sf_dir, "documents").select("doc_id", evidence.metadata(said).alias("m")).select("doc_id", "m.*")


def _project_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files of their sources' projects, what each is by its length; languages but one as groups."""
    n, id_ = F.col("n_chars"), F.col("doc_id").cast("string")
    title = F.when(n % 5 == 0, "").otherwise(F.col("lang"))
    status = F.when(n % 3 == 0, "archived").when(n % 3 == 1, "active").otherwise("odd")
    heirs = F.when(n % 2 == 0, ', "context_inheritance": false').otherwise("")
    meta = F.when(n % 7 == 0, F.lit("{bad")).otherwise(F.concat(F.lit('{"title": "'), title, F.lit('", "status": "'), status, F.lit('", "group_code": " '), "lang", F.lit('"'), heirs, F.lit("}")))
    names = [
        F.concat(F.lit("K"), (n % 3).cast("string"), F.lit(" - Память.md")), F.lit("Память.md"), F.concat(F.lit("Память_Graph/20_Decisions/"), id_, F.lit(".md")), F.concat(F.lit("Память_Graph/90_Archive/"), id_, F.lit(".md")),
        F.concat(F.lit("Исходники/"), id_, F.lit(".TXT")), F.concat(F.lit("Транскрипции/a/"), id_, F.lit(".exe")), F.lit("K0 - Источники.md"), F.lit("project.json"),
    ]
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.get(F.array(*names), F.pmod(n, F.lit(8)).cast("int")).alias("path"), F.when(F.pmod(n, F.lit(8)) == 7, meta).otherwise(F.col("text")).alias("text"), "lang")
    return rows.drop("lang"), rows.where("lang <> 'es'").select(F.col("lang").alias("code"), F.upper("lang").alias("title")).distinct()


def project_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.projects(*_project_files(spark, sf_dir), archived=True)


def project_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, groups = _project_files(spark, sf_dir)
    return corpora.corpus(files, corpora.projects(files, groups))


def source_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, groups = _project_files(spark, sf_dir)
    out = corpora.primary_sections(files, corpora.corpus(files, corpora.projects(files, groups)))
    return out.select("project", "path", "heading", "line_end", "scope", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def inherited_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections of their language's group, for each project that inherits from it."""
    sections_ = table(spark, sf_dir, "documents").select(F.col("lang").alias("group_code"), F.concat("source", F.lit(".md")).alias("path")).distinct()
    return corpora.inherited(corpora.projects(*_project_files(spark, sf_dir)), sections_)


def document_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names from the documents' first lines."""
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(F.split("text", "\n")[0]).alias("slug"))


def dictionary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under the rules of a dictionary alone: whole words only."""
    rules = protection.dictionary_rules({"Word": ["les", "und", "with"], "Name": ["license", "  "]})
    out = protection.protect(table(spark, sf_dir, "documents"), rules)
    return out.select("doc_id", "status", F.size("findings").alias("n_findings"), F.size(F.filter("findings", lambda f: f["category"] == "Name")).alias("n_names"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and name != "queries" and not name.startswith("_")}
