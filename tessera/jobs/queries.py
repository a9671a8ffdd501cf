"""The library's own queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import privacy, text
from tessera.operators import authority, candidates, chunks, provenance, search, sections
from tessera.sources.tables import context_items, markdown_files, operational_items, registry_objects, table
from tessera.streaming import events

#: The terms of the section queries.
TERMS = ["that", "les", "und", "mit", "que", "dans", "como", "assistant"]


def section_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best covered sections of each project that fit the character budget."""
    scored = sections.score(sections.scan_sections(markdown_files(spark, sf_dir)), TERMS)
    scored = scored.where(sections.covered(F.col("matches"), len(TERMS)))
    narrow = scored.select("project", "path", "line_start", "score", F.length("text").alias("n_chars"))
    return sections.fit_budget(sections.best(narrow, 24), 6000, size=F.col("n_chars")).select("project", "path", "line_start", "rank", "score", "n_chars")


def section_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.scan_sections(markdown_files(spark, sf_dir))
    return out.select("project", "path", "heading", "line_start", "line_end", "section_id", F.length("text").alias("n_chars"))


def section_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.score(sections.scan_sections(markdown_files(spark, sf_dir)), TERMS)
    return out.select("section_id", "matches", "score", sections.covered(F.col("matches"), len(TERMS)).alias("covered"))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.sha2(F.array_join(tokens, " ").cast("binary"), 256).alias("tokens_sha256"), text.estimated_tokens(F.col("text")).alias("token_bound"))


def item_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(context_items(spark, sf_dir), search.Params("that stion", actor_presence="present", limit=20, offset=5))


def item_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching(context_items(spark, sf_dir), search.Params("les ment", deadline_presence="present")).select("id", "item_type", "score")


def item_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(context_items(spark, sf_dir))


def item_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.overview(context_items(spark, sf_dir))


def item_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"decision": 3, "action": 5, "risk": 5, "open_question": 5}
    return search.highlights(context_items(spark, sf_dir), limits).select("item_type", "rank", "id", "updated_at", "deadline")


def item_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summary lists of unrelated items with a deadline."""
    out = search.sections(context_items(spark, sf_dir), conflict=False, deadline=True)
    return out.select("id", "item_type", "status", "actor_ref", "deadline", "updated_at")


def intake_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return provenance.intake(docs.select(F.col("source").alias("workspace_id"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("doc_id").alias("seq")))


def object_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("seq"))
    return provenance.versions(rows, ["owner"]).drop("seq")


def object_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = provenance.lineage(spark, registry_objects(spark, sf_dir, once=False))
    return out.select("id", "root_id", "depth", F.array_join("path", ">").alias("path"))


def object_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = registry_objects(spark, sf_dir).withColumn("parents", F.array_compact(F.array("parent_id")))
    return provenance.object_counts(objects)


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.latest_state(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"], ["value", "props"])


def absent_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders as a table, to which all customers are offered."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("origin", F.lit("order"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin"))
    return provenance.insert_if_absent(orders, customers, ["id"], ["origin"])


def expired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("mtime"))
    return provenance.expired(files, 10, 1706572800.0)


def recent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred diagnostics: the limit is the log's own."""
    return provenance.last_records(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["event_id"])


def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.when(F.col("n_chars") > 2000, "high").when(F.col("n_chars") > 500, "medium").otherwise("low")
    return candidates.deduplicate(docs.select(F.col("doc_id").alias("seq"), F.col("lang").alias("item_type"), F.col("text").alias("statement"), size.alias("confidence"), F.col("source").alias("block")))


def item_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "decision").otherwise("risk")
    return candidates.conflicts(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("workspace_id"), kind.alias("item_type"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("statement")))


def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spans of days around their dates against line items shipped by the same order."""
    day = lambda c: F.datediff(F.col(c), F.lit("1990-01-01")).cast("long")
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), day("o_orderdate").alias("start"), (day("o_orderdate") + 60).alias("end"))
    right = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), day("l_shipdate").alias("start"), (day("l_shipdate") + F.col("l_linenumber") * 5).alias("end"))
    return candidates.overlapping(left, right, ["key"])


def sensitive_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = [f"n_{kind.lower()}" for kind in privacy.MASKS]
    counted = docs.select("doc_id", privacy.any_topic(F.col("text")).alias("topic"), *(privacy.count(F.col("text"), kind).alias(n) for kind, n in zip(privacy.MASKS, names, strict=True)))
    return counted.select("doc_id", (F.greatest(*names) > 0).alias("concrete"), "topic", *names)


def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = privacy.mask(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return masked.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("masked_sha256"))


def strictest_handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = operational_items(spark, sf_dir)
    level = F.when(F.col("sensitivity") == "restricted", "restricted").when(F.col("lifecycle") == "retired", "unknown").otherwise("standard")
    return items.groupBy("scope_ref").agg(privacy.strictest(level).alias("handling"), (F.max(privacy.level(level)) == 0).alias("external_allowed"))


def authority_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = authority.exclusion(operational_items(spark, sf_dir), ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["standard"])
    return authority.resolve(items).select("id", "reason", "verdict")


def sound_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = authority.sound_partitions(operational_items(spark, sf_dir), "cast(value as double) > 2000")
    return items.groupBy("scope_ref").agg(F.count("*").alias("n"))


def conversation_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authority.summaries(table(spark, sf_dir, "conversations"))


def latest_user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authority.latest_user_turn(table(spark, sf_dir, "conversations"))


def context_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authority.context_queries(table(spark, sf_dir, "conversations"), ("of", "to", "und", "les"))


def group_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with how many projects each has, those without any included."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    counts = nations.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("projects"))
    return regions.join(counts, "r_regionkey", "left").select(F.col("r_name").alias("title"), F.coalesce("projects", F.lit(0)).alias("projects"))


def compact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = text.head_and_tail(F.col("text"), 600)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(short).alias("n_chars"), F.sha2(short.cast("binary"), 256).alias("sha256"), text.stable_id(F.col("source"), F.col("lang"), F.col("text")).alias("item_id"))


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.semantic_units(table(spark, sf_dir, "documents").select("doc_id", "text"), 4000)
    return out.select("doc_id", "start", "end", "boundary", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def errors_after_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the user's latest click at or before it."""
    rows = table(spark, sf_dir, "events")
    clicks = rows.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return chunks.last_before(rows.where("event_type = 'error'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "click").drop("ts")


def open_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest two hundred open documents: the limit is the inbox's own."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    state = labels.groupBy(F.col("doc_id").alias("id")).agg(F.when(F.min("quality") == 0, "ignored").otherwise("seen").alias("status"))
    files = docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("mtime"))
    return chunks.inbox(files, state, docs.where("source = 'src0'").select(F.col("doc_id").alias("id")), ["ignored", "processed"])


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.hourly(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and name != "queries"}
