"""Queries on protection, reviews, projects and excerpts over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import excerpts, text
from tessera.operators import chunks, projects, protection, reviews, search
from tessera.sources.tables import context_items, markdown_files, operational_items, table

RULES = [
    protection.Rule("Email", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}", True),
    protection.Rule("Link", r"https?://[^\s<>]+", True),
    protection.Rule("Phone", r"\+[0-9][0-9 ().-]{6,}[0-9]", True),
    protection.Rule("Address", r"([0-9]{1,3}\.){3}[0-9]{1,3}", True),
    protection.Rule("Number", r"[0-9]{4,}"),
]


def protected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = protection.protect(table(spark, sf_dir, "documents"), RULES)
    names = F.array_join(F.transform("findings", lambda f: f["pseudonym"]), ",")
    return out.select("doc_id", "status", F.size("findings").alias("n_findings"), names.alias("pseudonyms"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as artifacts, large line items as findings, closed line items as decisions."""
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "artifact_id", "l_linenumber": "finding_id", "l_partkey": "seq"})
    decision = F.when(F.col("l_returnflag") == "R", "replace").when(F.col("l_returnflag") == "A", "keep").otherwise("change_category")
    decided = rows.where("l_linestatus = 'F'").select("artifact_id", "finding_id", "seq", decision.alias("decision"))
    return reviews.review_states(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact_id")), rows.where("l_quantity > 25"), decided)


def item_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred items of each user, and the user's events as decisions on them."""
    action = F.when(F.col("event_type") == "click", "confirm").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "purchase", "edit").when(F.col("event_type") == "signup", "duplicate").otherwise("view")
    log = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.pmod("event_id", F.lit(100))).alias("id"), F.col("event_id").alias("seq"), action.alias("action"))
    return reviews.item_states(log.select("id").distinct(), log)


def item_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which two in three replace the one before them; closed ones are retired."""
    orders = table(spark, sf_dir, "orders")
    place = F.pmod("o_orderkey", F.lit(3))
    items = orders.select(F.col("o_orderkey").alias("id"), F.when(place > 0, F.col("o_orderkey") - place).alias("supersedes_id"))
    out = reviews.lifecycles(items, orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))
    return out.select("id", "lifecycle", F.array_join("successors", ",").alias("successors"))


def competing_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.competing(operational_items(spark, sf_dir).where("confirmation = 'proposed'"))


def linked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents as items, odd ones as candidates."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("workspace_id"), F.lit("fact").alias("item_type"), F.col("text").alias("statement"), "doc_id", "source")
    return reviews.linked_or_new(docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "id"), docs.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "seq"))


def material_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sources, their customers as extractions, those's orders as sanitized texts with reviews by line items."""
    def objects(kind: str, rows: DataFrame, id_: str, parent: str, current: str, created: str) -> DataFrame:
        own = F.concat(F.lit(f"{kind}:"), F.col(id_).cast("string"))
        return rows.select(own.alias("id"), F.lit(kind).alias("kind"), F.expr(parent).alias("parent_id"), F.expr(current).alias("current"), F.col(id_).cast("long").alias("seq"), F.expr(created).alias("created_at"))

    all_ = objects("source", table(spark, sf_dir, "nation"), "n_nationkey", "cast(null as string)", "true", "n_name")
    all_ = all_.union(objects("extraction", table(spark, sf_dir, "customer"), "c_custkey", "concat('source:', c_nationkey)", "c_acctbal > 0", "''"))
    all_ = all_.union(objects("sanitized", table(spark, sf_dir, "orders"), "o_orderkey", "concat('extraction:', o_custkey)", "o_orderstatus <> 'F'", "''"))
    state = F.when(F.bool_and(F.col("l_linestatus") == "F"), "confirmed").otherwise("requires_review")
    checked = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("sanitized:"), F.col("l_orderkey").cast("string")).alias("artifact_id")).agg(state.alias("state"))
    return reviews.materials(all_, checked)


def file_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    content = F.when(F.col("doc_id") % 2 == 0, F.coalesce("text", F.lit(""))).otherwise("x")
    return reviews.integrity(files, docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.sha2(content.cast("binary"), 256).alias("checksum")))


def refused_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.get(F.array(*(F.lit(s) for s in (".TXT", ".md", ".pdf", ".exe"))), F.pmod("doc_id", F.lit(4)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", projects.refusal(F.concat("source", suffix), F.col("text")).alias("reason"))


def candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", projects.is_candidate(path, ("html", "htm"), ("fr", "tmp"), ("1.html",)).alias("candidate"))


def indexed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a pipe table; every seventh lacks its last two cells."""
    mode = F.when(F.col("o_orderstatus") == "P", " Only Source ").otherwise("full")
    memory = F.when(F.col("o_orderpriority") == "5-LOW", "in memory").otherwise("not mentioned")
    comment = F.when(F.col("o_totalprice") > 400000, "see: covered in [[Index]]").otherwise("")
    start = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), mode, F.lit(" | "), F.when(F.col("o_orderpriority") == "1-URGENT", "done").otherwise("open"))
    row = F.when(F.col("o_orderkey") % 7 == 0, start).otherwise(F.concat(start, F.lit(" | "), memory, F.lit(" | "), comment, F.lit(" |")))
    return table(spark, sf_dir, "orders").select("o_orderkey", projects.registry_row(row, "only source", "not mentioned", "done", ("covered in [[", "covered by memory")).alias("indexed"))


def project_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = markdown_files(spark, sf_dir).select("project", F.split("path", "/")[0].alias("folder"))
    sources = table(spark, sf_dir, "documents").select(F.concat(F.lit("P"), F.pmod("doc_id", F.lit(4)).cast("string")).alias("project"), F.col("lang").alias("status"))
    return projects.health(files, sources, "fr")


def planned_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.concat("lang", F.pmod("n_chars", F.lit(50)).cast("string"))
    return projects.plan_groups(table(spark, sf_dir, "documents").select(F.col("source").alias("package"), F.col("doc_id").alias("seq"), context.alias("context"), F.col("doc_id").cast("string").alias("name"), "text"))


def gated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.split("text", "\n")[0], " ")
    title = F.array_join(F.slice(words, F.lit(1), (1 + F.pmod("doc_id", F.lit(5))).cast("int")), " ")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.concat("lang", F.lit("/"), F.lower(title)).alias("target"), title.alias("title"), F.when(F.col("doc_id") % 2 == 0, "source_summary").otherwise("decision").alias("category"), (F.col("n_chars") > 500).alias("durable"))
    return projects.quality_gate(rows)


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = excerpts.clean_list(text.query_terms(F.col("text")), 12, 20)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, " ").alias("terms"), F.size(found).alias("n_terms"))


def document_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", excerpts.window(F.col("text"), ["tion", "ungen"], 300).alias("excerpt"))


def document_keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = excerpts.keyword_lines(F.col("text"), ["tion", "mente"])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, "\n").alias("lines"), F.size(found).alias("n_lines"))


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as a model would answer, in a fence with words around it; every ninth answer has none."""
    answer = F.when(F.col("event_id") % 9 == 0, "none").otherwise(F.concat(F.lit("Here you are:\n```json\n"), "props", F.lit("\n```")))
    k = F.from_json(excerpts.json_object(answer), "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(k.between(0, 49), "low").when(k.between(50, 99), "high").otherwise("invalid").alias("grade"))


def stale_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of ten days and more before February; every tenth has a time that can't be read."""
    at = F.when(F.col("event_id") % 10 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").where(excerpts.older_than(at, F.lit("2024-02-01 00:00:00").cast("timestamp"), 864000)).select("event_id")


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page_summary(context_items(spark, sf_dir), search.Params("that stion", actor_presence="present", limit=20, offset=5))


def chosen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's items name by three times their number, in the items' order."""
    ids = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("id"), F.col("item_id").alias("pos"))
    return search.chosen(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars"), ids).orderBy("pos")


def heading_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of conversations with the headings above it: turns have three levels, two in five are fenced code."""
    turn = F.col("turn")
    part = F.concat(F.when(turn % 5 == 3, "```\n").otherwise(""), F.repeat(F.lit("#"), (1 + turn % 3).cast("int")), F.lit(" "), "role", F.lit(" "), turn.cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.when(turn % 5 == 4, "\n```").otherwise(""))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    docs = docs.select("conv_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("text"))
    lines = docs.select("conv_id", F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n")))).alias("line"))
    out = chunks.heading_stacks(lines, chunks.headings(docs, "conv_id"), "conv_id")
    return out.select("conv_id", "line", F.array_join("stack", " > ").alias("stack"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and name != "queries"}
