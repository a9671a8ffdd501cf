"""The given tables as the library's inputs: context items, objects, files, operational records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def context_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as context items; their labels say whether they are confirmed, rejected, in conflict or unseen."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    types = F.array(*(F.lit(t) for t in ("requirement", "decision", "risk", "open_question", "action")))
    status = F.when(F.col("quality").isNull(), "requires_review").when(F.col("toxic") == 1, "conflicted").when(F.col("quality") == 0, "rejected").otherwise("confirmed")
    day = F.lpad((1 + F.pmod("n_chars", F.lit(28))).cast("string"), 2, "0")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("context").alias("kind"), F.col("source").alias("workspace_id"), status.alias("status"), (F.col("n_chars") > 0).alias("current"),
        F.get(types, F.pmod("n_chars", F.lit(5)).cast("int")).alias("item_type"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("statement"),
        F.when(F.col("toxic") == 0, F.upper("lang")).otherwise("").alias("actor_ref"), F.when(F.col("n_chars") > 1000, F.concat(F.lit("2026-02-"), day)).otherwise("").alias("deadline"),
        F.lit("").alias("explicit_status"), F.when(F.col("n_chars") > 3000, "high").otherwise("").alias("priority"), F.concat(F.lit("2026-01-"), day).alias("updated_at"),
        F.array("source").alias("source_links"), F.when(F.col("quality") == 1, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("relation_ids"), F.col("doc_id").alias("seq"),
    )


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown files: a heading for each turn's role, the folder by how long it is."""
    turns = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("# "), F.col("role"), F.lit("\n"), F.coalesce("text", F.lit("")))
    files = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"), F.count("*").alias("n"))
    folders = F.array(*(F.lit(f) for f in ("10_Branches", "20_Decisions", "30_Open_Questions", "40_Risks", "50_Sources")))
    name = F.concat(F.get(folders, F.pmod("n", F.lit(5)).cast("int")), F.lit("/"), F.col("conv_id").cast("string"), F.lit(".md"))
    return files.select(F.concat(F.lit("P"), F.pmod("n", F.lit(3)).cast("string")).alias("project"), name.alias("path"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("text"))


def operational_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as operational records of customers."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("scope_ref"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("subject_ref"),
        F.col("o_totalprice").cast("string").alias("value"), F.when(F.year("o_orderdate") >= 1994, "active").otherwise("retired").alias("lifecycle"),
        F.when(F.col("o_totalprice") > 50000, "confirmed").otherwise("proposed").alias("confirmation"), F.when(F.col("o_totalprice") > 400000, "restricted").otherwise("standard").alias("sensitivity"),
    )


def registry_objects(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """Line items, orders, customers and nations as objects, each made from the one before; each line item ``once``, or as often as it is given."""
    def kind(name: str, id_: str, parent: str | None, table_: str) -> DataFrame:
        df = table(spark, sf_dir, table_)
        own = F.concat_ws(":", F.lit(name), *(F.col(c).cast("string") for c in id_.split(",")))
        up = F.concat(F.lit(parent), F.lit(":"), F.col(PARENT[name]).cast("string")) if parent else F.lit(None).cast("string")
        return df.select(own.alias("id"), F.lit(name).alias("kind"), up.alias("parent_id"))

    items = kind("context", "l_orderkey,l_linenumber", "sanitized", "lineitem")
    return (
        kind("source", "n_nationkey", None, "nation").union(kind("extraction", "c_custkey", "source", "customer"))
        .union(kind("sanitized", "o_orderkey", "extraction", "orders")).union(items.distinct() if once else items)
    )


PARENT = {"extraction": "c_nationkey", "sanitized": "o_custkey", "context": "l_orderkey"}
