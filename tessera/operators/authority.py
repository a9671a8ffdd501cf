"""Retrieval of operational items under authority: exclusion, ambiguity, budget; and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import bounded_terms, query_terms


def exclusion(items: DataFrame, kinds: list[str], sensitivities: list[str], subjects: list[str] | None = None) -> DataFrame:
    """items with ``reason``: the first that applies of not_active, not_confirmed, unsupported_kind, invalid_record, sensitivity_denied, not_applicable; else empty."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (
        F.when(~F.coalesce(F.col("lifecycle") == "active", F.lit(False)), "not_active")
        .when(~F.coalesce(F.col("confirmation") == "confirmed", F.lit(False)), "not_confirmed")
        .when(~F.coalesce(F.col("kind").isin(kinds), F.lit(False)), "unsupported_kind")
        .when(blank("subject_ref") | blank("value"), "invalid_record")
        .when(~F.coalesce(F.col("sensitivity").isin(sensitivities), F.lit(False)), "sensitivity_denied")
    )
    if subjects:
        reason = reason.when(~F.col("subject_ref").isin(subjects), "not_applicable")
    return items.withColumn("reason", reason.otherwise(""))


def resolve(items: DataFrame) -> DataFrame:
    """Items with ``verdict``: eligible, ambiguous (several eligible ones have its kind and subject) or excluded.

    The count of each (kind, subject) is an aggregate that is joined back.
    """
    counts = items.where("reason = ''").groupBy("scope_ref", "kind", "subject_ref").agg(F.count("*").alias("n"))
    out = items.join(counts, ["scope_ref", "kind", "subject_ref"], "left")
    return out.withColumn("verdict", F.when(F.col("reason") != "", "excluded").when(F.col("n") > 1, "ambiguous").otherwise("eligible")).drop("n")


def sound_partitions(items: DataFrame, valid: str) -> DataFrame:
    """Only items of scopes all of whose records are valid: one bad record closes its scope."""
    bad = items.where(f"not coalesce({valid}, false)").select("scope_ref").distinct()
    return items.join(bad, "scope_ref", "left_anti")


def summaries(turns: DataFrame, last: int = 20, cut: int = 260, total: int = 2400) -> DataFrame:
    """(conv_id, summary, n_turns): a conversation's last messages without the blank ones, each cut, of which the end is kept."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("_nth", F.row_number().over(newest)).withColumn("_text", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    rows = rows.withColumn("_line", F.when(F.col("_text") != "", F.concat(F.lit("- "), "role", F.lit(": "), F.left("_text", F.lit(cut)))))
    out = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.when((F.col("_nth") <= last) & F.col("_line").isNotNull(), F.struct("turn", "_line")))).alias("rows"))
    joined = F.array_join(F.transform("rows", lambda r: r["_line"]), "\n")
    return out.select("conv_id", F.right(joined, F.lit(total)).alias("summary"), "n_turns")


def latest_user_turn(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text) of each conversation's last message by a user that isn't blank."""
    rows = turns.where((F.col("role") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return rows.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last")).select("conv_id", "last.turn", "last.text")


def context_queries(conversations: DataFrame, filler: tuple[str, ...] = (), most: int = 16, length: int = 200) -> DataFrame:
    """(conv_id, turn, query): the latest user turn's terms, then those of the user turn before it, within bounds.

    Both turns are found by aggregates, so that a long conversation isn't sorted
    in one task. Conversations without a user turn that holds text have no row;
    of rows that repeat a turn one counts.
    """
    now = latest_user_turn(conversations)
    earlier = conversations.join(now.select("conv_id", F.col("turn").alias("_latest")), "conv_id").where("turn < _latest")
    before = latest_user_turn(earlier).select("conv_id", F.col("text").alias("_before"))
    query = bounded_terms(query_terms(F.col("text"), filler), query_terms(F.col("_before"), filler), most, length)
    return now.join(before, "conv_id", "left").select("conv_id", "turn", query.alias("query"))
