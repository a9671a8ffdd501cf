"""Candidates of statements: deduplication, conflicts and spans that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENCE = ("low", "medium", "high")


def folded(text: Column) -> Column:
    """Trimmed, without regard to case."""
    return F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("ß"), F.lit("ss"))


def deduplicate(candidates: DataFrame) -> DataFrame:
    """One row for each (item_type, folded statement): the first by seq, with the highest confidence and how many blocks.

    candidates: (seq, item_type, statement, confidence, block). Unknown
    confidences rank lowest.
    """
    rank = F.coalesce(*(F.when(F.col("confidence") == c, i) for i, c in enumerate(CONFIDENCE)), F.lit(0))
    rows = candidates.withColumns({"_key": F.sha2(folded(F.col("statement")).cast("binary"), 256), "_rank": rank})
    out = rows.groupBy("item_type", "_key").agg(F.min("seq").alias("seq"), F.max("_rank").alias("_rank"), F.count_distinct("block").alias("blocks"), F.count("*").alias("merged"))
    return out.select("seq", "item_type", F.get(F.lit(list(CONFIDENCE)), F.col("_rank")).alias("confidence"), "blocks", "merged")


def conflicts(items: DataFrame) -> DataFrame:
    """items (id, workspace_id, item_type, title, statement) with n_other: how many of the same title say something else.

    Counted from sums over titles and over (title, statement), without joining
    the items of a title with each other.
    """
    rows = items.select("id", "workspace_id", "item_type", F.sha2(folded(F.col("title")).cast("binary"), 256).alias("_title"), F.sha2(F.coalesce("statement", F.lit("")).cast("binary"), 256).alias("_said"))
    group = ["workspace_id", "item_type", "_title"]
    said = rows.groupBy(*group, "_said").agg(F.count("*").alias("_same"))
    titles = said.groupBy(*group).agg(F.sum("_same").alias("_all"), F.count("*").alias("_ways")).where("_ways > 1")
    other = said.join(titles, group).select(*group, "_said", (F.col("_all") - F.col("_same")).alias("n_other"))
    out = rows.join(other, [*group, "_said"], "left")
    n = F.coalesce("n_other", F.lit(0))
    return out.select("id", "item_type", n.alias("n_other"), F.when(n > 0, F.when(F.col("item_type") == "decision", "conflicted").otherwise("possible_duplicate")).otherwise("clear").alias("mark"))


def leftmost_spans(spans: Column) -> Column:
    """Of spans (start, end, rule) those that a reader from the left takes: by start, then rule, longer first; none overlap."""
    def before(a: Column, b: Column) -> Column:
        return F.when(a["start"] != b["start"], F.signum((a["start"] - b["start"]).cast("double")).cast("int")).when(a["rule"] != b["rule"], F.signum((a["rule"] - b["rule"]).cast("double")).cast("int")).otherwise(F.signum((b["end"] - a["end"]).cast("double")).cast("int"))

    kept = F.slice(spans, F.lit(1), F.lit(0))
    return F.aggregate(
        F.array_sort(spans, before), kept,
        lambda acc, s: F.when((F.size(acc) == 0) | (s["start"] >= F.element_at(acc, F.greatest(F.lit(-1), -F.size(acc)))["end"]), F.array_append(acc, s)).otherwise(acc),
    )


def overlapping(left: DataFrame, right: DataFrame, key: list[str], width: int = 256) -> DataFrame:
    """Pairs (key..., a_start, a_end, b_start, b_end) of half-open spans that overlap.

    Spans meet in bins of ``width``; a pair counts in the bin where the later of
    both begins, so each is found once and no key's spans are all compared.
    """
    def binned(df: DataFrame, name: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
        return df.where("end > start").select(*key, F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"), F.explode(bins).alias("_bin"))

    both = binned(left, "a").join(binned(right, "b"), [*key, "_bin"])
    late = F.greatest("a_start", "b_start")
    return both.where((F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start")) & (F.floor(late / width) == F.col("_bin"))).drop("_bin")
