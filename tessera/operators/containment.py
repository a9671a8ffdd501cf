"""Which of many needles stand literally in which texts, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the pieces that are looked up.
PIECE = 6


def saved(df: DataFrame) -> DataFrame:
    """``df``, computed once: written to the session's checkpoint folder or, where none is set, cached.

    What a lost executor held of a cached table is computed again.
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") else df.persist()


def _pieces(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters of a text, found in one pass; none of a shorter one."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def contained(needles: DataFrame, texts: DataFrame, keys: list[str] | None = None, piece: int = PIECE) -> DataFrame:
    """(keys..., needle, id): each distinct needle and the texts of its keys that hold it.

    needles: (keys..., needle); texts: (keys..., id, text). Of a needle only the
    piece of ``piece`` characters that fewest texts hold is looked up (a shorter
    needle is its own piece); texts found so are then searched for the whole
    needle. A needle of which any piece is nowhere is settled by that. Null and
    empty needles are in nothing, null texts hold nothing; rows that repeat an id
    count as one text if one of them holds the needle. Null keys match nothing.
    """
    keys = keys or []
    by = [*keys, "_piece"]
    needles = needles.where(F.length("needle") > 0).select(*keys, "needle").distinct()
    texts = texts.where("text is not null").select(*keys, F.col("id").alias("_id"), F.col("text").alias("_text"))
    cut = needles.withColumn("_size", F.least(F.length("needle"), F.lit(piece)))
    sizes = sorted(r["_size"] for r in cut.select("_size").distinct().collect())  # ``piece`` different ones at most
    own = F.coalesce(*(F.when(F.col("_size") == s, _pieces(F.col("needle"), s)) for s in range(1, piece + 1)))
    wanted = cut.select(*keys, "needle", F.explode(own).alias("_piece"))
    every = F.flatten(F.array(*(_pieces(F.col("_text"), s) for s in sizes))) if sizes else F.array().cast("array<string>")
    held = texts.select(*keys, "_id", F.explode(every).alias("_piece")).join(wanted.select(*by).distinct(), by, "left_semi")
    held = saved(held)
    n = wanted.join(held.groupBy(*by).agg(F.count("*").alias("_n")), by, "left")
    rarest = n.groupBy(*keys, "needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_piece")).alias("_rarest")).where("_rarest._n > 0")
    near = rarest.select(*keys, "needle", F.col("_rarest._piece").alias("_piece")).join(held, by).select(*keys, "needle", "_id")
    found = near.join(texts, [*keys, "_id"]).where(F.contains("_text", F.col("needle")))
    return found.select(*keys, "needle", F.col("_id").alias("id")).distinct()


def unindexed(sources: DataFrame, texts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """sources (keys..., source_id, needles array) none of whose needles stands in any text (keys..., id, text) of their keys.

    Rows that repeat a source_id are one source with the needles of all. A source
    with a null key or without needles is in no index.
    """
    keys = keys or []
    all_ = sources.select(*keys, "source_id", F.explode_outer("needles").alias("needle"))
    found = contained(all_, texts, keys).select(*keys, "needle").distinct()
    indexed = all_.join(found, [*keys, "needle"]).select(*keys, "source_id").distinct()
    same = F.lit(True)
    out, known = sources.select(*keys, "source_id").distinct(), indexed.toDF(*(f"_{c}" for c in [*keys, "source_id"]))
    for c in [*keys, "source_id"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out.join(known, same, "left_anti")
