"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item is cut into windows of ten consecutive words. A window's tokens are its
three-word shingles, ordered by rarity in the corpus. As a window must be
contained whole, one token is a necessary prefix: its rarest. Document shingles
join that prefix; the token's place in the window then bounds where the window
must lie in the document, and the words there are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, without

WINDOW, SHINGLE = 10, 3
#: Windows (and, with their shingles, eight times as many tokens) up to which the benchmark's side is broadcast: some 60 MB.
BROADCAST_WINDOWS = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """A text's words: runs of digits, letters a-z (A-Z in lower case) and characters beyond ASCII. Null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # Of ASCII-only texts, lower() changes A-Z alone, and quickly.
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _windows(items: DataFrame) -> DataFrame:
    """(item_id, window array<string>, len): an item's windows; fewer than ten words are one window, none none."""
    cut = items.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    cut = cut.select("item_id", "w", F.explode(starts).alias("at"))
    return cut.select("item_id", F.slice("w", F.col("at"), F.lit(WINDOW)).alias("window")).withColumn("len", F.size("window"))


def _hash(k: int, array: str, at: Column) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(array, at + i) for i in range(k)))


def _tokens(windows: DataFrame) -> DataFrame:
    """(wid, k, place, token): each window's shingles; k is their number of words."""
    k = F.least(F.col("len"), F.lit(SHINGLE))
    out = windows.select("wid", "window", k.alias("k"), F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("place"))
    token = F.when(F.col("k") == 1, _hash(1, "window", F.col("place"))).when(F.col("k") == 2, _hash(2, "window", F.col("place"))).otherwise(_hash(3, "window", F.col("place")))
    return out.select("wid", "k", "place", token.alias("token"))


def _shingled(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each word of each document (one for a document without words), with ``tokens`` that begin there."""
    out = docs.select("*", F.posexplode_outer("w").alias("pos", "word")).drop("word")
    if len(sizes) == 1:
        return out.withColumn("token", _hash(sizes[0], "w", F.col("pos")))
    return out.withColumn("token", F.explode(F.array(*(_hash(k, "w", F.col("pos")) for k in sizes))))


def _covered(spans: str) -> Column:
    """How many words lie in a union of (start, end) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    return F.aggregate(
        F.array_sort(spans), start,
        lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["total"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("total")),
        lambda acc: acc["total"],
    )


def contamination(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None, bound: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    docs: (doc_id, text, ...), items: (item_id, text, ...); other columns are
    ignored. A document word inside any occurrence of any window of an item is
    hit. items_sha256 is of the occurring items' ids, sorted as strings and
    joined by commas. Null and wordless texts, and an empty table of items, have
    no hits. Repeated rows give a row each. A null item_id counts as no item,
    though its windows hit. An empty table of documents gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontaminate")
    docs = docs.select("doc_id", "text")
    cut = scratch.save(_windows(items.select("item_id", "text")), "item-windows")
    windows = scratch.save(cut.select("window", "len").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    owners = scratch.save(cut.join(windows, ["window", "len"]).where("item_id is not null").select("wid", F.col("item_id").cast("string").alias("item_id")).distinct(), "owners")
    few = windows.limit(bound + 1).count() <= bound
    small = F.broadcast if few else (lambda df: df)
    tokens = scratch.save(_tokens(windows), "tokens")
    sizes = sorted(r["k"] for r in tokens.select("k").distinct().collect()) or [SHINGLE]

    cut_docs = docs.select("doc_id", words(F.col("text")).alias("w"))
    plain = _shingled(cut_docs.select("w"), sizes).select("token")
    counts = plain.join(small(tokens.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    counts = scratch.save(counts, "rarity")
    # The rarest token of each window is its prefix.
    ranked = tokens.join(small(counts), "token", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "token")).alias("rarest"))
    # A window with a token that no document has can't occur.
    prefix = ranked.where("rarest.n > 0").join(windows, "wid").select("wid", "window", "len", F.col("rarest.place").alias("place"), F.col("rarest.token").alias("token"))
    prefix = scratch.save(prefix, "prefix")

    start = F.col("pos") - F.col("place")
    bounded = (start >= 0) & (start + F.col("len") <= F.size("w"))
    contained = F.coalesce(bounded & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("window")), F.lit(False))
    span = F.when(F.col("hit"), F.struct(start.alias("start"), (start + F.col("len")).alias("end")))
    if few:
        keyed = cut_docs.withColumn("row", F.monotonically_increasing_id())
        found = _shingled(keyed, sizes).join(small(prefix), "token", "left").withColumn("hit", contained)
        # A document's first word is passed on in any case, so that each document has a row.
        found = found.where("hit or coalesce(pos, 0) = 0")
        found = scratch.save(found.select("row", "doc_id", F.size("w").alias("n_words"), span.alias("span"), F.when(F.col("hit"), F.col("wid")).alias("wid")), "hits")
        base, key = found.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans")), ["row"]
    else:
        # Only ids, places and tokens are shuffled to meet the prefix, and words only of documents with a candidate.
        key = ["doc_id", "hash", "chars"]
        named = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.length("text").alias("chars"), words(F.col("text")).alias("w"))
        named = named.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).withColumn("chars", F.coalesce("chars", F.lit(-1)))
        near = _shingled(named, sizes).select(*key, "pos", "token").join(prefix.select("token", "wid", "place"), "token")
        near = scratch.save(near.where(start >= 0).select(*key, "pos", "wid").distinct(), "candidates")
        seen = near.join(named.dropDuplicates(key), key).join(prefix, "wid").withColumn("hit", contained).where("hit")
        found = scratch.save(seen.select(*key, span.alias("span"), "wid"), "hits")
        spans = found.groupBy(*key).agg(F.collect_set("span").alias("spans"))
        every = docs.select("doc_id", F.size(words(F.col("text"))).alias("n_words"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.xxhash64("text").alias("hash"), F.coalesce(F.length("text"), F.lit(-1)).alias("chars"))
        base = every.join(spans.withColumnRenamed("doc_id", "_id"), ["_id", "hash", "chars"], "left")
        found, key = found.withColumnRenamed("doc_id", "_id"), ["_id", "hash", "chars"]
    named_items = found.where("wid is not null").select(*key, "wid").distinct().join(small(owners), "wid")
    named_items = named_items.groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = base.join(named_items, key, "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(_covered("spans"), F.lit(0)).cast("long")
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns as they are; a null doc_id stays only if its texts are all clean."""
    gone = contamination(docs, items).where("contaminated").select("doc_id").distinct()
    return without(docs, Scratch(docs.sparkSession, "clean").save(gone, "gone"))
