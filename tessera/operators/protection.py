"""Protection by a table of rules: leftmost spans, pseudonyms for each workspace, and what is left to review."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import placed
from tessera.operators.candidates import leftmost_spans

#: Ids that are numbered together: a category's values are numbered block by block, so that no task sees all of them.
BLOCK = 65_536


@dataclass(frozen=True)
class Rule:
    """What a category looks like; without a required rule nothing may be protected."""

    category: str
    pattern: str
    required: bool = False


# The rules that protection applies, in order, and those without which nothing may be protected.
REQUIRED = ("ЭлектроннаяПочта", "Телефон", "Ссылка", "СетевойАдрес", "Секрет")
PATTERNS = (
    ("ЭлектроннаяПочта", r"(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-zА-Яа-я]{2,}(?![\w-])"),
    ("Телефон", r"(?<!\d)(?:\+7|8)[\s(.-]*\d{3}[\s). -]*\d{3}[\s.-]*\d{2}[\s.-]*\d{2}(?:\s*(?:доб\.?|ext\.?)\s*\d+)?"),
    ("Ссылка", r"https?://[^\s<>]+"),
    ("СетевойАдрес", r"\b(?!(?:127|0)\.0\.0\.1\b)(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("Секрет", r"(?i)\b(?:bearer\s+\S+|(?:api[_ -]?key|token|password|secret)\s*[:=]\s*\S+)"),
    ("Идентификатор", r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"),
    ("СНИЛС", r"\b\d{3}-\d{3}-\d{3}\s\d{2}\b"),
    ("ИНН", r"\b\d{10}(?:\d{2})?\b"),
    ("Документ", r"\b(?:\d{4}\s\d{6}|(?:договор|заявка)\s*№?\s*[A-Za-zА-Яа-я0-9/-]{4,})\b"),
    ("Реквизит", r"(?i)\b(?:сч[её]т|бик|карт[аы])\s*[:№]?\s*\d(?:[\d ]{7,22}\d)\b"),
    ("Адрес", r"(?i)\b(?:г\.?\s*[^,]+,\s*)?(?:ул\.?|улица|проспект)\s+[^,]+,\s*(?:дом|д\.)\s*\d+(?:\s*(?:кв\.?|корп\.?|стр\.)\s*\d+)?"),
)
#: The same as rules; letters, digits and word ends are those of all scripts.
RULES = [Rule(category, f"(?U){pattern}", category in REQUIRED) for category, pattern in PATTERNS]


def dictionary_rules(values: dict[str, list[str]]) -> list[Rule]:
    """Required rules for whole words of a dictionary; blank values are none."""
    word = r"[\p{L}\p{N}_-]"
    return [Rule(category, f"(?<!{word}){re.escape(v)}(?!{word})", True) for category, all_ in values.items() for v in all_ if v.strip()]


def usable(spark: SparkSession, rules: list[Rule]) -> tuple[list[Rule], list[str]]:
    """Rules that can be applied, and the categories of optional ones that can't; a required one that can't is an error.

    A pattern that isn't one, or that matches an empty text, can't be applied.
    """
    good, failed = [], []
    for rule in rules:
        try:
            bad = spark._jvm.java.util.regex.Pattern.compile(rule.pattern).matcher("").find()
        except Exception:  # noqa: BLE001 - the gateway's error for a pattern that isn't one
            bad = True
        if bad and rule.required:
            raise ValueError(f"the required rule of {rule.category} can't be applied")
        (failed.append(rule.category) if bad else good.append(rule))
    return good, failed


def find(docs: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """(key, start, end, rule, category, value) of all places that a rule finds, from the text as it is; offsets in code points.

    Places are found in each row, nothing is shuffled.
    """
    def hits(i: int, rule: Rule) -> Column:
        parts, values = F.split("text", rule.pattern), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        # What lies between and what is found take turns.
        turns = placed(F.flatten(F.zip_with(parts, values, lambda gap, value: F.array(gap, F.coalesce(value, F.lit(""))))))
        found = F.filter(turns, lambda t, at: at % 2 == 1)
        found = F.filter(found, lambda t: t["text"] != "")
        return F.struct(F.lit(i).alias("rule"), F.lit(rule.category).alias("category"), F.when(F.size(values) > 0, found).alias("found"))

    if not rules:
        return docs.select(key, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("rule"), F.lit("").alias("category"), F.lit("").alias("value")).where("false")
    rows = docs.where("text is not null").select(key, F.inline(F.array(*(hits(i, r) for i, r in enumerate(rules)))))
    rows = rows.select(key, "rule", "category", F.explode("found").alias("f"))
    return rows.select(key, F.col("f.start").alias("start"), (F.col("f.start") + F.length("f.text")).alias("end"), "rule", "category", F.col("f.text").alias("value"))


def numbered(values: DataFrame, keys: list[str], id_: str, order: str) -> DataFrame:
    """``values`` with ``number``: its place from 1 among those of its keys, by ``order``, whose first part is the number ``id_``.

    Ids are ranked in blocks of ``BLOCK`` and moved by the sum of the blocks
    before, so that a group of any size is never sorted in one task.
    """
    rows = values.withColumn("_block", F.floor(F.col(id_) / BLOCK))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order))
    return rows.withColumn("_at", inside).join(sums, [*keys, "_block"]).withColumn("number", F.col("_at") + F.col("_before")).drop("_block", "_at", "_before")


def protect(docs: DataFrame, rules: list[Rule], key: str = "doc_id", workspace: str = "source") -> DataFrame:
    """(key, text, findings, status): texts with pseudonyms, and (category, pseudonym) of each place in order.

    Of places that overlap the leftmost counts, then that of the earlier rule,
    then the longer. A value has one pseudonym in its workspace whatever its
    case; values are numbered by document (its number in ``key``), in a document
    from its end, those of rows without a key first. Rows that share a key are
    protected each by its own text. Null texts stay null; without findings, if every rule could be
    applied, a text is ``ready_for_review``, else ``requires_review``.
    """
    rules, failed = usable(docs.sparkSession, rules)
    # Rows are told apart by all that they hold, so those that share a key, or have none, never get each other's places.
    own = F.sha2(F.to_json(F.struct(F.col(key), F.col(workspace).alias("w"), "text")).cast("binary"), 256)
    docs = docs.select(F.col(key), F.coalesce(F.col(workspace), F.lit("")).alias("_workspace"), "text", own.alias("_row"))
    spans = find(docs, rules, "_row").distinct().groupBy("_row").agg(F.collect_list(F.struct("start", "end", "rule", "category", "value")).alias("spans"))
    spans = spans.join(docs.select("_row", F.col(key).alias("_key"), "_workspace").distinct(), "_row").select("_row", "_key", "_workspace", F.inline(leftmost_spans(F.col("spans"))))
    spans = spans.withColumn("_value", F.lower("value"))
    group = ["_workspace", "category", "_value"]
    # Documents without a key come first.
    id_ = F.coalesce(F.col("_key").cast("long"), F.lit(-(2**62)).cast("long"))
    firsts = spans.groupBy(*group).agg(F.min(F.struct(id_.alias("id"), (-F.col("start")).alias("place"), F.col("_value").alias("value"))).alias("first")).withColumn("_id", F.col("first.id"))
    names = numbered(firsts, ["_workspace", "category"], "_id", "first").select(*group, F.concat_ws("-", "category", F.when(F.col("number") < 10, F.concat(F.lit("0"), "number")).otherwise(F.col("number").cast("string"))).alias("pseudonym"))
    found = spans.join(names, group).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "category", "pseudonym"))).alias("places"))
    out = docs.join(found, "_row", "left")

    def piece(p: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get("places", i - 1)["end"])
        return F.concat(F.substring(F.col("text"), begin + 1, p["start"] - begin), p["pseudonym"])

    tail = F.substring(F.col("text"), F.element_at("places", -1)["end"] + 1, F.length("text"))
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("places", piece), ""), tail))
    findings = F.coalesce(F.transform("places", lambda p: F.struct(p["category"], p["pseudonym"])), F.array().cast("array<struct<category:string,pseudonym:string>>"))
    status = F.when((F.size(findings) > 0) | F.lit(bool(failed)), "requires_review").otherwise("ready_for_review")
    return out.select(key, text.alias("text"), findings.alias("findings"), status.alias("status"))
