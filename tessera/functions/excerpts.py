"""Short pieces of texts as column expressions: lists, windows around terms, lines with keywords, payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import once, placed


def clean_list(values: Column, most: int, length: int) -> Column:
    """The first distinct values in order, each trimmed and cut, without blank ones; null is an empty list."""
    cut = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.left(F.trim(F.coalesce(v, F.lit(""))), F.lit(length)))
    return F.slice(F.array_distinct(F.filter(cut, lambda v: v != "")), 1, most)


def window(text: Column, terms: list[str], length: int) -> Column:
    """A text on one line; if it is longer, ``length`` characters from a third before its earliest term, with dots where it was cut."""
    def cut(clean: Column) -> Column:
        lower = F.lower(clean)
        found = [F.nullif(F.locate(t.lower(), lower), F.lit(0)) for t in terms] + [F.lit(None).cast("int")] * 2
        begin = F.greatest(F.coalesce(F.least(*found), F.lit(1)) - 1 - length // 3, F.lit(0))
        piece = F.trim(F.substring(clean, begin + 1, F.lit(length)))
        dotted = F.concat(F.when(begin > 0, "... ").otherwise(""), piece, F.when(begin + length < F.length(clean), " ...").otherwise(""))
        return F.when(F.length(clean) <= length, clean).otherwise(dotted)

    return once(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), cut)


def keyword_lines(text: Column, keywords: list[str], most: int = 3, length: int = 220) -> Column:
    """The first distinct lines that hold a keyword, on one line each and cut with dots beyond ``length``."""
    def cut(line: Column) -> Column:
        return F.when(F.length(line) > length, F.concat(F.rtrim(F.left(line, F.lit(length - 3))), F.lit("..."))).otherwise(line)

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    held = F.filter(lines, lambda s: F.exists(F.lit(keywords), lambda k: F.contains(F.lower(s), k)))
    return F.slice(F.array_distinct(F.transform(held, cut)), 1, most)


def json_object(answer: Column) -> Column:
    """What stands from an answer's first opening to its last closing brace; null without both."""
    return F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))


def older_than(at: Column, now: Column, seconds: int) -> Column:
    """Whether a time given as text lies ``seconds`` or more before ``now``; null if it isn't a time."""
    return F.timestamp_diff("SECOND", F.try_to_timestamp(at), now) >= seconds


def halves(text: Column, limit: int, notice: str = "\n[...]\n") -> Column:
    """A text of at most ``limit`` characters: half from its head and half from its tail around a notice, without white space at the cuts."""
    room = max(0, limit - len(notice))
    head = room // 2
    start, end = F.regexp_replace(F.left(text, F.lit(head)), r"\s+\z", ""), F.regexp_replace(F.right(text, F.lit(room - head)), r"\A\s+", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(start, F.lit(notice), end))


def focused(text: Column, keywords: list[str], limit: int, least: int = 700, most: int = 1400, notice: str = "\n[...]\n") -> Column:
    """Windows around a place of each keyword, in the keywords' order, joined; without any, the text; then cut to ``limit``.

    A window has a quarter of the limit, within bounds, half of it before the
    keyword's beginning. Of a keyword the first place counts whose window none
    before has; no more are taken once the joined ones reach the limit. Keywords are found whatever their case; a null
    text is empty.
    """
    size = max(least, min(most, limit // 4))

    def cut(said: Column) -> Column:
        lower = F.lower(said)

        def windows(word: str) -> Column:
            """Around every place of a keyword, one place after the other."""
            parts = placed(F.split(lower, f"\\Q{word}\\E"))
            at = F.transform(F.slice(parts, 2, F.size(parts)), lambda p, i: p["start"] + i * len(word))
            return F.transform(at, lambda i: F.struct(F.greatest(F.lit(0), i - size // 2).alias("start"), F.least(F.length(said), i + size // 2).alias("end")))

        none = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("seen"), F.lit(None).cast("string").alias("text"))

        def take(acc: Column, own: Column) -> Column:
            new = F.get(F.filter(own, lambda w: ~F.array_contains(acc["seen"], w)), F.lit(0))
            piece = F.regexp_replace(F.substring(said, new["start"] + 1, new["end"] - new["start"]), r"\A\s+|\s+\z", "")
            longer = F.struct(F.array_append(acc["seen"], new).alias("seen"), F.when(acc["text"].isNull(), piece).otherwise(F.concat(acc["text"], F.lit(notice), piece)).alias("text"))
            return F.when(new.isNull() | F.coalesce(F.length(acc["text"]) >= limit, F.lit(False)), acc).otherwise(longer)

        joined = F.aggregate(F.array(*(windows(k.lower()) for k in keywords)), none, take, lambda acc: acc["text"])
        return halves(F.coalesce(joined, said), limit, notice)

    return once(F.coalesce(text, F.lit("")), cut) if keywords else halves(F.coalesce(text, F.lit("")), limit, notice)
