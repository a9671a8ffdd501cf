"""Patterns of sensitive text, numbered masks and the order of handling levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is masked, in the order in which it is tried.
MASKS = {
    "EMAIL": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "CARD": r"\b\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{4}\b",
    "PHONE": r"\+\d[\d \-().]{8,}\d",
    "IP": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
TOPICS = r"(?i)\b(password|passport|token|secret|паспорт|пароль|снилс|инн)\b"
#: Handling levels, weakest first.
HANDLING = ("standard", "unknown", "restricted")


def any_topic(text: Column) -> Column:
    """Whether a text speaks of secrets or papers."""
    return F.coalesce(text.rlike(TOPICS), F.lit(False))


def count(text: Column, kind: str) -> Column:
    """How many places of a kind a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(MASKS[kind])), F.lit(0))


def numbered(text: Column, kind: str) -> Column:
    """A text with a kind's places replaced by ``[KIND_1]``, ``[KIND_2]``... in order of appearance."""
    parts = F.split(text, MASKS[kind])
    return F.array_join(F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.lit(f"[{kind}_"), i.cast("string"), F.lit("]"), part))), "")


def mask(df: DataFrame, column: str) -> DataFrame:
    """``df`` with all kinds masked in a column, one kind after another; each step reads the last one's text once."""
    for kind in MASKS:
        df = df.withColumn(column, numbered(F.col(column), kind))
    return df


def level(handling: Column) -> Column:
    """A handling level's place; an unknown word is the strictest, so that it is never lowered."""
    return F.when(handling == HANDLING[0], 0).when(handling == HANDLING[1], 1).otherwise(2)


def strictest(handling: Column) -> Column:
    """Aggregate: the strictest of levels, ``standard`` of none."""
    return F.get(F.lit(list(HANDLING)), F.coalesce(F.max(level(handling)), F.lit(0)))
