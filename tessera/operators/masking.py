"""Masking by a chain of rules with numbered tokens, and a verdict on what is left."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.protection import Rule

# The rules in the order in which they are applied, those of dialogues, and what makes a text look personal.
PATTERNS = (
    ("INN", r"\bИНН\s*[:№#-]?\s*[0-9\- ]{6,24}\b"),
    ("ADDRESS", r"\b(?:адрес|проживает по адресу|зарегистрирован[а-я ]*по адресу)\s*[:№#-]?\s*[^\n;]{8,160}?(?=(?:\.\s+(?:Паспорт|Договор|Контракт|ИНН|КПП|ОГРН|СНИЛС)\b)|[;\n]|$)"),
    ("PASSPORT", r"\b(?:паспорт|паспортные данные|серия|номер паспорта)\s*[:№#-]?\s*[0-9\- ]{4,24}\b"),
    ("EMAIL", r"(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-zА-Яа-я]{2,}(?![\w-])"),
    ("PHONE", r"(?<!\d)(?:\+7|8)?[\s(.-]*\d{3}[\s). -]*\d{3}[\s.-]*\d{2}[\s.-]*\d{2}(?!\d)"),
    ("PHONE", r"\b(?:телефон|номер\s+телефона)\s*[:—-]?\s*(?:семь|восемь)(?:[\s-]+(?:ноль|один|одна|два|две|три|четыре|пять|шесть|семь|восемь|девять|десять|одиннадцать|двенадцать|тринадцать|четырнадцать|пятнадцать|шестнадцать|семнадцать|восемнадцать|девятнадцать|двадцать|тридцать|сорок|пятьдесят|шестьдесят|семьдесят|восемьдесят|девяносто|сто|двести|триста|четыреста|пятьсот|шестьсот|семьсот|восемьсот|девятьсот)){6,18}\b"),
    ("PERSON", r"\b[А-ЯЁ][а-яё]{2,}(?:ым|ом|а|у|е|ой|ая|ий|ый)?\s+[А-ЯЁ][а-яё]{2,}(?:ым|ом|а|у|е|ой|ая|ий|ый)?\s+[А-ЯЁ][а-яё]+(?:вич|вича|вичу|вичем|вичём|вна|вны|вне|вной|ична|ичны|ичне|ичной)\b"),
    ("PERSON", r"\b[А-ЯЁ][а-яё]{2,}\s+[А-ЯЁ]\.\s?[А-ЯЁ]\."),
    ("ID", r"\b(?:КПП|ОГРН|СНИЛС)\s*[:№#-]?\s*[0-9\- ]{6,24}\b"),
    ("CONTRACT", r"\b(?:договор|контракт|доп\.?\s*соглашение)\s*(?:№|N|#)?\s*[A-Za-zА-Яа-я0-9_./\\-]*\d[A-Za-zА-Яа-я0-9_./\\-]*\b"),
)
#: These two mind the case.
INTERNAL = ("INTERNAL_ID", r"\b[A-Za-zА-Яа-яЁё]{4,}[-_]\d{2,}\b")
DIALOGUE = ("PERSON", r"(?:(?<=\bу\s)|(?<=\bдля\s)|(?<=\bк\s)|(?<=\bот\s)|(?<=\bс\s)|(?<=\bпо\s)|(?<=\bпро\s)|(?<=\bо\s)|(?<=\bоб\s))[А-ЯЁ][а-яё]{3,}(?:а|у|е|ым|ом|ой)?\b")
CONCRETE = (
    r"[\w.+-]+@[\w.-]+\.[A-Za-zА-Яа-я]{2,}",
    r"(?:\+7|8)?[\s(.-]*\d{3}[\s). -]*\d{3}[\s.-]*\d{2}[\s.-]*\d{2}",
    r"\bИНН\s*[:№#-]?\s*[0-9\- ]{6,24}\b",
    r"\b(?:КПП|ОГРН|СНИЛС)\s*[:№#-]?\s*[0-9\- ]{6,24}\b",
    r"\b(?:паспортн(?:ые|ых)?\s+данн(?:ые|ых)|серия\s+(?:и\s+)?номер\s+паспорта|номер\s+паспорта|паспорт)\s*(?:№|N|No|номер|\d)\s*[0-9\- ]{4,24}",
    r"\b(?:номер\s+(?:договора|контракта)|(?:договор|контракт)\s*(?:№|N|No|номер|\d))\s*[A-Za-zА-Яа-я0-9_./\\-]*\d[A-Za-zА-Яа-я0-9_./\\-]*\b",
    r"\b[А-ЯЁ][а-яё]{2,}\s+[А-ЯЁ][а-яё]{2,}\s+[А-ЯЁ][а-яё]+(?:вич|вна|ич|ична)\b",
)
TOPICS = (
    r"\b(?:персональн(?:ые|ых|ыми|ым)?\s+данн(?:ые|ых|ыми|ым)|ПДн?|ПИИ|PII)\b",
    r"\b(?:политик[аи]\s+обработки|согласие\s+на\s+обработку|обработка\s+персональных\s+данных)\b",
    r"\b(?:паспорт|паспортные данные|реквизиты|договор|контракт)\s+(?:клиента|участника|заявителя|собственника|пользователя)\b",
)
#: What a text comes out as.
STATES = ("empty", "unavailable", "needs_check", "needs_look", "done", "nothing_found", "needs_check_after_review")

#: Letters, digits and word ends are those of all scripts; upper case is lower case but in the last two.
RULES = [Rule(category, f"(?iU){pattern}") for category, pattern in PATTERNS] + [Rule(INTERNAL[0], f"(?U){INTERNAL[1]}")]
DIALOGUE_RULES = [Rule(DIALOGUE[0], f"(?U){DIALOGUE[1]}")]

#: Letters that Cyrillic ones match without regard to case.
CYRILLIC = "[\u0400-\u052F\u1C80-\u1C8F\uA640-\uA69F]"
_PHONE = r"(?U)\d{3}[\s). -]*\d{3}[\s.-]*\d{2}[\s.-]*\d{2}"
#: What a text must hold for a pattern of ours to match, as a simpler pattern that is tried first. Patterns of others have none.
NEEDS = {f"(?iU){p}": CYRILLIC for p in (*(p for _, p in PATTERNS), *CONCRETE, *TOPICS)} | {
    f"(?iU){PATTERNS[3][1]}": "@", f"(?iU){CONCRETE[0]}": "@", f"(?iU){PATTERNS[4][1]}": _PHONE, f"(?iU){CONCRETE[1]}": _PHONE,
    f"(?iU){TOPICS[0]}": f"(?iU)PII|{CYRILLIC}", f"(?U){INTERNAL[1]}": r"(?U)[-_]\d\d", f"(?U){DIALOGUE[1]}": CYRILLIC,
}


def _looks(text: Column, patterns: tuple[str, ...]) -> Column:
    groups: dict[str, Column] = {}
    for pattern in (f"(?iU){p}" for p in patterns):
        need = NEEDS[pattern]
        groups[need] = groups[need] | text.rlike(pattern) if need in groups else text.rlike(pattern)
    out = F.lit(False)
    for need, found in groups.items():
        out = out | (text.rlike(need) & found)
    return out


def _token(category: str):
    """What joins a part to the one before it: the category's next number."""
    return lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.lit(f"[{category}_"), (F.col(f"_{category}") + i).cast("string"), F.lit("]"), part))


def masked(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """docs (text, ...) with ``masked`` and ``counts`` (category to number): each rule works on what the rules before it left.

    A place becomes ``[CATEGORY_n]``; n goes on through all rules of a category,
    and begins at 1 in every text. A null text is empty. Texts are masked in their
    rows; nothing is shuffled. A rule of ours is passed by where the text lacks
    what it needs.
    """
    rules = RULES if rules is None else rules
    rows = docs.withColumn("masked", F.coalesce("text", F.lit("")))
    # Of what is put in, only a category could be Cyrillic.
    named = any(re.search(CYRILLIC, r.category) for r in rules)
    rows = rows.withColumn("_cyrillic", F.lit(True) if named else F.col("masked").rlike(CYRILLIC))
    for category in dict.fromkeys(r.category for r in rules):
        rows = rows.withColumn(f"_{category}", F.lit(0))
    for rule in rules:
        need, parts = NEEDS.get(rule.pattern), F.split("masked", rule.pattern)
        if need:
            parts = F.when(F.col("_cyrillic") if need == CYRILLIC else F.col("masked").rlike(need), parts).otherwise(F.array("masked"))
        rows = rows.withColumn("_parts", parts)
        rows = rows.withColumn("masked", F.when(F.size("_parts") == 1, F.col("masked")).otherwise(F.array_join(F.transform("_parts", _token(rule.category)), "")))
        rows = rows.withColumn(f"_{rule.category}", F.col(f"_{rule.category}") + F.size("_parts") - 1)
    categories = sorted({r.category for r in rules})
    counts = F.map_filter(F.create_map(*(x for c in categories for x in (F.lit(c), F.col(f"_{c}")))), lambda k, n: n > 0) if categories else F.create_map().cast("map<string,int>")
    return rows.withColumn("counts", counts).drop("_parts", "_cyrillic", *(f"_{c}" for c in categories))


def masking_report(docs: DataFrame, rules: list[Rule] | None = None, reviewed: Column | None = None, available: Column | None = None) -> DataFrame:
    """docs (text, ...) with masked, counts, total, suspected, unresolved, by_hand and status.

    suspected: the text looks as if it held personal data; unresolved: it holds a
    concrete sign of some, and no rule replaced anything. A later review
    (``reviewed``, a condition) can only raise the risk. Where masking isn't
    ``available`` the text stays as it is. Null and empty texts are ``empty``.
    """
    text = F.coalesce("text", F.lit(""))
    available = F.lit(True) if available is None else F.coalesce(available, F.lit(False))
    reviewed = F.lit(False) if reviewed is None else F.coalesce(reviewed, F.lit(False))
    rows = masked(docs, rules).withColumns({"_empty": text == "", "_on": available, "_concrete": _looks(text, CONCRETE)})
    rows = rows.withColumn("suspected", ~F.col("_empty") & (F.col("_concrete") | _looks(text, TOPICS)))
    rows = rows.withColumns({"masked": F.when(F.col("_on"), F.col("masked")).otherwise(text), "counts": F.when(F.col("_on"), F.col("counts")).otherwise(F.map_filter("counts", lambda k, n: F.lit(False)))})
    rows = rows.withColumn("total", F.aggregate(F.map_values("counts"), F.lit(0), lambda a, n: a + n))
    found = F.when(F.col("_on"), F.col("_concrete") & (F.col("total") == 0)).otherwise(F.col("suspected")) & ~F.col("_empty")
    rows = rows.withColumns({"_found": found, "_again": reviewed & F.col("_on") & ~F.col("_empty")})
    rows = rows.withColumn("by_hand", F.col("suspected") & F.col("_on") & ~F.col("_found") & ~F.col("_again"))
    state = dict(zip(STATES, STATES, strict=True))
    status = (
        F.when(F.col("_empty"), state["empty"]).when(~F.col("_on"), state["unavailable"]).when(F.col("_again"), state["needs_check_after_review"]).when(F.col("_found"), state["needs_check"])
        .when(F.col("by_hand") & (F.col("total") == 0), state["needs_look"]).when(F.col("total") > 0, state["done"]).otherwise(state["nothing_found"])
    )
    return rows.withColumns({"unresolved": F.col("_found") | F.col("_again"), "status": status}).drop("_empty", "_on", "_concrete", "_found", "_again")
