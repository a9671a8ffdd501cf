"""Quality rules whose cutoffs control how many good documents they reject.

A rule rejects a document whose number reaches a cutoff. All rules' cutoffs are
tightened along one path that is fixed beforehand, from lenient to strict. On
labelled documents that had no part in making it, a step of the path is accepted
if the exact binomial (Clopper-Pearson) upper bound of the share of good
documents that all rules together reject there is at most ``RISK``. A fixed
sequence of tests that ends with the first failure needs no correction; over
strata the error rate is divided (Bonferroni). So with probability
``1 - ERROR`` no stratum loses more than ``RISK`` of its good documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

#: Most good documents that a stratum may lose, and the probability that one loses more.
RISK, ERROR = 0.03, 0.05
#: A good document counts as so many bad ones when a cutoff is chosen among the accepted.
GOOD_IS_WORTH = 10
MOST_STRATA = 1000

#: Rules: name -> (SQL of the number, its cutoffs from lenient to strict).
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (3.0, 2.0, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "repeated_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3)),
    "shouting": ("n_upper_words / greatest(n_words, 1)", (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25)),
    "exclamation": ("n_exclamations / greatest(n_words, 1)", (3.0, 2.0, 1.0, 0.75, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25)),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", (0.2, 0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.13, 0.12, 0.11)),
}
#: The path: the n-th cutoffs of all rules, then the next ones.
PATH = [(rule, cutoffs[level]) for level in range(10) for rule, (_, cutoffs) in RULES.items()]

_SPACE = re.compile("[ \t-\r]")
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_exclamations")


def measure(text: str | None) -> tuple[int, ...]:
    """The numbers of ``_FIELDS`` for one text; null is as an empty text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeated = 0
    if len(words) > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            end = 0
            for i, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += i + 5 - max(end, i)
                    end = i + 5
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), len(text) - len(_SPACE.findall(text)), symbols, dup, repeated, lines, sum(w.isupper() for w in words), text.count("!")


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [measure(t if isinstance(t, str) else None) for t in batch.pop("text")]
        yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=_FIELDS)], axis=1)


def at_most(k: int, n: int, p: float) -> float:
    """Probability of at most ``k`` hits in ``n`` tries of probability ``p``, summed exactly from the largest term down."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    mode = min(k, math.floor((n + 1) * p))
    log = math.lgamma(n + 1) - math.lgamma(mode + 1) - math.lgamma(n - mode + 1) + mode * math.log(p) + (n - mode) * math.log1p(-p)
    odds = p / (1 - p)
    total = term = 1.0
    for i in range(mode, 0, -1):
        term *= i / ((n - i + 1) * odds)
        total += term
        if term < 1e-17 * total:
            break
    term = 1.0
    for i in range(mode, k):
        term *= (n - i) / (i + 1) * odds
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, math.exp(log) * total)


def upper_bound(k: int, n: int, error: float) -> float:
    """The exact (Clopper-Pearson) upper confidence bound of a share of which ``k`` of ``n`` were seen."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most(k, n, mid) > error else (low, mid)
    return high


def choose_step(good: list[int], bad: list[int], n_good: int, risk: float, error: float) -> tuple[int, float]:
    """The chosen step of the path and the bound of good documents lost there; (-1, 0.0) if none is accepted and useful.

    good, bad: how many documents of each kind the rules reject first at each step.
    """
    best, worth, lost, caught = (-1, 0.0), 0, 0, 0
    for step, (g, b) in enumerate(zip(good, bad, strict=True)):
        lost, caught = lost + g, caught + b
        if n_good == 0 or at_most(lost, n_good, risk) > error:
            break
        if caught - GOOD_IS_WORTH * lost > worth:
            worth, best = caught - GOOD_IS_WORTH * lost, (step, upper_bound(lost, n_good, error))
    return best


def first_step(rule: str) -> Column:
    """The step of the path at which a rule first rejects; null if it never does."""
    number = F.expr(RULES[rule][0])
    steps = [(i, cutoff) for i, (name, cutoff) in enumerate(PATH) if name == rule]
    out = F.when(number >= steps[0][1], steps[0][0])
    for i, cutoff in steps[1:]:
        out = out.when(number >= cutoff, i)
    return out


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[str, tuple[int, float]]:
    """Stratum -> (step of the path, bound), from texts with a label that pass the base rules.

    measured: (doc_id, stratum, h1, h2 hashes of the text, the measured numbers);
    labels: (doc_id, quality). The bound needs independent trials, so that a text
    is one trial in its stratum however many rows or ids hold it. Of several
    labels of a text the lowest counts; null ones don't.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") >= 1).alias("good"))
    rows = measured.where(~base_failed()).join(known, "doc_id")
    step = F.least(*(F.coalesce(first_step(rule), F.lit(len(PATH))) for rule in RULES))
    trials = rows.groupBy("stratum", "h1", "h2").agg(F.min("good").alias("good"), F.min(step).alias("step"))
    counts = trials.groupBy("stratum", "good", "step").agg(F.count("*").alias("n"))
    most = 2 * MOST_STRATA * (len(PATH) + 1)
    found = counts.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {MOST_STRATA} strata")
    strata: dict[str, dict[bool, list[int]]] = {}
    for r in found:
        strata.setdefault(r["stratum"], {True: [0] * (len(PATH) + 1), False: [0] * (len(PATH) + 1)})[r["good"]][r["step"]] += r["n"]
    return {s: choose_step(n[True][:-1], n[False][:-1], sum(n[True]), risk, error / len(strata)) for s, n in sorted(strata.items())}


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by) for each row of ``docs``.

    docs: (doc_id, text, lang, ...); strata are the values of lang, null being
    one of its own. labels: (doc_id, quality, ...). Words stand between ASCII
    white space. kept is false if the base rules fail or any rule rejects at
    the stratum's step of the path; rejected_by names the rules. A stratum without enough
    labels has no step and only the base rules apply. Null texts are empty;
    repeated rows are judged each; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("\0null")).alias("stratum"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({f"h{i}": F.xxhash64(F.lit(i), F.coalesce("text", F.lit(""))) for i in (1, 2)})
    ids = dict(docs.select("doc_id").dtypes)["doc_id"]
    measured = scratch.save(rows.mapInPandas(_measure, f"doc_id {ids}, stratum string, h1 long, h2 long, {', '.join(f'{f} long' for f in _FIELDS)}"), "measured")
    steps = calibrate(measured, labels.select("doc_id", "quality"))
    chosen = [x for stratum, (step, _) in steps.items() for x in (F.lit(stratum), F.lit(step))]
    allowed = F.coalesce(F.try_element_at(F.create_map(*chosen), F.col("stratum")), F.lit(-1)) if chosen else F.lit(-1)
    out = measured.withColumn("base_failed", base_failed())
    out = out.withColumn("rejected_by", F.array_compact(F.array(*(F.when(first_step(rule) <= allowed, F.lit(rule)) for rule in RULES))))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
