"""Language identification by inference of each document's mixture of languages.

A language is a distribution over hashed character trigrams inside words, fitted
on labelled documents. A document's words get a likelihood under each language;
expectation-maximisation estimates in which proportions the languages are mixed.
Of the nested sets of its most likely languages, the one with the best
likelihood after a penalty for each further language (BIC) is the document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, without

#: Trigram buckets; what each gets before counting; most languages that a model may have.
BUCKETS, PRIOR, MOST_LANGUAGES = 1 << 15, 0.5, 512
#: Labelled documents of each language that are counted, in expectation: a bounded sample by a hash of doc_id.
SAMPLE = 3000
#: Steps of expectation-maximisation, languages up to which all sets are tried (larger ones while they gain), and the share from which a further one is tried.
STEPS, ALWAYS_TRIED, LEAST_SHARE = 12, 4, 0.02
#: Share of the selected set in the mixture of all languages below which :func:`keep_identified` rejects.
LEAST_CERTAINTY = 0.35
#: Characters that are worked on at once (a longer text alone).
CHUNK = 1_000_000

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x32000)] + [False]))
    return _LETTERS[0]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter; where each word begins among them; the text of each word."""
    joined = "\n".join(texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(codes, 0x32000)]
    at = np.flatnonzero(letter)
    x = np.where(letter, codes, 0).astype(np.uint64)
    x = np.concatenate([[0], x, [0]]).astype(np.uint64)
    h = x[at] * np.uint64(0x9E3779B97F4A7C15) + x[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[at + 2] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    buckets = (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 15)).astype(np.int64)
    starts = np.flatnonzero(x[at] == 0)
    # A text's words are those that begin before its end; lower() may lengthen a text, so the ends are counted in line feeds added.
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    if len(codes) != ends[-1] - 1:  # lower() of the whole differs from that of its parts
        parts = [_grams([t]) for t in texts] if len(texts) > 1 else []
        if parts:
            sizes = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + s for p, s in zip(parts, sizes, strict=True)]), np.concatenate([p[2] + i for i, p in enumerate(parts)])
        return buckets, starts, np.zeros(len(starts), np.int64)
    return buckets, starts, np.searchsorted(ends, at[starts], side="right")


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, bucket, n) of a batch."""
    for batch in batches:
        for lang, group in batch.groupby("lang"):
            total = np.zeros(BUCKETS, np.int64)
            for _, part in _chunks(list(group["text"])):
                total += np.bincount(_grams(part)[0], minlength=BUCKETS)
            some = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": some, "n": total[some]})


def _mix(words: np.ndarray, doc: np.ndarray, begins: np.ndarray, steps: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document's languages, and its log-likelihood under them.

    words: likelihood of each word under each language; doc: its document, in
    order, all with words; begins: each document's first word; allowed: which
    languages each document may have.
    """
    share = allowed / allowed.sum(1, keepdims=True)
    n = np.diff(np.append(begins, len(words)))[:, None]
    for _ in range(steps):
        part = words * share[doc]
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, begins) / n
    return share, np.add.reduceat(np.log((words * share[doc]).sum(1)), begins)


def infer(texts: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the shares of all languages, those of the selected set (0 elsewhere), and whether it has letters."""
    full = np.zeros((len(texts), model.shape[1]))
    chosen = np.zeros_like(full)
    lettered = np.zeros(len(texts), bool)
    for begin, part in _chunks(texts):
        buckets, starts, doc = _grams(part)
        if not len(starts):
            continue
        loglik = np.add.reduceat(model[buckets], starts)
        words = np.exp(np.maximum(loglik - loglik.max(1, keepdims=True), -30))
        begins = np.flatnonzero(np.diff(doc, prepend=-1))
        which = doc[begins]
        n = np.diff(np.append(begins, len(words)))
        doc = np.repeat(np.arange(len(which)), n)
        share, _ = _mix(words, doc, begins, STEPS, np.ones((len(which), model.shape[1])))
        rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
        best = (rank == 0).astype(float)
        best_score = np.add.reduceat(np.log((words * best[doc]).sum(1)), begins)
        # Further languages are tried only where one more has a share that could pay.
        second = np.sort(share, axis=1)[:, -2] if model.shape[1] > 1 else np.zeros(len(which))
        some = np.flatnonzero(second >= LEAST_SHARE)
        if len(some):
            for k in range(2, model.shape[1] + 1):
                pick = np.isin(doc, some)
                w, n_some = words[pick], n[some]
                d, b = np.repeat(np.arange(len(some)), n_some), np.concatenate([[0], np.cumsum(n_some)[:-1]])
                found, score = _mix(w, d, b, STEPS, (rank[some] < k).astype(float))
                score = score - (k - 1) / 2 * np.log(n_some)
                better = score > best_score[some]
                best[some[better]], best_score[some[better]] = found[better], score[better]
                if k >= ALWAYS_TRIED:
                    some = some[better]
                if not len(some):
                    break
        full[begin + which], chosen[begin + which], lettered[begin + which] = share, best, True
    return full, chosen, lettered


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in order, and the log-probability of each bucket (rows) in each (columns).

    Only rows with an id, a text and a language that are not held out count; of
    each language about ``SAMPLE`` of them, chosen by a hash of doc_id.
    """
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, SAMPLE / sizes[k]))))
    sample = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))
    rows = sample.select("text", "lang").mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((BUCKETS, len(langs)), PRIOR)
    got = rows.toPandas()  # at most BUCKETS rows for each language
    counts[got["bucket"].to_numpy(int), [langs.index(x) for x in got["lang"]]] += got["n"].to_numpy()
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, shares) for each row of ``docs``.

    lang_pred has the largest share in the selected set (the first by name in a
    tie) and score is its share in the mixture of all languages. languages names
    the set, largest share first, and shares has their proportions. A text that
    is null or has no letters is ``und`` with score 0 and no languages; so is all
    if there is nothing to fit on. The model is fitted on ``docs`` unless given.
    Other columns are ignored; an empty table gives an empty result.
    """
    return _identified(docs, model).drop("certainty")


def _identified(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """What :func:`identify` returns, and certainty: the selected set's share in the mixture of all languages."""
    langs, table = model or fit(docs)
    held = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS x languages floats

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            out = pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": "und", "score": 0.0, "certainty": 0.0})
            names: list[list[str]] = [[] for _ in texts]
            shares: list[list[float]] = [[] for _ in texts]
            if langs and texts:
                full, chosen, lettered = infer(texts, held.value)
                top = chosen.argmax(1)
                out["lang_pred"] = np.where(lettered, np.array(langs, object)[top], "und")
                out["score"] = np.where(lettered, np.clip(full[np.arange(len(top)), top], 0, 1), 0.0)
                out["certainty"] = np.where(lettered, np.clip((full * (chosen > 0)).sum(1), 0, 1), 0.0)
                for i in np.flatnonzero(lettered):
                    order = [j for j in np.argsort(-chosen[i], kind="stable") if chosen[i, j] > 0]
                    names[i], shares[i] = [langs[j] for j in order], [float(chosen[i, j]) for j in order]
            yield out.assign(languages=names, shares=shares)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double, certainty double, languages array<string>, shares array<double>")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a language: not ``und``, and a selected set that has ``LEAST_CERTAINTY`` or more of the mixture; all columns as they are.

    A null doc_id can't be told from others and its rows stay.
    """
    gone = _identified(docs).where((F.col("lang_pred") == "und") | (F.col("certainty") < LEAST_CERTAINTY)).where("doc_id is not null").select("doc_id").distinct()
    return without(docs, Scratch(docs.sparkSession, "language").save(gone, "gone"))
