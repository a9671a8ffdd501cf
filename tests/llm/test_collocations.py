"""Phrase collocations against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from tessera.llm import collocations


def brute(rows, least=30, longest=4, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        wanted = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in wanted.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    most[p[i : i + m]] = max(most[p[i : i + m]], a)
        found = []
        for p, a in wanted.items():
            if 100 * most[p] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def result(found):
    return sorted(map(tuple, found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "text").collect()]


@pytest.mark.parametrize("least, top", [(30, 2000), (3, 150)])
def test_equals_brute_force(spark, rows, least, top):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    assert result(collocations.collocations(docs, least, top=top)) == brute(rows, least, top=top)


def test_blocks_of_words_and_phrases(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 700)
    monkeypatch.setattr(collocations, "BLOCK_PHRASES", 500)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    assert result(collocations.collocations(docs, 4)) == brute(rows, 4)


def test_edges(spark):
    texts = [
        ("en", "a b c. a b\tc\nA B c d"), ("en", "x x x x x x"), (None, "a b"), ("und", "a b! a  b"), ("fr", None), ("fr", ""), ("fr", "... ,"),
        ("en", "the same Été\x1cx ÀB àB"), ("de", "straße gasse " * 50_000), ("en", "a b c. a b\tc\nA B c d"), ("ru", "это да " * 5), ("en", "nul\x00in word nul\x00in word"),
    ]
    docs = spark.createDataFrame([(*t, 1, 2, b"") for t in texts], "lang string, text string, n int, id long, words binary")
    for least, longest in ((2, 4), (1, 4), (2, 2), (3, 3)):
        assert result(collocations.collocations(docs, least, longest)) == brute(texts, least, longest), (least, longest)
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert result(collocations.collocations(docs, 10**6)) == []


@pytest.mark.parametrize("dense", [1, 4, 10**9])
def test_tiles(monkeypatch, dense):
    monkeypatch.setattr(collocations, "SIDE", 8)
    monkeypatch.setattr(collocations, "DENSE", dense)
    monkeypatch.setattr(collocations, "AT_A_TIME", 2)
    rng = np.random.default_rng(dense)
    left, right = rng.zipf(1.5, 3000).clip(max=200) - 1, rng.zipf(1.5, 3000).clip(max=90) - 1
    got = collocations.count_pairs(left, right)
    assert {(a, b): n for a, b, n in zip(*map(np.ndarray.tolist, got), strict=True)} == Counter(zip(left.tolist(), right.tolist()))
    assert len(got[0]) == len(set(zip(left.tolist(), right.tolist())))
    none = np.empty(0, np.int64)
    assert [len(x) for x in collocations.count_pairs(none, none)] == [0, 0, 0]


def test_counts_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(collocations, "FLUSH_WORDS", 3)
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"], "text": ["a b c d", "a a", "a b"]})
    total = Counter()
    for part in collocations._count_words(iter([batch, batch])):
        for lang, word, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
            total[lang, word] += n
    assert total == {("en", None): 12, ("de", None): 4, ("en", b"a"): 4, ("en", b"b"): 4, ("en", b"c"): 2, ("en", b"d"): 2, ("de", b"a"): 4}


def test_scores_beyond_64_bits(spark):
    """2,000,000 times a count of 5e12 passes 64 bits."""
    got = spark.sql("SELECT (cast(2000000 as decimal(7, 0)) * cast(5000000000000 as decimal(19, 0))) div (cast(6000000000000 as decimal(19, 0)) + cast(5000000000000 as decimal(19, 0))) AS s").first()["s"]
    assert got == 2_000_000 * 5 * 10**12 // (11 * 10**12)


def test_memory_of_counting_is_bounded():
    """A task's memory grows neither with the texts of a batch nor with the tiles that are dense."""
    import tracemalloc

    rng = np.random.default_rng(13)
    texts = [rng.integers(0, 8 * collocations.SIDE, 400).astype(np.int32).tobytes() for _ in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(texts, pa.binary()), pa.array([4] * len(texts), pa.int32())], names=["words", "symbols", "wide"])
    tracemalloc.start()
    try:
        handed = [(b.num_rows, int(b.column(2).to_numpy().sum())) for b in collocations._count_phrases(1)(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(n for _, n in handed) == 10_000 * 399 and max(n for n, _ in handed) <= 100_000
    assert peak < 150e6, peak


def test_driver_gathers_bits_alone(spark, rows, monkeypatch):
    """What passes through the driver is a row of bits for some 2,000 words or phrases, and no word or phrase."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    gathered = []

    def watched(plain):
        def gather(self, *args, **more):
            found = plain(self, *args, **more)
            gathered.append((tuple(self.columns), len(found)))
            return found

        return gather

    for name in ("collect", "toPandas", "toArrow"):
        monkeypatch.setattr(type(docs), name, watched(getattr(type(docs), name)))
    found = collocations.collocations(docs, 2)
    monkeypatch.undo()
    assert {columns for columns, _ in gathered} == {("bucket", "bits")}
    assert sum(n for _, n in gathered) < 50
    assert result(found) == brute(rows, 2)


def test_bits_and_chunks_have_no_effect(spark, rows, monkeypatch):
    """Bits that many phrases share only let through what the sums drop again."""
    for name, value in (("BLOCK_WORDS", 1), ("BLOCK_PHRASES", 1), ("CHUNK", 500)):
        monkeypatch.setattr(collocations, name, value)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    assert result(collocations.collocations(docs, 2, 5)) == brute(rows, 2, 5)


def test_bits_of_phrases():
    """A phrase passes whose bits, and those of its parts, are set; ends of pieces and rare words are in none."""
    words = np.array([5, 6, 7, collocations.BREAK, 5, 6, collocations.RARE, 6, 7, 8, collocations.BREAK])

    def table(*phrases):
        bits = np.zeros(collocations.BUCKET, np.uint8)
        for phrase in phrases:
            for factor in collocations.FACTORS:
                total = phrase[0]
                for word in phrase[1:]:
                    total = (total * factor + word) % collocations.PRIME
                bits[total % len(bits)] = 1
        return np.packbits(bits, bitorder="little").tobytes()

    two, three = table((5, 6), (6, 7)), table((5, 6, 7))
    assert collocations._places(words, []).tolist() == [0, 1, 2, 4, 5, 7, 8, 9]
    assert collocations._places(words, [two]).tolist() == [0, 1, 4, 7]
    assert collocations._places(words, [two, three]).tolist() == [0]
    assert collocations._places(words, [table(), three]).tolist() == []
