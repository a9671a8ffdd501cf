"""Near-duplicates whose ids stand for several texts, and patterns on texts made to be slow."""

from __future__ import annotations

import random
import time

import pytest
from test_operators import Union, shingles

from tessera.llm import near_dedup, pii


def brute(rows):
    """The component of each (doc_id, text): by links of texts and by ids that texts share."""
    sets = {(d, t): shingles(t) for d, t in rows if d is not None}
    union = Union({d for d, _ in sets})
    keys = [k for k in sets if sets[k]]
    for i, x in enumerate(keys):
        for y in keys[:i]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                union.join(x[0], y[0])
    return {(d, t): union.find(d) if s else d for (d, t), s in sets.items()}


def words(rng, n=60):
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(1000)) for _ in range(n))


def test_each_text_of_an_id_links(spark):
    rng = random.Random(3)
    a, b, c = words(rng), words(rng), words(rng)
    rows = [(5, a), (5, b), (5, c), (9, b + " tail"), (11, a + " tail"), (13, c + " tail"), (2, words(rng)), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(5, 5), (9, 5), (11, 5), (13, 5), (2, 2)}


@pytest.mark.parametrize("seed", range(3))
def test_random_repeated_ids(spark, seed):
    rng = random.Random(seed)
    texts = [words(rng) for _ in range(12)]
    texts += [t + " tail" for t in texts[:8]] + ["new " + t for t in texts[4:9]] + ["", "one"]
    rows = [(rng.randrange(14), rng.choice(texts)) for _ in range(40)]
    docs = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "n int, doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in near_dedup.near_duplicates(docs).collect())
    want = brute(rows)
    assert got == sorted((d, want[d, t], len(shingles(t))) for d, t in rows)


@pytest.mark.parametrize("text", ["a [at] " + "xdot" * 200 + "éb", "a at " + "b dot " * 500 + "é", "a at " + "b." * 500 + "!", "dot" * 500, "a [at] b" + " dot" * 500])
def test_spelled_addresses_take_linear_time(text):
    began = time.process_time()
    for a in range(0, len(text), 7):
        pii._SPELLED.fullmatch(text, a)
    assert time.process_time() - began < 1


def test_spelled_addresses():
    good = ["a.b at c dot org", "a [at] c [dot] org", "a(at)c(dot)d.org", "x_1 [AT] mail.co", "a at c.d dot e"]
    assert all(pii._SPELLED.fullmatch(t) for t in good)
    assert not any(pii._SPELLED.fullmatch(t) for t in ["a at c", "data", "a at dot", "cat dot org", "a [at] [dot] b"])


def test_sampling_does_not_depend_on_partitions(spark):
    rows = [(i, f"write to user{i % 40}@mail{i % 7}.org or call +49 30 {i:06d} now, order {i}") for i in range(200)] + [(0, "write to x@y.org")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.fit(docs.repartition(2)) == pii.fit(docs.repartition(7)) != {}
