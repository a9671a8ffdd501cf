"""Ranked lexical search against brute force, and its graph of shared sums."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from conftest import SMALL

from tessera.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def brute(docs, items, top=50):
    """(item_id, rank, doc_id, score), as the scores are defined."""
    bags = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(words(text))
    out = []
    for item, wanted in terms.items():
        found = []
        for d, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in wanted if t in bag)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(found)[:top], 1)]
    return out


def result(found):
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_equals_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert result(lexical.search(docs, items)) == ordered(want)


def test_many_passes(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 7)
    monkeypatch.setattr(lexical, "MINE_TERMS", 60)
    monkeypatch.setattr(lexical, "PASS_TERMS", 200)
    assert result(lexical.search(docs.repartition(3), items, top=7)) == ordered(want)


def test_edges(spark):
    docs = [(3, "Apple pear, plum"), (1, "apple pear plum"), (None, "apple PEAR plum"), (None, "apple pear plum"), (1, "apple pear plum"), (9, None), (8, ""), (7, "..."), (5, "kiwi " * 70_000), (6, "été Ünder 42"), (2, "other words only")]
    items = [(1, "Pear pear KIWI"), (2, None), (None, "plum"), (None, "42"), (4, ""), (5, "unknown"), (1, "Ünder"), (6, "ÜNDER été"), (7, "pear plum apple kiwi " * 400)]
    d = spark.createDataFrame([(*r, 1, 2, "x") for r in docs], "doc_id long, text string, score int, item long, word string")
    i = spark.createDataFrame([(*r, 1, "y") for r in items], "item_id long, text string, doc_id int, pass string")
    want = ordered(brute(docs, items))
    assert result(lexical.search(d, i)) == want and any(r[2] is None for r in want)
    assert result(lexical.search(d, i, top=2)) == ordered(brute(docs, items, 2))
    assert lexical.search(d.limit(0), i).collect() == [] and lexical.search(d, i.limit(0)).collect() == []
    assert lexical.search(d, i).columns == lexical.search(d, i.limit(0)).columns


def test_graph_sums_every_item_once():
    rng = random.Random(5)
    for case in range(30):
        common = list(range(12))
        items = {k: sorted(set(rng.sample(common, rng.randint(0, 9)) + rng.sample(range(12, 90), rng.randint(0, 60)))) for k in range(25)}
        items = {k: v for k, v in items.items() if v}
        nodes, roots = lexical.share(items)

        def leaves(x):
            return [~x] if x < 0 else leaves(nodes[x][0]) + leaves(nodes[x][1])

        assert roots.keys() == items.keys() and all(sorted(leaves(roots[k])) == v for k, v in items.items()), case
        assert all(max(n) < i for i, n in enumerate(nodes))
        assert len(nodes) <= sum(len(v) - 1 for v in items.values())
        found = pd.DataFrame([(0, i, x, y, None) for i, (x, y) in enumerate(nodes)] + [(0, len(nodes), n, None, k) for k, n in roots.items()], columns=["mined", "node", "left", "right", "item"])
        graph = lexical.Graph(90, found)
        sums = np.zeros((graph.size, 4), np.int64)
        sums[:90] = np.arange(90)[:, None] ** 2 * [1, 2, 3, 5]
        assert {k: s.tolist() for k, s in zip(graph.items.tolist(), graph.add_up(sums))} == {k: [m * sum(t * t for t in v) for m in (1, 2, 3, 5)] for k, v in items.items()}


def test_sharing_saves_sums(spark):
    """Items with common terms need fewer sums than each on its own."""
    items = {k: sorted({1, 2, 3, 4, 5, 6, 7, *range(10 * k + 10, 10 * k + 13)}) for k in range(20)}
    nodes, _ = lexical.share(items)
    assert len(nodes) == 6 + 20 * 3  # the seven common terms once; then each item's three own ones and both together


def test_lengths_beyond_64_bits():
    n = np.array([3, 10**9])
    assert lexical._lengths(n, 10**12, 10**15).tolist() == [50 + 50 * int(k) * 10**12 // 10**15 for k in n]
