"""Ranked lexical search of many items at once, with shared partial sums.

An item's score in a document is a sum over its terms, so what several items
share need be summed only once. Mining finds, among items, terms that occur in
the same items and then, again and again, the pair of partial sums that most
items still have in common; each becomes a node of a graph in which an item is
the sum of two nodes. A task fills the accumulators of single terms for some
documents, adds them up along the graph, every node once, and keeps of each item
the documents that can still be among the first. All of it is exact in 64-bit
integers.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch
from tessera.llm.token_files import _in_batches

#: Documents of an item's result.
TOP = 50
#: (item, term) pairs of the items that one pass over the documents serves, and of those that are mined together.
PASS_TERMS, MINE_TERMS = 1_000_000, 20_000
#: Partial sums of an item of which all pairs are counted at a time.
MINE_WIDTH = 48
#: Bytes of a task's accumulators.
ACCUMULATORS = 64_000_000
#: Candidates that a task holds before it drops those that can't be among the first.
HELD = 400_000
#: Parts of an item's candidates whose first ones are found before those of all.
SALTS = 32

#: A-Z in lower case; every ASCII character that is no letter or digit separates terms.
_TABLE = bytes(c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text in UTF-8, with repeats; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def share(items: dict[int, list[int]]) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """A graph of sums over ``items`` (each a list of distinct terms): nodes (left, right), and each item's node.

    Term t is ~t; node i comes after those it adds. Items without terms have none.
    """
    nodes: list[tuple[int, int]] = []

    def total(parts: list[int]) -> int:
        """The node of a sum, as a balanced tree."""
        while len(parts) > 1:
            paired = []
            for x, y in zip(parts[::2], parts[1::2]):
                nodes.append((x, y))
                paired.append(len(nodes) - 1)
            parts = paired + parts[len(parts) // 2 * 2 :]
        return parts[0]

    # Terms that are in the same items are one sum.
    within = defaultdict(list)
    for item, terms in items.items():
        for t in terms:
            within[t].append(item)
    groups = defaultdict(list)
    for t, where in within.items():
        groups[tuple(where)].append(~t)
    parts: dict[int, list[int]] = defaultdict(list)
    for where, terms in sorted(groups.items(), key=lambda g: -len(g[0])):
        node = total(terms)
        for item in where:
            parts[item].append(node)
    # The pair of sums that most items have in common becomes a node, until no two items share any. Very long items are mined in
    # pieces, those of the most common sums first.
    pieces = {(item, at): set(p[at : at + MINE_WIDTH]) for item, p in parts.items() for at in range(0, len(p), MINE_WIDTH)}
    holding = defaultdict(set)
    for key, piece in pieces.items():
        for x in piece:
            holding[x].add(key)
    common = Counter(pair for piece in pieces.values() for pair in combinations(sorted(x for x in piece if len(holding[x]) > 1), 2))
    heap = [(-n, pair) for pair, n in common.items() if n > 1]
    heapify(heap)
    while heap:
        n, (x, y) = heappop(heap)
        keys = holding[x] & holding[y]
        if len(keys) < 2:
            continue
        if len(keys) < -n:
            heappush(heap, (-len(keys), (x, y)))
            continue
        nodes.append((x, y))
        new = len(nodes) - 1
        near: Counter = Counter()
        for key in keys:
            piece = pieces[key]
            piece -= {x, y}
            near.update(piece)
            piece.add(new)
        holding[x] -= keys
        holding[y] -= keys
        holding[new] = set(keys)
        for z, k in near.items():
            if k > 1:
                heappush(heap, (-k, (min(z, new), max(z, new))))
    roots = defaultdict(list)
    for (item, _), piece in pieces.items():
        roots[item] += sorted(piece)
    return nodes, {item: total(p) for item, p in roots.items()}


def _mine(rows: pd.DataFrame) -> pd.DataFrame:
    """The graph of a group of items: nodes (node, left, right) in order, then each item's node (item, left)."""
    items = rows.sort_values(["item", "term"]).groupby("item")["term"].agg(list).to_dict()
    nodes, roots = share(items)
    out = [(i, x, y, None) for i, (x, y) in enumerate(nodes)] + [(len(nodes), node, None, item) for item, node in roots.items()]
    return pd.DataFrame(out, columns=["node", "left", "right", "item"]).assign(mined=rows["mined"].iloc[0]).astype({"left": "Int64", "right": "Int64", "item": "Int64"})


class Graph:
    """Sums of terms, level by level. A slot is a term, or beyond all terms a node."""

    def __init__(self, n_terms: int, found: pd.DataFrame):
        left, right, items, roots, self.size = [], [], [], [], n_terms
        for _, one in found.sort_values(["mined", "node"]).groupby("mined"):
            slot = lambda refs, base=self.size: np.where(refs < 0, ~refs, base + refs)
            sums = one[one["item"].isna()]
            left.append(slot(sums["left"].to_numpy(np.int64)))
            right.append(slot(sums["right"].to_numpy(np.int64)))
            ends = one[one["item"].notna()]
            items.append(ends["item"].to_numpy(np.int64))
            roots.append(slot(ends["left"].to_numpy(np.int64)))
            self.size += len(sums)
        self.items, self.roots = np.concatenate(items), np.concatenate(roots)
        a, b = np.concatenate(left), np.concatenate(right)
        depth = np.zeros(self.size, np.int64)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            depth[n_terms + i] = 1 + max(depth[x], depth[y])
        self.levels = [(np.flatnonzero(depth == d), a[at], b[at]) for d in range(1, depth.max(initial=0) + 1) for at in [np.flatnonzero(depth == d) - n_terms]]

    def add_up(self, sums: np.ndarray) -> np.ndarray:
        """Scores (item, document), from ``sums`` (slot, document) with those of terms filled in."""
        for out, x, y in self.levels:
            sums[out] = sums[x] + sums[y]
        return sums[self.roots]


_POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tf", pa.binary())])


def _postings(known):
    """Of each document with a term: how many it has, and which query terms how often."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = terms_of(text.as_py())
                    if words:
                        ids = np.fromiter(map(place.get, words, repeat(-1)), np.int32, len(words))
                        ids, tf = np.unique(ids[ids >= 0], return_counts=True)
                        yield doc_id, len(words), ids.tobytes(), tf.astype(np.int64).tobytes()

        yield from _in_batches(rows(), _POSTINGS, lambda row: 3 * len(row[2]))

    return scan


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of a task's documents."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
        n = np.bincount(ids, minlength=len(total))
        n[: len(total)] += total
        total = n
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["term", "df"])


def weight(n_docs: int, df: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _lengths(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents of ``n`` terms; 50 * n * N may pass 64 bits."""
    if int(n.max(initial=0)) * 50 * n_docs < 2**63:
        return 50 + 50 * n * n_docs // total
    return np.array([50 + 50 * int(k) * n_docs // total for k in n], np.int64)


def _score(graph, n_docs: int, total: int, top: int):
    """The documents of a task that can be among the first of each item: (item, doc_id, score)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, weights = graph.value
        step = max(8, ACCUMULATORS // (8 * g.size))
        least = np.ones(len(g.items), np.int64)
        held: list[np.ndarray] = []

        def first(rows: np.ndarray) -> np.ndarray:
            """The ``top`` rows (item's place, null id, doc_id, score) of each item; null ids are last among equals."""
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 3], rows[:, 0]))]
            begin = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
            nth = np.arange(len(rows)) - np.repeat(begin, np.diff(begin, append=len(rows)))
            full = rows[nth == top - 1]
            least[full[:, 0]] = full[:, 3]
            return rows[nth < top]

        def put(doc_ids: list[int | None], n: np.ndarray, ids: list[bytes], tf: list[bytes]) -> None:
            nonlocal held
            sums = np.zeros((g.size, len(n)), np.int64)
            doc = np.repeat(np.arange(len(n)), [len(x) // 4 for x in ids])
            term, f = np.frombuffer(b"".join(ids), np.int32), np.frombuffer(b"".join(tf), np.int64)
            sums[term, doc] = weights[term] * (1_000_000_000 * f // (1000 * f + 20 * _lengths(n, n_docs, total)[doc]))
            scores = g.add_up(sums)
            item, doc = np.nonzero(scores >= least[:, None])
            null = np.array([d is None for d in doc_ids])
            number = np.array([d or 0 for d in doc_ids], np.int64)
            held.append(np.stack([item, null[doc].astype(np.int64), number[doc], scores[item, doc]], 1))
            if sum(map(len, held)) > HELD:
                held = [first(np.concatenate(held))]

        for batch in batches:
            n = batch.column(1).to_numpy()
            for at in range(0, len(n), step):
                put(batch.column(0)[at : at + step].to_pylist(), n[at : at + step], batch.column(2)[at : at + step].to_pylist(), batch.column(3)[at : at + step].to_pylist())
        rows = first(np.concatenate(held)) if held else np.empty((0, 4), np.int64)
        for at in range(0, max(1, len(rows)), 100_000):
            part = rows[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(g.items[part[:, 0]]), pa.array(part[:, 2], mask=part[:, 1] > 0), pa.array(part[:, 3])], names=["item", "doc_id", "score"])

    return score


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(item, t) for item, text in zip(batch["item"], batch["text"], strict=True) for t in set(terms_of(text))]
        yield pd.DataFrame(rows, columns=["item", "word"])


def search(docs: DataFrame, items: DataFrame, top: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of docs (doc_id, text, ...) for each item of items (item_id, text, ...).

    Rows that repeat an item_id, null ones too, are one item with the terms of
    all. Every row of docs is a document of its own, whatever its doc_id; null
    ids are last among equal scores. Texts without terms, null ones too, match
    nothing. Other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lexical")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = scratch.save(items.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    texts = items.select("item_id", F.col("text").cast("string").alias("text"))
    texts = texts.join(ids.withColumnRenamed("item_id", "known"), F.col("item_id").eqNullSafe(F.col("known"))).select("item", "text")
    pairs = scratch.save(texts.mapInPandas(_terms, "item long, word binary").distinct(), "terms")
    # An item's terms stay together; items are dealt out to passes over the documents, and within a pass to groups that are mined.
    groups = 1 + pairs.count() // MINE_TERMS
    passes = 1 + groups * MINE_TERMS // PASS_TERMS
    pairs = pairs.withColumn("mined", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int")).withColumn("pass", F.col("mined") % passes)
    best = []
    for nth in range(passes):
        mine = pairs.where(F.col("pass") == nth)
        words = mine.select("word").distinct().toPandas()["word"].sort_values()  # those of PASS_TERMS pairs
        place = {bytes(w): i for i, w in enumerate(words)}
        known = spark.sparkContext.broadcast(place)
        postings = docs.mapInArrow(_postings(known), "doc_id long, n long, terms binary, tf binary")
        postings = scratch.save(postings, "postings")
        n_docs, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not place:
            continue
        df = postings.select("terms").mapInArrow(_holding, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
        weights = np.zeros(len(place), np.int64)
        weights[df["term"].to_numpy(np.int64)] = [weight(n_docs, int(n)) for n in df["df"]]
        mined = mine.mapInPandas(_numbered(known), "mined int, item long, term long").groupBy("mined").applyInPandas(_mine, "node long, left long, right long, item long, mined int")
        graph = spark.sparkContext.broadcast((Graph(len(place), mined.toPandas()), weights))
        best.append(postings.mapInArrow(_score(graph, n_docs, total, top), "item long, doc_id long, score long"))
    if not best:
        return ids.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    found = best[0]
    for more in best[1:]:
        found = found.union(more)
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    for keys in (["item", "salt"], ["item"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def _numbered(known):
    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"mined": batch["mined"], "item": batch["item"], "term": [known.value[bytes(w)] for w in batch["word"]]})

    return number
