"""Best-fit packing of tokenized documents into sequences, by large-item matching.

Only how many pieces have each length decides the plan, and there are no more
lengths than the capacity: so the plan is made once from a histogram of bounded
size. Pieces above a third of the capacity go two to a sequence at most, the
longest with the longest that still fits; smaller ones, longest first, go where
they leave the least room. Each piece then finds its place by its length and its
rank among the pieces of that length, which is counted in parts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, bounded
from tessera.llm.tokens import default_vocabulary, encoder

CAPACITY = 2048
#: Pieces in a part, on average.
PART = 4096

#: Rows of a plan: pieces of ``length`` with ranks from ``start`` up to ``end`` go ``each`` to a sequence, from sequence ``base`` and place ``offset`` on.
PLAN = ("length", "start", "end", "each", "base", "offset")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """The plan's rows for ``counts`` pieces of each length from 1 to ``capacity``."""
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    #: Room in a sequence -> [how many sequences, their pieces as (length, each)].
    open_: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, how_many: int, pieces: tuple) -> None:
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append((how_many, pieces))

    for n in reversed(large):
        while left[n] > 0:
            mate = next((m for m in reversed(large[: bisect_left(large, capacity - n + 1)]) if left[m] > (m == n)), None)
            if mate is None:
                put(capacity - n, left[n], ((n, 1),))
                left[n] = 0
            elif mate == n:
                put(capacity - 2 * n, left[n] // 2, ((n, 2),))
                left[n] %= 2
            else:
                pairs = min(left[n], left[mate])
                put(capacity - n - mate, pairs, ((n, 1), (mate, 1)))
                left[n] -= pairs
                left[mate] -= pairs
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                put(capacity, -(-todo // (capacity // n)), ())
                continue
            room = rooms[at]
            how_many, pieces = open_[room].pop()
            if not open_[room]:
                del open_[room]
                del rooms[at]
            each = room // n
            full = min(how_many, todo // each)
            if full:
                put(room - each * n, full, (*pieces, (n, each)))
                todo -= full * each
            rest = 0
            if todo and full < how_many:
                rest, some = 1, min(each, todo)
                put(room - some * n, 1, (*pieces, (n, some)))
                todo -= some
            if how_many - full - rest:
                put(room, how_many - full - rest, pieces)
    rows, base, used = [], 0, dict.fromkeys(counts, 0)
    for room in rooms:
        for how_many, pieces in open_[room]:
            if pieces:
                offset = 0
                for n, each in pieces:
                    rows.append((n, used[n], used[n] + how_many * each, each, base, offset))
                    used[n] += how_many * each
                    offset += n * each
                base += how_many
    return np.array(sorted(rows), np.int64).reshape(-1, len(PLAN))


def _pieces(vocabulary: str, capacity: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        encode = encoder(vocabulary)
        size = 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                ids = encode(text if isinstance(text, str) else None) + b"\0\0\0\0"
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    rows.append((None if pd.isna(doc_id) else doc_id, at // size, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return cut


def _placed(rows: np.ndarray):
    """Adds sequence and offset by (length, rank); ``rows`` are sorted by (length, start)."""
    key = rows[:, 0] << 48 | rows[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch.pop("rank").to_numpy()
            length = batch["length"].to_numpy()
            at = rows[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            sequence, nth = np.divmod(rank - at[:, 1], at[:, 3])
            yield batch.assign(sequence_id=at[:, 4] + sequence, offset=at[:, 5] + nth * length)

    return place


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of ``docs``.

    A row's ids are its text's by the vocabulary file, then id 0 (alone for a
    null or empty text). Rows of more than ``capacity`` ids are cut into pieces
    of that many; the last may be shorter. All pieces of a sequence lie one after
    another from offset 0. Repeated rows are packed each; a null doc_id stays
    null. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = scratch.save(docs.mapInPandas(_pieces(vocabulary or default_vocabulary(), capacity), schema), "pieces")
    # Full pieces fill a sequence each and need no plan; their sequences are numbered below zero.
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    parts = max(1, rest.count() // PART)
    rest = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    counts = scratch.save(rest.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = scratch.save(counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")), "before")
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rest.withColumn("nth", nth).join(bounded(before), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    out = full.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    if histogram:
        out = out.unionByName(ranked.mapInPandas(_placed(plan(histogram, capacity)), f"{schema}, sequence_id long, offset long"))
    return out
