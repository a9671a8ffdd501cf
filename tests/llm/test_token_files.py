"""Huffman codes and files of token ids: round trips, optimality and edge cases."""

from __future__ import annotations

import heapq
import itertools
import zlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tessera.llm import huffman, token_files
from tessera.llm.scratch import Scratch


def huffman_cost(counts):
    """Bits of all symbols by the plain algorithm, without a limit."""
    heap = [(int(c), 0) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
        total += a + b
        heapq.heappush(heap, (a + b, 0))
    return total


def test_lengths_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = rng.zipf(1.3, rng.integers(2, 60)).clip(max=10**6)
        lengths = huffman.code_lengths(counts, 25)
        assert (counts * lengths).sum() == huffman_cost(counts) or lengths.max() == 25
    # With a limit: against all sets of lengths that a prefix code can have.
    for counts in ([1, 1, 2, 5, 30], [1, 2, 4, 8, 16, 32], [7, 7, 7, 1]):
        lengths = huffman.code_lengths(np.array(counts), 3)
        best = min(sum(c * b for c, b in zip(counts, bits)) for bits in itertools.product((1, 2, 3), repeat=len(counts)) if sum(2.0**-b for b in bits) <= 1)
        assert lengths.max() <= 3 and sum(2.0 ** -lengths.astype(float)) <= 1 and (counts * lengths).sum() == best
    assert huffman.code_lengths(np.array([0, 9, 0])).tolist() == [0, 1, 0] and not huffman.code_lengths(np.zeros(4, int)).any()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, int), 2)


def test_codes_are_canonical_prefix_codes():
    counts = np.random.default_rng(4).integers(0, 50, 200) ** 3
    lengths = huffman.code_lengths(counts)
    codes = huffman.canonical_codes(lengths)
    words = [format(int(c), f"0{b}b") for c, b in sorted(zip(codes, lengths), key=lambda x: (x[1], x[0])) if b]
    assert words == sorted(words) and not any(y.startswith(x) for x, y in itertools.pairwise(words))


@pytest.mark.parametrize("n", [0, 1, 2, 6, 7, 8, 1000, 4097])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), 70_000) - 1
    lengths = huffman.code_lengths(np.bincount(ids, minlength=70_000))
    payload, marks = huffman.encode(ids, lengths, huffman.canonical_codes(lengths), 7)
    table, top = huffman.decoding_table(lengths)
    assert np.array_equal(huffman.decode(payload, marks, n, table, top, 7), ids)
    for k in range(0, n // 7, 50):  # a block alone, from the byte on that holds its first bit
        at = int(marks[k]) // 8
        assert np.array_equal(huffman.decode(payload[at:], marks[k : k + 2].astype(np.int64) - 8 * at, 7, table, top, 7), ids[7 * k : 7 * k + 7])


def test_damage_is_noticed():
    ids = np.arange(600) % 50
    lengths = huffman.code_lengths(np.bincount(ids) ** 2)
    payload, marks = huffman.encode(ids, lengths, huffman.canonical_codes(lengths), 64)
    table, top = huffman.decoding_table(lengths)
    bad = bytes([payload[0] ^ 255]) + payload[1:]
    try:
        assert not np.array_equal(huffman.decode(bad, marks, 600, table, top, 64), ids)
    except ValueError:
        pass


def library_ids(text):
    e = token_files._encoder(token_files.default_vocabulary())
    return [*e.whole.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]


def test_ids_are_the_librarys(spark):
    encode = token_files._encoder(token_files.default_vocabulary())
    assert encode.fast
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += ["  a  b\n\n  c ", "it's\n foo  bar\tbaz", " x", "\n y", "a \nb", "é\xa0 　x 中文 字", "a\x1c b \x1d", "a᠎ b", "x<|endoftext|>y", "'s't're", "a" * 5000, "\xad\x7f½²", "\r\n\r\n"]
    for text in texts:
        assert np.frombuffer(encode(text), encode.kind).tolist() == library_ids(text)[:-1], text[:50]


def want(rows):
    """(doc_id, start, n_tokens, crc) of documents in order, null ids first."""
    out, start = [], 0
    ids = [(d, np.array(library_ids(t), "<u4")) for d, t in rows]
    for d, i in sorted(ids, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1]))):
        out.append((d, start, len(i), zlib.crc32(i)))
        start += len(i)
    return out


def test_files_round_trip(spark, tmp_path):
    long = "one two, three. " * 3000
    rows = [(5, "a b"), (3, None), (None, "x y z"), (9, ""), (4, long), (3, "twice"), (3, "twice"), (-7, "  \n "), (None, None), (2**62, "中文")]
    docs = spark.createDataFrame([(*r, 1, "n", "f") for r in rows], "doc_id long, text string, n_tokens int, ids string, file string")
    for block, file_ids in ((512, 4_000_000), (3, 5), (8, 5000)):
        path = f"file://{tmp_path}/{block}"
        token_files.write_ids(docs, path, block=block, file_ids=file_ids)
        got = token_files.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want(rows)


def test_whole_table(spark):
    scratch = Scratch(spark, "test-token-files")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    path = scratch.path("files")
    token_files.write_ids(docs.repartition(5), path, file_ids=20_000)
    got = token_files.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_a_part_of_a_file_is_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} with some words") for i in range(300)], "doc_id long, text string").coalesce(1)
    token_files.write_ids(docs, f"file://{tmp_path}/f", block=16)
    (name,) = [p for p in (tmp_path / "f").iterdir() if p.suffix == ".tid"]
    with name.open("rb") as f:
        file = token_files.IdFile(f)
        ids = file.ids()
        assert ids.tolist() == [i for d in range(300) for i in library_ids(f"text number {d} with some words")]
        for a, b in ((0, 1), (15, 17), (100, 100), (333, 401), (len(ids) - 1, len(ids))):
            assert np.array_equal(file.ids(a, b), ids[a:b])


def test_nothing_gives_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_ids(none, f"file://{tmp_path}/none")
    assert token_files.read_ids(spark, f"file://{tmp_path}/none").collect() == []
