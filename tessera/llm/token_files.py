"""Files of token ids, Huffman-coded in blocks.

Documents are tokenized once, in any order. The counts of all ids give one
canonical code of limited length. Documents are then dealt out by ranges of
doc_id, so that tasks in their order hold them in ascending order, and each task
writes its files. A task's attempt gives its files names of its own and reports
them only when it is done; the list of files holds what was reported, so a lost
or repeated attempt leaves nothing that is ever read.

A file (all numbers little-endian): ``MAGIC``; six unsigned 64-bit numbers:
vocabulary, ids in a block, documents, ids, blocks, bytes of coded ids; a byte
for each id of the vocabulary: the length of its code; an unsigned 64-bit bit
offset for each block, and that of the end; for each document a signed 64-bit
doc_id and its unsigned 64-bit number of ids; for each document a byte: 1 if its
doc_id is null; the coded ids. Codes are canonical, first bit highest.
"""

from __future__ import annotations

import functools
import io
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import huffman
from tessera.llm.scratch import Scratch

MAGIC = b"TIDFILE1"
#: The id after each document's.
END_ID = 2
#: Ids after which a task begins another file, and about as many for each task.
FILE_IDS = 4_000_000
#: Bytes in an Arrow batch that a task hands on, one document at least.
BATCH_BYTES = 16_000_000

#: How byte-level vocabularies cut texts into pieces: a fixed pattern.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What isn't white space of ASCII or a printable character of ASCII or Latin-1.
_UNUSUAL = re.compile("[^\t\n\r -~¡-¬®-ÿ]")


def default_vocabulary() -> str:
    """The vocabulary file of this operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteEncoder:
    """Whole texts to ids, as the ``tokenizers`` library gives them without special tokens added.

    A byte-level vocabulary whose ids ascend in the order of its merges is what
    ``tiktoken`` calls ranks, and both libraries then give the same ids; it takes
    a quarter of the time. Texts of characters that the two could class
    differently, or with special tokens, go through ``tokenizers``, and so do all
    texts if the vocabulary isn't of that kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        #: Of the largest id that the library knows.
        self.size = max(self.whole.get_vocab(with_added_tokens=True).values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        ranks = self._ranks(spec)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ranks(self, spec: dict) -> dict[bytes, int] | None:
        cut, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = not spec["normalizer"] and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and model["type"] == "BPE"
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        # Byte-level vocabularies write printable bytes as themselves and others as letters from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = iter(range(0x100, 0x200))
        byte = {chr(b if b in shown else next(hidden)): b for b in range(256)}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        in_order = sorted(vocabulary.values()) == list(range(len(vocabulary))) and [vocabulary[m] for m in merged] == list(range(256, len(vocabulary)))
        return {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items()} if in_order else None

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or _UNUSUAL.search(text) or any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast(text)
        return np.array(ids, self.kind).tobytes()


@functools.cache
def _encoder(path: str) -> ByteEncoder:
    """This Python worker's encoder for a vocabulary file."""
    return ByteEncoder(path)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, bytes_of) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``BATCH_BYTES`` each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += bytes_of(row) + 64
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def _tokenize(vocabulary: str, end_id: int):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        end = np.array([end_id], encode.kind).tobytes()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = encode(text.as_py()) + end
                    wide = np.frombuffer(ids, encode.kind).astype("<u4")
                    yield doc_id, len(wide), zlib.crc32(wide), ids

        yield from _in_batches(rows(), _IDS, lambda row: len(row[3]))

    return tokenize


def _count(kind: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, n) of a task."""
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                n = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                if len(n) > len(total):
                    total = np.append(total, np.zeros(len(n) - len(total), np.int64))
                total[: len(n)] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["id", "n"])

    return count


def _folder(path: str):
    """The file system of a folder's URI and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _file(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int) -> bytes:
    payload, checkpoints = huffman.encode(ids, lengths, codes, block)
    head = np.array([len(lengths), block, len(doc_ids), len(ids), len(checkpoints) - 1, len(payload)], "<u8")
    docs = np.empty((len(doc_ids), 2), "<i8")
    docs[:, 0], docs[:, 1] = [d or 0 for d in doc_ids], sizes
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, head.tobytes(), lengths.tobytes(), checkpoints.tobytes(), docs.tobytes(), nulls.tobytes(), payload])


def _write(path: str, kind: str, lengths: np.ndarray, block: int, file_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        codes = huffman.canonical_codes(lengths)
        system, folder = _folder(path)
        rows, doc_ids, sizes, ids, held = [], [], [], [], 0

        def put() -> None:
            name = f"ids-{part:06d}-{len(rows):05d}-{attempt}.tid"
            with system.open_output_stream(f"{folder}/{name}") as f:
                f.write(_file(doc_ids, sizes, np.concatenate(ids), lengths, codes, block))
            rows.append((part, len(rows), name, len(doc_ids), held))

        for batch in batches:
            for doc_id, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(one.as_buffer(), kind)
                if held and held + len(one) > file_ids:
                    put()
                    doc_ids, sizes, ids, held = [], [], [], 0
                doc_ids.append(doc_id)
                sizes.append(len(one))
                ids.append(one)
                held += len(one)
        if held:
            put()
        yield pa.RecordBatch.from_pylist([dict(zip(_FILES.names, r, strict=True)) for r in rows], schema=_FILES)

    return write


_FILES = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, block: int = huffman.BLOCK, file_ids: int = FILE_IDS, scratch: Scratch | None = None) -> None:
    """Write the ids of docs (doc_id, text, ...) as files below ``path``, a new folder that driver and executors share.

    Each row is a document: the ids of its whole text, then ``end_id`` (alone for
    a null or empty text). Documents stand in ascending order of doc_id, null
    ones first; rows that repeat a doc_id are documents of their own, in order of
    their ids' checksum. A document that is longer than ``file_ids`` has a file
    of its own. An empty table makes no file. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "token-files")
    vocabulary = vocabulary or default_vocabulary()
    kind = _encoder(vocabulary).kind.str
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = docs.mapInArrow(_tokenize(vocabulary, end_id), "doc_id long, n_tokens long, ids_crc32 long, ids binary")
    ids = scratch.save(ids.withColumn("row", F.monotonically_increasing_id()), "ids")
    # A row for each id of the vocabulary at most.
    counts = ids.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(max(_encoder(vocabulary).size, end_id + 1), np.int64)
    total[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    lengths = huffman.code_lengths(total)
    system, folder = _folder(path)
    system.create_dir(folder, recursive=True)
    order = ["doc_id", "ids_crc32", "row"]
    dealt = ids.repartitionByRange(1 + int(total.sum()) // file_ids, *order).sortWithinPartitions(*order)
    files = dealt.select("doc_id", "ids").mapInArrow(_write(path, kind, lengths, block, file_ids), "part int, nth int, file string, n_docs long, n_ids long")
    files.write.parquet(f"{path}/files")
    scratch.drop(ids)


class IdFile:
    """A file of token ids, read block by block."""

    def __init__(self, source):
        """source: a seekable binary file."""
        self.source = source
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("no file of token ids")
        vocabulary, self.block, n, self.n_ids, blocks, self.n_bytes = map(int, np.frombuffer(source.read(48), "<u8"))
        self.lengths = np.frombuffer(source.read(vocabulary), np.uint8)
        self.checkpoints = np.frombuffer(source.read(8 * blocks + 8), "<u8")
        docs = np.frombuffer(source.read(16 * n), "<i8").reshape(n, 2)
        nulls = np.frombuffer(source.read(n), np.uint8)
        self.doc_ids = [None if null else d for d, null in zip(docs[:, 0].tolist(), nulls.tolist(), strict=True)]
        self.sizes = docs[:, 1]
        self.at = len(MAGIC) + 48 + vocabulary + 8 * blocks + 8 + 17 * n
        self.table, self.top = huffman.decoding_table(self.lengths)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from place ``start`` of the file up to ``end``; only the blocks that hold them are read."""
        end = self.n_ids if end is None else end
        if end <= start:
            return np.empty(0, np.int64)
        first, last = start // self.block, -(-end // self.block)
        marks = self.checkpoints[first : last + 1].astype(np.int64)
        self.source.seek(self.at + int(marks[0]) // 8)
        payload = self.source.read((int(marks[-1]) + 7) // 8 - int(marks[0]) // 8)
        n = min(self.n_ids, last * self.block) - first * self.block
        found = huffman.decode(payload, marks - int(marks[0]) // 8 * 8, n, self.table, self.top, self.block)
        return found[start - first * self.block : end - first * self.block]


#: Blocks that are decoded at a time.
LANES = 8192
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _read(path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _folder(path)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    with system.open_input_file(f"{folder}/{name}") as source:
                        yield from _documents(IdFile(source), start)

        yield from _in_batches(rows(), _DOCS, lambda row: len(row[3]))

    return read


def _documents(file: IdFile, start: int) -> Iterator[tuple]:
    """(doc_id, start, n_tokens, ids) of a file's documents, decoded ``LANES`` blocks at a time."""
    ends = np.cumsum(file.sizes)
    held, base = np.empty(0, "<u4"), 0  # ids from place ``base`` of the file on
    step = LANES * file.block
    for doc_id, size, end in zip(file.doc_ids, file.sizes.tolist(), ends.tolist(), strict=True):
        out = io.BytesIO()
        at = end - size
        while at < end:
            if at == base + len(held):
                base = at
                held = file.ids(at, min(file.n_ids, (at // step + 1) * step)).astype("<u4")
            part = held[at - base : end - base]
            out.write(part.data)
            at += len(part)
        yield doc_id, start + end - size, size, out.getvalue()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document of the files that :func:`write_ids` wrote below ``path``.

    start: ids of all documents before it. ids: unsigned 32-bit numbers, little-endian.
    """
    files = spark.read.schema("part int, nth int, file string, n_docs long, n_ids long").parquet(f"{path}/files")
    # Sums of earlier parts (a row for each task that wrote), then of earlier files of the part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("within", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part")
    files = files.select("file", (F.col("base") + F.col("within")).alias("start")).repartition(max(1, files.count()), "start")
    return files.mapInArrow(_read(path), "doc_id long, start long, n_tokens long, ids binary")
