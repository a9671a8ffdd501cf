"""Phrases whose words occur together, by direct-address tiles of pair counts.

Frequent words get numbers by rank of frequency, so that most pairs of
neighbours fall into few tiles of the table of all pairs. A task counts the pairs
of a tile that many of its pairs fall into by one dense ``bincount``, and those of
all other tiles as a sorted list of coordinates; sums over tasks are an aggregate.
Frequent pairs are ranked anew in each task, as symbols of their own, and the pairs
of such a symbol and the word after it are counted in the same way: that gives three
words, and once more, four. A longer phrase is frequent only if both of its parts
that are a word shorter are, so no frequent phrase is missed.

Neither words nor phrases pass through the driver. What it gathers and broadcasts is
a table of bits that rules out most of what isn't frequent. What the bits let through
has no effect on results: a join decides on words, and the sums on phrases.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, bounded
from tessera.llm.token_files import _in_batches

#: Occurrences of a phrase at least, words of one at most, and phrases of a language in the result.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase goes if a longer one that holds it occurs at least so often, in hundredths of its own occurrences.
INSIDE = 80
#: Side of a tile, and pairs from which on a tile is counted densely.
SIDE, DENSE = 1024, 16_384
#: Dense tiles that are counted at a time (8 MB each).
AT_A_TIME = 2
#: Word occurrences after which a task hands on its counts, and different words.
FLUSH, FLUSH_WORDS = 1_000_000, 200_000
#: Word occurrences after which a chunk of texts ends, and different words.
CHUNK, CHUNK_WORDS = 4_000_000, 600_000
#: Texts that are counted at a time, and counts that a task hands on at a time.
TEXTS, HANDED = 1000, 100_000
#: Bits of a table for each word or phrase, and words or phrases from which on it grows no more (16 MB), so that bits are shared.
BITS, BLOCK_WORDS, BLOCK_PHRASES = 16, 8_000_000, 8_000_000
#: Bits that Spark's bitmap functions put into one row.
BUCKET = 32_768
#: A phrase's bits come from polynomials of its words' numbers modulo a prime, one for each factor.
PRIME, FACTORS = 2**31 - 1, (1_540_483_477, 668_265_263)
#: Phrases up to which Spark may choose to broadcast a side of a join of them.
FEW = 100_000

#: What stands for a place without a frequent word (or phrase), and for a place between pieces.
RARE, BREAK = -1, -2

#: A-Z in lower case, tabs as spaces; what ends a piece, as a full stop, which no word holds.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 46 if c in b".,;:!?\n\v\f\r" else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A whole text's words, with b"." wherever a piece ends; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).replace(b".", b" . ").split()


def ranked(df: DataFrame, order: list[Column], name: str, scratch: Scratch, per_task: int = 100_000) -> DataFrame:
    """``df`` (saved before) with ``id``: each row's place in ``order``, from 0, found by ranges and without one task that sees all."""
    n = df.count()
    dealt = df.repartitionByRange(1 + n // per_task, *order).sortWithinPartitions(*order)
    # The high bits of this number are the partition's, the low ones the row's place in it.
    dealt = scratch.save(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    dealt = dealt.withColumn("part", part).join(bounded(scratch.save(parts, f"{name}-parts")), "part")
    return dealt.withColumn("id", F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "base", "at")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a task; those with a null word are how many words a language has."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def put() -> Iterator[pa.RecordBatch]:
        for lang, counted in counts.items():
            counted.pop(b".", None)
            words = [None, *counted]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(words, pa.binary()), pa.array([sum(counted.values()), *counted.values()], pa.int64())], names=["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[lang].update(words_of(text.as_py()))
            if sum(map(len, counts.values())) > FLUSH_WORDS:
                yield from put()
    yield from put()


#: A text's codes, or a word of its chunk and the code of that.
_CODED = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("code", pa.int32()), ("codes", pa.binary())])
#: wide: bytes of each number.
_NUMBERED = pa.schema([("words", pa.binary()), ("wide", pa.int32())])


def _numbers(column: pa.Array, wide: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int32 if w == 4 else np.int64).astype(np.int64) for x, w in zip(column, wide.to_pylist(), strict=True)]


def _n_bits(n: int, most: int) -> int:
    """Bits of a table for ``n`` words or phrases."""
    return -(-BITS * min(n, most) // BUCKET) * BUCKET


def _table_of_bits(places: DataFrame, n_bits: int) -> Broadcast:
    """The table in which the bits at ``places`` (at) are set, 8 a byte from the lowest on."""
    at = F.col("at") + 1
    rows = places.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    table = np.zeros(n_bits // 8, np.uint8)
    for bucket, bits in rows.collect():
        table[(bucket - 1) * BUCKET // 8 : bucket * BUCKET // 8] = np.frombuffer(bits, np.uint8)
    return places.sparkSession.sparkContext.broadcast(table.tobytes())


class _Codes(dict):
    """Codes of a language's words, given in order of appearance to those whose bit is set, and kept in ``langs`` and ``found``."""

    def __init__(self, lang: str, table: bytes, langs: list[str], found: list[bytes]):
        super().__init__({b".": BREAK})
        self.lang, self.table, self.langs, self.found, self.start = lang, table, langs, found, zlib.crc32(lang.encode())

    def __missing__(self, word: bytes) -> int:
        at, code = zlib.crc32(word, self.start) % (8 * len(self.table)), RARE
        if self.table[at >> 3] >> (at & 7) & 1:
            code = len(self.found)
            self.langs.append(self.lang)
            self.found.append(word)
        self[word] = code
        return code


def _code_words(bits: Broadcast):
    """Texts as codes, in chunks, each with what its codes stand for."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, chunk = bits.value, TaskContext.get().partitionId() << 32

        def put(texts: list[bytes], langs: list[str], found: list[bytes]) -> Iterator[pa.RecordBatch]:
            n, codes = len(found), np.arange(len(found), dtype=np.int32)
            words = pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(langs, pa.string()), pa.array(found, pa.binary()), pa.array(codes), pa.nulls(n, pa.binary())], schema=_CODED)
            yield from (words.slice(at, HANDED) for at in range(0, n, HANDED))
            yield from _in_batches(((chunk, None, None, None, x) for x in texts), _CODED, lambda row: len(row[4]))

        size, texts, codes, langs, found = 0, [], {}, [], []
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in codes:
                    codes[lang] = _Codes(lang, table, langs, found)
                words = words_of(text.as_py())
                ids = np.fromiter(map(codes[lang].__getitem__, words), np.int32, len(words))
                if ids.max(initial=RARE) >= 0:
                    texts.append(ids.tobytes())
                size += len(words)
                if size >= CHUNK or sum(map(len, codes.values())) > CHUNK_WORDS:
                    yield from put(texts, langs, found)
                    chunk += 1
                    size, texts, codes, langs, found = 0, [], {}, [], []
        yield from put(texts, langs, found)

    return code


def _number_words(texts: pa.Table, known: pa.Table) -> pa.Table:
    """The texts of a chunk with numbers instead of codes; a code that isn't ``known`` stands for a rare word."""
    code, number = known["code"].to_numpy(), known["id"].to_numpy()
    lists = [np.frombuffer(x.as_buffer(), np.int32) for x in texts["codes"]]
    place = np.full(1 + max([code.max(initial=0), *(x.max() for x in lists)]) - BREAK, RARE, np.int64)
    place[code], place[BREAK] = number, BREAK  # RARE and BREAK are the last places
    rows = [(x.astype(np.int32 if wide == 4 else np.int64).tobytes(), wide) for x in map(place.__getitem__, lists) if x.max() >= 0 for wide in [4 if x.max() < 2**31 else 8]]
    return pa.table([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(_NUMBERED.types)], schema=_NUMBERED)


def count_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, n) of the different pairs of equally long arrays of numbers from 0 on.

    Pairs of tiles that hold many are counted in a dense table of their tile, all others in sorted order.
    """
    tile = (left // SIDE) << 32 | right // SIDE
    tiles, n = np.unique(tile, return_counts=True)
    dense = np.flatnonzero(n >= DENSE)
    out = []
    if len(dense):
        place = np.full(len(tiles), -1, np.int32)
        place[dense] = np.arange(len(dense))
        at = place[np.searchsorted(tiles, tile)]
        cell = (left % SIDE) * SIDE + right % SIDE
        for begin in range(0, len(dense), AT_A_TIME):
            mine = np.flatnonzero((at >= begin) & (at < begin + AT_A_TIME))
            counts = np.bincount((at[mine] - begin) * SIDE * SIDE + cell[mine])
            found = np.flatnonzero(counts)
            which, inner = np.divmod(found, SIDE * SIDE)
            corner = tiles[dense[begin + which]]
            out.append(((corner >> 32) * SIDE + inner // SIDE, (corner & 0xFFFFFFFF) * SIDE + inner % SIDE, counts[found]))
        sparse = np.flatnonzero(at < 0)
        left, right = left[sparse], right[sparse]
    if len(left) and max(left.max(), right.max()) < 1 << 31:
        key, n = np.unique(left << 32 | right, return_counts=True)
        out.append((key >> 32, key & 0xFFFFFFFF, n))
    else:
        (left, right), n = np.unique(np.stack([left, right]), axis=1, return_counts=True)
        out.append((left, right, n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _next(at: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` (ascending) are followed by a place of ``at``."""
    return np.flatnonzero(at[1:] == at[:-1] + 1)


def _places(words: np.ndarray, passed: list[bytes]) -> np.ndarray:
    """Where a phrase begins whose bit is set in ``passed`` (for two words, three, ...), and so are those of all its parts."""
    at = np.flatnonzero(words >= 0)
    sums = [words[at] for _ in FACTORS]
    for n, table in enumerate(passed, 1):
        bits, on = np.frombuffer(table, np.uint8), _next(at)
        at = at[on]
        sums = [(x[on] * factor + words[at + n]) % PRIME for x, factor in zip(sums, FACTORS, strict=True)]
        both = np.flatnonzero(np.logical_and.reduce([bits[(bit := x % (8 * len(bits))) >> 3] >> (bit & 7) & 1 for x in sums]))
        at, sums = at[both], [x[both] for x in sums]
    return at


def _symbols(words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank by frequency of each phrase of ``length`` words at ``at``, and where a phrase of each rank is."""
    symbols, first = words[at], None
    for n in range(1, length):
        _, first, symbols, count = np.unique(symbols * (words.max() + 1) + words[at + n], return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        symbols, first = rank[symbols], first[order]
    return symbols, at[first]


def _count_phrases(length: int, passed: list[Broadcast] | tuple = ()):
    """(w0, w1, ..., n) of a task: phrases of ``length`` words and the word after each, where the phrase a place later may be frequent, too.

    passed: the bits of the frequent phrases of two words up to ``length``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, tables = [], 0, [x.value for x in passed]

        def hand_on(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            counted = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[*_names(length + 1), "n"])
            for begin in range(0, counted.num_rows, HANDED):
                yield counted.slice(begin, HANDED)

        def put() -> Iterator[pa.RecordBatch]:
            words = np.concatenate(held)
            held.clear()
            at = _places(words, tables)
            at = at[_next(at)]
            if length == 1:
                left, right = words[at], words[at + 1]
                del words, at
                yield from hand_on(*count_pairs(left, right))
                return
            # Ranks take more memory than words do, so no more than half of the places get theirs at a time.
            for part in np.array_split(at, 1 + 2 * len(at) // FLUSH):
                symbols, places = _symbols(words, part, length)
                left, right, n = count_pairs(symbols, words[part + length])
                places = places[left]
                yield from hand_on(*(words[places + i] for i in range(length)), right, n)

        end = np.array([BREAK])
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            for words in _numbers(batch.column("words"), batch.column("wide")):
                held += words, end
                size += len(words)
                if size >= FLUSH:
                    yield from put()
                    size = 0
        if held:
            yield from put()

    return count


def _names(length: int) -> list[str]:
    """Columns of the numbers of a phrase's words."""
    return [f"w{i}" for i in range(length)]


def _words_numbered(docs: DataFrame, vocabulary: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(words, wide) of each document with a frequent word.

    Words whose bit is set meet the vocabulary in a join, each once a chunk.
    """
    n_bits = _n_bits(n, BLOCK_WORDS)
    bits = _table_of_bits(vocabulary.select((F.crc32(F.concat(F.col("lang").cast("binary"), "word")) % n_bits).alias("at")), n_bits)
    coded = scratch.save(docs.mapInArrow(_code_words(bits), "chunk long, lang string, word binary, code int, codes binary"), "coded")
    bits.destroy()
    known = coded.where("word is not null").join(vocabulary.select("lang", "word", "id").hint("merge"), ["lang", "word"]).select(F.col("chunk").alias("of"), "code", "id")
    texts = coded.where("word is null").select("chunk", "codes")
    numbered = scratch.save(texts.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_number_words, "words binary, wide int"), "words")
    scratch.drop(coded)
    return numbered


def frequent_phrases(docs: DataFrame, least: int, longest: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All phrases of at most ``longest`` words that a language of docs (lang, text) has ``least`` times or more; languages (lang, n).

    Phrases: (words, lang, phrase, n, ls, rs). words: their numbers, which are
    unique over all languages. ls and rs: how often the first 1, 2, ... words
    occur, and what follows them.
    """
    counts = docs.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts.where(F.col("word").isNull() | (F.col("n") >= least)), "counts")
    totals = counts.where("word is null").select("lang", "n")
    vocabulary = scratch.save(ranked(counts.where("word is not null"), [F.desc("n"), F.asc("lang"), F.asc("word")], "ranked", scratch), "vocabulary")
    n = vocabulary.count()
    empty = F.array().cast("array<bigint>")
    word = F.col("word").cast("string")
    levels = [vocabulary.select(F.col("id").alias("w0"), "lang", word.alias("phrase"), word.alias("last"), "n", empty.alias("ls"), empty.alias("rs"))]
    numbered = _words_numbered(docs, vocabulary, n, scratch) if n else None
    passed: list[Broadcast] = []
    for length in range(1, longest):
        if not n:
            break
        names = _names(length + 1)
        counted = numbered.mapInArrow(_count_phrases(length, passed), ", ".join(f"{c} long" for c in [*names, "n"]))
        found = scratch.save(counted.groupBy(names).agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
        before, n = n, found.count()
        levels.append(scratch.save(_described(found, names, levels[-1].hint("merge") if before > FEW else levels[-1]), "described"))
        if length + 1 < longest and n:
            n_bits = _n_bits(n, BLOCK_PHRASES)
            places = found.select(F.explode(F.array(*(_sum_of(names, factor) % n_bits for factor in FACTORS))).alias("at"))
            passed = [*passed, _table_of_bits(places, n_bits)]
    for table in passed:
        table.destroy()
    if numbered:
        scratch.drop(numbered)
    out = None
    for length, level in enumerate(levels, 1):
        level = level.select(F.array(*_names(length)).alias("words"), "lang", "phrase", "n", "ls", "rs")
        out = out.union(level) if out else level
    return out, totals


def _sum_of(names: list[str], factor: int) -> Column:
    """A phrase's polynomial, as in ``_places``; it stays below 64 bits."""
    total = F.col(names[0])
    for name in names[1:]:
        total = (total * factor + F.col(name)) % PRIME
    return total


def _described(found: DataFrame, names: list[str], before: DataFrame) -> DataFrame:
    """found (w0, w1, ..., n) with its words and the counts of its parts, by the phrases ``before`` that are a word shorter."""
    first = before.select(*names[:-1], "lang", F.col("phrase").alias("start"), F.col("n").alias("n_left"), F.col("ls").alias("ls_left"))
    # What follows the first word.
    tail = before.select(*(F.col(a).alias(b) for a, b in zip(names, names[1:])), "last", F.col("n").alias("n_tail"), F.col("rs").alias("rs_tail"))
    return found.join(first, names[:-1]).join(tail, names[1:]).select(
        *names, "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "n",
        F.concat("ls_left", F.array("n_left")).alias("ls"), F.concat(F.array("n_tail"), "rs_tail").alias("rs"),
    )


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language of docs (lang, text, ...).

    Phrases of two words up to ``longest`` that occur ``least`` times or more are
    scored by the cut between their words with the lowest score. A phrase goes if
    a longer one that holds it occurs at least 80 % as often. A null language is
    ``und``, a null text empty; repeated rows count each; other columns are
    ignored. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "collocations")
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    found, totals = frequent_phrases(docs, least, longest, scratch)
    found = found.where(F.size("words") > 1)
    # Phrases of two words or more inside.
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")
    held = found.where(F.size("words") > 2).select(F.explode(inner).alias("words"), "n").groupBy("words").agg(F.max("n").alias("most"))
    # Exact beyond 64 bits.
    cut = F.expr("""array_min(transform(ls, (l, i) -> named_struct(
        'score', (cast(2000000 as decimal(7, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(rs[i] as decimal(19, 0))), 'k', i, 'l', l, 'r', rs[i])))""")
    kept = found.join(held, "words", "left").where(F.col("most").isNull() | F.expr(f"cast(most as decimal(19, 0)) * 100 < cast(n as decimal(19, 0)) * {INSIDE}"))
    kept = kept.select("lang", "phrase", F.col("n").alias("a"), cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
