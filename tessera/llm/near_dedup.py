"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct five-word shingles. Equal sets are one class
before any search, so groups of copies cost one sketch. A sketch holds ``M``
registers: for hash function i, ``floor(1 - log_b(min exp_i))`` truncated to
16 bits, where exp_i is exponentially distributed over the shingles. Registers
of a union are the maxima of both sides' registers, and two registers agree
about as often as the sets' Jaccard similarity (b is close to 1). Bands of
``ROWS`` registers give candidates; the registers of both sides then give the
joint maximum-likelihood similarity; what stays possible is confirmed on the
full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.clusters import OPEN, OTHER, components, in_buckets, star_links
from tessera.llm.scratch import Scratch, bounded, only_keys, without

SHINGLE = 5
THRESHOLD = 0.75
#: Registers, registers in a band, base, rate and largest register of the sketch.
M, ROWS, BASE, RATE, LARGEST = 128, 4, 1.001, 20.0, 2**16 - 2
#: How far below the threshold an estimate may be before its pair is given up: four standard errors.
MARGIN = 4 * (THRESHOLD * (1 - THRESHOLD) / M) ** 0.5
#: Words whose hash a Python worker remembers.
MEMO = 300_000

_U = np.uint64
_rng = np.random.default_rng(20)
_MUL = _rng.integers(0, 2**63, M, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 2**63, M, dtype=np.uint64)
_WORDS: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles.

    Words are what stands between ASCII white space, A-Z in lower case. Fewer
    than five words are one shingle; none (or null) give an empty set.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    new = set(words).difference(_WORDS)
    if new:
        if len(_WORDS) > MEMO:
            _WORDS.clear()
            new = set(words)
        _WORDS.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    ids = np.array([_WORDS[w] for w in words], np.uint64)
    k = min(SHINGLE, len(ids))
    n = len(ids) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + ids[i : i + n])
    return np.unique(h)


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes (all 0 for an empty set)."""
    if not len(items):
        return np.zeros(M, np.uint16)
    low = np.full(M, 2**64 - 1, np.uint64)
    for at in range(0, len(items), 2048):
        part = items[at : at + 2048]
        for i in range(M):
            low[i] = min(low[i], (part * _MUL[i] + _ADD[i]).min())
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LARGEST + 1).astype(np.uint16)


def set_digest(items: np.ndarray) -> str | None:
    """128 bits that are equal for equal sets: two independent sums of mixed hashes; none for an empty set."""
    if not len(items):
        return None
    a, b = (int(_mix(x).sum(dtype=np.uint64)) for x in (items, items ^ _U(0xA0761D6478BD642F)))
    return f"{a:016x}{b:016x}"


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            items = shingle_set(text)
            rows.append((len(items), set_digest(items), registers(items).tobytes() if len(items) else None))
        yield pd.DataFrame({"doc_id": batch["doc_id"], **dict(zip(("n_shingles", "set_digest", "sketch"), zip(*rows, strict=True), strict=True))} if rows else {"doc_id": [], "n_shingles": [], "set_digest": [], "sketch": []})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"]]
        yield pd.DataFrame({"set_digest": [set_digest(s) for s in sets], "items": [s.tobytes() for s in sets]})


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(bucket, id, bits) for each band of each sketch; no bits are used."""
    for batch in batches:
        if len(batch):
            regs = np.frombuffer(b"".join(batch["sketch"]), np.uint16).reshape(len(batch), M // ROWS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(M // ROWS, dtype=np.uint64), regs.shape[:2]).copy()
            for i in range(ROWS):
                key = _mix(key * _U(0x9E3779B97F4A7C15) + regs[:, :, i])
            yield pd.DataFrame({"bucket": key.view(np.int64).ravel(), "id": np.repeat(batch["id"].to_numpy(), M // ROWS), "bits": 0})


def similarity(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of rows of registers, given both set sizes.

    The likelihood is that of how many registers are larger on the one side,
    larger on the other, and equal; it is concave in the similarity, so a
    ternary search over the possible range finds its maximum.
    """
    u = na / (na + nb)
    v = nb / (na + nb)
    over, under = (ra > rb).sum(1), (ra < rb).sum(1)
    same = ra.shape[1] - over - under

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def loglik(j: np.ndarray) -> np.ndarray:
        more, less = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        tiny = 1e-12
        return over * np.log(more + tiny) + under * np.log(less + tiny) + same * np.log(np.maximum(1 - more - less, tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = loglik(a) > loglik(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


def _estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            ra, rb = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), M) for c in ("sketch_a", "sketch_b"))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "guess": similarity(ra, rb, batch["n_a"].to_numpy(float), batch["n_b"].to_numpy(float))})


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for a, b in zip(batch["items_a"], batch["items_b"], strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            either = len(x) + len(y) - both
            rows.append((100 * both >= 75 * either, both / either))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": [r[0] for r in rows], "exact": [r[1] for r in rows]})


#: Items of the sets on one side of a block, and about as many of all sets in a task's group of blocks: 16 MB.
POOL = 2_000_000


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) between the open and the other sets of each of some blocks, by counting common items."""
    out = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
    for _, one in rows.groupby("key", sort=False):
        items = [np.frombuffer(x, np.uint64) for x in one["items"]]
        size = np.array([len(x) for x in items])
        ids, parts, role = (one[c].to_numpy() for c in ("id", "part", "role"))
        open_ = np.flatnonzero(role & OPEN)
        if not len(open_):
            continue
        pool = np.concatenate([items[i] for i in open_])
        owner = np.repeat(np.arange(len(open_)), size[open_])
        order = np.argsort(pool, kind="stable")
        pool, owner = pool[order], owner[order]
        for j in np.flatnonzero(role & OTHER):
            low, high = np.searchsorted(pool, items[j], "left"), np.searchsorted(pool, items[j], "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(open_))
            found = open_[(100 * both >= 75 * (size[open_] + size[j] - both)) & (parts[open_] != parts[j])]
            out.append(pd.DataFrame({"a": np.minimum(ids[found], ids[j]), "b": np.maximum(ids[found], ids[j])}))
    return pd.concat(out).astype("int64").drop_duplicates()


def _by_size(blocks: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """``blocks`` (key, role, id, part) with n_shingles, cut further so that neither side of one holds many more than ``POOL`` items."""
    sized = scratch.save(blocks.join(bounded(sizes), "id").select("key", "role", "id", "part", "n_shingles"), "sized")
    cuts = [F.ceil(F.sum(F.when(F.col("role").bitwiseAND(F.lit(r)) > 0, F.col("n_shingles"))) / POOL).cast("int").alias(c) for r, c in ((OPEN, "opens"), (OTHER, "others"))]
    heavy = scratch.save(sized.groupBy("key").agg(*cuts).where("opens > 1 or others > 1"), "heavy")
    whole = sized.join(bounded(heavy), "key", "left_anti").select("key", "role", "id", "part", "n_shingles")
    cut = sized.join(bounded(heavy), "key")
    sides = [
        cut.where(F.col("role").bitwiseAND(F.lit(r)) > 0).withColumn(mine, F.pmod(F.xxhash64("id"), mine)).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)))
        .select(F.xxhash64("key", F.col("opens").cast("int"), F.col("others").cast("int")).alias("key"), F.lit(r).alias("role"), "id", "part", "n_shingles")
        for r, mine, theirs in ((OPEN, "opens", "others"), (OTHER, "others", "opens"))
    ]
    return whole.union(sides[0]).union(sides[1])


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id long, text string, ...).

    Documents are linked at a Jaccard similarity of 0.75 or more of their sets;
    component_id is the smallest doc_id that links reach, and that document is
    kept. Null and wordless texts have an empty set: they link with nothing and
    are kept. Rows that repeat a doc_id share its component; they are linked by
    it, whatever their texts. A null doc_id can't be linked: its component is
    null and it is kept. Other columns are ignored; an empty table gives an empty result. Missing a
    link needs all 32 bands to differ: about 5 in a million at 0.75, less above.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = scratch.save(docs.mapInPandas(_sketch, "doc_id long, n_shingles long, set_digest string, sketch binary"), "sketches")
    known = sketched.where("doc_id is not null and set_digest is not null")
    # A class is a distinct set, whichever documents have it; all search is over classes. Its text is read from the first of them.
    classes = scratch.save(known.groupBy("set_digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    classes = scratch.save(classes.withColumn("id", F.monotonically_increasing_id()), "numbered")
    firsts = known.join(classes.select("set_digest", "id", F.col("first").alias("doc_id")), ["set_digest", "doc_id"]).dropDuplicates(["id"])
    firsts = scratch.save(firsts.select("id", "doc_id", "set_digest", "n_shingles", "sketch"), "firsts")
    members = firsts.select("id", "sketch").mapInPandas(_bands, "bucket long, id long, bits long")

    def sets_of(ids: DataFrame, n: int) -> DataFrame:
        """(id, items) of classes; a doc_id may have several texts, so the digest says which is meant."""
        wanted = scratch.save(firsts.join(bounded(ids), "id", "left_semi").select("id", "doc_id", "set_digest"), "wanted")
        texts = only_keys(docs, scratch.save(wanted.select("doc_id").distinct(), "wanted-ids", n), ["doc_id"])
        items = texts.mapInPandas(_sets, "set_digest string, items binary").join(bounded(wanted.select("id", "set_digest")), "set_digest")
        return scratch.save(items.select("id", "items").dropDuplicates(["id"]), "sets", n, 5_000)

    def verify(pairs: DataFrame) -> DataFrame:
        left = firsts.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
        right = firsts.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
        n = pairs.count()
        guessed = pairs.join(left, "a").join(right, "b").mapInPandas(_estimate, "a long, b long, guess double")
        guessed = scratch.save(guessed, "estimates", n, 20_000)
        near = guessed.where(F.col("guess") >= THRESHOLD - MARGIN)
        ids = scratch.save(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), "open", n)
        items = sets_of(ids, ids.count())
        both = near.select("a", "b").join(items.toDF("a", "items_a"), "a").join(items.toDF("b", "items_b"), "b")
        sure = both.mapInPandas(_confirm, "a long, b long, linked boolean, exact double")
        far = guessed.where(F.col("guess") < THRESHOLD - MARGIN)
        return sure.select("a", "b", "linked", F.col("exact").alias("alike")).union(
            far.select("a", "b", F.lit(False), F.col("guess"))
        )

    def compare(blocks: DataFrame, seen: DataFrame) -> DataFrame:
        blocks = scratch.save(_by_size(blocks, firsts.select("id", "n_shingles"), scratch), "blocks")
        ids = scratch.save(blocks.select("id").distinct(), "open")
        items = sets_of(ids, ids.count())
        groups = 1 + (blocks.agg(F.sum("n_shingles")).first()[0] or 0) // POOL
        full = blocks.join(items, "id").withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)))
        return full.groupBy("g").applyInPandas(lambda rows: _compare(rows), "a long, b long")

    links = star_links(in_buckets([members], scratch), verify, compare, scratch)
    # The same doc_id on different texts joins their classes too.
    own = known.select("doc_id", "set_digest").distinct()
    repeats = scratch.save(own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeats")
    own = own.join(bounded(repeats), "doc_id").join(classes.select("set_digest", "id"), "set_digest").select("doc_id", "id")
    own = own.join(own.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
    tree = components(links.union(own), scratch)
    placed = scratch.save(classes.join(tree, "id", "left").where("n > 1 or component is not null").select("set_digest", "first", F.coalesce("component", "id").alias("part")), "placed")
    smallest = scratch.save(placed.groupBy("part").agg(F.min("first").alias("component")), "smallest")
    merged = scratch.save(placed.join(smallest, "part").select("set_digest", "component"), "merged")
    out = sketched.select("doc_id", "n_shingles", "set_digest").join(merged, "set_digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, all columns as they are.

    Of rows with one doc_id all stay or go together; rows with a null doc_id stay.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.save(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    return without(docs, found)
