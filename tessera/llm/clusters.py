"""Links inside candidate buckets, and the components that links span.

Neither step makes all pairs of a group. In each bucket the smallest member is
the pivot, and first only (pivot, member) pairs are verified; a tight group is
then one component and done. In buckets that stay open the member most like the
pivot is compared with all others, too. What is then outside of a bucket's
largest component meets the bucket's other components in blocks of bounded size.
Wherever members carry bits, pairs whose bits rule out a link are never verified.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, bounded

#: Pairs that a task verifies.
PAIRS = 4_000

#: Open members and members in a block that is compared in one go.
OPEN_BLOCK, BLOCK = 128, 1024

#: A block's rows may be on the open side, on the other, or on both.
OTHER, OPEN = 2, 1


def in_buckets(parts: list[DataFrame], scratch: Scratch, bits: DataFrame | None = None) -> DataFrame:
    """(bucket, id, bits, n, pivot struct<id, bits>) for the members that share a bucket; one shuffle for each part.

    parts: (bucket long, id long, bits long) each, no bucket in two of them and
    each pair once; bits aren't null. bits: (id, bits), once for each id, if the
    parts have none; they then move only with members that share a bucket. Null
    buckets or ids share nothing.
    """
    out = None
    for members in parts:
        placed = members.where("bucket is not null and id is not null").repartition("bucket")
        # The aggregate uses all columns, so that it reads the same shuffle as the join's other side. A least struct would be
        # sorted for; the least id is hashed, and its bits are looked up among the few members that share a bucket.
        groups = placed.groupBy("bucket").agg(F.count("bits" if bits is None else "id").alias("n"), F.min("id").alias("pivot")).where("n > 1")
        shared = scratch.save(placed.join(groups.hint("shuffle_hash"), "bucket"), "shared")
        if bits is not None:
            alone, shared = shared, scratch.save(shared.join(bits.hint("shuffle_hash"), "id"), "shared")
            scratch.drop(alone)
        pivots = scratch.save(shared.where("id = pivot").select("bucket", F.struct("id", "bits").alias("pivot")), "pivots")
        found = scratch.save(shared.select("bucket", "id", "bits", "n").join(bounded(pivots), "bucket"), "members")
        scratch.drop(shared, pivots)
        out = out.union(found) if out else found
    return out


def _in_blocks(placed: DataFrame, scratch: Scratch, whole: int, n: int) -> DataFrame:
    """(key, role, id, bits, part): each open member meets each member of its buckets in one block.

    Buckets of ``whole`` members at most are blocks as they are. Larger ones are
    joined by their main part and cut, so that a block has about ``OPEN_BLOCK``
    open members and ``BLOCK`` members, however large the group is.
    """
    is_open = (F.col("part") != F.col("main")).cast("int")
    small = placed.where(F.col("n") <= whole).select(F.col("bucket").alias("key"), (OTHER + OPEN * is_open).alias("role"), "id", "bits", "part")
    group = scratch.save(placed.where(F.col("n") > whole).select("main", "id", "bits", "part").distinct(), "groups", n)
    sizes = group.groupBy("main").agg(F.count("*").alias("n"), F.sum(is_open).alias("n_open")).where("n_open > 0")
    sizes = scratch.save(sizes.select("main", F.expr(f"1 + n div {BLOCK}").alias("salts"), F.expr(f"1 + n_open div {OPEN_BLOCK}").alias("blocks")), "sizes", n)
    group = group.join(bounded(sizes), "main")
    key = F.xxhash64("main", "block", "salt").alias("key")
    all_ = group.select("main", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), "salts").alias("salt"), "id", "bits", "part")
    open_ = group.where(is_open == 1).select("main", F.pmod(F.xxhash64("id", F.lit(1)), "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "id", "bits", "part")
    return small.union(all_.select(key, F.lit(OTHER), "id", "bits", "part")).union(open_.select(key, F.lit(OPEN), "id", "bits", "part"))


def star_links(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame, DataFrame], DataFrame], scratch: Scratch,
    possible: Callable[[Column, Column], Column] | None = None, whole: int = 0,
) -> DataFrame:
    """Links (a, b) between ids that share a bucket, enough to span the components that all links span.

    members: those that share buckets, as :func:`in_buckets` gives them. verify: from
    distinct pairs (a, b) to (a, b, linked boolean, alike double). compare: from
    blocks (key, role, id, bits, part) and the pairs (a, b) seen before to all
    links (a, b) between an ``OPEN`` and an ``OTHER`` member of a block that are
    of different parts. possible: false for bits of two members that can't be
    linked. Empty input: no links.
    """
    near = possible or (lambda x, y: F.lit(True))
    stars = members.where(F.col("id") != F.col("pivot.id")).where(near(F.col("bits"), F.col("pivot.bits")))
    stars = scratch.save(stars.select("bucket", F.col("pivot.id").alias("pivot"), "id", "bits"), "stars")
    n = stars.count()
    pairs = scratch.save(stars.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs", n)
    seen = scratch.save(verify(pairs).select("a", "b", "linked", "alike"), "verified", pairs.count(), PAIRS)
    links = seen.where("linked").select("a", "b")
    # A pivot may be an outlier of its group. Buckets that it left open get a second one: the member most like the first.
    known = stars.join(seen.withColumnsRenamed({"a": "pivot", "b": "id"}), ["pivot", "id"])
    hubs = known.groupBy("bucket").agg(F.min("linked").alias("settled"), F.max_by(F.struct("id", "bits"), "alike").alias("hub")).where("not settled")
    hubs = scratch.save(hubs.select("bucket", "hub"), "hubs", n)
    others = members.join(bounded(hubs), "bucket").where("id <> hub.id and id <> pivot.id").where(near(F.col("bits"), F.col("hub.bits")))
    pairs = others.select(F.least("hub.id", "id").alias("a"), F.greatest("hub.id", "id").alias("b")).distinct()
    pairs = scratch.save(pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    more = scratch.save(verify(pairs).select("a", "b", "linked", "alike"), "verified", pairs.count(), PAIRS)
    seen = seen.unionByName(more)
    links = links.unionByName(more.where("linked").select("a", "b"))
    tree = bounded(components(links, scratch))
    # A bucket's main part is the component with most members; without any, that of the pivot. What is outside of it is open.
    placed = members.join(tree, "id", "left").select("bucket", "id", "bits", "n", "component", F.coalesce("component", "id").alias("part"), F.col("pivot.id").alias("pivot"))
    parts = placed.where("component is not null").groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mains = scratch.save(parts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main")), "mains")
    placed = placed.join(bounded(mains), "bucket", "left").withColumn("main", F.coalesce("main", "pivot"))
    blocks = _in_blocks(placed, scratch, whole, n)
    return links.unionByName(scratch.save(compare(blocks, seen.select("a", "b")), "compared"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): for every id in a link the smallest id that it reaches.

    Distributed union-find by alternating large-star and small-star steps: each
    id hangs its neighbours below the smallest id it knows. Rows are grouped by
    minimum only (with a map-side part) and joined, so no neighbour list is ever
    held in one task. Self links and nulls link nothing.
    """
    links = links.where("a <> b")
    n = links.count()
    edges = scratch.save(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges", n)
    before = None
    while n:
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        lows = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large", 2 * n)
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        large = scratch.save(large.distinct(), "large-star", n)
        lows = scratch.save(large.groupBy("hi").agg(F.min("lo").alias("m")), "small", n)
        joined = large.join(lows, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(joined.select("hi", F.col("m").alias("lo"))).where("hi <> lo")
        edges = scratch.save(small.distinct(), "small-star", n)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        n = now[0]
    tree = edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return scratch.save(tree.union(edges.select("lo", "lo").distinct()), "tree", 2 * n)
