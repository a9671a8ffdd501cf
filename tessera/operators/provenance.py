"""Content-addressed intake, versions, lineage and state from event logs."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.containment import saved


def intake(incoming: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """incoming (workspace_id, id, content, seq) with checksum, object_id and duplicate.

    In a workspace equal contents are one object: the one that ``known``
    (workspace_id, checksum, object_id) holds, else the row with the smallest
    (seq, id). Rows are joined to one summary per content, so that a content that
    comes very often isn't gathered anywhere.
    """
    rows = incoming.withColumn("checksum", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)).drop("content")
    first = rows.groupBy("workspace_id", "checksum").agg(F.min(F.struct("seq", "id")).alias("first"))
    first = first.select(F.col("workspace_id").alias("_w"), F.col("checksum").alias("_c"), F.col("first.id").alias("_first"))
    out = rows.join(first, F.col("workspace_id").eqNullSafe(F.col("_w")) & (F.col("checksum") == F.col("_c")))
    if known is not None:
        old = known.select(F.col("workspace_id").alias("_kw"), F.col("checksum").alias("_kc"), F.col("object_id").alias("_known"))
        out = out.join(old, F.col("workspace_id").eqNullSafe(F.col("_kw")) & (F.col("checksum") == F.col("_kc")), "left")
        kept = F.coalesce("_known", "_first")
    else:
        kept = F.col("_first")
    return out.select("workspace_id", "id", "checksum", kept.alias("object_id"), (F.col("id") != kept).alias("duplicate"))


def versions(objects: DataFrame, key: list[str]) -> DataFrame:
    """objects (key..., id, seq) with previous_id, version, current and status: of each key the latest is current."""
    by = Window.partitionBy(*key).orderBy("seq", "id")
    latest = F.lead("id").over(by).isNull()
    return objects.withColumns({
        "previous_id": F.lag("id").over(by), "version": F.row_number().over(by), "current": latest,
        "status": F.when(latest, "ready").otherwise("superseded"),
    })


def lineage(spark: SparkSession, objects: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, root_id, depth, path): the way from each object along its first parent.

    objects: (id, parent_id); of several rows with one id the smallest parent
    counts. A missing parent ends the way, and so does
    ``depth``, if given; without it a cycle is an error. Only objects that others
    are made from walk, by joins, one for each level, of those that still move;
    each level is saved. Then every object goes on from its parent's way.
    """
    edges = saved(objects.groupBy("id").agg(F.min("parent_id").alias("parent_id")))
    up = edges.where("parent_id is not null").withColumnsRenamed({"id": "_at", "parent_id": "_up"})
    up = saved(up.join(edges.select(F.col("id").alias("_there")), F.col("_up") == F.col("_there"), "left_semi"))
    alone = [F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.array("id").alias("path")]
    if depth is not None and depth < 1:
        return edges.select("id", *alone)
    ways = _walked(up.select(F.col("_up").alias("id")).distinct().select("id", *alone), up, None if depth is None else depth - 1)
    ways = ways.select(F.col("id").alias("_up"), F.col("root_id").alias("_root"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
    out = edges.select("id").join(up.join(ways, "_up"), F.col("id") == F.col("_at"), "left")
    path = F.when(F.col("_path").isNull(), F.array("id")).otherwise(F.array_prepend("_path", F.col("id")))
    return out.select("id", F.coalesce("_root", "id").alias("root_id"), F.coalesce(F.col("_depth") + 1, F.lit(0)).alias("depth"), path.alias("path"))


def _walked(moving: DataFrame, up: DataFrame, depth: int | None) -> DataFrame:
    """moving (id, root_id, depth, path) led on along up (_at, _up), as far as it goes or ``depth`` levels."""
    columns = moving.columns
    done = []
    for _ in count() if depth is None else range(depth):
        step = saved(moving.join(up, F.col("root_id") == F.col("_at"), "left"))
        done.append(step.where("_up is null").select(*columns))
        moved = step.where("_up is not null")
        moving = moved.select("id", F.col("_up").alias("root_id"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("_up")).alias("path"))
        n, again = moved.agg(F.count("*"), F.bool_or(F.array_contains("path", F.col("_up")))).first()
        if depth is None and again:
            raise ValueError("an object is among its own ancestors")
        if not n:
            return reduce(DataFrame.union, done)
    return reduce(DataFrame.union, done, moving)


def object_counts(objects: DataFrame) -> DataFrame:
    """(kind, n, without_parents) of a registry."""
    none = F.coalesce(F.size("parents"), F.lit(0)) <= 0
    return objects.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(none & (F.col("kind") != "source")).alias("without_parents"))


def latest_state(events: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """The fields of each key's last event, with how many it had; an aggregate, so frequent keys combine before the shuffle."""
    last = F.max(F.struct(*order, *fields)).alias("_last")
    return events.groupBy(*key).agg(last, F.count("*").alias("events")).select(*key, *(f"_last.{f}" for f in order + fields), "events")


def insert_if_absent(table: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``table`` with the rows of ``new`` whose key it lacks; of several new rows with one key the first by ``order``."""
    first = new.groupBy(*key).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("_row")).select("_row.*")
    return table.unionByName(first.join(table.select(*key).distinct(), key, "left_anti"))


def expired(files: DataFrame, days: int, now: float) -> DataFrame:
    """The files (path, mtime in seconds, ...) that retention removes: strictly older than ``days``; 0 days remove none."""
    return files.where(F.lit(days > 0) & (F.col("mtime") < F.lit(now - days * 86400.0)))


def last_records(log: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """The last ``n`` records of a log, newest first; each task hands on no more than that."""
    return log.orderBy(*(F.desc(c) for c in order)).limit(n)
