"""States that follow from logs of decisions, and joins of materials with what was made of them.

Each state is an aggregate over its log; none sorts a key's whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.candidates import folded


def review_states(artifacts: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """(artifact_id, n_findings, n_decided, n_kept, state) from findings (artifact_id, finding_id) and decisions (artifact_id, finding_id, seq, decision).

    The first decision on a finding counts; those on no finding don't. Without
    open findings an artifact is ready_for_confirmation, with some decided it is
    review_in_progress, else requires_review.
    """
    key = ["artifact_id", "finding_id"]
    first = decisions.groupBy(*key).agg(F.min(F.struct("seq", "decision")).alias("first")).select(*key, "first.decision")
    met = findings.select(*key).distinct().join(first, key, "left")
    counts = met.groupBy("artifact_id").agg(F.count("*").alias("n"), F.count("decision").alias("decided"), F.count_if(F.col("decision") == "keep").alias("kept"))
    out = artifacts.select("artifact_id").join(counts, "artifact_id", "left")
    n, decided = F.coalesce("n", F.lit(0)), F.coalesce("decided", F.lit(0))
    state = F.when(n == decided, "ready_for_confirmation").when(decided > 0, "review_in_progress").otherwise("requires_review")
    return out.select("artifact_id", n.alias("n_findings"), decided.alias("n_decided"), F.coalesce("kept", F.lit(0)).alias("n_kept"), state.alias("state"))


def item_states(items: DataFrame, events: DataFrame) -> DataFrame:
    """(id, status, current, n_late) of items after events (id, seq, action: confirm, reject, edit, duplicate).

    reject, edit and duplicate end an item: the first of them counts, and what
    comes later (n_late) is refused. An item that was edited is superseded, one
    marked a duplicate is rejected. Unknown actions and ids change nothing.
    """
    ends = F.col("action").isin("reject", "edit", "duplicate")
    known = events.where(ends | (F.col("action") == "confirm"))
    end = known.where(ends).groupBy("id").agg(F.min(F.struct("seq", "action")).alias("end"))
    rows = known.join(end, "id", "left").groupBy("id").agg(
        F.first("end").alias("end"), F.bool_or((F.col("action") == "confirm") & (F.col("end").isNull() | (F.col("seq") < F.col("end.seq")))).alias("confirmed"),
        F.count_if(F.col("seq") > F.col("end.seq")).alias("late"),
    )
    out = items.select("id").join(rows, "id", "left")
    status = F.when(F.col("end.action") == "edit", "superseded").when(F.col("end").isNotNull(), "rejected").when(F.col("confirmed"), "confirmed").otherwise("requires_review")
    return out.select("id", status.alias("status"), F.col("end").isNull().alias("current"), F.coalesce("late", F.lit(0)).alias("n_late"))


def lifecycles(items: DataFrame, retired: DataFrame) -> DataFrame:
    """(id, lifecycle, successors) of items (id, supersedes_id): superseded by those that name it, retired if it was active then, else active.

    successors: their ids, sorted. A name of no item changes nothing.
    """
    newer = items.where("supersedes_id is not null").groupBy(F.col("supersedes_id").alias("id")).agg(F.array_sort(F.collect_set("id")).alias("successors"))
    gone = retired.select("id").distinct().withColumn("_gone", F.lit(True))
    out = items.select("id").join(newer, "id", "left").join(gone, "id", "left")
    state = F.when(F.size("successors") > 0, "superseded").when(F.col("_gone"), "retired").otherwise("active")
    return out.select("id", state.alias("lifecycle"), F.coalesce("successors", F.array().cast(dict(newer.dtypes)["successors"])).alias("successors"))


def competing(pending: DataFrame) -> DataFrame:
    """pending (id, scope_ref, kind, subject_ref, value) with ``card``: needs_clarification where one identity has several values, else requires_decision."""
    identity = ["scope_ref", "kind", "subject_ref"]
    several = pending.groupBy(*identity).agg((F.min("value") < F.max("value")).alias("_several"))
    out = pending.join(several, identity)
    return out.select("id", *identity, F.when(F.col("_several"), "needs_clarification").otherwise("requires_decision").alias("card"))


def linked_or_new(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """(workspace_id, item_type, id, seq, n_sources, outcome) after candidates are offered to the existing items.

    Equal statements of a type in a workspace, whatever their case and outer
    blanks, are one item. Those that exist (the smallest id) gain the candidates'
    sources: ``linked``, or ``kept`` without candidates; others are ``new``, from
    the first candidate by seq.
    """
    key = ["workspace_id", "item_type", "_said"]
    said = F.sha2(folded(F.col("statement")).cast("binary"), 256).alias("_said")
    old = existing.select("workspace_id", "item_type", said, F.col("id"), F.lit(None).cast(dict(candidates.dtypes)["seq"]).alias("seq"), "source")
    new = candidates.select("workspace_id", "item_type", said, F.lit(None).cast(dict(existing.dtypes)["id"]).alias("id"), "seq", "source")
    out = old.unionByName(new).groupBy(*key).agg(F.min("id").alias("id"), F.min("seq").alias("seq"), F.count_distinct("source").alias("n_sources"))
    outcome = F.when(F.col("id").isNull(), "new").when(F.col("seq").isNull(), "kept").otherwise("linked")
    return out.withColumn("outcome", outcome).drop("_said")


def materials(objects: DataFrame, reviews: DataFrame) -> DataFrame:
    """(source_id, created_at, sanitized_id, review_state) of sources: the first current extraction, of that the first current sanitized text, of that the review.

    objects: (id, kind, parent_id, current, seq, created_at); reviews:
    (artifact_id, state). What is missing is null, a review then not_started.
    """
    def first(kind: str, name: str) -> DataFrame:
        rows = objects.where((F.col("kind") == kind) & F.col("current") & F.col("parent_id").isNotNull())
        return rows.groupBy(F.col("parent_id").alias(f"{name}_of")).agg(F.min_by("id", F.struct("seq", "id")).alias(name))

    out = objects.where("kind = 'source'").select(F.col("id").alias("source_id"), "created_at")
    out = out.join(first("extraction", "extraction_id"), F.col("source_id") == F.col("extraction_id_of"), "left")
    out = out.join(first("sanitized", "sanitized_id"), F.col("extraction_id") == F.col("sanitized_id_of"), "left")
    out = out.join(reviews.select(F.col("artifact_id").alias("sanitized_id"), "state"), "sanitized_id", "left")
    return out.select("source_id", "created_at", "sanitized_id", F.coalesce("state", F.lit("not_started")).alias("review_state"))


def integrity(files: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, status) of files (id, content) against a registry (id, checksum): intact, changed (also if the file is missing) or orphan."""
    hashed = files.select("id", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("_sha"), F.lit(True).alias("_file"))
    both = hashed.join(registry.select("id", "checksum", F.lit(True).alias("_known")), "id", "full")
    return both.select("id", F.when(F.col("_known").isNull(), "orphan").when(F.col("_sha") == F.col("checksum"), "intact").otherwise("changed").alias("status"))
