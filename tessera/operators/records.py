"""Operational records and the evidence that must agree with them; admission of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.containment import saved

# What a reference may look like, and the closed registries of words.
REFERENCE = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
SCOPES, LIFECYCLES, SENSITIVITIES, ACTIONS = ("user", "project", "system"), ("active", "superseded", "retired"), ("standard", "restricted", "unknown"), ("promotion", "replacement", "retirement")
KINDS = {"requirement": ("project", "system"), "decision": ("project", "system"), "risk": ("project", "system"), "open_question": ("project",), "action": ("user", "project")}


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _reference(c: str, optional: bool = False) -> Column:
    sound = F.coalesce(F.col(c).rlike(REFERENCE), F.lit(False))
    return sound | ~_filled(c) if optional else sound


def sound_item() -> Column:
    """Whether a record holds what a record must: references, a kind that its scope allows, a value, an origin and a confirmation."""
    kinds = F.lit(False)
    for kind, scopes in KINDS.items():
        kinds = kinds | (F.col("kind") == kind) & F.col("scope").isin(*scopes)
    said = (F.trim(F.coalesce("value", F.lit(""))) != "") | (F.trim(F.coalesce("reference", F.lit(""))) != "")
    origin = (_filled("source_ref") | _filled("candidate_ref")) & _reference("source_ref", True) & _reference("candidate_ref", True)
    words = F.col("lifecycle").isin(*LIFECYCLES) & F.col("sensitivity").isin(*SENSITIVITIES) & (F.col("confirmation") == "confirmed")
    dates = _filled("created_at") & _filled("updated_at")
    out = _reference("id") & _reference("scope_ref") & kinds & _reference("subject_ref") & said & _reference("reference", True) & origin & words & _reference("confirmation_ref") & dates & _reference("supersedes_id", True)
    return F.coalesce(out, F.lit(False))


def sound_evidence() -> Column:
    """Whether a confirmation holds what it must; one that promotes or replaces names where it comes from."""
    named = _filled("source_ref") | _filled("candidate_ref") | (F.col("action") == "retirement")
    out = _reference("id") & F.col("scope").isin(*SCOPES) & _reference("scope_ref") & F.col("action").isin(*ACTIONS) & _reference("target_item_id") & _reference("actor_ref") & _filled("created_at") & named
    return F.coalesce(out & _reference("source_ref", True) & _reference("candidate_ref", True), F.lit(False))


def partitions(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """(scope, scope_ref, n_items, n_evidence, n_bad, state) of partitions; one bad record closes its partition.

    items: (scope, scope_ref, id, kind, subject_ref, value, reference, source_ref,
    candidate_ref, lifecycle, confirmation, confirmation_ref, sensitivity,
    supersedes_id, created_at, updated_at); evidence: (scope, scope_ref, id, action,
    target_item_id, actor_ref, source_ref, candidate_ref, created_at). A record is
    bad if it isn't sound, if its confirmation isn't in its partition, or if that
    disagrees with it on the action (replacement of what it supersedes, else
    promotion), the target, the candidate or the source. Evidence is looked up by
    partition and id, so a large partition is met in many tasks; of several with
    one id all must agree. Null parts of a partition's name are one name.
    """
    at = ["scope", "scope_ref"]
    proof = evidence.withColumn("_sound", sound_evidence())
    narrow = proof.select(*at, F.col("id").alias("confirmation_ref"), F.struct("action", "target_item_id", F.coalesce("candidate_ref", F.lit("")).alias("c"), F.coalesce("source_ref", F.lit("")).alias("s"), "_sound").alias("_proof"))
    met = items.withColumn("_sound", sound_item()).join(narrow, [*at, "confirmation_ref"], "left")
    action = F.when(_filled("supersedes_id"), "replacement").otherwise("promotion")
    agrees = (F.col("_proof.action") == action) & (F.col("_proof.target_item_id") == F.col("id")) & (F.col("_proof.c") == F.coalesce("candidate_ref", F.lit(""))) & (F.col("_proof.s") == F.coalesce("source_ref", F.lit("")))
    bad = ~(F.col("_sound") & F.coalesce(agrees & F.col("_proof._sound"), F.lit(False)))
    each = met.groupBy(*at, "id").agg(F.max(bad.cast("int")).alias("_bad")).select(*at, F.lit(1).alias("_i"), F.lit(0).alias("_e"), "_bad")
    proofs = proof.select(*at, F.lit(0).alias("_i"), F.lit(1).alias("_e"), (~F.col("_sound")).cast("int").alias("_bad"))
    out = each.union(proofs).groupBy(*at).agg(F.sum("_i").alias("n_items"), F.sum("_e").alias("n_evidence"), F.sum("_bad").alias("n_bad"))
    return out.withColumn("state", F.when(F.col("n_bad") > 0, "closed").otherwise("open"))


def open_items(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """The items of partitions that no bad record closes."""
    closed = partitions(items, evidence).where("state = 'closed'").select(F.col("scope").alias("_s"), F.col("scope_ref").alias("_r"))
    return items.join(closed, F.col("scope").eqNullSafe(F.col("_s")) & F.col("scope_ref").eqNullSafe(F.col("_r")), "left_anti")


def admit(known: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot after uploads, and what came of each (workspace_id, upload_id, outcome, source_id, supersedes_id).

    known: (workspace_id, upload_id, seq, source_id, checksum, name_key, current);
    uploads: (workspace_id, upload_id, seq, filename, content, refusal), refusal
    empty if the file may be taken in; upload ids are distinct in a workspace. In
    order of (seq, upload_id): a refused file changes nothing; a content that the
    workspace has, or that came before, is a ``duplicate``; others are
    ``accepted``, or a ``new_version`` if the name has a current source, which is
    then superseded. Uploads that ``known`` holds were applied before and are
    passed by, so that the same batch twice gives one snapshot; their outcomes
    aren't repeated. A null content is empty; a null workspace is one of its own.
    The snapshot is saved, so that one after another doesn't grow the plan.
    """
    key = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    rows = uploads.select(F.coalesce("workspace_id", F.lit("")).alias("_w"), "workspace_id", "upload_id", "seq", F.coalesce("refusal", F.lit("")).alias("_refusal"), key(F.col("content")).alias("checksum"), key(F.col("filename")).alias("name_key"))
    old = known.withColumn("_w", F.coalesce("workspace_id", F.lit("")))
    rows = rows.join(old.select("_w", "upload_id"), ["_w", "upload_id"], "left_anti")
    fine = rows.where("_refusal = ''")
    first = fine.groupBy("_w", "checksum").agg(F.min(F.struct("seq", "upload_id")).alias("_first"))
    there = old.select("_w", "checksum").distinct().withColumn("_there", F.lit(True))
    judged = fine.join(first, ["_w", "checksum"]).join(there, ["_w", "checksum"], "left")
    again = F.col("_there").isNotNull() | (F.struct("seq", "upload_id") != F.col("_first"))
    judged = judged.withColumns({"_again": again, "source_id": F.concat(F.lit("src-"), F.left(F.sha2(F.concat_ws("\n", "_w", "checksum").cast("binary"), 256), F.lit(16)))})
    judged = saved(judged)
    taken = judged.where(~F.col("_again"))
    # Of each name the current source, then what is taken in, in order.
    chain = old.where("current").join(taken.select("_w", "name_key").distinct(), ["_w", "name_key"], "left_semi").select("_w", "name_key", F.lit(0).alias("_new"), "seq", "upload_id", "source_id")
    chain = chain.unionByName(taken.select("_w", "name_key", F.lit(1).alias("_new"), "seq", "upload_id", "source_id"))
    order = Window.partitionBy("_w", "name_key").orderBy("_new", "seq", "upload_id")
    chain = chain.withColumns({"supersedes_id": F.lag("source_id").over(order), "current": F.lead("source_id").over(order).isNull()})
    chain = saved(chain)
    links = chain.where("_new = 1").select("_w", "upload_id", "supersedes_id", "current")
    admitted = taken.join(links, ["_w", "upload_id"])
    ended = chain.where("_new = 0 and not current").select("_w", "upload_id", F.lit(True).alias("_ended"))
    columns = ["workspace_id", "upload_id", "seq", "source_id", "checksum", "name_key", "current"]
    kept = old.join(ended, ["_w", "upload_id"], "left").withColumn("current", F.col("current") & F.col("_ended").isNull())
    snapshot = saved(kept.select(*columns).unionByName(admitted.select(*columns)))
    nothing = F.lit(None).cast("string")
    outcomes = admitted.select("workspace_id", "upload_id", F.when(F.col("supersedes_id").isNull(), "accepted").otherwise("new_version").alias("outcome"), "source_id", "supersedes_id")
    outcomes = outcomes.unionByName(judged.where("_again").select("workspace_id", "upload_id", F.lit("duplicate").alias("outcome"), "source_id", nothing.alias("supersedes_id")))
    outcomes = outcomes.unionByName(rows.where("_refusal <> ''").select("workspace_id", "upload_id", F.col("_refusal").alias("outcome"), nothing.alias("source_id"), nothing.alias("supersedes_id")))
    return snapshot, outcomes
