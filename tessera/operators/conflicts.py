"""Decisions on items, and resolutions that move the items in conflict with them, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of a resolution: what becomes of the item and of those related to it (status, current); nothing if it stays as it is.
RESOLUTIONS = {"choose_current": (("confirmed", True), ("superseded", False)), "keep_both": (("confirmed", True), ("confirmed", True)), "keep_open": (("conflicted", None), None)}
#: Of a decision: what becomes of an item that is current.
DECISIONS = {"confirm": ("confirmed", True), "reject": ("rejected", False), "edit": ("superseded", False), "duplicate": ("rejected", False)}
FIRST = ("requires_review", True)


def effects(events: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, seq, op, by) of events (id, seq, action): on the item itself, and for resolutions on each item that relations (id, related_id) give it.

    A resolution of an item without relations is refused: it has no effect. op is
    the decision, or ``set:`` with the state that a resolution gives.
    """
    links = relations.where("id is not null and related_id is not null and id <> related_id").distinct()
    own = events.where(F.col("action").isin(*DECISIONS)).select("id", "seq", F.col("action").alias("op"), F.col("id").alias("by"))
    resolved = events.where(F.col("action").isin(*RESOLUTIONS)).join(links, "id")
    said = lambda i: F.coalesce(*(F.when(F.col("action") == a, F.lit(f"set:{s[i][0]}:{'' if s[i][1] is None else s[i][1]}")) for a, s in RESOLUTIONS.items() if s[i]))
    both = F.array(F.struct(F.col("id").alias("to"), said(0).alias("op")), F.struct(F.col("related_id").alias("to"), said(1).alias("op")))
    moved = resolved.select("seq", F.col("id").alias("by"), F.explode(both).alias("e")).where("e.op is not null").select(F.col("e.to").alias("id"), "seq", "e.op", "by")
    return own.unionByName(moved.select("id", "seq", "op", "by")).distinct()


def resolved_conflicts(items: DataFrame, events: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, status, current) of items (id) after all events in order of seq, which is distinct among them.

    Only what came after the last resolution that touched an item, and the last
    that said whether it is current, can count: both are aggregates, so no item's
    events are sorted or gathered. From there the first decision that ends the
    item decides; a decision on an item that isn't current is refused.
    """
    all_ = effects(events, relations)
    parts = F.split("op", ":")
    sets = all_.where(F.startswith("op", F.lit("set:"))).select("id", "seq", parts[1].alias("status"), F.nullif(parts[2], F.lit("")).alias("now"))
    # A conflict kept open changes the status alone; whether the item is current then follows from what came before.
    strong = sets.where("now is not null").groupBy("id").agg(F.max(F.struct("seq", "status", "now")).alias("_set"))
    open_ = sets.where("now is null").groupBy("id").agg(F.max("seq").alias("_open"))
    decided = all_.where(~F.startswith("op", F.lit("set:"))).join(strong, "id", "left")
    decided = decided.where(F.col("_set").isNull() | (F.col("seq") > F.col("_set.seq")) & (F.col("_set.now") == "True"))
    ends = F.col("op") != "confirm"
    last = decided.groupBy("id").agg(F.min(F.when(ends, F.struct("seq", "op"))).alias("_end"))
    confirms = decided.where(~ends).join(last.select("id", "_end"), "id").where(F.col("_end").isNull() | (F.col("seq") < F.col("_end.seq"))).groupBy("id").agg(F.max("seq").alias("_confirmed"))
    out = items.select("id").distinct().join(strong, "id", "left").join(open_, "id", "left").join(last.select("id", "_end"), "id", "left").join(confirms, "id", "left")
    # The latest of: the resolution, the conflict kept open, the end, the confirmation.
    ended = F.coalesce(*(F.when(F.col("_end.op") == d, F.lit(s[0])) for d, s in DECISIONS.items()))
    marks = F.array_compact(F.array(
        F.when(F.col("_set").isNotNull(), F.struct(F.col("_set.seq").alias("seq"), F.col("_set.status").alias("status"))), F.when(F.col("_open").isNotNull(), F.struct(F.col("_open").alias("seq"), F.lit("conflicted").alias("status"))),
        F.when(F.col("_end").isNotNull(), F.struct(F.col("_end.seq").alias("seq"), ended.alias("status"))), F.when(F.col("_confirmed").isNotNull(), F.struct(F.col("_confirmed").alias("seq"), F.lit("confirmed").alias("status"))),
    ))
    status = F.coalesce(F.array_max(marks)["status"], F.lit(FIRST[0]))
    current = F.when(F.col("_end").isNotNull(), False).otherwise(F.coalesce(F.col("_set.now") == "True", F.lit(FIRST[1])))
    return out.select("id", status.alias("status"), current.alias("current"))


def followed_conflicts(events: DataFrame, relations: DataFrame) -> DataFrame:
    """The same of a stream of events that come in order of seq: each item's state (id, seq, status, current) whenever it changes.

    relations is a table. An item's state is kept between batches; within a batch
    its effects are applied in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, current, at = state.get if state.exists else (*FIRST, -1)
        rows = pd.concat(list(batches)).sort_values("seq")
        before = (status, current, at)
        for seq, op in zip(rows["seq"].tolist(), rows["op"], strict=True):
            if op.startswith("set:"):
                _, status, now = op.split(":")
                current = current if now == "" else now == "True"
                at = seq
            elif current:
                status, current = DECISIONS[op]
                at = seq
        state.update((status, current, at))
        if (status, current, at) != before:
            yield pd.DataFrame({"id": [key[0]], "seq": [at], "status": [status], "current": [current]})

    kind = dict(events.dtypes)["id"]
    schema = "status string, current boolean, seq long"
    return effects_stream(events, relations).groupBy("id").applyInPandasWithState(step, f"id {kind}, seq long, status string, current boolean", schema, "update", "NoTimeout")


def effects_stream(events: DataFrame, relations: DataFrame) -> DataFrame:
    """:func:`effects` of a stream: an event touches each item once, so nothing has to be made distinct."""
    links = relations.where("id is not null and related_id is not null and id <> related_id").groupBy("id").agg(F.collect_set("related_id").alias("related"))
    rows = events.join(links, "id", "left")
    said = lambda i: F.coalesce(*(F.when(F.col("action") == a, F.lit(f"set:{s[i][0]}:{'' if s[i][1] is None else s[i][1]}")) for a, s in RESOLUTIONS.items() if s[i]))
    own = F.when(F.col("action").isin(*DECISIONS), F.col("action")).when(F.col("related").isNotNull(), said(0))
    others = F.transform(F.coalesce("related", F.array().cast(dict(links.dtypes)["related"])), lambda r: F.struct(r.alias("to"), said(1).alias("op")))
    touched = F.filter(F.concat(F.array(F.struct(F.col("id").alias("to"), own.alias("op"))), others), lambda e: e["op"].isNotNull())
    return rows.select("seq", F.explode(touched).alias("e")).select(F.col("e.to").alias("id"), "seq", "e.op")
