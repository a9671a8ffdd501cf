"""Packages of inputs under one budget of characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.privacy import level, strictest
from tessera.operators.memory import first_of

#: In the order in which they are packed.
LAYERS = ("request", "authority", "ambiguity", "memory", "session")


def fitted(inputs: DataFrame, capacity: int, order: list[str], key: str = "package_id") -> DataFrame:
    """inputs (key, order..., cost) with ``included`` and ``used``, taken in order: what would overflow the budget is left out, smaller ones later may fit.

    Only key, order and cost are gathered: a package is one row, and many are
    walked at a time. What costs more than the budget never fits and isn't
    gathered. Nulls come first.
    """
    @F.pandas_udf("included array<boolean>, used array<bigint>")
    def take(costs: pd.Series) -> pd.DataFrame:
        included, used = [], []
        for package in costs:
            total, fits, after = 0, [], []
            for cost in package.tolist():
                fits.append(total + cost <= capacity)
                total += cost if fits[-1] else 0
                after.append(total)
            included.append(fits)
            used.append(after)
        return pd.DataFrame({"included": included, "used": used})

    lists = inputs.select(key, F.struct(*order, "cost").alias("_i")).where(F.col("_i.cost") <= capacity).groupBy(key).agg(F.array_sort(F.collect_list("_i")).alias("_rows"))
    took = lists.select(key, "_rows", take("_rows.cost").alias("_t"))
    took = took.select(key, F.explode(F.arrays_zip("_rows", "_t.included", "_t.used")).alias("_x"))
    return took.select(key, *(F.col(f"_x._rows.{c}").alias(c) for c in (*order, "cost")), F.col("_x.included").alias("included"), F.col("_x.used").alias("used"))


def layer_place(layer: Column) -> Column:
    """A layer's place in the order in which layers are packed; unknown ones come last."""
    return F.coalesce(*(F.when(layer == name, i) for i, name in enumerate(LAYERS)), F.lit(len(LAYERS)))


def context_packages(inputs: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Packages (package_id, status, used, handling, n_included, n_omitted, external_allowed) and what they leave out (package_id, layer, ref, handling).

    inputs: (package_id, layer, seq, ref, cost, handling); (layer, seq) is distinct
    within a package. One budget goes through the layers in order (request,
    authority, ambiguity, memory, session); within and after a layer what doesn't
    fit is left out and the rest goes on. A package whose request alone overflows
    is ``refused`` and leaves everything out. The handling is the strictest of all
    inputs, of those left out, too. A null cost counts as 0.
    """
    rows = inputs.select("package_id", "layer", layer_place(F.col("layer")).alias("_place"), "seq", "ref", F.coalesce("cost", F.lit(0)).cast("long").alias("cost"), "handling")
    request = rows.groupBy("package_id").agg(F.sum(F.when(F.col("_place") == 0, F.col("cost")).otherwise(0)).alias("_request"))
    took = fitted(rows, capacity, ["_place", "seq"]).where("included").select("package_id", "_place", "seq", F.lit(True).alias("_in"), "used")
    same = [F.col("i.package_id").eqNullSafe(F.col("t.package_id")) & (F.col("i._place") == F.col("t._place")) & F.col("i.seq").eqNullSafe(F.col("t.seq"))]
    out = rows.alias("i").join(took.alias("t"), same, "left").select("i.*", F.coalesce("t._in", F.lit(False)).alias("_in"), "t.used")
    refused = request.where(F.col("_request") > capacity).select(F.col("package_id").alias("_refused"), F.lit(True).alias("_no"))
    out = out.join(refused, F.col("package_id").eqNullSafe(F.col("_refused")), "left").withColumn("_in", F.col("_in") & F.col("_no").isNull())
    packages = out.groupBy("package_id").agg(
        F.when(F.bool_or(F.col("_no").isNotNull()), "refused").otherwise("composed").alias("status"), F.coalesce(F.max(F.when(F.col("_in"), F.col("used"))), F.lit(0)).alias("used"),
        strictest(F.col("handling")).alias("handling"), F.count_if("_in").alias("n_included"), F.count_if(~F.col("_in")).alias("n_omitted"), (F.max(level(F.col("handling"))) == 0).alias("external_allowed"),
    )
    return packages, out.where(~F.col("_in")).select("package_id", "layer", "ref", "handling")


def dialogue_contexts(memory: DataFrame, items: DataFrame, total: int, reserved: int, most: int) -> DataFrame:
    """(package_id, memory_text, memory_chars, context_chars, n_selected, n_included) of memory (package_id, text) and items (package_id, seq, cost).

    Memory first gets all but the reserved characters; the first ``most`` items get
    what it doesn't need, whole or not at all; then memory is cut to what they
    left. Every package of memory has a row; a null text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    room = memory.select("package_id", (total - F.least(F.length(text), F.lit(total - reserved))).alias("_room"))
    costs = items.select("package_id", "seq", F.coalesce("cost", F.lit(0)).cast("long").alias("cost"))
    firsts = first_of(costs, ["package_id"], [F.asc("seq"), F.asc("cost")], most, spread="seq")
    lists = firsts.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("seq", "cost"))).alias("rows"))
    lists = room.join(lists, "package_id", "left")
    fold = F.aggregate(
        F.coalesce("rows", F.array().cast(dict(lists.dtypes)["rows"])), F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n")),
        lambda acc, r: F.when(acc["used"] + r["cost"] <= F.col("_room"), F.struct((acc["used"] + r["cost"]).alias("used"), (acc["n"] + 1).alias("n"))).otherwise(acc),
    )
    lists = lists.select("package_id", F.coalesce(F.size("rows"), F.lit(0)).alias("_n"), fold.alias("_took"))
    out = memory.select("package_id", text.alias("text")).join(lists, "package_id")
    cut = F.left("text", (total - F.col("_took.used")).cast("int"))
    return out.select("package_id", cut.alias("memory_text"), F.length(cut).alias("memory_chars"), F.col("_took.used").alias("context_chars"), F.greatest("_n", F.lit(0)).alias("n_selected"), F.col("_took.n").alias("n_included"))
