"""Search over confirmed context items: gate, filters, score, facets and pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normal_term, normalize, term_matches

TYPES = ("requirement", "decision", "risk", "open_question", "action")
FIELDS = ("title", "statement", "actor_ref", "deadline", "explicit_status", "priority")
SORTS = ("relevance", "updated_desc", "updated_asc", "title_asc")


@dataclass(frozen=True)
class Params:
    """What a search asks for; wrong values raise ValueError before any plan is made."""

    query: str = ""
    types: tuple[str, ...] = TYPES
    actor: str = ""
    actor_presence: str = "any"
    deadline_presence: str = "any"
    related: str = "any"
    sort: str = ""
    limit: int = 50
    offset: int = 0
    terms: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        terms = tuple(normal_term(self.query).split())
        wrong = {
            "query": len(self.query) > 200 or len(terms) > 16,
            "types": not set(self.types) <= set(TYPES),
            "actor": bool(self.actor) and self.actor_presence == "missing",
            "presence": {self.actor_presence, self.deadline_presence} - {"any", "present", "missing"} or self.related not in ("any", "present", "none"),
            "sort": self.sort not in ("", *SORTS),
            "page": not 1 <= self.limit <= 100 or self.offset < 0,
        }
        for name, bad in wrong.items():
            if bad:
                raise ValueError(f"search parameter {name}")
        object.__setattr__(self, "terms", terms)
        object.__setattr__(self, "sort", self.sort or ("relevance" if terms else "updated_desc"))


def eligible(items: DataFrame) -> DataFrame:
    """Confirmed current items of a known type."""
    return items.where((F.col("kind") == "context") & (F.col("status") == "confirmed") & F.col("current") & F.col("item_type").isin(*TYPES))


def _filled(name: str, presence: str) -> Column:
    there = normalize(F.col(name)) != ""
    return {"any": F.lit(True), "present": there, "missing": ~there}[presence]


def _related(items_related: str) -> Column:
    there = F.coalesce(F.size("relation_ids") > 0, F.lit(False))
    return {"any": F.lit(True), "present": there, "none": ~there}[items_related]


def matching(items: DataFrame, params: Params) -> DataFrame:
    """Eligible items that pass all filters and have every term in some field, with their score."""
    rows = eligible(items).where(F.col("item_type").isin(*params.types))
    rows = rows.where(_filled("actor_ref", params.actor_presence) & _filled("deadline", params.deadline_presence) & _related(params.related))
    if params.actor:
        rows = rows.where(normalize(F.col("actor_ref")) == normal_term(params.actor))
    rows = rows.withColumns({f"_{name}": normalize(F.col(name)) for name in FIELDS})
    score = F.when(F.col("_title") == " ".join(params.terms), 1000).otherwise(0) if params.terms else F.lit(0)
    for i, term in enumerate(params.terms):
        hits = [term_matches(term, F.col(f"_{name}")) for name in FIELDS]
        rows = rows.withColumn(f"_hit{i}", F.array(*hits)).where(F.array_contains(f"_hit{i}", True))
        for place, worth in enumerate((100, 50, 10, 10, 10, 10)):
            score += F.when(F.get(f"_hit{i}", F.lit(place)), worth).otherwise(0)
    return rows.withColumn("score", score)


def _order(sort: str) -> list[Column]:
    tie = [F.col("_title").asc(), F.col("id").asc()]
    updated = F.coalesce(F.col("updated_at"), F.lit(""))
    return {"relevance": [F.desc("score"), *tie], "updated_desc": [updated.desc(), *tie], "updated_asc": [updated.asc(), *tie], "title_asc": tie}[sort]


def page(items: DataFrame, params: Params) -> DataFrame:
    """One page in order, with ``position`` from 1; Spark keeps only offset + limit rows a task."""
    top = matching(items, params).orderBy(*_order(params.sort)).limit(params.offset + params.limit)
    ranked = top.withColumn("position", F.row_number().over(Window.orderBy(*_order(params.sort)))).where(F.col("position") > params.offset)
    sources = F.coalesce(F.size("source_links"), F.lit(0))
    related = F.coalesce(F.size("relation_ids") > 0, F.lit(False))
    return ranked.select("position", "id", "item_type", "title", "score", "updated_at", sources.alias("source_count"), related.alias("has_related"))


def facets(items: DataFrame) -> DataFrame:
    """(facet, value, count) of the eligible items, before any query: each type, also at 0, and each actor as first written.

    The first is that with the smallest ``seq``.
    """
    rows = eligible(items)
    all_types = items.sparkSession.createDataFrame([(t,) for t in TYPES], "value string")
    types = all_types.join(rows.groupBy(F.col("item_type").alias("value")).agg(F.count("*").alias("n")), "value", "left")
    types = types.select(F.lit("type").alias("facet"), "value", F.coalesce("n", F.lit(0)).alias("count"))
    actors = rows.withColumn("key", normalize(F.col("actor_ref"))).where("key <> ''")
    actors = actors.groupBy("key").agg(F.min_by(F.trim("actor_ref"), "seq").alias("value"), F.count("*").alias("count"))
    return types.union(actors.select(F.lit("actor"), "value", "count"))


def sections(items: DataFrame, item_type: str | None = None, conflict: bool | None = None, deadline: bool = False, actor: bool = False) -> DataFrame:
    """The eligible items that a summary lists by type; without ``deadline`` or ``actor`` items with and without one stay."""
    rows = eligible(items)
    related = F.coalesce(F.size("relation_ids") > 0, F.lit(False))
    filled = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    tests = [F.col("item_type") == item_type] if item_type else []
    tests += [related == conflict] if conflict is not None else []
    tests += [filled(name) for name, wanted in (("deadline", deadline), ("actor_ref", actor)) if wanted]
    for test in tests:
        rows = rows.where(test)
    return rows.select("id", "item_type", "title", "statement", "status", "actor_ref", "deadline", "updated_at", "relation_ids")


def overview(items: DataFrame) -> DataFrame:
    """One row of counts: workflow states, confirmed items by type, and what needs attention."""
    now = F.coalesce(F.col("current"), F.lit(False)) & (F.col("kind") == "context")
    done = now & (F.col("status") == "confirmed")
    count = lambda cond, name: F.count_if(cond).alias(name)
    action = done & (F.col("item_type") == "action")
    return items.agg(
        count(done, "confirmed"), count(now & (F.col("status") == "requires_review"), "requires_review"), count(now & (F.col("status") == "conflicted"), "conflicted"),
        count(now & F.col("status").isin("requires_review", "conflicted"), "pending_total"), *(count(done & (F.col("item_type") == t), t) for t in TYPES),
        count(action & (F.coalesce(F.trim("actor_ref"), F.lit("")) == ""), "actions_without_actor"), count(action & (F.coalesce(F.trim("deadline"), F.lit("")) == ""), "actions_without_deadline"),
        count(done & (F.size("relation_ids") > 0), "related"),
    )


def highlights(items: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The latest items of each type, up to a limit for each; actions with a deadline first, missing dates first of all.

    Rank is counted in two steps, so that a type with most of the rows isn't
    sorted in one task: first within parts, then among each part's best.
    """
    rows = eligible(items).where(F.col("item_type").isin(*limits))
    rows = rows.withColumns({"_late": F.when((F.col("item_type") == "action") & (F.coalesce("deadline", F.lit("")) == ""), 1).otherwise(0), "_updated": F.coalesce("updated_at", F.lit("")), "_normal": normalize(F.col("title"))})
    order = [F.col("_late"), F.when(F.col("_updated") == "", 0).otherwise(1), F.desc("_updated"), F.col("_normal"), F.col("id")]
    limit = F.try_element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col("item_type"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_type", "_part").orderBy(*order))).where(F.col("rank") <= limit)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_type").orderBy(*order))).where(F.col("rank") <= limit)
    return rows.select("item_type", "rank", "id", "title", "updated_at", "deadline")


def page_summary(items: DataFrame, params: Params) -> DataFrame:
    """One row (total, returned, has_more) on the page that the parameters ask for."""
    total = F.count("*")
    rest = F.greatest(total - params.offset, F.lit(0))
    return matching(items, params).agg(total.alias("total"), F.least(rest, F.lit(params.limit)).alias("returned"), (rest > params.limit).alias("has_more"))


def chosen(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items (id, ...) that a request names, by ids (id, pos), with ``pos``; a name of no item is an error when the rows are read."""
    known = items.withColumn("_known", F.lit(True))
    out = ids.join(known, "id", "left")
    return out.where(F.coalesce("_known", F.raise_error(F.concat(F.lit("unknown id "), F.col("id").cast("string"))).cast("boolean"))).drop("_known")
