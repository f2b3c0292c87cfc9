"""Priorities, signals, selections and gates that decide what is examined next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import ascii_key, clamp01

#: How close a related unit stands, by relation.
RELATION_PRIORITY = {
    "triggers": 130,
    "handles": 128,
    "on_success": 126,
    "on_error": 126,
    "delayed_trigger": 124,
    "registers": 120,
    "configured_by": 116,
    "calls": 110,
    "routes_to": 108,
    "writes": 102,
    "reads": 98,
    "next_in_source": 92,
    "called_by": 75,
    "entrypoint": 55,
    "search": 45,
}
#: The same for plain symbols.
SYMBOL_PRIORITY = {"calls": 100, "routes_to": 95, "writes": 90, "reads": 85, "called_by": 75, "entrypoint": 55, "search": 45}
#: Names that look like entry points, and names that look like helpers.
ENTRY_NAMES = "route|handler|controller|screen|transition|service|process|submit|create|place|checkout|order|approve|import|export|run|execute"
HELPER_NAMES = "test|spec|mock|fixture|util|helper"
ENTRY_KINDS = ["transition", "screen", "service"]


def relation_priority(relation: Column, priorities: dict[str, int] | None = None) -> Column:
    out = F.lit(20)
    for name, p in (priorities or RELATION_PRIORITY).items():
        out = F.when(relation == name, p).otherwise(out)
    return out


def nearest(neighbours: DataFrame, most: int = 18, priorities: dict[str, int] | None = None) -> DataFrame:
    """Per unit the closest other targets, each under its best relation.
    neighbours: src, dst, relation."""
    p = relation_priority(F.col("relation"), priorities)
    best = neighbours.where(F.col("src").cast("string") != F.col("dst").cast("string")).groupBy("src", "dst").agg(F.max(p).alias("priority"), F.min_by("relation", F.struct((-p).alias("p"), F.col("relation").alias("r"))).alias("relation"))
    w = Window.partitionBy("src").orderBy(F.desc("priority"), "dst")
    return best.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)


def entry_priority(name: Column, path: Column, kind: Column, incoming: Column, references: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, path))
    return (
        F.when(incoming == 0, 25).otherwise(0)
        + F.when(kind.isin(ENTRY_KINDS), 35).otherwise(0)
        + F.when(text.rlike(ENTRY_NAMES), 20).otherwise(0)
        - F.when(text.rlike(HELPER_NAMES), 15).otherwise(0)
        + F.least(F.lit(15), references)
    )


#: What synthetic units and structured markup add to an entry's priority.
KIND_PRIORITY = {"module_init": 45, "ui_event": 50, "event": 50, "config_value": -30, "semantic_constant": -30, "environment_value": -30}
STRUCTURE_PRIORITY = {
    "xml_screen": 140, "screen": 140, "transition": 90, "module_init": 90, "ui_event": 90, "event": 90, "xml_actions": 55,
    "xml_service_call": -70, "xml_entity_find": -70, "xml_entity_find_count": -70, "xml_entity_one": -70, "config_value": -45, "semantic_constant": -45, "environment_value": -45, "json_object": -45,
}


def kind_adjustment(kind: Column, structured: bool = False) -> Column:
    """What a unit's kind adds to ``entry_priority``: synthetic units, and with ``structured``
    what containers and call sites of markup add to that."""
    out = F.lit(0)
    for of in (KIND_PRIORITY, STRUCTURE_PRIORITY) if structured else (KIND_PRIORITY,):
        part = F.lit(0)
        for name, points in of.items():
            part = F.when(kind == name, points).otherwise(part)
        out = out + part
    return out


def coverage(units: DataFrame, visited: DataFrame) -> DataFrame:
    """Per source: units in all, visited and not.  units: source, id; visited: id."""
    seen = visited.select("id").distinct().withColumn("seen", F.lit(1))
    return units.join(seen, "id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count("seen").alias("visited"), (F.count("*") - F.count("seen")).alias("uncovered"))


def representative(units: DataFrame, visited: DataFrame) -> DataFrame:
    """Per source the unit of the highest priority, uncovered ones first.
    units: source, id, priority."""
    seen = visited.select("id").distinct().withColumn("seen", F.lit(True))
    rows = units.join(seen, "id", "left")
    order = F.struct(F.coalesce("seen", F.lit(False)).alias("s"), (-F.col("priority")).alias("p"), F.col("id").alias("i"))
    return rows.groupBy("source").agg(F.min_by("id", order).alias("id"))


def select_arc(fits: DataFrame, explicit: DataFrame, least: float = 0.25) -> DataFrame:
    """The arc that evidence goes to: the named one if it fits, else the best that fits,
    else a new one if asked for, else none.  fits: packet, arc, score; explicit: packet,
    best."""
    best = fits.groupBy("packet").agg(F.min_by(F.struct("arc", "score"), F.struct((-F.col("score")).alias("s"), F.col("arc").alias("a"))).alias("top"))
    named = explicit.join(fits.select("packet", F.col("arc").alias("best"), "score"), ["packet", "best"], "left")
    rows = named.join(best, "packet", "left")
    choice = F.when(F.col("score") >= least, F.col("best")).when(F.col("top.score") >= least, F.col("top.arc")).when(F.upper("best") == "NEW", "NEW")
    return rows.select("packet", choice.alias("arc"))


def signal_reason(trail: DataFrame) -> DataFrame:
    """Why a walk along an arc should look elsewhere, at each step; the first reason that
    holds.  trail: arc, step, score, candidates, classification, complete."""
    w = Window.partitionBy("arc").orderBy("step")
    one, two = F.lag("score", 1).over(w), F.lag("score", 2).over(w)
    falls = F.coalesce((two > one) & (one > F.col("score")) & (two - F.col("score") >= 0.10), F.lit(False))
    aside = F.col("classification").isin("technical", "orientation") & (F.col("score") < 0.45)
    reason = F.when(F.col("complete"), "complete").when(falls, "declining").when(F.col("score") < 0.25, "weak").when(F.col("candidates") == 0, "exhausted").when(aside, "drift").otherwise("")
    return trail.withColumn("reason", reason)


def unfinished(arcs: DataFrame) -> DataFrame:
    """Arcs in the order in which they go on.  arcs: arc, priority, started, completed,
    opportunity, created."""
    return arcs.where(~F.coalesce("completed", F.lit(False))).orderBy(F.desc(F.coalesce("priority", F.lit(-1.0))), F.coalesce("started", F.lit(False)), F.desc(F.coalesce("opportunity", F.lit(0.0))), F.coalesce("created", F.lit(0)))


def promote(rankings: DataFrame, titles: DataFrame, most: int = 3) -> DataFrame:
    """Scouted paths that become arcs: worth pursuing, likely and new, with a new title; a
    title counts once.  rankings: item, pursue, likelihood, novelty, title, ord."""
    ok = F.col("pursue") & (clamp01(F.col("likelihood")) >= 0.55) & (clamp01(F.col("novelty")) >= 0.45) & (F.trim("title") != "")
    fresh = rankings.where(ok).withColumn("key", F.lower(F.trim("title"))).join(titles.select(F.lower(F.trim("title")).alias("key")).distinct(), "key", "left_anti")
    first = fresh.groupBy("key").agg(F.min_by(F.struct("item", "title", "ord"), F.col("ord")).alias("r"))
    return first.select("r.*").orderBy("ord", "item").limit(most)


def evidence_depth(stages: Column, entities: Column, persistent: Column, relations: Column, effects: Column, outcome: Column) -> tuple[Column, Column]:
    """(dimensions, sufficient) from counts, and whether an outcome is known."""
    dims = sum((F.when(c, 1).otherwise(0) for c in (stages >= 2, entities >= 2, persistent >= 1, relations >= 1, effects >= 1)), F.lit(0))
    return dims, (dims >= 2) | (stages >= 3) | ((entities >= 2) & outcome)


def closure(completed: Column, interpreted: Column, pending: Column, sufficient: Column) -> Column:
    """closed, needs_more_evidence, or open."""
    ready = interpreted & (pending == 0) & completed
    return F.when(ready & sufficient, "closed").when(ready, "needs_more_evidence").otherwise("open")


def arc_state(closed: Column, calls: Column, details: Column) -> Column:
    return F.when(closed, "complete").when((calls > 0) | (details > 0), "explored").otherwise("identified")


def minimal_container(paths: DataFrame) -> DataFrame:
    """(child, parent): each path's shortest path that strictly contains it as a run.

    Every proper run of a path is one hash; the best path of each hash is found before the
    join, so a child meets one row and frequent tokens form no pairs.
    paths: id, tokens, ord."""
    mark = lambda t: F.xxhash64(F.size(t), F.concat_ws("\x1e", t))
    n = F.size("tokens")
    starts = paths.where(n > 1).select("id", "ord", "tokens", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("i"))
    room = F.least(F.col("n") - F.col("i") + 1, F.col("n") - 1)
    runs = starts.select("id", "ord", "n", F.explode(F.transform(F.sequence(F.lit(1), room), lambda m: F.struct(m.alias("m"), F.slice("tokens", F.col("i"), m).alias("run")))).alias("r"))
    best = runs.groupBy(mark(F.col("r.run")).alias("key")).agg(F.min_by("id", F.struct("n", "ord")).alias("parent"))
    own = paths.where(n > 0).select(F.col("id").alias("child"), mark(F.col("tokens")).alias("key"))
    return own.join(best, "key").select("child", "parent")


def path_of_symbol(paths: DataFrame) -> DataFrame:
    """The longest path through each symbol.  paths: id, symbols."""
    return paths.select("id", F.size("symbols").alias("n"), F.explode(F.array_distinct("symbols")).alias("symbol")).groupBy("symbol").agg(F.min_by("id", F.struct((-F.col("n")).alias("n"), F.col("id").alias("i"))).alias("path"))


def scout_groups(paths: DataFrame, top: int, branches: int = 3) -> DataFrame:
    """The best ``3 x top`` paths by entry: the best one and a few more.
    paths: entry, id, rank."""
    few = paths.orderBy("rank", "id").limit(3 * top)
    rows = F.array_sort(F.collect_list(F.struct("rank", "id")))
    grouped = few.groupBy("entry").agg(rows.alias("r"))
    return grouped.select("entry", F.get("r", F.lit(0)).id.alias("best"), F.transform(F.slice("r", 2, branches), lambda x: x.id).alias("branches"), F.get("r", F.lit(0)).rank.alias("rank"))


def running_usage(calls: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.select(key, order, *(F.sum(c).over(w).alias(f"total_{c}") for c in columns))


def candidate_schemas(names: DataFrame, schemas: DataFrame, fields: DataFrame, most: int = 8, context: DataFrame | None = None) -> DataFrame:
    """Schemas that a business name may mean: 8 if they begin with it, 5 if they contain it,
    3 more if they have its id as a field; 10 if the same workflow uses them, 9 if a related
    one stores the name in them, where that is more.  names: name; schemas: schema; fields:
    schema, field; context: name, schema, how (workflow or representation).

    A schema contains a name's key only if one of its substrings of the key's length equals
    it, so candidates come from an equi-join on substrings, not from a cross join."""
    wanted = names.select("name", ascii_key(F.col("name")).alias("key")).where("key <> ''").distinct()
    keyed = schemas.select("schema", ascii_key(F.col("schema")).alias("sk")).where("sk <> ''").distinct()
    n = F.length("sk")
    starts = keyed.select("schema", "sk", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    parts = starts.select("schema", "sk", F.explode(F.sequence(F.lit(1), F.length("sk") - F.col("i") + 1)).alias("m"), "i").select("schema", "sk", F.substring(F.col("sk"), F.col("i"), F.col("m")).alias("key")).distinct()
    by_name = wanted.join(parts, "key").where("sk <> key").select("name", "schema", F.when(F.col("sk").startswith(F.col("key")), 8).otherwise(5).alias("score"))
    ids = fields.select("schema", ascii_key(F.col("field")).alias("fk")).distinct()
    by_id = wanted.select("name", "key", F.concat("key", F.lit("id")).alias("fk")).join(ids, "fk").where(ascii_key(F.col("schema")) != F.col("key")).select("name", "schema", F.lit(3).alias("score")).distinct()
    both = by_name.unionByName(by_id).groupBy("name", "schema").agg(F.sum("score").alias("score"))
    if context is not None:
        points = F.when(F.col("how") == "workflow", 10).otherwise(9)
        near = context.where(ascii_key(F.col("schema")) != ascii_key(F.col("name"))).select("name", "schema", points.cast("long").alias("score"))
        both = both.unionByName(near.join(wanted.select("name").distinct(), "name", "left_semi")).groupBy("name", "schema").agg(F.max("score").alias("score"))
    w = Window.partitionBy("name").orderBy(F.desc("score"), "schema")
    return both.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
