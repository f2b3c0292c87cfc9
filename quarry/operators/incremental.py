"""Operators for re-examining only what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import path_key


def interval_union(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Ranges merged where they overlap or touch (a gap of one at most)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0)
    islands = ranges.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def ancestor_dirs(files: DataFrame, path: str = "path") -> DataFrame:
    """Every directory above any of the files: (dir, depth)."""
    parts = F.split(path_key(F.col(path)), "/")
    each = files.select(parts.alias("p")).where(F.size("p") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.array_join(F.slice("p", 1, i), "/"))).alias("dir"))
    return each.distinct().select("dir", F.size(F.split("dir", "/")).alias("depth"))


def top_level_changes(files: DataFrame, trees: DataFrame) -> DataFrame:
    """Changed files and trees by first path segment."""
    top = F.when(F.substring_index("path", "/", 1) == "", ".").otherwise(F.substring_index("path", "/", 1))
    both = files.select(top.alias("path"), F.lit(1).alias("f"), F.lit(0).alias("t")).unionByName(trees.select(top.alias("path"), F.lit(0).alias("f"), F.lit(1).alias("t")))
    return both.groupBy("path").agg(F.sum("f").alias("files_changed"), F.sum("t").alias("trees_changed"))


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed by content hash."""
    b, a = before.select("path", F.col("hash").alias("old")), after.select("path", F.col("hash").alias("new"))
    both = b.join(a, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def reuse_plan(items: DataFrame, changed: DataFrame, state: str = "diff") -> DataFrame:
    """(item, decision, reason, touched) per knowledge item.  state: unprepared, first,
    unchanged, unknown (no diff) or diff.  items: item, files array; changed: path."""
    fixed = {
        "unprepared": ("none", "the repository isn't prepared"),
        "first": ("review", "knowledge from before commits were compared"),
        "unchanged": ("reuse", "same commit"),
        "unknown": ("review", "no difference could be established"),
    }
    if state in fixed:
        decision, reason = fixed[state]
        return items.select("item", F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), F.lit(0).cast("long").alias("touched"))
    files = items.select("item", F.explode("files").alias("path")).withColumn("path", path_key(F.col("path"), lower=True)).distinct()
    hits = files.join(changed.select(path_key(F.col("path"), lower=True).alias("path")).distinct(), "path").groupBy("item").agg(F.count("*").alias("n"))
    touched = F.coalesce("n", F.lit(0))
    bare = F.coalesce(F.size("files"), F.lit(0)) <= 0
    return items.join(hits, "item", "left").select(
        "item",
        F.when(bare | (touched > 0), "review").otherwise("reuse").alias("decision"),
        F.when(bare, "no evidence files known").when(touched > 0, "evidence changed").otherwise("no evidence file changed").alias("reason"),
        touched.alias("touched"),
    )


def uncovered(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines outside every range of their source.  lines: source, line; ranges: source,
    start, end.  Merged ranges don't overlap, so at most one can hold a line: the last that
    starts at or before it, found by a window rather than a range join."""
    merged = interval_union(ranges.select("source", "start", "end"), ["source"])
    both = lines.select("source", "line", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("end")).unionByName(merged.select("source", F.col("start").alias("line"), F.lit(0).alias("kind"), F.col("end").cast("long").alias("end")))
    w = Window.partitionBy("source").orderBy("line", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("reach", F.last("end", ignorenulls=True).over(w)).where((F.col("kind") == 1) & (F.col("reach").isNull() | (F.col("reach") < F.col("line")))).select("source", "line")


def module_bodies(files: DataFrame, ranges: DataFrame, most: int = 80) -> DataFrame:
    """(source, line, body): what a file does outside its symbols: the first ``most`` lines
    that aren't empty or comments, and where they begin.  files: source, text; ranges: source,
    start, end."""
    lines = files.select("source", F.posexplode(F.split("text", r"\r?\n")).alias("at", "text")).select("source", (F.col("at") + 1).cast("long").alias("line"), "text")
    said = lines.where((F.trim("text") != "") & ~F.col("text").rlike(r"^\s*(?://|/\*|\*|#)"))
    out = uncovered(said.select("source", "line"), ranges)
    w = Window.partitionBy("source").orderBy("line")
    few = out.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).join(said, ["source", "line"])
    rows = F.array_sort(F.collect_list(F.struct("line", "text")))
    return few.groupBy("source").agg(F.min("line").alias("line"), F.array_join(F.transform(rows, lambda r: r.text), "\n").alias("body"))


def description_targets(entities: DataFrame, fields: DataFrame, each: int = 18, total: int = 54, most: int = 5) -> DataFrame:
    """(entity, pos, field): fields that lack a description, ``each`` of an entity, ``total``
    in all, of ``most`` entities.  Entities and their fields come in order; an entity that the
    budget cuts gets what is left of it.  entities: entity, ord; fields: entity, pos, field,
    description."""
    bare = fields.where(F.coalesce(F.trim("description"), F.lit("")) == "").join(entities, "entity")
    w = Window.partitionBy("entity").orderBy("pos")
    few = bare.withColumn("k", F.row_number().over(w)).where(F.col("k") <= each)
    first = few.select("ord", "entity").distinct().orderBy("ord", "entity").limit(most)
    return few.join(F.broadcast(first), ["ord", "entity"], "left_semi").orderBy("ord", "entity", "k").limit(total).select("entity", "pos", "field")


def passes(batch, most: int = 3) -> int:
    """Run a batch (a function that says how much it changed) until it changes nothing, at
    most so often; all that changed."""
    changed = 0
    for _ in range(most):
        n = batch()
        changed += n
        if not n:
            break
    return changed


def budgeted(rows: DataFrame, group: Column | str, order: list, each: int, total: int) -> DataFrame:
    """At most ``each`` rows of a group and ``total`` in all, in order."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= each).drop("_k").orderBy(*order).limit(total)


def not_attempted(rows: DataFrame, attempted: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose content wasn't tried before.  attempted: fingerprint."""
    return rows.withColumn("fingerprint", F.sha1(F.to_json(F.struct(*columns)))).join(attempted.select("fingerprint").distinct(), "fingerprint", "left_anti")
