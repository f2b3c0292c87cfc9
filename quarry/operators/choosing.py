"""Which candidate is next: priorities, mixes, tiers and pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import clamp01
from quarry.operators.arcs import WEIGHTS, weighted

#: What a candidate's relation, place and name are worth.
FILE_RELATIONS = {"reference": 100, "symbol_reference": 95, "search": 85, "contains": 30, "sibling": 8}
SLICE_RELATIONS = {"calls": 120, "routes_to": 115, "writes": 105, "reads": 95, "called_by": 85, "reference": 80, "symbol_reference": 75, "entrypoint": 60, "search": 50, "contains": 10, "sibling": 0}
SEMANTIC_RELATIONS = {"triggers": 90, "handles": 88, "on_success": 86, "on_error": 86, "delayed_trigger": 82, "registers": 78, "configured_by": 70}
FLOW_PLACES = "screen|service|src|app|route|controller|workflow|process|pipeline|api|test|script"
CODE_FILES = r"[.](xml|js|jsx|ts|tsx|py|java|kt|sql|groovy|gradle)$"
PLAIN_FILES = r"(readme|license|gitignore|package-lock|yarn[.]lock|gradle[.]properties|build[.]gradle|pom[.]xml|component[.]xml)$"
ACTING_NAMES = "submit|place|create|approve|process|checkout|order|payment|save|update|execute|run|handler|transition|service"
AIDING_NAMES = "test|spec|mock|fixture|helper|util|logger|format"


def _worth(relation: Column, of: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, points in of.items():
        out = F.when(relation == name, points).otherwise(out)
    return out


def _if(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def file_priority(relation: Column, kind: Column, path: Column, label: Column) -> Column:
    """Of files and directories."""
    p, name = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))
    folder = F.coalesce(kind == "directory", F.lit(False))
    return _worth(relation, FILE_RELATIONS, 0) + _if(folder, 12) + _if(folder & p.rlike(FLOW_PLACES), 28) + _if(p.rlike(CODE_FILES), 10) - _if(p.rlike(PLAIN_FILES), 22) - _if(name.startswith("."), 12)


def flow_priority(relation: Column, kind: Column, path: Column, label: Column) -> Column:
    """Of symbols along one flow."""
    text = F.lower(F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(path, F.lit(""))))
    named = _if(text.rlike(ACTING_NAMES), 12) - _if(text.rlike(AIDING_NAMES), 15)
    return _worth(relation, SLICE_RELATIONS, 20) + _if(kind == "symbol", 30) + named


def boundary_priority(relation: Column, kind: Column, path: Column, label: Column) -> Column:
    """Of symbols along one flow; boundaries to other systems first."""
    return flow_priority(relation, kind, path, label) + _if(kind == "external_boundary", 180)


def slice_priority(relation: Column, kind: Column, path: Column, label: Column) -> Column:
    """Of symbols along one flow; boundaries to other systems and semantic functions first."""
    return boundary_priority(relation, kind, path, label) + _if(kind == "semantic_function", 20) + _worth(relation, SEMANTIC_RELATIONS, 0)


def path_priority(relation: Column, kind: Column, path: Column, label: Column, functions: Column) -> Column:
    """Where whole call paths are candidates too: a path by the functions it holds (none: 0),
    anything else as along one flow."""
    whole = F.coalesce(kind == "call_path_seed", F.lit(False)) | F.coalesce(relation == "call_path", F.lit(False))
    return F.when(whole, 120 + F.coalesce(functions, F.lit(0))).otherwise(slice_priority(relation, kind, path, label))


def _top(rows: DataFrame, keys: list[str], order: list, most: Column | int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)


def mixed(candidates: DataFrame, visited: DataFrame, local: int = 10, far: int = 4) -> DataFrame:
    """Per source its best neighbours and then a few from elsewhere, visited ones aside; an
    id that is a neighbour isn't offered as far.  candidates: src, id, is_local, priority;
    visited: src, id."""
    fresh = candidates.join(visited.select("src", "id").distinct(), ["src", "id"], "left_anti")
    best = fresh.groupBy("src", "id").agg(F.max("is_local").alias("is_local"), F.max("priority").alias("priority"))
    return _top(best, ["src", "is_local"], [F.desc("priority"), "id"], F.when(F.col("is_local"), local).otherwise(far))


def stacked(candidates: DataFrame, most: int = 10, far: int = 4) -> DataFrame:
    """Per source the candidates of the nearest stack frame that has any: depth 0 are its own,
    1 and up its callers', null those of the whole repository, which come last and few.
    candidates: src, id, depth, priority."""
    depth = F.coalesce("depth", F.lit(1 << 30))
    tier = F.min(depth).over(Window.partitionBy("src"))
    near = candidates.withColumn("tier", tier).where(depth == F.col("tier"))
    limit = F.when(F.col("depth").isNull(), far).otherwise(most)
    return _top(near, ["src"], [F.desc("priority"), "id"], limit).drop("tier")


def ranked_paths(paths: DataFrame, most: int) -> DataFrame:
    """The longest paths, equal ones by their joined signatures.  paths: id, signatures."""
    joined = F.concat_ws(" → ", "signatures")
    return paths.select("id", F.size("signatures").alias("functions"), joined.alias("signature")).orderBy(F.desc("functions"), "signature", "id").limit(most)


def scout_order(directions: DataFrame, most: int) -> DataFrame:
    """Directions by novelty times likelihood.  directions: id, novelty, likelihood."""
    return directions.withColumn("worth", clamp01(F.col("novelty")) * clamp01(F.col("likelihood"))).orderBy(F.desc("worth"), "id").limit(most)


def best_fit(scores: DataFrame, offered: DataFrame, visited: DataFrame, least: float = 0.25) -> DataFrame:
    """(packet, id, fit): the best offered candidate that wasn't visited; none if even that
    fits less than ``least``.  scores: packet, id, continuity, coherence, expected_gain."""
    known = scores.join(offered.select("packet", "id").distinct(), ["packet", "id"], "left_semi").join(visited.select("packet", "id").distinct(), ["packet", "id"], "left_anti")
    fit = known.select("packet", "id", weighted(WEIGHTS["fit"]).alias("fit"))
    best = fit.groupBy("packet").agg(F.min_by(F.struct("id", "fit"), F.struct((-F.col("fit")).alias("f"), F.col("id").alias("i"))).alias("b"))
    return best.where(F.col("b.fit") >= least).select("packet", "b.id", "b.fit")


def discovery_choice(starts: DataFrame) -> DataFrame:
    """(packet, id): the likeliest start that is pursued and not qualified yet.
    starts: packet, id, likelihood, pursue, status."""
    open_ = starts.where(F.coalesce("pursue", F.lit(True)) & ~F.col("status").eqNullSafe("qualified"))
    return open_.groupBy("packet").agg(F.min_by("id", F.struct((-clamp01(F.col("likelihood"))).alias("l"), F.col("id").alias("i"))).alias("id"))


def pending(frames: DataFrame, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """(arc, id): the first id, still in the frontier and not visited, of the newest frame
    that has one.  frames: arc, frame, pos, id; frontier, visited: arc, id."""
    left = frames.join(frontier.select("arc", "id").distinct(), ["arc", "id"], "left_semi").join(visited.select("arc", "id").distinct(), ["arc", "id"], "left_anti")
    return left.groupBy("arc").agg(F.min_by("id", F.struct((-F.col("frame")).alias("f"), F.col("pos").alias("p"), F.col("id").alias("i"))).alias("id"))


def unrepresented(candidates: DataFrame, represented: DataFrame) -> DataFrame:
    """Candidates with the path ids that nothing represents yet; those without any are left
    out.  candidates: id, path_ids; represented: path_id."""
    each = candidates.select("id", F.posexplode("path_ids").alias("pos", "path_id")).join(represented.select("path_id").distinct(), "path_id", "left_anti")
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path_id"))), lambda x: x.path_id).alias("path_ids"))


def reviewed(*sources: DataFrame) -> DataFrame:
    """Path ids that any of the sources names.  sources: path_id."""
    out = sources[0].select("path_id")
    for s in sources[1:]:
        out = out.unionByName(s.select("path_id"))
    return out.where("path_id IS NOT NULL").distinct()


def ordinals(rows: DataFrame, key: str, order: str, kept: Column) -> DataFrame:
    """Rows that are kept, numbered from 1 within their key."""
    return rows.where(kept).withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(order)))
