"""Call graphs: resolution, neighbourhoods, maximal paths, suffix sharing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.components import connected_components
from quarry.runtime import materialise

#: Relations along which execution flows.
EXECUTABLE = ["calls", "routes_to", "returns_to", "triggers", "handles", "on_success", "on_failure", "delayed_trigger"]


def resolve_names(refs: DataFrame, symbols: DataFrame, most: int = 4) -> DataFrame:
    """(ref, symbol) by lower-cased name or simple name; at most ``most`` per reference, in
    the symbols' order.  refs: ref, name; symbols: id, name, simple_name, ord."""
    index = symbols.select(F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("simple_name")))).alias("key"), "id", "ord")
    found = refs.select("ref", F.lower("name").alias("key")).join(index, "key")
    order = Window.partitionBy("ref").orderBy("ord", "id")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("ref", F.col("id").alias("symbol"), "k")


def resolve_by_precedence(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """One target per reference: a full name in the same file, then a unique full name, a
    simple name in the same file, a unique simple name; otherwise none.
    refs: ref, name, simple_name, source; symbols: id, name, simple_name, source."""
    by = lambda c: symbols.select(F.lower(c).alias("key"), F.col("id"), F.col("source").alias("at"))
    parts = []
    for rank, column in ((0, "name"), (2, "simple_name")):
        # A key's symbols are added up before references meet them, so a common name makes no pairs.
        keys = by(column).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        files = by(column).groupBy("key", F.col("at").alias("source")).agg(F.min("id").alias("near"))
        hit = refs.select("ref", "source", F.lower(column).alias("key")).join(keys, "key").join(files, ["key", "source"], "left")
        both = hit.groupBy("ref").agg(F.min("near").alias("near"), F.when(F.min("lo") == F.max("hi"), F.min("lo")).alias("only"))
        parts += [both.select("ref", F.lit(rank).alias("rank"), F.col("near").alias("id")), both.select("ref", F.lit(rank + 1).alias("rank"), F.col("only").alias("id"))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where("id IS NOT NULL").groupBy("ref").agg(F.min_by("id", "rank").alias("symbol"))


def callers(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("symbol"), F.col("src").alias("caller"), F.lit("called_by").alias("relation")).distinct()


def unresolved(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    return refs.join(resolved, "ref", "left_anti")


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, is_root) of every node."""
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return nodes.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("in_degree"), F.col("n").isNull().alias("is_root"))


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int, undirected: bool = True) -> DataFrame:
    """(start, id, depth): all nodes within ``hops`` edges, at their least depth.  The walk
    is unrolled; a node that was reached is not walked from again."""
    e = edges.select("src", "dst").distinct()
    if undirected:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = start.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    edge = seen
    for k in range(1, hops + 1):
        step = edge.join(e, edge["id"] == e["src"]).select("start", F.col("dst").alias("id")).distinct()
        edge = step.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(edge)
    return seen


def _least_of_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The least node of each connected part of some nodes."""
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    parts = connected_components(inside, "src", "dst")
    alone = nodes.join(parts.select(F.col("node").alias("id")), "id", "left_anti")
    return parts.select(F.col("component").alias("id")).distinct().unionByName(alone.select("id"))


def maximal_paths(nodes: DataFrame, edges: DataFrame, deepest: int = 100, most: int = 1_000_000, unresolved: DataFrame | None = None) -> DataFrame:
    """All paths from the roots, and then from the least node of every part not yet covered
    (a cycle has no root), until every node is covered.  (path, terminal, target): a path
    ends at a leaf (end), before a node it already holds (cycle), or at a leaf that refers to
    what is not there: external with the relations, and the names as its target.
    unresolved: id, name, relation.

    Paths can be exponentially many: beyond ``deepest`` nodes or ``most`` rows an error is
    raised, nothing is cut off silently."""
    e = edges.where(F.col("relation").isin(EXECUTABLE)) if "relation" in edges.columns else edges
    e = e.select("src", "dst").distinct()
    e = e.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    out, rows = None, 0
    left = materialise(nodes.select("id").distinct(), "nodes")
    seeds = left.join(e.select(F.col("dst").alias("id")), "id", "left_anti")
    if seeds.isEmpty():
        seeds = _least_of_components(left, e)
    while True:
        live = seeds.select(F.array("id").alias("path"))
        depth = 1
        while not live.isEmpty():
            if depth > deepest:
                raise ValueError(f"a path has over {deepest} nodes")
            step = live.join(e, F.element_at("path", -1) == F.col("src"), "left")
            again = F.array_contains("path", F.col("dst"))
            done = step.where(F.col("dst").isNull() | again).select("path", F.when(again, "cycle").otherwise("end").alias("terminal"), F.when(again, F.col("dst")).alias("target"))
            live = materialise(step.where(~again).select(F.concat("path", F.array("dst")).alias("path")), "paths")
            done = materialise(done, "paths")
            rows += done.count()
            if rows > most:
                raise ValueError(f"there are over {most} paths")
            out = done if out is None else out.unionByName(done)
            depth += 1
        if out is None:
            return left.select(F.array("id").alias("path"), F.lit("end").alias("terminal"), F.lit(None).cast("string").alias("target")).limit(0)
        left = materialise(left.join(out.select(F.explode("path").alias("id")).distinct(), "id", "left_anti"), "nodes")
        if left.isEmpty():
            return out if unresolved is None else _external(out, unresolved)
        seeds = _least_of_components(left, e)


def _external(paths: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Plain ends at nodes with unresolved executable references become external ones."""
    refs = unresolved.where(F.col("relation").isin(EXECUTABLE)).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("relation")), "+").alias("how"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    rows = paths.join(refs, F.element_at("path", -1) == F.col("id"), "left")
    out = (F.col("terminal") == "end") & F.col("how").isNotNull()
    return rows.select("path", F.when(out, F.concat(F.lit("external:"), "how")).otherwise(F.col("terminal")).alias("terminal"), F.when(out, F.col("names")).otherwise(F.col("target").cast("string")).alias("target"))


def path_key(path: str = "path", terminal: str = "terminal"):
    return F.sha1(F.concat_ws("\x1f", F.concat_ws("\x1e", path), F.coalesce(F.col(terminal), F.lit(""))))


def dedupe_paths(paths: DataFrame, seq: str = "seq") -> DataFrame:
    """Equal nodes and terminal: the first stays; relations don't count."""
    rest = [c for c in paths.columns if c not in ("path", "terminal")]
    kept = paths.groupBy("path", "terminal").agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return kept.select("path", "terminal", *(F.col(f"_r.{c}").alias(c) for c in rest))


def drop_suffixes(paths: DataFrame) -> DataFrame:
    """Without paths that are the proper end of another: every proper suffix's hash is
    emitted once and anti-joined, instead of comparing all pairs."""
    ends = paths.select(F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("path"), F.lit(2))), lambda i: F.when(i <= F.size("path"), F.slice("path", i, F.size("path"))))).alias("end"), "terminal", F.col("target").alias("t"))
    keys = ends.where("end IS NOT NULL").select(F.sha1(F.concat_ws("\x1f", F.concat_ws("\x1e", "end"), "terminal", F.coalesce("t", F.lit("")))).alias("k")).distinct()
    own = F.sha1(F.concat_ws("\x1f", F.concat_ws("\x1e", "path"), "terminal", F.coalesce("target", F.lit(""))))
    return paths.withColumn("k", own).join(keys, "k", "left_anti").drop("k")


def fragments(paths: DataFrame) -> DataFrame:
    """Distinct suffixes (the nodes of a shared chain): symbol, next fragment, terminal."""
    n = F.size("path")
    cut = paths.select(F.explode(F.sequence(F.lit(1), n)).alias("i"), "path", "terminal", F.coalesce("target", F.lit("")).alias("t"))
    key = lambda i: F.sha1(F.concat_ws("\x1f", F.concat_ws("\x1e", F.slice("path", i, n)), "terminal", "t"))
    return cut.select(key(F.col("i")).alias("id"), F.get("path", F.col("i") - 1).alias("symbol"), F.when(F.col("i") < n, key(F.col("i") + 1)).alias("next"), F.when(F.col("i") == n, F.col("terminal")).alias("terminal")).distinct()


def next_in_source(units: DataFrame, source: str = "source", line: str = "line", unit: str = "id") -> DataFrame:
    w = Window.partitionBy(source).orderBy(line, unit)
    return units.select(F.col(unit).alias("src"), F.lead(unit).over(w).alias("dst"), F.lit("next_in_source").alias("relation")).where("dst IS NOT NULL")


def sibling_sequence(nodes: DataFrame) -> DataFrame:
    """Edges of an element tree: a parent calls its first child and each child returns to
    the next; screens route to all children, conditions call all of theirs.
    nodes: id, parent, parent_tag, ord."""
    w = Window.partitionBy("parent").orderBy("ord")
    n = nodes.where("parent IS NOT NULL").withColumn("k", F.row_number().over(w)).withColumn("after", F.lead("id").over(w))
    wide = F.col("parent_tag").isin("screen", "if", "condition", "else")
    down = n.where(wide | (F.col("k") == 1)).select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.when(F.col("parent_tag") == "screen", "routes_to").otherwise("calls").alias("relation"))
    across = n.where(~wide & F.col("after").isNotNull()).select(F.col("id").alias("src"), F.col("after").alias("dst"), F.lit("returns_to").alias("relation"))
    return down.unionByName(across)


def follow_aliases(aliases: DataFrame, rounds: int = 20) -> DataFrame:
    """(alias, target) at the end of each chain by pointer doubling; cycles stop."""
    now = aliases.select("alias", "target")
    for _ in range(rounds):
        ahead = now.select(F.col("alias").alias("target"), F.col("target").alias("further"))
        step = now.join(ahead, "target", "left").select("alias", F.when(F.col("further").isNull() | (F.col("further") == F.col("alias")), F.col("target")).otherwise(F.col("further")).alias("next"), "target")
        changed = step.where("next <> target").limit(1).count()
        now = materialise(step.select("alias", F.col("next").alias("target")), "aliases")
        if not changed:
            break
    return now
