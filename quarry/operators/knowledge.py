"""Projections, filters and lookups over symbols, schemas, arcs and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import attribute, identity_key, simple_name
from quarry.operators.evidence import first_by

#: Relations that edges may carry.
RELATIONS = "calls routes_to reads writes returns_to triggers handles on_success on_failure delayed_trigger registers configured_by next_in_source called_by".split()
#: Markup that refers to other units, by relation.
MARKUP_REFERENCES = {
    "calls": ("service-call", "name"),
    "routes_to": ("transition", "name"),
    "reads": ("entity-find|entity-one", "entity-name"),
    "writes": ("create|update|delete|store|entity-make", "entity-name"),
}


def _with_relation(relation: str):
    return lambda n: F.struct(n.alias("name"), F.lit(relation).alias("relation"))


def markup_references(units: DataFrame, most: int = 100) -> DataFrame:
    """(id, pos, name, simple_name, relation, explicit) that markup names; at most ``most``
    per unit in all.  units: id, body."""
    lists = []
    for relation, (tags, name) in MARKUP_REFERENCES.items():
        found = F.regexp_extract_all("body", F.lit(rf"<(?:{tags})\b[^>]*\b{name}=[\"']([^\"']+)[\"']"), 1)
        lists.append(F.transform(found, _with_relation(relation)))
    every = F.slice(F.concat(*lists), 1, most)
    rows = units.select("id", F.posexplode(every).alias("pos", "r"))
    return rows.select("id", "pos", "r.name", simple_name(F.col("r.name")).alias("simple_name"), "r.relation", F.lit(True).alias("explicit"))


def parameters(signature: Column) -> Column:
    """Names between the first parentheses, without defaults and types."""
    inside = F.regexp_extract(signature, r"\(([^)]*)\)", 1)
    bare = F.transform(F.split(inside, ","), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"[=:].*$", ""), r"^\s*(?:[\w<>\[\]?.]+\s+)+(?=[\w$]+\s*$)", "")))
    return F.filter(bare, lambda p: p != "")


#: Relations that change something outside a unit.
EFFECTS = "writes routes_to publishes_event triggers handles on_success on_error delayed_trigger".split()


def _found(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all("body", F.lit(pattern), group)


def canonical_packet(symbols: DataFrame, references: DataFrame | None = None, most: int = 100) -> DataFrame:
    """(id, inputs, outputs, operations, conditions, effects, provenance) of units: what they
    take, give, do, test and change, and where they stand.  Operations and effects come from
    the unit's first ``most`` references, as relation:target; where no references are given,
    operations are the names that the body calls.  A unit with neither just executes.
    symbols: id, signature, body, and if known path, start_line, end_line; references: id,
    pos, relation, name."""
    inputs = F.array_distinct(F.concat(parameters(F.col("signature")), _found(r"<parameter\b[^>]*\bname=[\"']([^\"']+)[\"']")))
    outputs = F.array_distinct(F.concat(_found(r"\breturn\s+([A-Za-z_$][\w$]*)"), _found(r"\b(?:out-map|list|count|to-field)=[\"']([^\"']+)[\"']")))
    fields = F.transform(_found(r"<econdition\b([^>]*)>"), lambda t: F.concat_ws("=", F.nullif(F.regexp_extract(t, r"\bfield-name=[\"']([^\"']+)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"\b(?:value|from)=[\"']([^\"']+)", 1), F.lit(""))))
    conditions = F.array_distinct(F.concat(F.transform(_found(r"\bif\s*\(([^)]+)\)"), lambda c: F.trim(c)), _found(r"\bcondition=[\"']([^\"']+)[\"']"), F.filter(fields, lambda f: f != "")))
    rows = symbols
    for c, kind in (("path", "string"), ("start_line", "int"), ("end_line", "int")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    none = F.array().cast("array<string>")
    if references is None:
        calls = F.array_distinct(_found(r"\b([A-Za-z_$][\w$.]*)\s*\("))
        rows = rows.withColumn("does", F.filter(calls, lambda c: ~c.isin("if", "for", "while", "switch", "catch", "return", "function"))).withColumn("changes", none)
    else:
        w = Window.partitionBy("id").orderBy("pos")
        few = references.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("id", "k", "relation", F.concat_ws(":", "relation", "name").alias("r"))
        said = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x.r)
        held = few.groupBy("id").agg(said(F.struct("k", "r")).alias("does"), said(F.when(F.col("relation").isin(EFFECTS), F.struct("k", "r"))).alias("changes"))
        rows = rows.join(held, "id", "left")
    does = F.when(F.size(F.coalesce("does", none)) > 0, F.col("does")).otherwise(F.array(F.lit("execute")))
    return rows.select("id", inputs.alias("inputs"), outputs.alias("outputs"), does.alias("operations"), conditions.alias("conditions"), F.coalesce("changes", none).alias("effects"), F.struct("path", "start_line", "end_line").alias("provenance"))


def entity_names(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("entity-name=\"([^\"]+)\""), 1))


def linked_concepts(texts: DataFrame, labels: list[str]) -> DataFrame:
    """(id, pos, label) of labels in prose, longest first, case aside.  The labels are one
    screen's concepts: a short list."""
    known = sorted({x.strip() for x in labels if len(x.strip()) > 2}, key=lambda x: (-len(x), x))
    if not known:
        return texts.select("id", F.lit(0).alias("pos"), F.lit("").alias("label")).limit(0)
    escaped = ["".join(c if c.isalnum() or c == " " else "\\" + c for c in x) for x in known]
    pattern = "(?i)(" + "|".join(escaped) + ")"
    return texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("pos", "label"))


def without_builtins(refs: DataFrame, builtins: DataFrame, local: DataFrame) -> DataFrame:
    """References to a language's own names go, unless a local symbol has that name.
    refs: language, name; builtins: language, name; local: name."""
    own = local.select(F.lower("name").alias("key")).distinct().withColumn("own", F.lit(True))
    hidden = builtins.select("language", F.lower("name").alias("key")).distinct().withColumn("hidden", F.lit(True))
    rows = refs.withColumn("key", F.lower("name")).join(own, "key", "left").join(hidden, ["language", "key"], "left")
    return rows.where("own OR hidden IS NULL").drop("key", "own", "hidden")


def allowed_edges(edges: DataFrame) -> DataFrame:
    """Known relations only; source order only within a file.  edges: src, dst, relation,
    src_path, dst_path."""
    return edges.where(F.col("relation").isin(RELATIONS) & ((F.col("relation") != "next_in_source") | (F.col("src_path") == F.col("dst_path"))))


def strong_external(relation: Column, name: Column, explicit: Column) -> Column:
    """Whether an unresolved reference deserves a node of its own."""
    return explicit | relation.isin("routes_to", "reads", "writes") | ((relation == "calls") & name.rlike("[./:#]"))


def real_services(units: DataFrame) -> DataFrame:
    """Without service units that are call sites misread.  units: kind, body."""
    return units.where(~((F.col("kind") == "service") & F.trim("body").startswith("<service-call")))


def boundary_nodes(unresolved: DataFrame) -> DataFrame:
    """External nodes for strong unresolved references.  unresolved: name, relation,
    explicit."""
    kept = unresolved.where(strong_external(F.col("relation"), F.col("name"), F.col("explicit")))
    return kept.select(F.concat(F.lit("external:"), F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20"))).alias("id"), "name").distinct()


def schema_ladder(names: DataFrame, schemas: DataFrame) -> DataFrame:
    """(name, schema) by the first rung that fits: exact name, last part, then their keys.
    names: name; schemas: schema, full_name, seq."""
    leaf = F.substring_index("full_name", ".", -1)
    key = lambda c: identity_key(c, compatibility=False)
    rungs = [(F.col("name"), F.col("schema")), (F.substring_index("name", ".", -1), F.col("schema")), (key(F.col("name")), key(F.col("schema"))), (key(F.col("name")), key(F.col("full_name"))), (key(F.substring_index("name", ".", -1)), key(leaf))]
    out = None
    for rank, (left, right) in enumerate(rungs):
        hit = names.select("name", left.alias("k")).join(schemas.select("schema", "seq", right.alias("k")), "k").where("k <> ''").select("name", "schema", "seq", F.lit(rank).alias("rank"))
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy("name").agg(F.min_by("schema", F.struct("rank", "seq")).alias("schema"))


def arc_of_path(paths: DataFrame, arcs: DataFrame) -> DataFrame:
    """The first arc that lists a path in any of its lists.  arcs: arc, ord, lists
    array<array<string>>; paths: path."""
    listed = arcs.select("arc", "ord", F.explode(F.array_distinct(F.flatten("lists"))).alias("path"))
    first = listed.groupBy("path").agg(F.min_by("arc", "ord").alias("arc"))
    return paths.join(first, "path", "left")


def representations(mappings: DataFrame, fields: DataFrame, learned: DataFrame) -> DataFrame:
    """(business, physical, field, description): what a business entity is stored as; a
    learned description wins over the schema's."""
    own = learned.select(F.col("entity").alias("physical"), "field", F.col("description").alias("said"))
    rows = mappings.join(fields.withColumnRenamed("entity", "physical"), "physical", "left")
    return rows.join(own, ["physical", "field"], "left").select("business", "physical", "field", F.coalesce(F.when(F.col("said") != "", F.col("said")), F.col("description")).alias("description"))


def flatten_links(nodes: DataFrame) -> DataFrame:
    """Adjacency to edges.  nodes: id, links array<struct<node, relationship>>."""
    return nodes.select(F.col("id").alias("src"), F.posexplode("links").alias("pos", "l")).select("src", "pos", F.col("l.node").alias("dst"), "l.relationship")


def gather_links(edges: DataFrame) -> DataFrame:
    """Edges to adjacency, in their order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col("dst").alias("node"), "relationship")))
    return edges.groupBy(F.col("src").alias("id")).agg(F.transform(rows, lambda r: F.struct(r.node.alias("node"), r.relationship.alias("relationship"))).alias("links"))


def relation_edges(relations: DataFrame) -> DataFrame:
    """One relation per ends, label and key maps; foreign keys before business relations,
    then the first.  relations: from, relation, to, kind, maps, seq."""
    key = lambda c: identity_key(F.col(c), compatibility=False)
    rows = relations.withColumn("k1", key("from")).withColumn("k2", key("relation")).withColumn("k3", key("to")).withColumn("k4", F.to_json("maps"))
    return first_by(rows, ["k1", "k2", "k3", "k4"], F.when(F.col("kind") == "schema_fk", 0).otherwise(1), "seq").drop("k1", "k2", "k3", "k4")


def learned_share(ranked: DataFrame, *seen: DataFrame) -> DataFrame:
    """How many ranked paths were reviewed or entered an arc, and in percent."""
    known = seen[0].select("path")
    for s in seen[1:]:
        known = known.unionByName(s.select("path"))
    rows = ranked.select("path").distinct().join(known.distinct().withColumn("hit", F.lit(1)), "path", "left")
    return rows.agg(F.count("hit").alias("learned"), F.count("*").alias("total"), F.round(100 * F.count("hit") / F.greatest(F.count("*"), F.lit(1))).cast("int").alias("percent"))


def best_opportunity(arcs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Opportunity raised to the best candidate's score.  candidates: arc, score."""
    best = candidates.groupBy("arc").agg(F.max("score").alias("best"))
    return arcs.join(best, "arc", "left").withColumn("opportunity", F.greatest("opportunity", F.coalesce("best", F.lit(0.0)))).drop("best")


def latest_of(rows: DataFrame, keys: list[str], types: list[str], seq: str = "seq") -> DataFrame:
    """Per key the last event of certain types."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.where(F.col("type").isin(types)).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def compact_trail(trail: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """Per key the nodes in the order first met, the last ``most`` of them.
    trail: keys, node, pos."""
    first = trail.groupBy(*keys, "node").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy(*keys).orderBy(F.desc("pos"))
    return first.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def unseen_first(ranked: DataFrame, seen: DataFrame, most: int = 12) -> DataFrame:
    """The first entries that hold unseen ids, by rank.  ranked: entry, rank, ids array;
    seen: id."""
    fresh = ranked.select("entry", "rank", F.explode("ids").alias("id")).join(seen.select("id").distinct(), "id", "left_anti")
    return fresh.groupBy("entry").agg(F.min("rank").alias("rank"), F.count("*").alias("unseen")).orderBy("rank", "entry").limit(most)


def collated(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in the order a reader expects (language-neutral collation), not by code point."""
    return df.orderBy(*(F.collate(F.col(c), "UNICODE") for c in columns))


def back_edges(steps: DataFrame) -> DataFrame:
    """Whether each offered neighbour lies on the current path (cycle), was met elsewhere
    (reuse), or is new.  steps: id, path array, visited array."""
    kind = F.when(F.array_contains("path", F.col("id")), "cycle").when(F.array_contains("visited", F.col("id")), "reuse").otherwise("new")
    return steps.withColumn("edge", kind)


def start_choice(entities: DataFrame, workflows: DataFrame) -> DataFrame:
    """One start: the best entity or the best workflow; the entity on a tie.  Both: name,
    score."""
    both = entities.select("name", "score", F.lit(0).alias("kind")).unionByName(workflows.select("name", "score", F.lit(1).alias("kind")))
    return both.orderBy(F.desc("score"), "kind", "name").limit(1).select("name", F.when(F.col("kind") == 0, "entity").otherwise("workflow").alias("kind"), "score")


def resume_candidates(boundaries: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """(boundary, id, relation): where a walk goes on after an external reference: the other
    targets of those who made it, a target once.  boundaries: boundary, caller; edges: src,
    dst, relation, priority."""
    rows = boundaries.distinct().join(edges, F.col("caller") == F.col("src")).where(F.col("dst") != F.col("boundary"))
    best = rows.groupBy("boundary", "dst").agg(F.max_by("relation", "priority").alias("relation"), F.max("priority").alias("priority"))
    w = Window.partitionBy("boundary").orderBy(F.desc("priority"), "dst")
    return best.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("boundary", F.col("dst").alias("id"), "relation")


def numbered_links(edges: DataFrame) -> DataFrame:
    """Edges with ids made anew from their ends, relation and place among their source's."""
    place = F.row_number().over(Window.partitionBy("src").orderBy("pos", "dst")) - 1
    made = edges.withColumn("place", place)
    return made.withColumn("id", F.concat(F.lit("relation:"), F.substring(F.sha1(F.concat_ws("|", "src", "relationship", "dst", F.col("place").cast("string"))), 1, 16)))


def closed_workflows(arcs: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(arc, title, entities, steps): closed workflows with what the graph links to them.
    arcs: arc, title, state; links: src, dst, relationship, pos; nodes: id, type, name."""
    told = links.join(nodes, F.col("dst") == F.col("id")).join(arcs.where("state = 'closed'").select(F.col("arc").alias("src")), "src", "left_semi")
    part = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("pos", "name")))), lambda x: x["name"])
    held = told.groupBy(F.col("src").alias("arc")).agg(part("entity").alias("entities"), part("step").alias("steps"))
    none = F.array().cast("array<string>")
    return arcs.where("state = 'closed'").select("arc", "title").join(held, "arc", "left").select("arc", "title", F.coalesce("entities", none).alias("entities"), F.coalesce("steps", none).alias("steps"))


def screen_links(units: DataFrame) -> DataFrame:
    """(id, url) of the addresses that markup units lead to."""
    return units.select("id", attribute(F.col("body"), "url").alias("url")).where("url <> ''")
