"""Views of symbols, files, flows, arcs and knowledge, as rows with bounded lists.

A list in a row is always one of the first so many of its key, cut by a window before it is
collected, so no row grows with the data.  Missing keys give a placeholder or an empty list,
null texts count as empty, and equal ranks go to the lesser id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import ascii_key, clamp01, clip, humanize, label_key, path_key
from quarry.operators.predicates import friendly_name


def _some(c: str | Column) -> Column:
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def listed(rows: DataFrame, keys: list[str], order: list, most: int, item: Column, out: str) -> DataFrame:
    """(keys, out): the first ``most`` items of each key, in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    few = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    pairs = F.array_sort(F.collect_list(F.struct(F.col("_k"), item.alias("_v"))))
    return few.groupBy(*keys).agg(F.transform(pairs, lambda x: x["_v"]).alias(out))


# Symbols and files ------------------------------------------------------------------------


def descriptor(relation: Column, hint: Column) -> list[Column]:
    """Columns that describe a candidate.  Of: id, path, name, kind, signature."""
    said = F.concat_ws("; ", _some(hint), F.col("signature"))
    return [F.col("id"), F.concat_ws("#", "path", "name").alias("path"), F.col("kind"), relation.alias("relation"), F.col("name").alias("label"), F.substring(said, 1, 260).alias("hint")]


def observations(wanted: DataFrame, symbols: DataFrame, neighbours: DataFrame, body: int = 2600, most: int = 18) -> DataFrame:
    """A row per wanted id: its symbol with a body of at most ``body`` signs and its nearest
    neighbours, or a placeholder of kind missing.  wanted: id; symbols: id, path, name, kind,
    signature, body; neighbours: src, dst, relation, priority."""
    near = listed(neighbours, ["src"], [F.desc("priority"), "dst"], most, F.struct("dst", "relation"), "neighbours").withColumnRenamed("src", "id")
    rows = wanted.select("id").distinct().join(symbols, "id", "left").join(near, "id", "left")
    found = F.col("kind").isNotNull()
    return rows.select(
        "id",
        F.coalesce("kind", F.lit("missing")).alias("kind"),
        F.when(found, F.concat_ws("#", "path", "name")).otherwise(F.col("id").cast("string")).alias("path"),
        F.when(found, F.concat_ws(" ", "kind", "name")).otherwise("Symbol no longer exists.").alias("summary"),
        F.substring(F.coalesce("body", F.lit("")), 1, body).alias("excerpt"),
        F.filter(F.coalesce("neighbours", F.array(F.struct(F.lit(None).cast(dict(neighbours.dtypes)["dst"]).alias("dst"), F.lit(None).cast("string").alias("relation")))), lambda n: n.dst.isNotNull()).alias("neighbours"),
    )


def orientation(symbols: DataFrame, most: int = 24) -> DataFrame:
    """One row: how many symbols and files there are, and the best entry points.
    symbols: id, path, priority."""
    best = symbols.orderBy(F.desc("priority"), "id").limit(most)
    ids = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "id"))), lambda x: x.id)
    return symbols.agg(F.count("*").alias("symbols"), F.countDistinct("path").alias("files")).join(F.broadcast(best.agg(ids.alias("entries"))))


def inventory(symbols: DataFrame, packets: DataFrame, most: int = 40) -> DataFrame:
    """The best entry points with their canonical packets.  symbols: id, priority; packets: id, ..."""
    return symbols.orderBy(F.desc("priority"), "id").limit(most).join(packets, "id", "left")


def with_coverage(packets: DataFrame, coverage: DataFrame) -> DataFrame:
    """Packets with the coverage of their source.  packets: source, ...; coverage: source,
    total, visited."""
    left = F.col("total") - F.col("visited")
    return packets.join(coverage.select("source", "total", "visited"), "source", "left").withColumn("uncovered", F.coalesce(left, F.lit(0)))


#: What a file is shown as, by its extension.
VIEWS = {"source_file_index": "py js jsx ts tsx java kt groovy".split(), "xml_file": ["xml", "jmx"], "config_file": "json yaml yml properties ini conf env".split(), "text_file": "md txt html css sql csv".split()}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def view_of(path: Column) -> Column:
    out = F.lit("opaque_file")
    for view, names in VIEWS.items():
        out = F.when(extension(path).isin(names), view).otherwise(out)
    return out


def file_views(files: DataFrame, symbols: DataFrame, values: DataFrame, text: int = 40_000, most: int = 200) -> DataFrame:
    """Each file by its kind: code as an index of its symbols, settings as their values,
    plain text as its beginning, others as nothing but their name.
    files: path, text; symbols: path, name, line; values: path, key, value, line."""
    index = listed(symbols, ["path"], ["line", "name"], 1 << 20, F.col("name"), "symbols")
    held = listed(values, ["path"], [F.asc_nulls_first("line"), "key"], most, F.concat_ws("=", "key", "value"), "settings")
    rows = files.select("path", "text", view_of(F.col("path")).alias("kind")).join(index, "path", "left").join(held, "path", "left")
    only = lambda kind, c: F.when(F.col("kind") == kind, c)
    none = F.array().cast("array<string>")
    return rows.select("path", "kind", only("source_file_index", F.coalesce("symbols", none)).alias("symbols"), only("config_file", F.coalesce("settings", none)).alias("settings"), only("text_file", F.substring(F.coalesce("text", F.lit("")), 1, text)).alias("excerpt"))


#: Relations of a function to what it calls.
CALLED = "calls routes_to reads writes configured_by on_success on_failure handles triggers next_in_source".split()


def function_details(symbols: DataFrame, edges: DataFrame, most: int = 18) -> DataFrame:
    """(id, body, called): symbols with the distinct targets they call, each under its best
    relation.  symbols: id, body; edges: src, dst, relation, priority."""
    best = edges.where(F.col("relation").isin(CALLED)).groupBy("src", "dst").agg(F.max("priority").alias("priority"))
    called = listed(best, ["src"], [F.desc("priority"), "dst"], most, F.col("dst"), "called").withColumnRenamed("src", "id")
    return symbols.select("id", "body").join(called, "id", "left")


def units_by_line(units: DataFrame, markup: bool = False) -> DataFrame:
    """Units of each file in the order of their lines; only markup's, or only others.
    units: path, id, name, line."""
    marked = F.col("name").startswith("$xml.")
    return units.where(marked if markup else ~marked).withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("line", "id")))


def artifact_kind(name: Column) -> tuple[Column, Column]:
    """(kind, key) of an artifact's id: dir:, file:, xmlnode: and external: say it, a # is a
    symbol's, a slash or a dot a path's, and anything else a symbol."""
    prefix = F.regexp_extract(name, r"^(dir|file|xmlnode|external):", 1)
    kind = F.when(prefix != "", prefix).when(F.contains(name, F.lit("#")), "symbol").when(name.rlike(r"[/.]"), "path").otherwise("symbol")
    return kind, F.regexp_replace(name, r"^(?:dir|file|xmlnode|external):", "")


def markup_overview(tree: DataFrame) -> DataFrame:
    """(path, ordinal, tag, depth, children): roots and what is directly in them.
    tree: path, ordinal, tag, parent, depth."""
    n = tree.where("parent IS NOT NULL").groupBy("path", F.col("parent").alias("ordinal")).agg(F.count("*").alias("children"))
    return tree.where("depth <= 1").select("path", "ordinal", "tag", "depth").join(n, ["path", "ordinal"], "left").withColumn("children", F.coalesce("children", F.lit(0)))


def markup_node(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, ordinal, child, tag): the direct children of wanted nodes.  wanted: path, ordinal."""
    return tree.select("path", F.col("parent").alias("ordinal"), F.col("ordinal").alias("child"), "tag").join(wanted, ["path", "ordinal"])


def shallow_tree(files: DataFrame, deepest: int = 3, most: int = 12) -> DataFrame:
    """(directory, depth, files): directories down to ``deepest``, with their first files.
    files: path."""
    parts = F.split("path", "/")
    rows = files.where(F.col("path") != "").select(parts.alias("p"))
    depth = F.size("p") - 1
    held = rows.where(depth < deepest).select(F.array_join(F.slice("p", 1, depth), "/").alias("directory"), F.element_at("p", -1).alias("name"))
    names = listed(held.distinct(), ["directory"], ["name"], most, F.col("name"), "files")
    above = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.least(depth, F.lit(deepest))), lambda k: F.array_join(F.slice(F.col("p"), F.lit(1), k), "/"))).alias("directory")).distinct()
    level = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))
    return above.join(names, "directory", "left").select("directory", level.alias("depth"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def chain_targets(files: DataFrame, deepest: int = 4) -> DataFrame:
    """(directory, target): where following single subdirectories leads, as long as no files
    lie beside them, ``deepest`` steps at most; directories that lead nowhere are left out.
    files: path."""
    parts = files.where(F.col("path") != "").select(F.split("path", "/").alias("p"))
    at = parts.select("p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("k"))
    child = F.when(F.col("k") < F.size("p") - 1, F.array_join(F.slice("p", F.lit(1), F.col("k") + 1), "/"))
    seen = at.select(F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("directory"), child.alias("child"))
    one = seen.groupBy("directory").agg(F.countDistinct("child").alias("n"), F.count(F.when(F.col("child").isNull(), 1)).alias("files"), F.min("child").alias("next"))
    step = one.where("n = 1 AND files = 0").select("directory", "next")
    now = step.select("directory", F.col("next").alias("target"))
    for _ in range(deepest - 1):
        on = step.select(F.col("directory").alias("target"), F.col("next").alias("further"))
        now = now.join(on, "target", "left").select("directory", F.coalesce("further", "target").alias("target"))
    return now


# Flows ------------------------------------------------------------------------------------


def clip_at(tokens: Column, token: Column) -> Column:
    """Tokens up to the first that equals a token; all if none does or the token is empty."""
    at = F.array_position(tokens, F.trim(token))
    return F.when((F.trim(F.coalesce(token, F.lit(""))) != "") & (at > 0), F.slice(tokens, F.lit(1), at.cast("int"))).otherwise(tokens)


def compact_paths(paths: DataFrame) -> DataFrame:
    """(id, functions, variants, terminal, prefix, branches, suffix, sequence): a family by
    its merged structure if it has one, otherwise by its sequence.
    paths: id, functions, branch_variants, entrances, duplicates, terminal, calls, prefix,
    branches, suffix, tokens."""
    merged = F.col("branches").isNotNull()
    variants = F.coalesce("branch_variants", F.lit(1)) + F.coalesce("entrances", F.lit(0)) + F.coalesce("duplicates", F.lit(0))
    end = F.when(F.col("terminal").startswith("external"), F.concat_ws(":", F.lit("external"), F.array_join("calls", ","))).when(F.col("terminal") == "cycle", "cycle").otherwise("end")
    return paths.select("id", "functions", variants.alias("variants"), end.alias("terminal"), *(F.when(merged, F.col(c)).alias(c) for c in ("prefix", "branches", "suffix")), F.when(~merged, F.col("tokens")).alias("sequence"))


def flow_observation(flows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(arc, branch, kind, tokens): whole flows (branch null) or one branch between its
    prefix and suffix; branches that don't exist are left out.
    flows: arc, prefix, branches, suffix; wanted: arc, branch."""
    rows = wanted.join(flows, "arc")
    one = F.get("branches", F.col("branch"))
    whole = F.concat("prefix", F.flatten("branches"), "suffix")
    rows = rows.select("arc", "branch", F.when(F.col("branch").isNull(), "call_graph_flow_summary").otherwise("call_graph_branch_summary").alias("kind"), F.when(F.col("branch").isNull(), whole).otherwise(F.concat("prefix", one, "suffix")).alias("tokens"))
    return rows.where("tokens IS NOT NULL")


def flow_packages(flows: DataFrame, named: DataFrame, fields: DataFrame, relations: DataFrame) -> DataFrame:
    """(arc, entity, fields, relations): the schemas of entities that a flow names, 80 fields
    and 30 relationships each.  flows: arc; named: arc, entity; fields: entity, pos, field;
    relations: entity, pos, to."""
    f = listed(fields, ["entity"], ["pos"], 80, F.col("field"), "fields")
    r = listed(relations, ["entity"], ["pos"], 30, F.col("to"), "relations")
    rows = named.join(flows.select("arc").distinct(), "arc", "left_semi").distinct()
    return rows.join(f, "entity").join(r, "entity", "left").select("arc", "entity", "fields", "relations")


def fingerprints(paths: DataFrame) -> DataFrame:
    """(id, fingerprint) of all columns of a path."""
    return paths.select("id", F.sha1(F.to_json(F.struct(*(c for c in paths.columns if c != "id")))).alias("fingerprint"))


def executable_edges(edges: DataFrame, nodes: DataFrame, relations: list[str]) -> DataFrame:
    """(src, dst, relation, place): resolved edges along which execution flows, in the order
    of relation and target.  edges: src, dst, relation; nodes: id."""
    kept = edges.where(F.col("relation").isin(relations)).join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    order = F.collate(F.concat_ws(":", "relation", F.col("dst").cast("string")), "UNICODE")
    return kept.select("src", "dst", "relation", F.row_number().over(Window.partitionBy("src").orderBy(order)).alias("place"))


def resolve_qualified(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, symbol): symbols with a reference's last part as their name; the part before it,
    if any, must be a folder of the symbol's path or begin its file's name.
    refs: ref, name; symbols: id, name, simple_name, path."""
    parts = F.filter(F.split("name", "[.:/]"), lambda p: p != "")
    wanted = refs.select("ref", parts.alias("p")).where(F.size("p") > 0).select("ref", F.lower(F.element_at("p", -1)).alias("leaf"), F.lower(F.when(F.size("p") > 1, F.element_at("p", -2))).alias("parent"))
    index = symbols.select("id", F.lower("path").alias("path"), F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("simple_name")))).alias("leaf"))
    at = F.contains(F.col("path"), F.concat(F.lit("/"), "parent", F.lit("/"))) | F.element_at(F.split("path", "/"), -1).startswith(F.col("parent"))
    return wanted.join(index, "leaf").where(F.col("parent").isNull() | at).select("ref", F.col("id").alias("symbol")).distinct()


def compact_neighbourhood(reached: DataFrame, symbols: DataFrame) -> DataFrame:
    """(start, id, depth, signature) of a neighbourhood.  reached: start, id, depth."""
    return reached.join(symbols.select("id", "signature"), "id", "left").select("start", "id", "depth", F.coalesce("signature", F.lit("")).alias("signature"))


def schema_relations(relations: DataFrame, schemas: DataFrame) -> DataFrame:
    """(from, relation, to, description) of relationships whose both ends are known schemas.
    relations: from, to, title, alias, type, pairs array<struct<field, related>>; schemas: name."""
    known = schemas.select(ascii_key(F.col("name")).alias("k"), F.col("name")).dropDuplicates(["k"])
    side = lambda c: known.select(F.col("k").alias(f"{c}_k"), F.col("name").alias(f"{c}_name"))
    rows = relations.withColumn("from_k", ascii_key(F.col("from"))).withColumn("to_k", ascii_key(F.col("to"))).join(side("from"), "from_k").join(side("to"), "to_k")
    pairs = F.filter(F.coalesce("pairs", F.array().cast("array<struct<field:string,related:string>>")), lambda m: (m.field != "") & (m.related != ""))
    rows = rows.withColumn("join", F.array_join(F.transform(pairs, lambda m: F.concat(F.col("from_name"), F.lit("."), m.field, F.lit(" = "), F.col("to_name"), F.lit("."), m.related)), " + "))
    label = F.substring(F.coalesce(_some("title"), _some("alias"), _some("type"), F.lit("references")), 1, 120)
    said = F.when(F.col("join") != "", F.concat(F.lit("Join: "), "join")).otherwise("The join fields are not declared.")
    return rows.select(F.col("from_name").alias("from"), label.alias("relation"), F.col("to_name").alias("to"), said.alias("description"))


# Arcs and knowledge -----------------------------------------------------------------------


def arc_board(arcs: DataFrame) -> DataFrame:
    """arcs: id, title, status, progress, trigger, stages, outcome, opportunity."""
    return arcs.select("id", "title", "status", "progress", F.coalesce("trigger", F.lit("")).alias("trigger"), F.slice("stages", F.greatest(F.lit(1), F.size("stages") - 7), 8).alias("stages"), F.coalesce("outcome", F.lit("")).alias("outcome"), F.format_string("%.2f", F.coalesce("opportunity", F.lit(0.0))).alias("opportunity"))


def hypothesis_board(rows: DataFrame) -> DataFrame:
    """Open hypotheses.  rows: id, title, actor, intent, confidence, reason, status."""
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("actor", "intent", "reason")]
    return rows.where("status = 'hypothesis'").select("id", "title", *text, F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def arc_summaries(arcs: DataFrame, entities: DataFrame, fields: DataFrame, relations: DataFrame) -> DataFrame:
    """arcs with their first 16 entities, 30 field names and 8 relation hints.
    arcs: id, title, intent; entities: id, ord, entity; fields: id, ord, field; relations:
    id, ord, from, relation, to."""
    once = lambda df, c: df.where(_some(c).isNotNull()).groupBy("id", c).agg(F.min("ord").alias("ord"))
    e = listed(once(entities, "entity"), ["id"], ["ord", "entity"], 16, F.col("entity"), "entities")
    f = listed(once(fields, "field"), ["id"], ["ord", "field"], 30, F.col("field"), "field_names")
    r = listed(relations, ["id"], ["ord"], 8, clip(F.concat_ws(" → ", "from", "relation", "to"), 180), "hints")
    none = F.array().cast("array<string>")
    rows = arcs.join(e, "id", "left").join(f, "id", "left").join(r, "id", "left")
    return rows.select("id", clip(F.col("title"), 160).alias("title"), clip(F.col("intent"), 220).alias("intent"), *(F.coalesce(c, none).alias(c) for c in ("entities", "field_names", "hints")))


def story_projection(arcs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(arc, status, step, artifact, meaning): arcs as stories, a row per piece of evidence.
    arcs: arc, status, progress; evidence: arc, ord, artifact, meaning."""
    status = F.when(F.col("status") == "broadly_complete", "broadly_complete").when(F.col("progress") >= 30, "building").otherwise("early")
    place = F.row_number().over(Window.partitionBy("arc").orderBy("ord"))
    rows = evidence.withColumn("n", place)
    return arcs.select("arc", status.alias("status")).join(rows, "arc", "left").select("arc", "status", F.when(F.col("n").isNotNull(), F.concat_ws("-e", F.col("arc").cast("string"), F.col("n").cast("string"))).alias("step"), "artifact", "meaning")


def entity_contexts(names: DataFrame, uses: DataFrame, steps: DataFrame, relations: DataFrame, most: int = 3) -> DataFrame:
    """(name, arc, steps, relations): the first ``most`` arcs that use an entity, each with
    its first steps and relations that touch it.
    names: name; uses: arc, name; steps: arc, ord, name, step; relations: arc, ord, from, to."""
    key = lambda c: label_key(F.col(c)).alias("key")
    wanted = names.select("name", key("name")).dropDuplicates(["key"])
    used = uses.select("arc", key("name")).distinct()
    w = Window.partitionBy("key").orderBy("arc")
    first = used.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).join(wanted, "key").drop("k")
    s = listed(steps.select("arc", "ord", "step", key("name")), ["arc", "key"], ["ord"], most, F.col("step"), "steps")
    ends = relations.select("arc", "ord", "from", "to", F.explode(F.array_distinct(F.array(label_key(F.col("from")), label_key(F.col("to"))))).alias("key"))
    r = listed(ends, ["arc", "key"], ["ord"], most, F.concat_ws(" → ", "from", "to"), "relations")
    none = F.array().cast("array<string>")
    rows = first.join(s, ["arc", "key"], "left").join(r, ["arc", "key"], "left")
    return rows.select("name", "arc", F.coalesce("steps", none).alias("steps"), F.coalesce("relations", none).alias("relations"))


def knowledge_items(workflows: DataFrame, rules: DataFrame, nodes: DataFrame, data: DataFrame) -> DataFrame:
    """(type, id, label, commit, validated, files) of everything known, with where it came
    from.  All: id, label, commit, validated, files; nodes also: kind."""
    def part(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), "id", "label", "commit", F.coalesce("validated", "commit").alias("validated"), F.array_distinct(F.coalesce("files", F.array().cast("array<string>"))).alias("files"))

    return part(workflows, "workflow").unionByName(part(rules, "rule")).unionByName(part(nodes.where("kind = 'business_concept'"), "concept")).unionByName(part(data, "persistent_data"))


def one_hop(wanted: DataFrame, edges: DataFrame, nodes: DataFrame, most: int = 30) -> DataFrame:
    """(id, node, kind): the nodes beside each wanted one, in either direction.
    wanted: id; edges: src, dst; nodes: node, kind."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("node"))
    both = out.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("node"))).distinct()
    rows = both.join(wanted.select("id").distinct(), "id", "left_semi").join(nodes, "node")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("node"))).where(F.col("k") <= most).select("id", "node", "kind")


def findings_for(findings: DataFrame, path: Column | None = None, query: Column | None = None) -> DataFrame:
    """Findings of a path, or whose query or text has a phrase.  findings: path, query, finding."""
    if path is not None:
        return findings.where(path_key(F.coalesce("path", F.lit(""))) == path_key(path))
    has = lambda c: F.contains(ascii_key(F.coalesce(c, F.lit(""))), ascii_key(query))
    return findings.where(has("query") | has("finding"))


def remaining_gaps(checklist: DataFrame) -> DataFrame:
    """(story, gap): what a checklist still lacks.  checklist: story, key, status, summary."""
    left = checklist.where(~F.coalesce(F.col("status").isin("supported", "not_applicable"), F.lit(False)))
    return left.select("story", F.concat_ws(": ", humanize(F.col("key")), F.coalesce(_some("summary"), F.col("status"))).alias("gap"))


def learning_progress(arcs: DataFrame, reviewed: DataFrame) -> DataFrame:
    """One row: arcs not closed, and paths reviewed.  arcs: closed; reviewed: path."""
    return arcs.agg(F.count(F.when(~F.coalesce("closed", F.lit(False)), 1)).alias("incomplete")).join(F.broadcast(reviewed.agg(F.countDistinct("path").alias("reviewed"))))


def seed_projection(seeds: DataFrame, arcs: DataFrame, paths: DataFrame) -> DataFrame:
    """Seeded arcs with where they begin.  seeds: arc; arcs: arc, title, opportunity, path;
    paths: path, entry, sources."""
    rows = seeds.select("arc").distinct().join(arcs, "arc").join(paths, "path", "left")
    return rows.select("arc", "title", F.coalesce("opportunity", F.lit(0.0)).alias("confidence"), "path", F.coalesce("entry", F.lit("")).alias("entry"), F.coalesce(F.get("sources", F.lit(0)), F.lit("")).alias("source"))


def accumulated(rows: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """Each key's lists, united over its rows and sorted."""
    return rows.groupBy(key).agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in lists))


def session_context(sessions: DataFrame) -> DataFrame:
    """(session, context): all other columns as JSON."""
    return sessions.select("session", F.to_json(F.struct(*(c for c in sessions.columns if c != "session"))).alias("context"))


# Judgments --------------------------------------------------------------------------------

#: The shape of a judgment on candidates.
JUDGMENT = "role string, path string, meaning string, scores array<struct<id:string, continuity:double, coherence:double, expectedGain:double>>, next struct<type:string, id:string>"


def normalised(replies: DataFrame) -> DataFrame:
    """Replies as typed rows: unknown roles and steps become the fallback, scores are clamped,
    texts trimmed and cut; null where a reply isn't JSON.  replies: step, reply."""
    j = F.from_json("reply", JUDGMENT)
    rows = replies.withColumn("j", j).withColumn("ok", j.isNotNull() & F.col("reply").rlike(r"^\s*\{"))
    role = F.when(F.col("j.role").isin("orientation", "story", "unattached"), F.col("j.role")).otherwise("unattached")
    scores = F.transform(F.coalesce("j.scores", F.expr(f"from_json('[]', '{JUDGMENT.split('scores ')[1].split(', next')[0]}')")), lambda s: F.struct(s.id.alias("id"), clamp01(s.continuity).alias("continuity"), clamp01(s.coherence).alias("coherence"), clamp01(s.expectedGain).alias("expected_gain")))
    kind = F.when(F.col("j.next.type").isin("artifact", "search", "stop"), F.col("j.next.type")).otherwise("stop")
    return rows.select("step", "ok", role.alias("role"), _some("j.path").alias("path"), F.substring(F.trim(F.coalesce("j.meaning", F.lit(""))), 1, 500).alias("meaning"), scores.alias("scores"), kind.alias("next_type"), _some("j.next.id").alias("next_id"))


def faults(judgments: DataFrame, offered: DataFrame) -> DataFrame:
    """(step, faults): what is wrong with each judgment, nothing if it stands: not JSON, a
    story without a path, scores of what wasn't offered or none for what was, and a next
    artifact that wasn't offered.  judgments: as normalised gives; offered: step, id."""
    ids = offered.groupBy("step").agg(F.collect_set("id").alias("offered"))  # candidates of one step
    rows = judgments.join(ids, "step", "left").withColumn("offered", F.coalesce("offered", F.array().cast("array<string>")))
    scored = F.transform("scores", lambda s: s.id)
    checks = [
        (~F.col("ok"), "not_json"),
        ((F.col("role") == "story") & F.col("path").isNull(), "story_without_path"),
        (F.size(F.array_except(scored, "offered")) > 0, "unknown_candidate"),
        (F.size(F.array_except("offered", scored)) > 0, "unscored_candidate"),
        ((F.col("next_type") == "artifact") & ~F.coalesce(F.array_contains("offered", F.col("next_id")), F.lit(False)), "unknown_next"),
    ]
    return rows.select("step", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in checks))).alias("faults"))


# Queries over a map -----------------------------------------------------------------------


def workflow_catalogue(arcs: DataFrame) -> DataFrame:
    """(id, name, description, state) of arcs that aren't hidden.
    arcs: id, title, intent, outcome, state, hidden."""
    said = F.coalesce(_some("intent"), _some("outcome"), F.lit(""))
    return arcs.where(~F.coalesce("hidden", F.lit(False))).select("id", clip(F.coalesce("title", F.lit("")), 110, ellipsis=False).alias("name"), clip(said, 150, ellipsis=False).alias("description"), "state")


def schema_navigation(schemas: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) by which schemas are walked: those with names that read like
    business things.  schemas: name, description; relations: from, relation, to."""
    plain = F.col("name").rlike(r"^[A-Za-z][A-Za-z0-9 _-]*$") & (F.length("name") <= 70) & ~F.col("name").rlike(r"(?i)\bcreated\b")
    entities = schemas.where(friendly_name(F.col("name")) & plain).select("name", F.coalesce("description", F.lit("")).alias("description")).dropDuplicates(["name"])
    ends = lambda c: entities.select(F.col("name").alias(c))
    return entities, relations.join(ends("from"), "from", "left_semi").join(ends("to"), "to", "left_semi").select("from", "relation", "to").distinct()


def fallback_answer(selected: DataFrame, most: int = 5) -> DataFrame:
    """(session, intent, answer) when no view was made: the entities found so far, or that
    there were none.  selected: session, ord, entity (null: none selected)."""
    good = selected.where(friendly_name(F.col("entity")))
    names = listed(good, ["session"], ["ord", "entity"], most, F.trim("entity"), "names")
    rows = selected.select("session").distinct().join(names, "session", "left")
    said = F.when(F.size("names") > 0, F.concat(F.lit("The walk found "), F.array_join("names", ", "), F.lit(", but no view with their fields was completed."))).otherwise("The walk found too few fields for a reliable view.")
    return rows.select("session", F.lit("data_analytics").alias("intent"), F.coalesce(said, F.lit("The walk found too few fields for a reliable view.")).alias("answer"))


def entity_nodes(wanted: DataFrame, fields: DataFrame, relations: DataFrame, uses: DataFrame, most: int = 18) -> DataFrame:
    """(name, fields, connected, workflows) of entities that a walk opens: their best fields,
    the entities beside them and the workflows that use them, ``most`` of each.
    wanted: name; fields: entity, field, score; relations: from, to; uses: arc, entity."""
    key = lambda c: label_key(F.col(c)).alias("key")
    w = wanted.select("name", key("name")).dropDuplicates(["key"])
    best = fields.groupBy(key("entity"), "field").agg(F.max("score").alias("score"))
    f = listed(best, ["key"], [F.desc("score"), "field"], most, F.col("field"), "fields")
    both = relations.select(key("from"), F.trim("to").alias("other")).unionByName(relations.select(key("to"), F.trim("from").alias("other")))
    c = listed(both.where(label_key(F.col("other")) != F.col("key")).distinct(), ["key"], ["other"], most, F.col("other"), "connected")
    u = listed(uses.select("arc", key("entity")).distinct(), ["key"], ["arc"], most, F.col("arc").cast("string"), "workflows")
    none = F.array().cast("array<string>")
    rows = w.join(f, "key", "left").join(c, "key", "left").join(u, "key", "left")
    return rows.select("name", *(F.coalesce(x, none).alias(x) for x in ("fields", "connected", "workflows")))


def workflow_nodes(wanted: DataFrame, steps: DataFrame, uses: DataFrame, most: int = 8) -> DataFrame:
    """(arc, steps, entities, related) of workflows that a walk opens: all steps in order, the
    entities, and ``most`` other workflows that share one.  An entity that everyone uses pairs
    with the wanted workflows only.  wanted: arc; steps: arc, ord, step; uses: arc, entity."""
    key = lambda c: label_key(F.col(c)).alias("key")
    w = wanted.select("arc").distinct()
    used = uses.select("arc", F.trim("entity").alias("entity"), key("entity")).dropDuplicates(["arc", "key"])
    own = used.join(w, "arc", "left_semi")
    s = listed(steps.join(w, "arc", "left_semi"), ["arc"], ["ord", "step"], 1 << 20, F.col("step"), "steps")
    e = listed(own, ["arc"], ["entity"], 1 << 20, F.col("entity"), "entities")
    shared = own.select("arc", "key").join(used.select(F.col("arc").alias("other"), "key"), "key").where("arc <> other").groupBy("arc", "other").agg(F.count("*").alias("n"))
    r = listed(shared, ["arc"], [F.desc("n"), "other"], most, F.col("other").cast("string"), "related")
    none = F.array().cast("array<string>")
    rows = w.join(s, "arc", "left").join(e, "arc", "left").join(r, "arc", "left")
    return rows.select("arc", *(F.coalesce(x, none).alias(x) for x in ("steps", "entities", "related")))


def retained(picks: DataFrame, shown: DataFrame) -> DataFrame:
    """Links that were picked and are on the screen, as they are shown there; a pick may name
    a link's ends the other way round.  picks: from, to; shown: from, relation, to."""
    ends = picks.select(label_key(F.col("from")).alias("a"), label_key(F.col("to")).alias("b"))
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = shown.withColumn("a", label_key(F.col("from"))).withColumn("b", label_key(F.col("to")))
    return seen.join(both, ["a", "b"], "left_semi").drop("a", "b").distinct()
