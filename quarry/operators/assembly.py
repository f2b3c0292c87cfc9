"""Resolution of qualified names, merging of schemas and knowledge, nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import label_key
from quarry.operators.components import connected_components
from quarry.operators.evidence import first_by
from quarry.runtime import dealt, materialise


def resolve_services(refs: DataFrame, services: DataFrame) -> DataFrame:
    """(ref, symbol, score) of names like ns.File.verb#Noun: the local name and the file's
    stem must match; the namespace as the path's end is worth 100, its parts anywhere 25.
    refs: ref, name; services: id, name, path."""
    before = F.substring_index("name", "#", -1)
    head = F.expr("substring(name, 1, length(name) - length(substring_index(name, '#', -1)) - 1)")
    parts = F.filter(F.split(head, r"\."), lambda p: p != "")
    q = refs.where("contains(name, '#') AND contains(name, '.')").select("ref", before.alias("noun"), parts.alias("p")).where(F.size("p") >= 2)
    q = q.select("ref", F.lower(F.concat(F.element_at("p", -1), F.lit("#"), "noun")).alias("local"), F.lower(F.concat(F.element_at("p", -2), F.lit(".xml"))).alias("file"), F.transform(F.slice("p", 1, F.size("p") - 2), lambda x: F.lower(x)).alias("ns"))
    s = services.select("id", F.lower("name").alias("local"), F.lower("path").alias("path")).withColumn("file", F.substring_index("path", "/", -1))
    hit = q.join(s, ["local", "file"])
    suffix = F.array_join(F.concat("ns", F.array("file")), "/")
    inside = F.forall("ns", lambda n: F.contains(F.col("path"), F.concat(F.lit("/"), n, F.lit("/"))) | F.col("path").startswith(F.concat(n, F.lit("/"))))
    score = F.lit(10) + F.when(F.col("path").endswith(suffix), 100).when((F.size("ns") > 0) & inside, 25).otherwise(0)
    return hit.select("ref", F.col("id").alias("symbol"), score.alias("score"))


def resolve_screens(refs: DataFrame, screens: DataFrame) -> DataFrame:
    """(ref, screen): a file beside the source or under screen/, else a unique file of that
    name; addresses with placeholders or schemes aren't screens.
    refs: ref, source, url; screens: id, path."""
    clean = F.regexp_extract(F.trim("url"), r"^([^?#]*)", 1)
    usable = refs.withColumn("u", clean).where((F.col("u") != "") & ~F.col("u").rlike(r"\$\{|^https?:|^mailto:|^#"))
    target = F.regexp_replace(F.regexp_replace("u", r"\\", "/"), "^/+", "")
    target = F.when(target.endswith(".xml"), target).otherwise(F.concat(target, F.lit(".xml")))
    folder = F.when(F.contains("source", F.lit("/")), F.regexp_replace("source", "/[^/]*$", "")).otherwise("")
    usable = usable.select("ref", F.explode(F.array(F.struct(F.lit(0).alias("r"), _tidy(F.concat_ws("/", folder, target)).alias("p")), F.struct(F.lit(1).alias("r"), _tidy(F.concat(F.lit("screen/"), target)).alias("p")))).alias("c"), F.lower(F.substring_index(target, "/", -1)).alias("leaf"))
    exact = usable.join(screens.select("id", F.col("path").alias("p")), F.col("c.p") == F.col("p")).groupBy("ref").agg(F.min_by("id", "c.r").alias("screen"))
    names = screens.groupBy(F.lower(F.substring_index("path", "/", -1)).alias("leaf")).agg(F.count("*").alias("n"), F.min("id").alias("only")).where("n = 1")
    loose = usable.select("ref", "leaf").distinct().join(names, "leaf").join(exact, "ref", "left_anti")
    return exact.unionByName(loose.select("ref", F.col("only").alias("screen")))


def _tidy(path: Column) -> Column:
    """A path without ./ and a/../ (up to four deep)."""
    out = F.regexp_replace(F.regexp_replace(path, r"(^|/)\./", "$1"), "/+", "/")
    for _ in range(4):
        out = F.regexp_replace(out, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    return F.regexp_replace(out, "^/", "")


def merge_schemas(rows: DataFrame) -> DataFrame:
    """Fields of each entity: those of its base definition, then of extensions; the first of
    a name stays.  rows: entity, name, extension, seq and any attributes."""
    return first_by(rows, ["entity", "name"], F.col("extension").asc(), "seq")


def same_knowledge(items: DataFrame) -> DataFrame:
    """(item, canonical): items of a kind that share an id, a label or a technical name are
    one; the earliest stands for all.  items: item, kind, label, names array, ord."""
    keys = F.array_distinct(F.concat(F.array(F.concat(F.lit("label:"), label_key(F.col("label")))), F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.concat(F.lit("name:"), F.lower(F.trim(n))))))
    keyed = items.select("ord", "kind", F.explode(keys).alias("key")).where("key NOT IN ('label:', 'name:')")
    first = keyed.groupBy("kind", "key").agg(F.min("ord").alias("first"))
    edges = keyed.join(first, ["kind", "key"]).where("ord <> first").select(F.col("ord").alias("a"), F.col("first").alias("b"))
    roots = connected_components(edges).withColumnRenamed("node", "ord")
    named = items.join(roots, "ord", "left").withColumn("root", F.coalesce("component", "ord"))
    return named.select("item", "root").join(items.select(F.col("ord").alias("root"), F.col("item").alias("canonical")), "root").select("item", "canonical")


def merge_knowledge(items: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row per canonical item: the longest description, all names and evidence files in
    the order first seen, the latest commit."""
    rows = items.join(canonical, "item")
    lists = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce(c, F.array().cast("array<string>")).alias("v")))), lambda x: x.v)))
    return rows.groupBy(F.col("canonical").alias("item")).agg(F.min_by("label", "ord").alias("label"), F.max_by("description", F.struct(F.length("description").alias("n"), (-F.col("ord")).alias("o"))).alias("description"), lists("names").alias("names"), lists("files").alias("files"), F.max_by("commit", F.when(F.col("commit").isNotNull(), F.col("ord"))).alias("commit"))


def workflow_documents(uses: DataFrame, fields: DataFrame, steps: DataFrame) -> DataFrame:
    """A nested row per workflow: entities with their fields, and steps in order.
    uses: workflow, entity, ord; fields: entity, field, ord; steps: workflow, name, ord."""
    listed = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    f = fields.groupBy("entity").agg(F.transform(listed("ord", "field"), lambda x: x.field).alias("fields"))
    e = uses.join(f, "entity", "left").groupBy("workflow").agg(F.transform(listed("ord", "entity", "fields"), lambda x: F.struct(x.entity.alias("name"), F.coalesce(x.fields, F.array().cast("array<string>")).alias("fields"))).alias("entities"))
    s = steps.groupBy("workflow").agg(F.transform(listed("ord", "name"), lambda x: x["name"]).alias("steps"))
    return e.join(s, "workflow", "full_outer").select("workflow", F.coalesce("entities", F.array()).alias("entities"), F.coalesce("steps", F.array()).alias("steps"))


def members_of(relations: DataFrame, uses: DataFrame) -> DataFrame:
    """(workflow, relation) of relations tagged with a workflow, or whose both ends it uses.
    relations: relation, from, to, workflow; uses: workflow, entity."""
    u = uses.select("workflow", "entity").distinct()
    tagged = relations.where("workflow IS NOT NULL").select("workflow", "relation")
    ends = relations.select("relation", "from", "to").join(u.withColumnRenamed("entity", "from"), "from").join(u.select(F.col("workflow").alias("w"), F.col("entity").alias("to")), "to").where("workflow = w")
    return tagged.unionByName(ends.select("workflow", "relation")).distinct()


def relations_of(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations at either end of the entities: two equi-joins instead of a disjunction."""
    e = entities.select("entity").distinct()
    out = relations.join(e.withColumnRenamed("entity", "from"), "from").select("relation", F.col("from").alias("entity"))
    back = relations.join(e.withColumnRenamed("entity", "to"), "to").select("relation", F.col("to").alias("entity"))
    return out.unionByName(back).distinct()


def weigh(neighbourhood: DataFrame) -> DataFrame:
    """Edges of a neighbourhood without those back to its start; mere source order weighs
    0.2.  neighbourhood: start, src, dst, relation."""
    return neighbourhood.where("dst <> start").withColumn("weight", F.when(F.col("relation") == "next_in_source", 0.2).otherwise(1.0))


def insert_steps(steps: DataFrame) -> DataFrame:
    """Steps in order, where some are placed before or after others.
    steps: story, step, ord, anchor, place ('before' or 'after'; null: at ord)."""
    steps = materialise(steps, "steps")
    n = steps.count()
    base = steps.select("story", F.col("step").alias("anchor"), F.col("ord").alias("at"))
    # Only steps that name an anchor look for it.
    tied = dealt(steps.where("anchor IS NOT NULL"), n, "story", "anchor").join(dealt(base, n, "story", "anchor"), ["story", "anchor"], "left")
    put = tied.unionByName(steps.where("anchor IS NULL").withColumn("at", F.lit(None).cast(dict(base.dtypes)["at"])))
    key = F.when(F.col("at").isNull() | F.col("place").isNull(), F.col("ord").cast("double")).when(F.col("place") == "before", F.col("at") - 0.5).otherwise(F.col("at") + 0.5)
    w = Window.partitionBy("story").orderBy("key", "ord")
    return dealt(put.select("story", "step", "ord", key.alias("key")), n, "story").select("story", "step", F.row_number().over(w).alias("position"))
