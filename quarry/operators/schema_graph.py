"""Entity schemas as a graph: key maps, normalisation, projection, join paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import identity_key
from quarry.operators.evidence import first_by


def key_maps(relations: DataFrame, fields: DataFrame) -> DataFrame:
    """(rel, pos, field, related, implicit): the column pairs of each relationship.

    A declared pair stays.  A declared field without a partner takes the target's field of
    that name, else the target's only key, else the key at its position if there are as
    many.  A relationship that declares nothing joins on the keys that both sides name.
    relations: rel, from, to, maps array<struct<field, related>>; fields: entity, name,
    is_pk, ord."""
    fields = fields.withColumn("key", identity_key(F.col("name"), compatibility=False))
    pk = fields.where("is_pk").groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("pks"))
    rel = relations.join(pk.withColumnRenamed("entity", "to"), "to", "left").withColumn("pks", F.coalesce("pks", F.array().cast("array<string>")))
    given = F.filter(F.coalesce("maps", F.array().cast("array<struct<field:string,related:string>>")), lambda m: F.coalesce(m.field, F.lit("")) != "")
    rel = rel.withColumn("given", given)
    declared = rel.where(F.size("given") > 0).select("rel", "from", "to", "pks", F.size("given").alias("n"), F.posexplode("given").alias("pos", "m"))
    named = fields.select(F.col("entity").alias("to"), "key", F.col("name").alias("same")).groupBy("to", "key").agg(F.min("same").alias("same"))
    declared = declared.withColumn("key", identity_key(F.col("m.field"), compatibility=False)).join(named, ["to", "key"], "left")
    stated = F.when(F.coalesce(F.col("m.related"), F.lit("")) != "", F.col("m.related"))
    related = F.coalesce(stated, F.col("same"), F.when(F.size("pks") == 1, F.get("pks", F.lit(0))), F.when(F.size("pks") == F.col("n"), F.get("pks", F.col("pos"))))
    one = declared.select("rel", "pos", F.col("m.field").alias("field"), related.alias("related"), stated.isNull().alias("implicit")).where("related IS NOT NULL")
    silent = rel.where(F.size("given") == 0).select("rel", "from", F.posexplode("pks").alias("pos", "field")).withColumn("key", identity_key(F.col("field"), compatibility=False))
    own = fields.select(F.col("entity").alias("from"), "key").distinct()
    two = silent.join(own, ["from", "key"], "left_semi").select("rel", "pos", "field", F.col("field").alias("related"), F.lit(True).alias("implicit"))
    return one.unionByName(two)


def normalise(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean a learned graph; applying it again changes nothing.

    Concepts that an entity's name shadows are redirected to it; links to nothing, foreign
    fields and foreign keys to non-entities go; a foreign key whose columns either side
    lacks becomes a mere reference; repeated links and fields nobody owns go.
    nodes: id, type, name, owner, field, resolved, seq; links: src, dst, relationship,
    kind, maps array<struct<field, related>>, seq."""
    keyed = nodes.withColumn("key", identity_key(F.col("name"), compatibility=False))
    best = first_by(keyed.where("type = 'entity'"), ["key"], F.desc("resolved"), "seq").select("key", F.col("id").alias("to"))
    redirect = keyed.where("type = 'concept'").join(best, "key").select("id", "to")
    kept = keyed.join(redirect, "id", "left_anti")
    moved = links.join(redirect.withColumnRenamed("id", "dst"), "dst", "left").withColumn("dst", F.coalesce("to", "dst")).drop("to")
    side = lambda p: kept.select(F.col("id").alias(p), F.col("type").alias(f"{p}_type"), F.col("key").alias(f"{p}_key"), F.col("owner").alias(f"{p}_owner"), F.col("field").alias(f"{p}_field"))
    both = moved.join(side("src"), "src").join(side("dst"), "dst")
    foreign = (F.col("relationship") == "has field") & (F.col("src_type") == "entity") & (F.col("dst_type") == "field") & (F.coalesce("dst_owner", F.lit("")) != "") & (identity_key(F.col("dst_owner"), compatibility=False) != F.col("src_key"))
    both = both.where(~foreign & ~((F.coalesce("kind", F.lit("")) == "schema_fk") & (F.col("dst_type") != "entity")))
    owned = both.where("relationship = 'has field' AND src_type = 'entity' AND dst_type = 'field'").select(F.col("src").alias("entity"), identity_key(F.col("dst_field"), compatibility=False).alias("f")).distinct()
    pairs = both.where("kind = 'schema_fk'").select("src", "dst", "seq", F.explode_outer("maps").alias("m"))
    pairs = pairs.select("src", "dst", "seq", identity_key(F.col("m.field"), compatibility=False).alias("a"), identity_key(F.col("m.related"), compatibility=False).alias("b"))
    tested = pairs.join(owned.select(F.col("entity").alias("src"), F.col("f").alias("a"), F.lit(True).alias("oka")), ["src", "a"], "left").join(owned.select(F.col("entity").alias("dst"), F.col("f").alias("b"), F.lit(True).alias("okb")), ["dst", "b"], "left")
    valid = tested.groupBy("src", "dst", "seq").agg(F.min(F.coalesce("oka", F.lit(False)) & F.coalesce("okb", F.lit(False))).alias("valid"))
    both = both.join(valid, ["src", "dst", "seq"], "left").withColumn("kind", F.when((F.col("kind") == "schema_fk") & ~F.coalesce("valid", F.lit(False)), "schema_reference").otherwise(F.coalesce("kind", F.lit(""))))
    sign = F.to_json("maps")
    out = first_by(both.withColumn("rk", identity_key(F.col("relationship"), compatibility=False)).withColumn("mk", sign), ["src", "dst", "rk", "kind", "mk"], "seq")
    out = out.select("src", "dst", "relationship", "kind", "maps", (F.col("kind") != "schema_reference").alias("evidenced"), "seq")
    used = out.where("relationship = 'has field'").select(F.col("dst").alias("id")).distinct()
    good = kept.where("type <> 'field'").unionByName(kept.where("type = 'field'").join(used, "id", "left_semi")).drop("key")
    return good, out


def navigation(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Foreign-key edges by entity name, one row per column pair."""
    names = nodes.where("type = 'entity'").select("id", "name")
    fk = links.where("kind = 'schema_fk'").join(names.select(F.col("id").alias("src"), F.col("name").alias("from")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("to")), "dst")
    return fk.select("from", "relationship", "to", F.explode("maps").alias("m")).select("from", "relationship", "to", F.col("m.field").alias("field"), F.col("m.related").alias("related"))


def related_workflows(uses: DataFrame, most: int = 8) -> DataFrame:
    """Workflows that share entities: how many, and the first few.  uses: workflow, entity."""
    u = uses.distinct()
    pairs = u.select(F.col("workflow").alias("a"), "entity").join(u.select(F.col("workflow").alias("b"), "entity"), "entity").where("a <> b")
    w = Window.partitionBy("a", "b").orderBy("entity")
    ranked = pairs.withColumn("k", F.row_number().over(w))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    few = ranked.where(F.col("k") <= most).groupBy("a", "b").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    return counts.join(few, ["a", "b"])


def join_path(links: list[tuple[str, str]], start: str, goal: str) -> list[str]:
    """The shortest chain of entities over (few) evidenced links, in either direction;
    empty if there is none."""
    near: dict[str, set[str]] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    trail, edge = {start: None}, [start]
    while edge:
        ahead = []
        for node in edge:
            if node == goal:
                out = []
                while node is not None:
                    out.append(node)
                    node = trail[node]
                return out[::-1]
            for n in sorted(near.get(node, ())):
                if n not in trail:
                    trail[n] = node
                    ahead.append(n)
        edge = ahead
    return []
