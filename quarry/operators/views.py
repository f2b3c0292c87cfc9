"""What arcs mean, as a view that is kept up to date from their changes alone.

An arc contributes rows: its workflow, its entities (one for all arcs that name it), their
fields, its steps, and the links between them, each with the kind of evidence it rests on.  The
view counts contributions by object and kind of evidence.  An edit is a set of arcs before and
after: contributions of the former are taken away, those of the latter added, and only objects
whose count changes are touched.  An object goes when its last contribution does.

Counts commute, so edits may be applied in any order and in batches; a view after any sequence
of edits equals one built anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import label_key

KEYS = ["kind", "id", "evidence", "name"]


def _named(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def contributions(arcs: DataFrame) -> DataFrame:
    """(kind, id, evidence, name, n): what arcs contribute.  Names that differ in case or
    spacing are one object; the name said most, then the least, is shown by ``shown``.
    arcs: arc, title, path (the call path it rests on), meaning, entities (array of struct of
    name, schema, fields: array<string>), steps (array<string>).  Null arcs, names, fields and
    steps contribute nothing."""
    own = arcs.where("arc IS NOT NULL")
    flow = F.concat(F.lit("workflow:"), F.col("arc").cast("string"))
    row = lambda kind, id_, evidence, name: F.struct(F.lit(kind).alias("kind"), id_.alias("id"), evidence.alias("evidence"), name.alias("name"))
    said = F.lit("llm_interpretation")
    head = own.select(F.explode(F.array(row("workflow", flow, F.lit("arc"), F.coalesce(_named(F.col("title")), F.col("arc").cast("string"))), F.when(_named(F.col("path")).isNotNull(), row("workflow", flow, F.lit("call_path"), _named(F.col("path")))), F.when(_named(F.col("meaning")).isNotNull(), row("workflow", flow, said, _named(F.col("meaning")))))).alias("c"))
    each = own.select("arc", flow.alias("flow"), F.explode("entities").alias("e")).select("arc", "flow", _named(F.col("e.name")).alias("name"), _named(F.col("e.schema")).alias("schema"), F.col("e.fields").alias("fields")).where("name IS NOT NULL")
    entity = F.concat(F.lit("entity:"), label_key(F.col("name")))
    evidence = F.when(F.col("schema").isNotNull(), "schema_definition").otherwise("llm_inference")
    link = lambda a, how, b: F.concat_ws("|", a, F.lit(how), b)
    entities = each.select(F.explode(F.array(row("entity", entity, evidence, F.col("name")), row("link", link(F.col("flow"), "uses entity", entity), F.lit("executable_code"), F.lit("uses entity")))).alias("c"))
    f = each.select("*", F.explode("fields").alias("field")).withColumn("field", _named(F.col("field"))).where("field IS NOT NULL")
    field = F.concat(F.lit("field:"), label_key(F.col("name")), F.lit("."), label_key(F.col("field")))
    fields = f.select(F.explode(F.array(row("field", field, evidence, F.col("field")), row("link", link(entity, "has field", field), evidence, F.lit("has field")))).alias("c"))
    s = own.select("arc", flow.alias("flow"), F.posexplode("steps").alias("ord", "step")).withColumn("step", _named(F.col("step"))).where("step IS NOT NULL")
    step = F.concat(F.lit("step:"), F.col("arc").cast("string"), F.lit(":"), F.col("ord").cast("string"))
    steps = s.select(F.explode(F.array(row("step", step, said, F.col("step")), row("link", link(F.col("flow"), "has step", step), said, F.lit("has step")))).alias("c"))
    rows = head.unionByName(entities).unionByName(fields).unionByName(steps).where("c IS NOT NULL").select("c.*")
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, id, evidence, name, n): what an edit adds to each count, nothing where it adds
    nothing.  before, after: the edited arcs; an arc that is only in one of them was added or
    removed, unedited ones may be left out."""
    gone = contributions(before).withColumn("n", -F.col("n"))
    return contributions(after).unionByName(gone).groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n <> 0")


def applied(view: DataFrame, change: DataFrame) -> DataFrame:
    """The view after an edit.  A count that would fall below zero raises an error: the edit
    takes away what was never there.  view, change: ``KEYS``, n."""
    n = F.sum("n")
    rows = view.select(*KEYS, "n").unionByName(change.select(*KEYS, "n")).groupBy(*KEYS).agg(n.alias("n")).where("n <> 0")
    return rows.withColumn("n", F.when(F.col("n") < 0, F.raise_error(F.lit("an edit takes away what isn't there"))).otherwise(F.col("n")))


def shown(view: DataFrame) -> DataFrame:
    """(kind, id, name, evidence, n): an object a row, with its kinds of evidence as
    ``kind:count``, in order.  A workflow is named by its title."""
    named = F.struct(F.when((F.col("kind") == "workflow") & (F.col("evidence") != "arc"), 1).otherwise(0).alias("aside"), (-F.col("n")).alias("n"), F.col("name").alias("name"))
    kinds = view.groupBy("kind", "id", "evidence").agg(F.sum("n").alias("n"), F.min(named).alias("best"))
    of = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "evidence", F.col("n").cast("string")))), ",")
    return kinds.groupBy("kind", "id").agg(F.min("best").alias("best"), of.alias("evidence"), F.sum("n").alias("n")).select("kind", "id", F.col("best.name").alias("name"), "evidence", "n")


def actions(view: DataFrame, change: DataFrame) -> DataFrame:
    """(kind, id, action) of the objects that an edit touches: insert, update or retract."""
    touched = change.select("kind", "id").distinct()
    old = view.groupBy("kind", "id").agg(F.sum("n").alias("old"))
    delta = change.groupBy("kind", "id").agg(F.sum("n").alias("delta"))
    rows = touched.join(old, ["kind", "id"], "left").join(delta, ["kind", "id"])
    now = F.coalesce("old", F.lit(0)) + F.col("delta")
    return rows.select("kind", "id", F.when(F.col("old").isNull(), "insert").when(now == 0, "retract").otherwise("update").alias("action"))
