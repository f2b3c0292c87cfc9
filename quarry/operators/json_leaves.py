"""Scalars of JSON texts by their dotted paths, on variants: no Python worker reads a text.

A level of all texts is one table; its leaves are written out and its objects are exploded into
the next level, until nothing nests.  So there are as many rounds as the deepest text has levels,
each over what is still nested, and texts meet in no task.

Lists of at most 12 scalars are joined by ``, ``, nulls in them as nothing; other lists and empty
objects give no rows.  A null is ``null``, but for a text that is nothing else, which gives no
row.  Null and broken texts, those over 1,000 levels, and objects that repeat a key (unless
``spark.sql.variant.allowDuplicateKeys`` is set: then the last counts) give no rows.  Whole numbers
have no point and decimals no zeros at their end; other numbers written with an exponent have
Spark's text.  Texts of one path, and repeated rows, give their rows each; an empty table gives none,
and columns beside ``path`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.runtime import discard, materialise, scratch_path

#: Fixed value: how many scalars of a list are joined.
LIST_MOST = 12
LEAVES = "path string, key string, value string"


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, or a scalar's type."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def _nests(v: Column) -> Column:
    return _kind(v).isin("OBJECT", "ARRAY")


def _text(v: Column) -> Column:
    """A scalar's text; null for a null."""
    number = F.try_variant_get(v, "$", "double")
    whole = (_kind(v) == "DOUBLE") & (number == F.rint(number)) & (F.abs(number) < 1e21)
    return F.when(whole, number.cast("decimal(38,0)").cast("string")).otherwise(F.try_variant_get(v, "$", "string"))


def _leaf(v: Column) -> Column:
    """The value of what is no object; null for lists that are left out."""
    items = F.try_variant_get(v, "$", "array<variant>")
    joined = F.when((F.size(items) <= LIST_MOST) & ~F.exists(items, _nests), F.array_join(F.transform(items, lambda x: F.coalesce(_text(x), F.lit(""))), ", "))
    return F.when(_kind(v) == "ARRAY", joined).otherwise(F.coalesce(_text(v), F.lit("null")))


def leaves(files: DataFrame) -> DataFrame:
    """(path, key, value) of every leaf of the texts.  files: path, text."""
    spark = files.sparkSession
    out = scratch_path(spark, "json-leaves")
    parsed = files.select(F.col("path").cast("string").alias("path"), F.try_parse_json(F.col("text").cast("string")).alias("v"))
    level = parsed.where(F.col("v").isNotNull() & ~F.is_variant_null("v")).select("path", F.lit("").alias("key"), "v")
    written = lambda rows: materialise(rows.withColumn("nested", _kind(F.col("v")) == "OBJECT"), "json-level")
    level, first = written(level), True
    while True:
        flat = level.where("NOT nested").select("path", "key", _leaf(F.col("v")).alias("value"))
        flat.where("value IS NOT NULL").write.mode("append").parquet(out)
        if level.where("nested").isEmpty():
            discard(level)
            return spark.read.schema(LEAVES).parquet(out)
        inner = spark.sql("SELECT l.path, l.key AS above, e.key AS own, e.value AS v FROM {level} l, LATERAL variant_explode(l.v) e", level=level.where("nested"))
        before, level = level, written(inner.select("path", (F.col("own") if first else F.concat("above", F.lit("."), "own")).alias("key"), "v"))
        discard(before)
        first = False
