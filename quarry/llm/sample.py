"""Labelled rows for fitting classifiers: all of them, or bounded, repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: So many labelled ids at most are broadcast.
BROADCAST = 2_000_000


def every_labelled(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, text, y) of all labelled documents.  Their ids are counted: few are broadcast, so
    that texts stay where they are."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(rows) if rows.count() <= BROADCAST else rows, "doc_id")


def labelled(docs: DataFrame, labels: DataFrame, target: str, most: dict[int, int], where: Column | None = None) -> DataFrame:
    """(doc_id, text, y) of labelled documents: of each class in ``most`` as many at most,
    those whose id hashes lowest.  The ids chosen are bounded, so they are broadcast."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where("doc_id IS NOT NULL")
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = None
    for y, n in most.items():
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
