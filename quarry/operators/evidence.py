"""Evidence, confidence and merging of semantic objects.

Where the first or last of several rows counts, an explicit ``seq`` column decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: How strongly each kind of source supports a statement.
STRENGTH = {
    "schema_definition": 0.99,
    "schema_relationship": 0.97,
    "executable_code": 0.90,
    "call_path": 0.88,
    "test_evidence": 0.82,
    "code_shape": 0.78,
    "service_contract": 0.78,
    "sql_projection": 0.76,
    "documentation": 0.64,
    "conversation": 0.56,
    "llm_interpretation": 0.52,
    "llm_inference": 0.35,
}


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def dedupe_evidence(evidence: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row per key, the earliest.  A hash aggregate, so hot keys combine map-side."""
    rest = [c for c in evidence.columns if c not in keys]
    return evidence.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def noisy_or(evidence: DataFrame, keys: list[str], strength: str = "strength") -> DataFrame:
    """1 - product of (1 - strength), strengths limited to [0, 1]; infinity counts as 1."""
    s = F.col(strength).cast("double")
    unit = F.when(s.isNull() | F.isnan(s), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))
    return evidence.groupBy(*keys).agg((1 - F.product(1 - unit)).alias("confidence"))


def merge_objects(rows: DataFrame, keys: list[str], properties: list[str], aliases: str, seq: str = "seq") -> DataFrame:
    """Upsert: the latest value of each property that has one, and all aliases in the order
    first seen (each distinct alias enters the group once)."""
    latest = rows.groupBy(*keys).agg(*(F.max_by(F.col(p), F.when(F.col(p).isNotNull(), F.col(seq))).alias(p) for p in properties))
    names = rows.where(F.col(aliases).isNotNull()).groupBy(*keys, aliases).agg(F.min(seq).alias("_s"))
    listed = names.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", aliases))), lambda x: x[aliases]).alias("aliases"))
    return latest.join(listed, keys, "left")


def collapse_relations(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One relation per (from, relation, to); later properties win, even if key maps differ."""
    rest = [c for c in rows.columns if c not in ("from", "relation", "to")]
    latest = rows.groupBy("from", "relation", "to").agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return latest.select("from", "relation", "to", *(F.col(f"_r.{c}").alias(c) for c in rest))


def canonical_names(rows: DataFrame, key: str, name: str, seq: str = "seq") -> DataFrame:
    """Per identity key the display name: a cased form before an all-lower one, then the first."""
    return rows.groupBy(key).agg(F.min_by(F.col(name), F.struct((F.col(name) == F.lower(name)).alias("l"), F.col(seq).alias("s"))).alias("canonical"))


def entity_catalog(rows: DataFrame, key: str, description: str, seq: str = "seq") -> DataFrame:
    """The first description that isn't empty, per key; empty if there is none."""
    full = F.when(F.col(description) != "", F.col(seq))
    return rows.groupBy(key).agg(F.coalesce(F.min_by(F.col(description), full), F.lit("")).alias("description"))


def merge_representations(rows: DataFrame, keys: list[str], text: str, confidence: str, seq: str = "seq") -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(confidence).alias("confidence"), F.max_by(F.col(text), F.col(seq)).alias(text))


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which rows of ``first`` win over rows of ``second`` with the same keys."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))
