"""Column profiles and key relationships found by value overlap."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import materialise

#: Types whose text form is the same in every engine.
KEY_TYPES = ("string", "int", "bigint", "smallint", "tinyint", "varchar", "char", "boolean")


def unpivot(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """(dataset, column, value) of the columns whose types compare as text."""
    columns = columns or [c for c, t in df.dtypes if t.split("(")[0] in KEY_TYPES]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))).alias("p")
    return df.select(pairs).select(F.lit(name).alias("dataset"), "p.column", "p.value")


def value_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, column, value, n): one row per distinct value, the base of both operators."""
    out = None
    for name in sorted(tables):
        part = unpivot(tables[name], name).groupBy("dataset", "column", "value").agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def column_profile(tables: dict[str, DataFrame], samples: int = 5) -> DataFrame:
    """Per column: rows with a value, share without, distinct values, how unique they are,
    and the first few in order.  Empty strings count as no value."""
    counts = materialise(value_counts(tables), "values")
    full = F.col("value").isNotNull() & (F.col("value") != "")
    stats = counts.groupBy("dataset", "column").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)).alias("non_null"),
        F.count(F.when(full, 1)).alias("distinct"),
    )

    def least(batches):
        held: dict[tuple[str, str], list[str]] = {}
        for batch in batches:
            for key, group in batch.to_pandas().groupby(["dataset", "column"])["value"]:
                held[key] = heapq.nsmallest(samples, [*held.get(key, ()), *group])
        rows = [(*key, v) for key, values in held.items() for v in values]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, names=["dataset", "column", "value"])

    # A task keeps a column's first few values, so nothing sorts them all.
    order = Window.partitionBy("dataset", "column").orderBy("value")
    first = counts.where(full).select("dataset", "column", "value").mapInArrow(least, "dataset string, column string, value string")
    first = first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= samples)
    first = first.groupBy("dataset", "column").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda s: s.value).alias("samples"))
    ratio = lambda a, b: F.round(a / F.greatest(F.lit(1), b), 4)
    return stats.join(first, ["dataset", "column"], "left").select(
        "dataset",
        "column",
        "non_null",
        F.round(1 - F.col("non_null") / F.greatest(F.lit(1), F.col("row_count")), 4).alias("null_rate"),
        "distinct",
        ratio(F.col("distinct"), F.col("non_null")).alias("uniqueness"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
    )


def value_overlap(tables: dict[str, DataFrame]) -> DataFrame:
    """For every two columns of different tables that share values: how many, and which
    share of either side's distinct values that is.

    Instead of comparing columns pairwise, each distinct value lists the columns that hold
    it (as many as there are columns at most) and votes for their pairs."""
    values = value_counts(tables).where("value IS NOT NULL AND value <> ''").select(F.struct("dataset", "column").alias("c"), "value")
    sizes = values.groupBy("c").agg(F.count("*").alias("n"))
    holders = values.groupBy("value").agg(F.array_sort(F.collect_list("c")).alias("cs")).where(F.size("cs") > 1)
    votes = holders.select(F.explode("cs").alias("l"), "cs").select("l", F.explode("cs").alias("r")).where("l.dataset < r.dataset").groupBy("l", "r").agg(F.count("*").alias("common"))
    left, right = sizes.select(F.col("c").alias("l"), F.col("n").alias("ln")), sizes.select(F.col("c").alias("r"), F.col("n").alias("rn"))
    return votes.join(left, "l").join(right, "r").select(
        F.concat_ws(".", "l.dataset", "l.column").alias("left"),
        F.concat_ws(".", "r.dataset", "r.column").alias("right"),
        (F.col("common") / F.col("ln")).alias("left_coverage"),
        (F.col("common") / F.col("rn")).alias("right_coverage"),
        F.col("common").alias("common_distinct_values"),
    )


def rank_relationships(overlap: DataFrame, least_common: int = 2, least_score: float = 0.55) -> DataFrame:
    """Candidates in rank order: the bound holds for the exact score, the order for the
    rounded one."""
    score = F.greatest("left_coverage", "right_coverage")
    return (
        overlap.where((F.col("common_distinct_values") >= least_common) & (score >= least_score))
        .select("left", "right", F.round("left_coverage", 4).alias("left_coverage"), F.round("right_coverage", 4).alias("right_coverage"), "common_distinct_values", F.round(score, 4).alias("score"))
        .orderBy(F.desc("score"), F.desc("common_distinct_values"), "left", "right")
    )


def typed_key_candidates(overlap: DataFrame, profile: DataFrame, least_coverage: float = 0.55) -> DataFrame:
    """Directed candidates: the referenced column must be unique, and most of the
    referencing column's values must occur there."""
    unique = profile.where("uniqueness = 1.0 AND `distinct` > 1").select(F.concat_ws(".", "dataset", "column").alias("to"))
    both = overlap.select(F.col("left").alias("from"), F.col("right").alias("to"), F.col("left_coverage").alias("coverage"), "common_distinct_values").unionByName(
        overlap.select(F.col("right").alias("from"), F.col("left").alias("to"), F.col("right_coverage").alias("coverage"), "common_distinct_values")
    )
    kept = both.where((F.col("coverage") >= least_coverage) & (F.col("common_distinct_values") >= 2))
    return kept.join(unique, "to", "left_semi").select("from", "to", F.round("coverage", 4).alias("coverage"), "common_distinct_values")
