"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import discard, materialise

SALTS = 64


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least v of its u.  The edges of a hub stay dealt over
    ``SALTS`` tasks: only a least value per node and salt meets in one."""
    salted = edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS)))
    low = salted.groupBy("u", "salt").agg(F.min("v").alias("low"))
    least = low.select("u", "salt", F.min("low").over(Window.partitionBy("u")).alias("m"))
    return salted.join(least, ["u", "salt"]).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in an edge; the component is its least node.

    Each round links every node's larger neighbours to its least neighbour, then its
    smaller ones; the number of rounds grows with the logarithm of a component's size.
    Rounds are written to the shared folder, so lineage stays short; a round's table goes
    once the next one is written.  Self-loops, repeated edges and null ends are dropped.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = materialise(e, "components")
    mark = _mark(e)
    while True:
        both = _with_least(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # A node's own least neighbour keeps the node linked; its others are linked to that.
        small = _with_least(large)
        after = materialise(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), "components")
        discard(e)
        now = _mark(after)
        if now == mark:
            roots = after.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return roots.unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        e, mark = after, now
