"""Families of call paths that share most of their flow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.components import connected_components
from quarry.operators.settling import first_groups, overlap_relation

MERGEABLE = ["duplicate", "branch", "alternate_entrance"]


def overlap_pairs(paths: DataFrame) -> DataFrame:
    """Shapes of the pairs that can merge or share a subflow.  Both need two equal tokens
    at the beginning or at the end, so pairs come from those keys.  paths: id, tokens."""
    t = F.col("tokens")
    whole = F.concat_ws("\x1e", t)
    keys = F.array_compact(F.array(F.concat(F.lit("="), whole), F.when(F.size(t) >= 2, F.concat(F.lit("<"), F.concat_ws("\x1e", F.slice(t, 1, 2)))), F.when(F.size(t) >= 2, F.concat(F.lit(">"), F.concat_ws("\x1e", F.slice(t, -2, 2))))))
    keyed = paths.where(F.size("tokens") > 0).select("id", "tokens", F.explode(keys).alias("key"))
    left, right = (keyed.select(F.col("id").alias(x), F.col("tokens").alias(f"t{x}"), "key") for x in ("a", "b"))
    pairs = left.join(right, "key").where("a < b").select("a", "b", "ta", "tb").dropDuplicates(["a", "b"])
    relation, ratio, prefix, suffix = overlap_relation(F.col("ta"), F.col("tb"))
    return pairs.select("a", "b", relation.alias("relation"), ratio.alias("ratio"), prefix.alias("prefix_length"), suffix.alias("suffix_length"))


def _shape(a: list, b: list) -> str:
    shorter = min(len(a), len(b))
    if not shorter:
        return "independent"
    if a == b:
        return "duplicate"
    p = next((k for k in range(shorter) if a[k] != b[k]), shorter)
    room = shorter - p
    s = next((k for k in range(room) if a[-1 - k] != b[-1 - k]), room)
    if p >= 2 and p > shorter / 2:
        return "branch"
    if s >= 2 and s > shorter / 2:
        return "alternate_entrance" if len(a) - s <= 2 and len(b) - s <= 2 else "shared_subflow"
    return "independent"


def _loose_shape(a: list, b: list) -> str:
    """The looser test: long common ends, or nearly the same sequence."""
    if a == b:
        return "duplicate"
    short, long = sorted((a, b), key=len)
    n = len(short)
    if n < 3:
        return "independent"
    ends = [next((k for k in range(n) if x[k] != y[k]), n) for x, y in ((a, b), (a[::-1], b[::-1]))]
    if ends[1] >= 3 and ends[1] >= 0.8 * n and len(long) - ends[1] <= 2:
        return "alternate_entrance"
    if ends[0] >= 3 and ends[0] >= 0.75 * n:
        return "branch"
    if len(long) - n <= 2 and any(long[k : k + n] == short for k in range(len(long) - n + 1)):
        return "normalized_variant"
    runs = [0] * (len(b) + 1)
    best = 0
    for x in a:
        runs = [0] + [runs[k] + 1 if x == y else 0 for k, y in enumerate(b)]
        best = max(best, *runs)
    return "normalized_variant" if best >= 3 and best >= 0.8 * n and len(long) - best <= 2 else "independent"


#: What may merge, and the test of two sequences, by how strict a grouping is.
SHAPES = {"strict": (_shape, MERGEABLE), "loose": (_loose_shape, ["duplicate", "alternate_entrance", "branch", "normalized_variant"])}


def greedy_groups(rows: pd.DataFrame, how: str = "strict") -> pd.DataFrame:
    """Rows in rank order; each joins the first group with any member it merges with."""
    shape_of, mergeable = SHAPES[how]
    groups: list[list] = []
    of, relation = [], []
    for tokens in rows["tokens"]:
        tokens = list(tokens)
        for k, members in enumerate(groups):
            shape = next((s for m in members if (s := shape_of(m, tokens)) in mergeable), None)
            if shape:
                members.append(tokens)
                of.append(k), relation.append(shape)
                break
        else:
            groups.append([tokens])
            of.append(len(groups) - 1), relation.append("representative")
    return rows.assign(group=of, relation=relation)


def path_families(paths: DataFrame) -> DataFrame:
    """(id, family, relation): what the greedy order over all paths gives, found by channels.
    paths: id, tokens, rank."""
    return first_groups(paths)


def loose_families(paths: DataFrame) -> DataFrame:
    """(id, family, relation) by the looser test.  What it merges shares a run of three
    tokens that covers most of the shorter sequence, so blocks are the connected parts of
    sequences with a common run of three; the greedy order is kept inside them.
    paths: id, tokens, rank."""
    kind = dict(paths.dtypes)["id"]
    n = F.size("tokens")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 2)), lambda i: F.concat_ws("\x1e", F.slice("tokens", i, F.lit(3))))
    keys = F.concat(F.array(F.concat(F.lit("="), F.concat_ws("\x1e", "tokens"))), F.when(n >= 3, runs).otherwise(F.array().cast("array<string>")))
    keyed = paths.where(n > 0).select("id", F.explode(F.array_distinct(keys)).alias("key"))
    heads = keyed.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("m")).where("m > 1")
    blocks = connected_components(keyed.join(heads, "key").select(F.col("head").alias("a"), F.col("id").alias("b"))).select(F.col("node").alias("id"), "component")
    rows = paths.join(blocks, "id", "left").withColumn("block", F.coalesce("component", "id")).select("id", "tokens", "rank", "block")

    def group(block: pd.DataFrame) -> pd.DataFrame:
        block = greedy_groups(block.sort_values(["rank", "id"]).reset_index(drop=True), "loose")
        first = block.groupby("group")["id"].first()
        return pd.DataFrame({"id": block["id"], "family": block["group"].map(first), "relation": block["relation"]})

    return rows.groupBy("block").applyInPandas(group, f"id {kind}, family {kind}, relation string")


def merged_families(paths: DataFrame, families: DataFrame) -> DataFrame:
    """(family, variants, entrances, duplicates, prefix, branches, suffix): each family as its
    members stand to the representative.  Variants count the representative; the merged
    structure is null where no member branches off, its branches are distinct.
    paths: id, tokens, rank; families: as ``path_families`` gives."""
    own = paths.select("id", "tokens", "rank")
    heads = own.select(F.col("id").alias("family"), F.col("tokens").alias("head"))
    rows = families.select("id", "family").join(own, "id").join(heads, "family")
    relation, _, prefix, suffix = overlap_relation(F.col("head"), F.col("tokens"))
    shaped = rows.where("id <> family").select("family", "rank", "id", "head", "tokens", relation.alias("relation"), prefix.alias("p"), suffix.alias("s"))
    middle = lambda c: F.slice(c, F.col("p") + 1, F.greatest(F.lit(0), F.size(c) - F.col("p") - F.col("s")))
    cut = F.struct("rank", "id", F.slice("head", F.lit(1), F.col("p")).alias("prefix"), F.array(middle("head"), middle("tokens")).alias("middles"), F.slice("head", F.size("head") - F.col("s") + 1, F.col("s")).alias("suffix"))
    count = lambda r: F.count(F.when(F.col("relation") == r, 1))
    all_ = shaped.groupBy("family").agg(count("branch").alias("b"), count("alternate_entrance").alias("e"), count("duplicate").alias("d"), F.array_sort(F.collect_list(F.when(F.col("relation") == "branch", cut))).alias("cuts"))
    out = families.select("family").distinct().join(all_, "family", "left")
    some, none = F.size("cuts") > 0, F.lit(0)
    branches = F.array_distinct(F.filter(F.flatten(F.transform("cuts", lambda c: c.middles)), lambda m: F.size(m) > 0))
    first = F.get("cuts", F.lit(0))
    return out.select("family", (F.coalesce("b", none) + 1).alias("variants"), F.coalesce("e", none).alias("entrances"), F.coalesce("d", none).alias("duplicates"), F.when(some, first.prefix).alias("prefix"), F.when(some, branches).alias("branches"), F.when(some, first.suffix).alias("suffix"))
