"""Families of call paths: the first group that takes a path, found by propagation.

Paths come in rank order; each joins the first group with any member it merges with, or begins
one.  Unrolled, a path's group begins with the least path it reaches by steps to earlier paths
it merges with.  So every path takes the least label of its earlier partners, and then that
label's own label, until nothing changes: no task holds a block of paths, and as labels jump,
long chains take few rounds.

Nor are partners listed.  What merges shares a key, and inside a key it is known who merges with
whom, so a key is a channel: givers tell their labels, and takers need the least label of earlier
givers only, which is a running minimum.  These are the channels:

- equal paths give to each other;
- two paths branch if they share a beginning of over half of the shorter one, and of two tokens.
  The beginning of just over half of a path is its own; longer paths hold it as well.  Owners give
  to owners and holders, holders to owners;
- two paths are alternate entrances if all but two tokens of both are one common ending.  Paths
  are classed by how many tokens they have before an ending, 0, 1 or 2.  An ending may not reach
  into a common beginning, which leaves out: an ending itself with paths that begin with its first
  token, and ``a`` + ending with ``a`` + the ending's first token + ending.  The latter is one
  head among many, so these classes give and take by the bits of the head's hash: those whose
  bit differs, for any bit, are all but that head.

A running minimum goes bucket by bucket of positions: each bucket's least label is aggregated,
carried over buckets, and continued inside a bucket, so a task gets ``BUCKET`` rows of a channel
at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.arrays import common_prefix, common_suffix
from quarry.runtime import discard, materialise, positions

#: Rows of one channel in one task, and rounds after which labels are taken for endless.
BUCKET, MOST_ROUNDS = 1 << 16, 1000


def overlap_relation(a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    """(relation, ratio, prefix length, suffix length) of two token arrays."""
    shorter = F.least(F.size(a), F.size(b))
    prefix = common_prefix(a, b)
    suffix = common_suffix(a, b, prefix)
    same = a == b
    pr, sr = prefix / shorter, suffix / shorter
    heads = F.greatest(F.size(a), F.size(b)) - suffix
    relation = (
        F.when(shorter <= 0, "independent")
        .when(same, "duplicate")
        .when((prefix >= 2) & (pr > 0.5), "branch")
        .when((suffix >= 2) & (sr > 0.5) & (heads <= 2), "alternate_entrance")
        .when((suffix >= 2) & (sr > 0.5), "shared_subflow")
        .otherwise("independent")
    )
    ratio = F.when(shorter <= 0, 0.0).when(same, 1.0).when(relation == "branch", pr).when(relation.isin("alternate_entrance", "shared_subflow"), sr).otherwise(F.greatest(pr, sr))
    return relation, ratio, F.when(shorter <= 0, 0).otherwise(prefix), F.when((shorter <= 0) | same, 0).otherwise(suffix)


def channels(paths: DataFrame) -> DataFrame:
    """(channel, id, pos, gives, takes).  paths: id, pos, tokens."""
    t, n = F.col("tokens"), F.size("tokens")
    name = lambda kind, part: F.md5(F.concat_ws("\x1e", F.lit(kind), part))
    row = lambda channel, gives, takes: F.struct(channel.alias("channel"), F.lit(gives).alias("gives"), F.lit(takes).alias("takes"))
    none = F.array().cast("array<struct<channel:string,gives:boolean,takes:boolean>>")
    own = F.greatest(F.lit(2), F.floor(n / 2).cast("int") + 1)

    def beginning(i: Column) -> Column:
        part = F.slice(t, F.lit(1), i)
        return F.when(i == own, F.array(row(name("own", part), True, True), row(name("hold", part), False, True))).otherwise(F.array(row(name("own", part), False, True), row(name("hold", part), True, False)))

    begins = F.when(n >= 2, F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(own, n))), beginning))).otherwise(none)

    def ending(e: int) -> Column:
        part, first = F.slice(t, F.lit(e + 1), F.greatest(F.lit(0), n - e)), F.get(t, F.lit(e))
        free = F.get(t, F.lit(0)) != first
        if e == 0:
            return F.when(n >= 2, F.array(row(name("whole", part), True, False), row(name("longer", part), False, True))).otherwise(none)
        outer = F.when(free, F.array(row(name("whole", part), False, True), row(name("longer", part), True, False))).otherwise(none)
        if e == 1:
            mine = F.array(row(name("one", part), True, True), row(name("one-two", part), True, False), row(name("two-one", part), False, True))
        else:
            mine = F.when(n > 4, F.array(row(name("two", part), True, True))).otherwise(none)
            mine = F.concat(mine, F.when(F.get(t, F.lit(1)) != first, F.array(row(name("one-two", part), False, True), row(name("two-one", part), True, False))).otherwise(none))
        return F.when(n - e >= 2, F.concat(outer, mine)).otherwise(none)

    equal = F.array(row(name("equal", F.concat_ws("\x1e", t)), True, True))
    every = F.concat(equal, begins, ending(0), ending(1), ending(2))
    plain = paths.where(n > 0).select("id", "pos", F.explode(every).alias("c")).select("c.channel", "id", "pos", "c.gives", "c.takes")
    # One token before an ending against two of which the second repeats the ending's first.
    two = paths.where((n >= 4) & (F.get(t, F.lit(1)) == F.get(t, F.lit(2)))).select("id", "pos", F.slice(t, F.lit(3), n - 2).alias("ending"), F.get(t, F.lit(0)).alias("head"), F.lit(True).alias("long"))
    one = paths.where(n >= 3).select("id", "pos", F.slice(t, F.lit(2), n - 1).alias("ending"), F.get(t, F.lit(0)).alias("head"), F.lit(False).alias("long"))
    one = one.join(two.select("ending").distinct(), "ending", "left_semi")
    both = two.unionByName(one).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63))))
    value = F.expr("shiftrightunsigned(xxhash64(head), bit) & 1L")
    # A channel is named by the giver's side and bit; takers listen to the other bit.
    for gives in (True, False):
        side = F.col("long") if gives else ~F.col("long")
        heard = value if gives else 1 - value
        told = F.md5(F.concat_ws("\x1e", F.lit("head"), F.col("ending"), side.cast("string"), F.col("bit").cast("string"), heard.cast("string")))
        plain = plain.unionByName(both.select(told.alias("channel"), "id", "pos", F.lit(gives).alias("gives"), F.lit(not gives).alias("takes")))
    return plain


def _useful(rows: DataFrame) -> DataFrame:
    """Without channels in which nobody gives or nobody else takes."""
    some = rows.groupBy("channel").agg(F.count("*").alias("n"), F.max("gives").alias("g"), F.max("takes").alias("t")).where("n > 1 AND g AND t").select("channel")
    return rows.join(some, "channel", "left_semi")


def _heard(rows: DataFrame, what: Column, keys: list[str]) -> DataFrame:
    """rows with ``heard``: the least ``what`` of earlier givers with the same keys."""
    rows = rows.withColumn("told", F.when(F.col("gives"), what)).withColumn("bucket", F.floor(F.col("pos") / BUCKET))
    ends = rows.groupBy(*keys, "bucket").agg(F.min("told").alias("told"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "bucket", F.min("told").over(before).alias("carried")).where("carried IS NOT NULL")
    inside = Window.partitionBy(*keys, "bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("near", F.min("told").over(inside)).join(carried, [*keys, "bucket"], "left").withColumn("heard", F.least("near", "carried"))


def first_groups(paths: DataFrame) -> DataFrame:
    """(id, family, relation): each path's group, named by the path that began it, and how it
    stands to the first member it merges with (the beginner is its ``representative``).
    paths: id, tokens, rank; ties of rank go to the lesser id; paths without tokens are groups
    of their own; null tokens count as none."""
    own = materialise(positions(paths.select("id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), "rank"), ["rank", "id"]), "paths")
    rows = materialise(_useful(channels(own)), "channels")
    labels = materialise(own.select("id", "pos", F.col("pos").alias("label")), "labels")
    for _ in range(MOST_ROUNDS):
        told = rows.join(labels.select("id", "label"), "id")
        heard = _heard(told, F.col("label"), ["channel"]).where("takes AND heard IS NOT NULL").groupBy("id").agg(F.min("heard").alias("heard"))
        jump = labels.select(F.col("pos").alias("heard"), F.col("label").alias("beyond"))
        next_ = heard.join(jump, "heard").select("id", F.least("heard", "beyond").alias("heard"))
        after = labels.join(next_, "id", "left").select("id", "pos", F.least("label", F.coalesce("heard", "label")).alias("label"), (F.coalesce("heard", "label") < F.col("label")).alias("moved"))
        after = materialise(after, "labels")
        discard(labels)
        labels = after
        if labels.where("moved").isEmpty():
            break
    else:
        raise ValueError(f"labels move for over {MOST_ROUNDS} rounds")
    # The first earlier partner of the same group.
    told = rows.join(labels.select("id", "label"), "id")
    first = _heard(told, F.col("pos"), ["channel", "label"]).where("takes AND heard IS NOT NULL").groupBy("id").agg(F.min("heard").alias("first"))
    heads = own.select(F.col("pos").alias("label"), F.col("id").alias("family"))
    member = own.select(F.col("pos").alias("first"), F.col("tokens").alias("met"))
    out = own.join(labels.select("id", "label"), "id").join(heads, "label").join(first, "id", "left").join(member, "first", "left")
    relation = overlap_relation(F.col("met"), F.col("tokens"))[0]
    return out.select("id", "family", F.when(F.col("id") == F.col("family"), "representative").otherwise(relation).alias("relation"))
