"""K-d tree partitioning into shards of near equal bytes, with built-in functions only.

The rows' metadata (not their texts) are written once, and the tree is built over one row
for each different text.  A node that is to become k leaves
is split along its widest dimension, at the weighted quantile floor(k/2)/k of its bytes
(the weighted median where k is even), until every node is one leaf of the target bytes.

Quantiles come from distributed histograms: one aggregate per pass for all nodes of a
level, of at most ``bins`` rows a node, narrows each node's interval to the bin that holds
the quantile, until that bin weighs less than ``tolerance`` of a shard.  Metadata belong to a
text: rows of one text take the least of them.  Rows with equal values are told apart by a hash
of their text, and a cut never runs through equal texts, so a group of copies is always in one
shard.  Where a cut misses its quantile by more than that tolerance, because the group there is
heavy, the ``swaps`` groups next to it on each side are dealt to the sides so that their sum comes
nearest; if that is not near enough, they keep their sides and the others are cut anew.  Groups
that outweigh an equal share get a shard of their own first, and the others share the rest.  The
driver sees bins, those neighbours, and one group a shard, never more rows.

Edge cases: null texts weigh nothing beside the fixed cost and are a group; null metadata
sort first; equal rows are a group; an empty table gives no rows; other columns of the input
are ignored, whatever they are called.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import discard, materialise

OVERHEAD = 16
GRID = 1 << 40
HEAVY = 10_000
BROADCAST_TEXTS = 1_000_000


def text_code(c: Column) -> Column:
    """A number that sorts as the first six UTF-8 bytes of a string; null: 0."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.encode(F.substring(c, 1, 6), "UTF-8")), 12, "0").substr(1, 12), 16, 10).cast("double"), F.lit(0.0))


def default_dimensions() -> dict[str, Column]:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("double")
    return {
        "language": text_code(F.col("lang").cast("string")),
        "length": F.log2(size + F.lit(OVERHEAD)),
        "density": F.coalesce(F.length("text").cast("double"), F.lit(0.0)) / F.greatest(size, F.lit(1.0)),
    }


@dataclass
class Node:
    id: int
    leaves: int
    weight: int = 0
    dimension: int = -1
    cut: tuple | None = None
    left: int = -1
    right: int = -1
    miss: float = 0.0  # bytes that the left side lacks
    zone: tuple = ()  # part, lo, hi and fixed of keys that hold the cut's neighbours
    dealt: dict = field(default_factory=dict)  # text: (size, whether it goes left)

    def need(self) -> float:
        """Bytes that should go left of the cut besides the texts that were dealt."""
        return self.weight * (self.leaves // 2) / self.leaves - sum(size for size, left in self.dealt.values() if left)


@dataclass
class Search:
    """Where a node's quantile lies: within [lo, hi] of the key's current part."""

    node: Node
    need: float  # bytes that should still go left of the interval's inside
    part: int = 0  # 0: dimension, 1: text hash
    lo: int = 0
    hi: int = 0
    fixed: int | None = None
    swaps: int = 0


WIDEST_HASH = 1 << 62


def _values(df: DataFrame, columns: str, rows: list[tuple]) -> DataFrame:
    """A small table of whole numbers, a row for each node at most."""
    text = ", ".join("(" + ", ".join("CAST(NULL AS BIGINT)" if v is None else f"{v}L" for v in r) + ")" for r in rows)
    return F.broadcast(df.sparkSession.sql(f"SELECT * FROM VALUES {text} AS t({columns})"))


def _dimension(dimensions: int) -> Column:
    """The value of a row's key in its node's dimension."""
    out = F.col("v0")
    for d in range(1, dimensions):
        out = F.when(F.col("dim") == d, F.col(f"v{d}")).otherwise(out)
    return out


def _less(v: Column) -> Column:
    """Whether a row stands before its node's cut."""
    return F.coalesce((v < F.col("c0")) | ((v == F.col("c0")) & (F.col("t") < F.col("c1"))), F.lit(False))


def _step(placed: DataFrame, nodes: list[Node], dimensions: int) -> DataFrame:
    """Move the rows of split nodes to their children; other rows stay."""
    cuts = _values(placed, "node, dim, c0, c1, to_left, to_right", [(n.id, n.dimension, *(*n.cut, None)[:2], n.left, n.right) for n in nodes])
    less = _less(_dimension(dimensions))
    out = placed.join(cuts, "node", "left")
    if dealt := [(n.id, t, int(left)) for n in nodes for t, (_, left) in n.dealt.items()]:
        out = out.join(_values(placed, "node, t, dealt", dealt), ["node", "t"], "left")
        less = F.coalesce(F.col("dealt") == 1, less)
    to = F.when(F.col("to_left").isNull(), F.col("node")).when(less, F.col("to_left")).otherwise(F.col("to_right"))
    return out.withColumn("next", to).drop("node", "dim", "c0", "c1", "to_left", "to_right", "dealt").withColumnRenamed("next", "node")


def _beside(rows: DataFrame, nodes: list[Node], dimensions: int, swaps: int) -> dict[int, list]:
    """The ``swaps`` texts next to each node's cut, on each side.  Only the keys around the cut
    are sorted, and each task keeps that many."""
    columns = "node, dim, c0, c1, part, lo, hi, f0"
    zones = _values(rows, columns, [(n.id, n.dimension, *(*n.cut, None)[:2], *n.zone) for n in nodes])
    v = _dimension(dimensions)
    inside = F.when(F.col("part") == 0, v.between(F.col("lo"), F.col("hi"))).otherwise((v == F.col("f0")) & F.col("t").between(F.col("lo"), F.col("hi")))
    near = rows.join(zones, "node").where(inside).select("node", "t", "size", v.alias("v"), _less(v).alias("less"))
    away = lambda c: F.when(F.col("less"), -F.col(c)).otherwise(F.col(c))
    rank = F.row_number().over(Window.partitionBy("node", "less").orderBy(away("v"), away("t")))
    out: dict[int, list] = {n.id: [] for n in nodes}
    for r in near.withColumn("k", rank).where(F.col("k") <= swaps).collect():
        out[r.node].append(r)
    return out


def nearest_sum(sizes: list[int], goal: float) -> list[bool]:
    """Which of the sizes make up the sum nearest to ``goal``: sums of two halves, met."""

    def sums(part: list[int]) -> list[tuple[int, int]]:
        out = [(0, 0)]
        for k, size in enumerate(part):
            out += [(s + size, m | 1 << k) for s, m in out]
        return out

    half = len(sizes) // 2
    right = sorted(sums(sizes[half:]))
    best = None
    for s, m in sums(sizes[:half]):
        at = bisect_left(right, (goal - s, 0))
        for t, o in right[max(0, at - 1) : at + 1]:
            if best is None or abs(s + t - goal) < best[0]:
                best = (abs(s + t - goal), m | o << half)
    return [bool(best[1] >> k & 1) for k in range(len(sizes))]


def _split(placed: DataFrame, level: list[Node], bounds: dict, dimensions: int, bins: int, least: float, swaps: int, rounds: int = 3) -> None:
    """Find the cut of every node, and the sides of the heavy texts around it."""
    left = level
    for _ in range(rounds):
        dealt = [(n.id, t) for n in left for t in n.dealt]
        rest = placed.join(_values(placed, "node, t", dealt), ["node", "t"], "left_anti") if dealt else placed
        searches = []
        for n in left:
            lo, hi = bounds[n.id][f"lo{n.dimension}"], bounds[n.id][f"hi{n.dimension}"]
            n.zone, n.miss = (0, lo, hi, None), 0.0
            searches.append(Search(n, n.need(), 0, lo, hi, None, swaps))
        while searches:
            searches = _pass(rest, searches, dimensions, bins, least)
        left = [n for n in left if abs(n.miss) > least] if swaps else []
        if not left:
            return
        near = _beside(rest, left, dimensions, swaps)
        for n in left:
            rows = sorted(near[n.id], key=lambda r: (r.v, r.t))
            goal = sum(r.size for r in rows if r.less) + n.miss
            sides = nearest_sum([r.size for r in rows], goal)
            n.dealt.update({r.t: (r.size, s) for r, s in zip(rows, sides)})
            n.miss = goal - sum(r.size for r, s in zip(rows, sides) if s)
        left = [n for n in left if abs(n.miss) > least and near[n.id]]
        if not left:
            return


def build(meta: DataFrame, dimensions: int, leaves: int, bins: int, tolerance: float, swaps: int = 0) -> tuple[dict[int, Node], DataFrame]:
    """The tree over rows (size, v0.., t), all long, and the rows with their leaf's node."""
    tree = {0: Node(0, leaves)}
    level = [tree[0]]
    placed = meta.withColumn("node", F.lit(0).cast("long"))
    total = meta.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tree[0].weight, target = total, total / leaves
    while level := [n for n in level if n.leaves > 1 and n.weight > 0]:
        spread = placed.where(F.col("node").isin([n.id for n in level])).groupBy("node")
        bounds = {r["node"]: r for r in spread.agg(*(f(f"v{d}").alias(f"{k}{d}") for d in range(dimensions) for k, f in (("lo", F.min), ("hi", F.max)))).collect()}
        for n in level:
            b = bounds[n.id]
            n.dimension = max(range(dimensions), key=lambda d: (b[f"hi{d}"] - b[f"lo{d}"], -d))
        _split(placed, level, bounds, dimensions, bins, target * tolerance, swaps)
        for n in level:
            n.left, n.right = len(tree), len(tree) + 1
            tree[n.left], tree[n.right] = Node(n.left, n.leaves // 2), Node(n.right, n.leaves - n.leaves // 2)
        # Written once a level: each pass then plans and reads one thin table.
        before, placed = placed, materialise(_step(placed, level, dimensions), "kd-level")
        if level[0].id:
            discard(before)
        weights = dict(placed.groupBy("node").agg(F.sum("size")).collect())
        level = [tree[i] for n in level for i in (n.left, n.right)]
        for n in level:
            n.weight = weights.get(n.id, 0)
    return tree, placed


def _pass(placed: DataFrame, searches: list[Search], dimensions: int, bins: int, least: float) -> list[Search]:
    """Narrow every search by one histogram; those that end set their node's cut."""
    wanted = _values(
        placed,
        "node, slot, dim, part, lo, hi, width, f0",
        [(s.node.id, k, s.node.dimension, s.part, s.lo, s.hi, max(1, -(-(s.hi - s.lo + 1) // bins)), s.fixed) for k, s in enumerate(searches)],
    )
    v = _dimension(dimensions)
    key = F.when(F.col("part") == 0, v).otherwise(F.col("t"))
    held = (F.col("part") == 0) | (v == F.col("f0"))
    inside = placed.join(wanted, "node").where(held).withColumn("key", key).where(F.col("key").between(F.col("lo"), F.col("hi")))
    rows = inside.groupBy("slot", F.expr("(key - lo) div width").alias("bin")).agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    left = []
    for k, s in enumerate(searches):
        own, before = sorted((r for r in rows if r.slot == k), key=lambda r: r.lo), 0
        at = 0
        if not own:  # every text of the node was dealt
            s.node.cut, s.node.miss = (s.lo,), s.need
            continue
        while at < len(own) - 1 and before + own[at].w <= s.need:
            before, at = before + own[at].w, at + 1
        r = own[at]
        # The narrowest interval that still holds enough texts on both sides of the cut.
        sides = [[j for j in js if sum(own[i].n for i in range(min(j, at), max(j, at) + 1) if i != at) >= s.swaps] for js in (range(at - 1, -1, -1), range(at + 1, len(own)))] if s.swaps else [[], []]
        if all(sides):
            s.node.zone = (s.part, own[sides[0][0]].lo, own[sides[1][0]].hi, s.fixed)
        # The cut may stand before this bin or after it; within it only if it is heavy and
        # holds several texts.
        if r.w <= least or r.n == 1 or (s.part == 1 and r.lo == r.hi):
            after = s.need - before > r.w / 2
            edge = r.hi + 1 if after else r.lo
            s.node.miss = s.need - before - (r.w if after else 0)
            s.node.cut = (edge,) if s.part == 0 else (s.fixed, edge)
        elif r.lo == r.hi:
            left.append(Search(s.node, s.need - before, 1, -WIDEST_HASH, WIDEST_HASH, r.lo, s.swaps))
        else:
            left.append(Search(s.node, s.need - before, s.part, r.lo, r.hi, s.fixed, s.swaps))
    return left


def _leaves(tree: dict[int, Node]) -> dict[int, int]:
    """The shard of each node without a cut, from left to right; one that had no bytes left
    to split stands for its first leaf."""
    out, stack = {}, [(0, 0)]
    while stack:
        i, first = stack.pop()
        if tree[i].cut is None:
            out[i] = first
        else:
            stack += [(tree[i].left, first), (tree[i].right, first + tree[tree[i].left].leaves)]
    return out


def _alone(texts: DataFrame, total: int, leaves: int) -> list[int]:
    """Texts that outweigh an equal share of what is left, heaviest first."""
    out: list[int] = []
    for r in texts.orderBy(F.desc("size"), "t").limit(leaves - 1).select("t", "size").collect():
        if r.size * (leaves - len(out)) <= total:
            break
        out.append(r.t)
        total -= r.size
    return out


def _rows_of(meta: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows with their text's shard.  Texts of over ``HEAVY`` rows, few by that bound, go to
    the rows; the others meet them in a shuffle."""
    heavy = placed.where(F.col("copies") > HEAVY)
    if not 0 < heavy.count() <= BROADCAST_TEXTS:
        return meta.join(placed, "t")
    rest = meta.join(F.broadcast(heavy.select("t")), "t", "left_anti").join(placed.where(F.col("copies") <= HEAVY), "t")
    return meta.join(F.broadcast(heavy), "t").unionByName(rest)


def kd_shards(docs: DataFrame, leaves: int = 40, dimensions: dict[str, Column] | None = None, bins: int = 512, tolerance: float = 0.0005, swaps: int = 10, rows_per_group: int = 2000) -> DataFrame:
    dims = list((dimensions or default_dimensions()).values())
    text = F.col("text").cast("string")
    meta = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.shiftright(F.xxhash64(text), 2).alias("t"),
        *(c.cast("double").alias(f"d{k}") for k, c in enumerate(dims)),
        F.monotonically_increasing_id().alias("row"),
    )
    meta = materialise(meta, "kd-metadata")
    texts = meta.groupBy("t").agg(F.sum("size").alias("size"), F.count("*").alias("copies"), *(F.min(f"d{k}").alias(f"d{k}") for k in range(len(dims))))
    texts = materialise(texts, "kd-texts")
    seen = texts.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), *(f(f"d{k}").alias(f"{m}{k}") for k in range(len(dims)) for m, f in (("lo", F.min), ("hi", F.max)))).first()
    # Every dimension is laid on a grid over its own range, so that widths compare.
    for k in range(len(dims)):
        lo, hi = seen[f"lo{k}"] or 0.0, seen[f"hi{k}"] or 0.0
        texts = texts.withColumn(f"v{k}", F.coalesce(F.floor((F.col(f"d{k}") - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit(float(GRID))), F.lit(-1)).cast("long")).drop(f"d{k}")
    alone = _alone(texts, seen.bytes, leaves)
    own = F.col("t").isin(alone) if alone else F.lit(False)
    tree, placed = build(texts.where(~own), len(dims), leaves - len(alone), bins, tolerance, swaps)
    shards = _values(meta, "node, shard", list(_leaves(tree).items()))
    groups = max(1, -(-seen.n // (leaves * rows_per_group)))
    placed = placed.join(shards, "node").select("t", "copies", F.col("shard").cast("int").alias("shard"))
    if alone:
        numbered = _values(meta, "t, shard", [(t, leaves - 1 - k) for k, t in enumerate(alone)])
        placed = placed.unionByName(texts.join(numbered, "t").select("t", "copies", F.col("shard").cast("int").alias("shard")))
    part = F.pmod(F.xxhash64("row"), F.lit(groups)).alias("part")
    placed = _rows_of(meta, placed).select("doc_id", "size", "text_crc32", "row", "shard", part)
    # Slots: numbers within bounded groups, plus what the shard's earlier groups hold.
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row")))
    return numbered.join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
