"""Maximal paths counted, ranked and drawn without being listed.

Nodes are eliminated in rounds: a node with few edges goes, and each way through it becomes an
edge from its predecessor to its successor that carries how many paths it stands for; parallel
edges add up.  A round takes every such node none of whose neighbours goes in the same round, so
chains, trees and diamonds vanish in a number of rounds that grows with the logarithm of their
length.  A node whose elimination would add edges stays, so the graph never grows; what is left
of it, the core, is walked level by level.  Then nodes come back in reverse, each from the edges
it had when it went.

The same rounds find strongly connected parts: a node belongs to the part that one of its
predecessors and one of its successors share, and elimination keeps who reaches whom.  Parts
shrink to one node each; what is left has no cycles, so its paths from roots to leaves can be
counted: as many pass through a node as there are above it times those below it.  The suffixes
that paths share are nodes of that graph once, whatever lies above them.

Paths can be asked for by number: a path's number, in the order of names, says which successor
to take at each node, as the counts below them are known.

Counts are exact decimals of 38 digits; larger ones raise an error.  A part with a cycle counts
as one node here (paths through it are paths of parts): where paths inside parts matter, list
them with ``graph.maximal_paths``.

Edge cases: repeated edges, self-loops and edges with a null or unknown end count once, not at
all and not at all; a node without edges is a path of its own; an empty graph gives no rows.
"""

from __future__ import annotations

from functools import cached_property
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import discard, materialise

_COUNT = "decimal(38,0)"
#: Rounds after which a sweep is taken for endless.
MOST_ROUNDS = 10_000


#: A node may go if that adds no more edges than this to the graph.
SPARE = 4
#: Rounds of trimming that are tried first: shallow graphs without cycles end in them.
TRIMS = 4
#: Edges of a block that one task searches at once.
BLOCK = 10_000
#: Node tables over this many rows are joined by hashes: edges then needn't be sorted by name.
MANY = 500_000


def _by(nodes: DataFrame, n: int, c: str) -> DataFrame:
    """A table of ``n`` nodes, each once, to be joined to edges by their end ``c``."""
    nodes = nodes.withColumnRenamed("id", c)
    return nodes.hint("shuffle_hash") if n > MANY else nodes


def _drop(*tables: DataFrame) -> None:
    discard(*(df for df in tables if getattr(df, "_scratch", None)))


def _trim(edges: DataFrame) -> DataFrame:
    """Edges that may be on a cycle: where no edge comes to an end, or none leaves it, the node
    is a part of its own.  After the first ``TRIMS`` rounds it goes on while a round takes half,
    so the work stays in proportion; the rest is left to elimination.  edges: src, dst,
    materialised."""
    given, n, rounds = edges, edges.count(), 0
    while n:
        rounds += 1
        ends = [edges.select(F.col(c).alias("id")).distinct() for c in ("src", "dst")]
        live = materialise(ends[0].join(ends[1], "id"), "live")
        k = live.count()
        left = edges.join(_by(live, k, "src"), "src", "left_semi").join(_by(live, k, "dst"), "dst", "left_semi")
        left = materialise(left.select("src", "dst"), "edges")
        before, n = n, left.count()
        discard(live, *([] if edges is given else [edges]))
        edges = left
        if n == before or rounds >= TRIMS and 2 * n > before:
            break
    return edges


def _eliminate(edges: DataFrame, inner_only: bool, keep: bool = True) -> tuple[list[DataFrame], DataFrame]:
    """(edges of the nodes that went, round by round: id, other, out, w, l, if ``keep``; the
    edges that are left).  edges: src, dst, w, l, each pair once, read from a materialised
    table.  With ``inner_only``, roots and leaves stay."""
    rounds = []
    for k in range(MOST_ROUNDS):
        sides = edges.select(F.col("src").alias("id"), F.lit(True).alias("out")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(False).alias("out")))
        n_out, n_in = F.count(F.when(F.col("out"), 1)), F.count(F.when(~F.col("out"), 1))
        few = F.col("n_in") * F.col("n_out") <= F.col("n_in") + F.col("n_out") + SPARE
        if inner_only:
            few &= (F.col("n_in") > 0) & (F.col("n_out") > 0)
        able = sides.groupBy("id").agg(n_in.alias("n_in"), n_out.alias("n_out")).where(few)
        # Cheap nodes go first, so a hub doesn't hold back the many beside it; among equals the
        # order is a hash, so that about a third of a chain goes at once.
        cost = F.ceil(F.log2(F.col("n_in") * F.col("n_out") + 1))
        able = materialise(able.select("id", cost.alias("c"), F.xxhash64("id", F.lit(k)).alias("h")), "able")
        n = able.count()
        if not n:
            discard(able)
            return rounds, edges
        turn = lambda c: F.when(F.col(f"{c}_c").isNotNull(), F.struct(f"{c}_c", f"{c}_h", c))
        for c in ("src", "dst"):
            tagged = (edges if c == "src" else tagged).join(_by(able, n, c).withColumnsRenamed({"c": f"{c}_c", "h": f"{c}_h"}), c, "left")
        tagged = materialise(tagged.select("src", "dst", "w", "l", F.col("src_c").isNotNull().alias("a"), F.col("dst_c").isNotNull().alias("b"), (turn("src") > turn("dst")).alias("later")), "tagged")
        # Of two neighbours that may go, the later one waits.
        late = materialise(tagged.where("a AND b").select(F.when(F.col("later"), F.col("src")).otherwise(F.col("dst")).alias("id")).distinct(), "late")
        n = late.count()
        went = tagged
        for c, may in (("src", "a"), ("dst", "b")):
            went = went.join(_by(late.withColumn("waits", F.lit(True)), n, c), c, "left").withColumn(may, F.col(may) & F.col("waits").isNull()).drop("waits")
        went = went.select("src", "dst", "w", "l", "a", "b")
        went = materialise(went, "went") if n > MANY else went
        into = went.where("b").select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(False).alias("out"), "w", "l")
        on = went.where("a").select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(True).alias("out"), "w", "l")
        if keep:
            rounds.append(materialise(into.unionByName(on), "round"))
        into = into.select("id", F.col("other").alias("src"), F.col("w").alias("w1"), F.col("l").alias("l1"))
        on = on.select("id", F.col("other").alias("dst"), "w", "l")
        through = into.join(on, "id").where("src <> dst").select("src", "dst", (F.col("w1") * F.col("w")).cast(_COUNT).alias("w"), (F.col("l1") + F.col("l")).alias("l"))
        stay = went.where("NOT a AND NOT b").select("src", "dst", "w", "l")
        after = materialise(stay.unionByName(through).groupBy("src", "dst").agg(F.sum("w").cast(_COUNT).alias("w"), F.max("l").alias("l")), "edges")
        _drop(edges, able, tagged, late, went)
        edges = after
    raise ValueError(f"over {MOST_ROUNDS} rounds of elimination")


def _without(nodes: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """The nodes that never went."""
    for went in rounds:
        nodes = nodes.join(went.select("id"), "id", "left_anti")
    return nodes


def _weighted(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.lit(1).cast(_COUNT).alias("w"), F.lit(1).cast("long").alias("l"))


def _reach(pairs: DataFrame, e: DataFrame) -> DataFrame:
    """(id, color) of nodes that reach a color's root inside its own color.
    pairs: id, color (the roots); e: src, dst, color of both ends."""
    a, b = "dst", "src"
    seen = materialise(pairs.select("id", "color"), "reach")
    edge = seen
    for _ in range(MOST_ROUNDS):
        step = edge.select(F.col("id").alias(a), "color").join(e, [a, "color"]).select(F.col(b).alias("id"), "color").distinct()
        fresh = materialise(step.join(seen, ["id", "color"], "left_anti"), "reach")
        if fresh.isEmpty():
            return seen
        after = materialise(seen.unionByName(fresh), "reach")
        discard(seen)
        seen, edge = after, fresh
    raise ValueError(f"a part is over {MOST_ROUNDS} steps deep")


def _parts_of_core(e: DataFrame) -> DataFrame:
    """(id, part) of all ends of some edges.  Every node takes the least name that reaches it as
    its color; what a color's own root reaches backwards inside the color is a part, since it is
    reached forwards as well.  The rest goes through another round; all colors are searched at
    once."""
    own = materialise(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "core")
    found = None
    while found is None or not own.isEmpty():
        color = materialise(own.select("id", F.col("id").alias("color")), "colors")
        for _ in range(MOST_ROUNDS):
            given = e.join(color.select(F.col("id").alias("src"), F.col("color").alias("c")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("c"))
            after = materialise(color.join(given, "id", "left").select("id", F.least("color", F.coalesce("c", "color")).alias("color"), F.coalesce(F.col("c") < F.col("color"), F.lit(False)).alias("moved")), "colors")
            discard(color)
            color = after
            if color.where("moved").isEmpty():
                break
        else:
            raise ValueError(f"a name travels over {MOST_ROUNDS} steps")
        ends = e.join(color.select(F.col("id").alias("src"), "color"), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("other")), "dst").where("color = other").select("src", "dst", "color")
        part = _reach(color.where("id = color"), materialise(ends, "colored-edges")).select("id", F.col("color").alias("part"))
        found = part if found is None else found.unionByName(part)
        own = materialise(own.join(part, "id", "left_anti"), "core")
        known = lambda c: own.select(F.col("id").alias(c))
        e = materialise(e.join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi").select("src", "dst"), "core-edges")
    return found


def _cycles(edges: list[tuple]) -> list[list]:
    """The strongly connected parts of a few edges that have more than one node (Tarjan)."""
    to: dict = {}
    for a, b in edges:
        to.setdefault(a, []).append(b)
    index, low, stack, held, found = {}, {}, [], set(), []
    for root in to:
        work = [] if root in index else [(root, iter(to[root]))]
        while work:
            node, rest = work[-1]
            if node not in index:
                index[node] = low[node] = len(index)
                stack.append(node)
                held.add(node)
            for x in rest:
                if x not in index:
                    work.append((x, iter(to.get(x, ()))))
                    break
                if x in held:
                    low[node] = min(low[node], index[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = [stack.pop()]
                    while part[-1] != node:
                        part.append(stack.pop())
                    held.difference_update(part)
                    if len(part) > 1:
                        found.append(part)
    return found


def _parts_of_blocks(edges: DataFrame) -> DataFrame:
    """(id, part) of nodes on cycles; a task holds the edges of one block at a time."""
    kind = dict(edges.dtypes)["src"]

    def search(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        ids, parts = [], []
        for _, block in groupby(rows, lambda r: r[0]):
            for nodes in _cycles([r[1:] for r in block]):
                ids += nodes
                parts += [min(nodes)] * len(nodes)
            if len(ids) > BLOCK:
                yield pa.RecordBatch.from_pydict({"id": ids, "part": parts})
                ids, parts = [], []
        if ids:
            yield pa.RecordBatch.from_pydict({"id": ids, "part": parts})

    rows = edges.select("block", "src", "dst").repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(search, f"id {kind}, part {kind}")


def strong_parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, part): the strongly connected part of each node, named by its least one.

    Edges may have a column ``block``: a promise that no node has edges of two blocks.  Then
    blocks of up to ``BLOCK`` edges are searched in a task each, however many there are; larger
    ones, and edges without a block, are eliminated together like a graph without blocks."""
    own = nodes.select("id").where("id IS NOT NULL").distinct()
    if "block" not in edges.columns:
        return _parts(own, materialise(clean_edges(own, edges), "clean"))
    known = lambda c: own.select(F.col("id").alias(c))
    clean = edges.select("block", "src", "dst").where("src <> dst").distinct()
    clean = materialise(clean.join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi").select("block", "src", "dst"), "clean")
    large = materialise(clean.groupBy("block").count().where(f"block IS NULL OR count > {BLOCK}").select("block"), "large")
    found = _parts_of_blocks(clean.join(large, "block", "left_anti").where("block IS NOT NULL"))
    if not large.isEmpty():
        rest = materialise(clean.join(large, clean["block"].eqNullSafe(large["block"]), "left_semi").select("src", "dst").distinct(), "clean")
        found = found.unionByName(_parts(rest.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), rest))
    return own.join(found, "id", "left").select("id", F.coalesce("part", "id").alias("part"))


def _parts(own: DataFrame, clean: DataFrame) -> DataFrame:
    edges = _trim(clean)
    if edges.isEmpty():
        return own.select("id", F.col("id").alias("part"))
    inner = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    rounds, core = _eliminate(_weighted(edges), inner_only=False)
    # Nodes that lost their last edge without going are parts of their own so far.
    ends = core.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    left = _without(inner, rounds).join(ends, "id", "left_anti").select("id", F.col("id").alias("part"))
    known = materialise(_parts_of_core(core.select("src", "dst")).unionByName(left), "known")
    for went in reversed(rounds):
        of = went.join(known.select(F.col("id").alias("other"), "part"), "other").groupBy("id", "part").agg(F.max("out").alias("a"), F.min("out").alias("b"))
        shared = of.where("a AND NOT b").groupBy("id").agg(F.min("part").alias("part"))
        fresh = went.select("id").distinct().join(shared, "id", "left").select("id", F.coalesce("part", "id").alias("part"))
        after = materialise(known.unionByName(fresh), "known")
        discard(known)
        known = after
    discard(*rounds)
    # Parts are named by the node that went last; the least one is its name for good.
    least = known.groupBy("part").agg(F.min("id").alias("least"))
    named = known.join(least, "part").select("id", "least")
    return own.join(named, "id", "left").select("id", F.coalesce("least", "id").alias("part"))


def clean_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst").where("src <> dst").distinct()
    known = lambda c: nodes.select(F.col("id").alias(c)).distinct()
    return e.join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi").select("src", "dst")


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ways, longest) of a core.  Each round settles the nodes all of whose successors are
    settled; a node's count is added up from them once."""
    need = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("need"))
    zero = F.lit(0).cast(_COUNT)
    done = materialise(nodes.join(need, "id", "left_anti").select("id", F.lit(1).cast(_COUNT).alias("ways"), F.lit(1).cast("long").alias("longest")), "ways")
    fresh, open_ = done, materialise(need.select("id", "need", zero.alias("ways"), F.lit(0).cast("long").alias("longest")), "open")
    for _ in range(MOST_ROUNDS):
        if open_.isEmpty():
            return done
        gain = edges.join(fresh.select(F.col("id").alias("dst"), "ways", "longest"), "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("got"), F.sum((F.col("w") * F.col("ways")).cast(_COUNT)).cast(_COUNT).alias("w"), F.max(F.col("l") + F.col("longest")).alias("l"))
        now = open_.join(gain, "id", "left")
        now = now.select("id", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"), (F.col("ways") + F.coalesce("w", zero)).cast(_COUNT).alias("ways"), F.greatest("longest", F.coalesce("l", F.lit(0))).alias("longest"))
        now = materialise(now, "open")
        fresh = materialise(now.where("need = 0").select("id", "ways", "longest"), "ways")
        discard(open_)
        after = materialise(done.unionByName(fresh), "ways")
        discard(done)
        done, open_ = after, now.where("need > 0")
        open_._scratch = now._scratch
    raise ValueError(f"a path has over {MOST_ROUNDS} parts")


def _sweep(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ways, longest): the number of ways from a node along the edges to where they end,
    and the nodes of the longest."""
    rounds, core = _eliminate(_weighted(edges), inner_only=True)
    known = _levels(_without(nodes, rounds), core)
    for r in reversed(rounds):
        on = r.where("out").join(known.select(F.col("id").alias("other"), "ways", "longest"), "other")
        fresh = on.groupBy("id").agg(F.sum((F.col("w") * F.col("ways")).cast(_COUNT)).cast(_COUNT).alias("ways"), F.max(F.col("l") + F.col("longest")).alias("longest"))
        after = materialise(known.unionByName(fresh), "ways")
        discard(known)
        known = after
    _drop(core, *rounds)
    return known


class PathGraph:
    """The maximal paths of a call graph, by its strongly connected parts.  What its questions
    share is worked out once.  nodes: id; edges: src, dst."""

    def __init__(self, nodes: DataFrame | None, edges: DataFrame):
        """nodes: all of them; None: the ends of the edges."""
        if nodes is None:
            own, clean = edges.select(F.explode(F.array("src", "dst")).alias("id")), edges.select("src", "dst").where("src <> dst").distinct()
        else:
            own, clean = nodes.select("id"), clean_edges(nodes, edges)
        clean = materialise(clean, "clean")
        self.parts = materialise(_parts(own.where("id IS NOT NULL").distinct(), clean), "parts")
        # Only nodes whose part has another name change an edge.
        moved = materialise(self.parts.where("part <> id"), "moved")
        n = moved.count()
        between = clean
        if n:
            for c in ("src", "dst"):
                between = between.join(_by(moved, n, c), c, "left").withColumn(c, F.coalesce("part", c)).drop("part")
            between = materialise(between.where("src <> dst").select("src", "dst").distinct(), "condensed")
        self.between = between
        self.heads = materialise(self.parts.groupBy(F.col("part").alias("id")).agg(F.count("*").alias("size")), "condensed-nodes")
        into, out = (self.between.select(F.col(c).alias("id")).distinct() for c in ("dst", "src"))
        self.roots, self.leaves = (materialise(self.heads.select("id").join(x, "id", "left_anti"), "ends") for x in (into, out))

    @cached_property
    def below(self) -> DataFrame:
        """(id, ways, longest) down from each part."""
        return _sweep(self.heads.select("id"), self.between)

    def counts(self) -> DataFrame:
        """(id, part, size, above, below, through, longest, is_root, is_leaf) of every node: the
        ways from roots to its part, from it to leaves, the maximal paths through it, and the
        parts on the longest one from it on."""
        up = _sweep(self.heads.select("id"), self.between.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        of = self.heads.join(self.below.select("id", F.col("ways").alias("below"), "longest"), "id").join(up.select("id", F.col("ways").alias("above")), "id")
        of = of.join(self.roots.withColumn("r", F.lit(True)), "id", "left").join(self.leaves.withColumn("f", F.lit(True)), "id", "left")
        no = F.lit(False)
        of = of.select(F.col("id").alias("part"), "size", "above", "below", (F.col("above") * F.col("below")).cast(_COUNT).alias("through"), "longest", F.coalesce("r", no).alias("is_root"), F.coalesce("f", no).alias("is_leaf"))
        return self.parts.join(of, "part").select("id", "part", "size", "above", "below", "through", "longest", "is_root", "is_leaf")

    def pairs(self) -> DataFrame:
        """(root, leaf, paths): maximal paths by both ends.  Rows are pairs of a root and a leaf
        that it reaches.  Where no core is left, the edges that elimination leaves are the
        result; a core's counts travel up from its leaves, a round per level."""
        _, core = _eliminate(_weighted(self.between), inner_only=True, keep=False)
        one = F.lit(1).cast(_COUNT).alias("paths")
        out = self.roots.join(self.leaves, "id").select(F.col("id").alias("root"), F.col("id").alias("leaf"), one)
        live = self.leaves.select("id", F.col("id").alias("leaf"), one)
        for _ in range(MOST_ROUNDS):
            up = core.join(live.select(F.col("id").alias("dst"), "leaf", "paths"), "dst").groupBy(F.col("src").alias("id"), "leaf").agg(F.sum((F.col("w") * F.col("paths")).cast(_COUNT)).cast(_COUNT).alias("paths"))
            live = materialise(up, "pairs")
            if live.isEmpty():
                return out.groupBy("root", "leaf").agg(F.sum("paths").cast(_COUNT).alias("paths"))
            out = out.unionByName(live.join(self.roots, "id", "left_semi").select(F.col("id").alias("root"), "leaf", "paths"))
        raise ValueError(f"a path has over {MOST_ROUNDS} parts")

    def numbered(self, wanted: DataFrame) -> DataFrame:
        """(root, number, path) of the paths that are asked for, numbered from 0 below each root
        in the order of their names.  Numbers past a root's last path give no row.
        wanted: root, number."""
        order = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
        to = self.between.join(self.below.select(F.col("id").alias("dst"), "ways"), "dst")
        span = to.select("src", "dst", F.coalesce(F.sum("ways").over(order), F.lit(0)).cast(_COUNT).alias("low"), "ways")
        span = materialise(span.withColumn("high", (F.col("low") + F.col("ways")).cast(_COUNT)), "spans")
        asked = wanted.where("number >= 0").select(F.col("root").alias("id"), F.col("number").cast(_COUNT).alias("number")).distinct()
        live = asked.join(self.roots, "id", "left_semi").join(self.below, "id").where("number < ways")
        live = materialise(live.select(F.col("id").alias("root"), "number", F.array("id").alias("path"), F.col("number").alias("rest")), "walks")
        out = live.select("root", "number", "path").limit(0)
        while not live.isEmpty():
            step = materialise(live.withColumn("src", F.element_at("path", -1)).join(span, "src", "left").where("dst IS NULL OR (rest >= low AND rest < high)"), "walks")
            out = out.unionByName(step.where("dst IS NULL").select("root", "number", "path"))
            live = step.where("dst IS NOT NULL").select("root", "number", F.concat("path", F.array("dst")).alias("path"), (F.col("rest") - F.col("low")).cast(_COUNT).alias("rest"))
        return out
