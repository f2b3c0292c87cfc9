"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors of one label are scaled to length 1 and rotated at random; cosine >= c is then
squared distance <= 2 - 2c.  The rotated coordinates are split into blocks.  By the
pigeonhole principle a linked pair keeps within the block's share of that distance in at
least one block, so each block is range-joined on its own: cells along the block's first
coordinate, as wide as the block's radius, bring together all pairs that could, and the
block's full distance filters them.

No pair leaves a task, so rows stay proportional to the vectors however large a group of
near vectors is.  Coordinates are whole numbers (steps of 2**-20) and their sums of squares
are exact in floating point, so every task sees the same distance for a pair: the pair is
taken up in the first block that brings it together, and nowhere else.  That is the union
of the blocks' candidates.  Its distance decides a pair at once if it is farther from the
bound than rounding can reach; the few pairs nearer to the bound leave the task and are
verified on the original vectors in double precision.  Tasks return link counts and a
spanning forest.

Equal vectors of one label form a class, with a number of its own, and are compared once.
A crowded cell is split into tiles: each task holds one tile and streams the cell past it.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows without a label, link with nothing; vectors of different lengths never meet; ids may be
null or repeat: every row counts, a component takes its least id (null only if all are
null), and all rows of that id in it are kept; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.forest import unite
from quarry.operators.components import connected_components
from quarry.runtime import bound_batches, discard, materialise

BLOCK_DIMS = 8
TILE = 8192
STRIP = 256
SCALE = 1 << 20


@cache
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[slice]:
    return [slice(a, min(dims, a + BLOCK_DIMS)) for a in range(0, dims, BLOCK_DIMS)]


def radius(dims: int, cosine: float) -> tuple[float, float]:
    """The largest distance of a link, in steps, and how far rounding can shift a distance:
    half a step in each coordinate of both vectors, and what doubles lose."""
    return SCALE * (2 - 2 * cosine) ** 0.5, dims**0.5 + 1e-6 * SCALE


def budgets(dims: int, cosine: float) -> list[int]:
    """Each block's share of the squared distance, in proportion to its dimensions."""
    most = sum(radius(dims, cosine)) ** 2
    return [int(most * (b.stop - b.start) / dims) + 1 for b in blocks_of(dims)]


def whole_numbers(v: np.ndarray) -> np.ndarray:
    """Vectors, one a row, as rotated unit vectors in steps."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ rotation(v.shape[1])
    return np.rint(v * SCALE).astype(np.int32)


def _cells(classes: DataFrame, cosine: float) -> DataFrame:
    """(label, dims, block, x, visitor, rep, steps): each vector in its own cell of each
    block, and as a visitor in the next one, so each pair of neighbours meets once."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                sizes = np.diff(part.column("v").offsets.to_numpy())
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                labels, reps = (part.column(c).to_numpy(zero_copy_only=False) for c in ("label", "rep"))
                for d in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == d)
                    steps = whole_numbers(flat[starts[rows][:, None] + np.arange(d)])
                    raw = pa.array([s.tobytes() for s in steps], pa.binary())
                    for k, (block, most) in enumerate(zip(blocks_of(d), budgets(d, cosine))):
                        x = steps[:, block.start] // (int(most**0.5) + 1)
                        for visitor in (False, True):
                            n = len(rows)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(labels[rows]), pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array((x + visitor).astype(np.int32)), pa.array(np.full(n, visitor)), pa.array(reps[rows]), raw],
                                names=["label", "dims", "block", "x", "visitor", "rep", "steps"],
                            )

    return classes.select("label", "rep", "v").mapInArrow(run, "label long, dims int, block int, x int, visitor boolean, rep long, steps binary")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b: whole numbers below 2**53, hence exact."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def pairs_in(a: np.ndarray, b: np.ndarray, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, squared distance) of the rows of a and b that this block brings together and
    no block before it does."""
    dims = a.shape[1]
    parts, shares = blocks_of(dims), budgets(dims, cosine)
    near = _squares(a[:, parts[block]], b[:, parts[block]]) <= shares[block]
    dense = np.count_nonzero(near) > near.size // 16
    if dense:
        for k in range(block):
            near &= _squares(a[:, parts[k]], b[:, parts[k]]) > shares[k]
        i, j = np.nonzero(near)
        if len(i) > near.size // 16:
            return i, j, _squares(a, b)[i, j]
    else:
        i, j = np.nonzero(near)
        for k in range(block):
            far = ((a[i, parts[k]] - b[j, parts[k]]) ** 2).sum(1) > shares[k]
            i, j = i[far], j[far]
    total = np.zeros(len(i))
    for s in range(0, len(i), 1 << 14):
        total[s : s + (1 << 14)] = ((a[i[s : s + (1 << 14)]] - b[j[s : s + (1 << 14)]]) ** 2).sum(1)
    return i, j, total


class Tile:
    """Vectors that a task holds, their links so far, and how they hang together."""

    def __init__(self, block: int, dims: int, cosine: float):
        self.block, self.cosine = block, cosine
        self.steps = np.zeros((0, dims))
        self.ids, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.links, self.root = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bound, self.margin = radius(dims, cosine)

    def _sure(self, i, j, square):
        """Which pairs are links whatever rounding did, and which may be."""
        far = np.sqrt(square)
        return far <= self.bound - self.margin, np.abs(far - self.bound) < self.margin

    def add(self, ids, size, steps):
        """Take in members; yields doubtful pairs as (a, b)."""
        at = len(self.ids)
        self.steps, self.ids, self.size = np.concatenate([self.steps, steps]), np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        self.links = np.concatenate([self.links, np.zeros(len(ids), np.int64)])
        self.root = np.concatenate([self.root, np.arange(at, at + len(ids))])
        for s in range(at, len(self.ids), STRIP):
            e = min(s + STRIP, len(self.ids))
            i, j, square = pairs_in(self.steps[s:e], self.steps[:e], self.block, self.cosine)
            once = j < i + s
            i, j, square = i[once] + s, j[once], square[once]
            sure, unsure = self._sure(i, j, square)
            yield self.ids[i[unsure]], self.ids[j[unsure]]
            i, j = i[sure], j[sure]
            self.links += np.bincount(i, self.size[j], len(self.ids)).astype(np.int64) + np.bincount(j, self.size[i], len(self.ids)).astype(np.int64)
            unite(self.root, i, j)

    def visit(self, ids, size, steps):
        """Compare rows that aren't members: yields (a, n, b) of their links, n of them null
        (-1) for doubtful pairs."""
        for s in range(0, len(ids), STRIP):
            i, j, square = pairs_in(steps[s : s + STRIP], self.steps, self.block, self.cosine)
            sure, unsure = self._sure(i, j, square)
            yield ids[s + i[unsure]], np.full(int(unsure.sum()), -1), self.ids[j[unsure]]
            i, j = i[sure], j[sure]
            some, first, of = np.unique(i, return_index=True, return_inverse=True)
            unite(self.root, j[first][of], j)
            self.links += np.bincount(j, size[s + i], len(self.ids)).astype(np.int64)
            yield ids[s + some], np.bincount(of, self.size[j], len(some)).astype(np.int64), self.ids[j[first]]

    def close(self):
        some = self.links > 0
        return self.ids[some], self.links[some], self.ids[self.root[some]]


CELL = ["label", "dims", "block", "x"]


def _linked(cells: DataFrame, sizes: DataFrame, cosine: float) -> DataFrame:
    """(a, n, b): n more links of a, which hangs together with b; a null n: a doubtful pair."""
    counts = cells.groupBy(*CELL).agg(F.sum(F.when(F.col("visitor"), 0).otherwise(1)).alias("homes"), F.count("*").alias("all")).where("homes > 0 AND all > 1")
    counts = counts.select(*CELL, F.ceil(F.col("homes") / TILE).cast("int").alias("tiles"))
    rows = cells.join(counts, CELL).join(sizes, "rep").withColumn("own", F.when(F.col("visitor"), -1).otherwise(F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")))
    # A tile's members come first (role 0), then what passes by: visitors and the members
    # of later tiles.
    dealt = rows.withColumn("tile", F.explode(F.when(F.col("visitor"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.sequence(F.lit(0), F.col("own")))))
    dealt = dealt.select(*CELL, "tile", F.when(F.col("own") == F.col("tile"), 0).otherwise(1).alias("role"), "rep", "size", "steps")
    keys = [*CELL, "tile"]

    def out(a, n, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n, pa.int64(), mask=n < 0), pa.array(b, pa.int64())], names=["a", "n", "b"])

    def run(batches):
        key, tile, kept = None, None, []

        def leave():
            if kept:
                yield out(*(np.concatenate(c) for c in zip(*kept)))
                kept.clear()

        for batch in batches:
            cols = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], 1)
            role, reps, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("role", "rep", "size"))
            raw = batch.column("steps")
            edge = np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(cols)]):
                now = tuple(cols[s].tolist())
                if now != key:
                    if tile is not None:
                        kept.append(tile.close())
                    key, tile = now, Tile(now[2], now[1], cosine)
                steps = np.frombuffer(b"".join(raw[s:e].to_pylist()), np.int32).reshape(e - s, -1).astype(np.float64)
                own = int((role[s:e] == 0).sum())
                if own:
                    kept += [(a, np.full(len(a), -1), b) for a, b in tile.add(reps[s : s + own], size[s : s + own], steps[:own]) if len(a)]
                if own < e - s:
                    kept += [row for row in tile.visit(reps[s + own : e], size[s + own : e], steps[own:]) if len(row[0])]
            yield from leave()
        if tile is not None:
            kept.append(tile.close())
        yield from leave()

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(run, "a long, n long, b long")


def _verify(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """Pairs whose exact cosine reaches the bound, in double precision."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ok = []
                for x, y in zip(part.column("va"), part.column("vb")):
                    x, y = x.values.to_numpy(), y.values.to_numpy()
                    x, y = x / np.abs(x).max(), y / np.abs(y).max()
                    ok.append(bool(x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda s: classes.select(F.col("rep").alias(s), F.col("v").alias(f"v{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Per vector: n_links, component_id, kept."""
    bound_batches(vectors.sparkSession)
    v = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.when(fine, v).alias("v"))
    classes = rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    cells = materialise(_cells(classes, cosine), "cells")
    linked = materialise(_linked(cells, classes.select("rep", "size"), cosine), "linked")
    exact = materialise(_verify(linked.where("n IS NULL").select("a", "b"), classes, cosine), "links")
    ends = exact.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(exact.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    degrees = ends.join(classes.select(F.col("rep").alias("other"), "size"), "other").select("rep", F.col("size").alias("n"))
    inside = linked.where("n IS NOT NULL")
    degrees = degrees.unionByName(inside.select(F.col("a").alias("rep"), "n")).groupBy("rep").agg(F.sum("n").alias("n"))
    roots = connected_components(exact.unionByName(inside.select("a", "b"))).select(F.col("node").alias("rep"), "component")
    grouped = classes.join(degrees, "rep", "left").join(roots, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    grouped = materialise(grouped.select("label", "v", "least", "component", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links")), "grouped")
    heads = grouped.groupBy("component").agg(F.min("least").alias("head"))
    named = grouped.join(heads, "component").select("label", "v", "n_links", "head")
    discard(cells, linked, exact, classes)
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = rows.where("v IS NOT NULL").join(named, ["label", "v"])
    return found.select("vec_id", "n_links", F.col("head").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("head")).alias("kept")).unionByName(alone)
