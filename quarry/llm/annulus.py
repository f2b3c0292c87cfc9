"""Exact k-means over whole numbers with an annulus search for the nearest centroid.

Centroids are sorted by norm.  For a vector, a binary search finds the centroid whose norm is
nearest to its own; the distance to that one is an upper bound, and by the triangle inequality
no centroid whose norm differs from the vector's by more than the bound can be nearer.  Two
binary searches give that annulus, and only its centroids are compared, in whole numbers, so
ties at the bound are seen and go to the smaller number.

Each round is one pass over the vectors: a task returns, for each centroid, how many vectors
it took and their componentwise sums, and Spark adds those up.  The driver holds only the k
centroids.

Edge cases: vectors that are null, of another length, or hold null or non-finite components are
left out; ids may be null or repeat: each row counts, and a null id starts a centroid only if
too few others exist (ties by components); fewer vectors than k give fewer centroids; distances
and sums beyond a long are given as the largest long; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import bound_batches, discard, materialise

#: Rows compared at a time in a task.
STRIP = 2048
#: Largest components for which 64 squares fit in a double's 53 bits, and in a long.
DOUBLE_EXACT, LONG_EXACT = 1 << 22, 1 << 27
LONG_MOST = (1 << 63) - 1


def whole(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * component) as longs, or as Python integers if some are too large for
    exact squares in longs."""
    with np.errstate(over="ignore"):
        x = np.floor(v * scale)
    if np.abs(x).max(initial=0) <= LONG_EXACT:
        return x.astype(np.int64)
    # A double whose multiple overflows is a whole number itself.
    return np.array([[int(m) if math.isfinite(m) else int(c) * scale for m, c in zip(*rows)] for rows in zip(x.tolist(), v.tolist())], dtype=object)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to one centroid."""
    d = x - c
    if d.dtype != object and np.abs(d).max(initial=0) <= DOUBLE_EXACT:
        d = d.astype(np.float64)
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    return (d * d).sum(axis=1)


class Annulus:
    """Centroids sorted by norm, for exact nearest-centroid search."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = np.array(centroids, dtype=object)
        self.small = np.abs(self.exact).max(initial=0) <= LONG_EXACT
        norms = np.array([float(sum(c * c for c in row)) ** 0.5 if self.small else 0.0 for row in centroids])
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.rows = self.exact.astype(np.int64) if self.small else self.exact

    def range_of(self, norms: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place + 1 of the centroids whose norms lie within ``bound`` of each
        norm, widened by what doubles may lose."""
        slack = bound + 1e-9 * (norms + self.norms[-1]) + 1e-6
        return np.searchsorted(self.norms, norms - slack, "left"), np.searchsorted(self.norms, norms + slack, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid."""
        if x.dtype == object or not self.small:
            return self._among_all(x.astype(object))
        rows = self.rows
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        right = np.clip(np.searchsorted(self.norms, norms), 0, len(self.norms) - 1)
        left = np.maximum(right - 1, 0)
        first = np.where(norms - self.norms[left] <= self.norms[right] - norms, left, right)
        best, number = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for place in np.unique(first).tolist():
            at = np.flatnonzero(first == place)
            number[at] = self.order[place]
            best[at] = squares(x[at], rows[self.order[place]])
        low, high = self.range_of(norms, np.sqrt(best.astype(np.float64)))
        for place, k in enumerate(self.order.tolist()):
            at = np.flatnonzero((low <= place) & (place < high) & (first != place))
            if len(at):
                far = squares(x[at], rows[k])
                better = (far < best[at]) | ((far == best[at]) & (k < number[at]))
                best[at[better]], number[at[better]] = far[better], k
        return number, best

    def _among_all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without norms, for components whose squares pass a long."""
        far = np.stack([squares(x, c) for c in self.exact], axis=1)
        number = np.array([min(range(len(row)), key=row.__getitem__) for row in far.tolist()])
        return number, far[np.arange(len(x)), number]


def _vectors(batch: pa.RecordBatch, dims: int, scale: int):
    """(slice, whole-numbered rows) of a batch of fixed-length vectors."""
    for a in range(0, batch.num_rows, STRIP):
        part = batch.slice(a, STRIP)
        v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
        yield part, whole(v, scale)


def limbs(s: int) -> list[int]:
    out = []
    while not -(1 << 40) < s < 1 << 40:
        out.append(s & ((1 << 40) - 1))
        s >>= 40
    return [*out, s]


def _sums(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> dict[int, list[int]]:
    """Count and componentwise sums of the vectors of each non-empty centroid, as
    [count, sum, ...]; tasks add up their own rows first."""

    def run(batches):
        index, total = Annulus(centroids), {}
        for batch in batches:
            for _, x in _vectors(batch, dims, scale):
                number, _ = index.nearest(x)
                for k in np.unique(number).tolist():
                    mine = x[number == k]
                    now = [len(mine), *map(int, mine.sum(axis=0))]
                    total[k] = [p + q for p, q in zip(total[k], now)] if k in total else now
        # Sums leave as limbs of 40 bits, the last one signed, so that no total overflows.
        rows = [(k, at, limb, part) for k, row in total.items() for at, s in enumerate(row) for limb, part in enumerate(limbs(s))]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["k", "at", "limb", "part"])

    summed = vectors.select("v").mapInArrow(run, "k int, at int, limb int, part long").groupBy("k", "at", "limb").agg(F.sum("part").alias("part"))
    out: dict[int, list[int]] = {}
    for r in summed.collect():  # a few limbs for each of k * (dims + 1) numbers
        out.setdefault(r.k, [0] * (dims + 1))[r["at"]] += r.part << (40 * r.limb)
    return out


def kept_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, v).alias("v")).where("v IS NOT NULL")


def first_centroids(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors whose ids hash lowest, as whole numbers."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return [[int(c) for c in whole(np.array([r.v]), scale)[0]] for r in rows]


def fit(kept: DataFrame, dims: int = 64, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> list[list[int]]:
    """Centroids after ``rounds`` rounds; empty ones stay where they were."""
    centroids = first_centroids(kept, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        for c, (n, *sums) in _sums(kept, centroids, dims, scale).items():
            centroids[c] = [s // n for s in sums]
    return centroids


def assign(kept: DataFrame, centroids: list[list[int]], dims: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches):
        index = Annulus(centroids)
        for batch in batches:
            for part, x in _vectors(batch, dims, scale):
                number, far = index.nearest(x)
                far = pa.array([min(int(d), LONG_MOST) for d in far], pa.int64()) if far.dtype == object else pa.array(far)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number.astype(np.int32)), far], names=["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, dims: int = 64, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> DataFrame:
    """Per kept vector: its cluster, its squared distance, the sums of those over its cluster
    and over all, and a hash of its centroid."""
    spark = vectors.sparkSession
    bound_batches(spark)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = materialise(kept_vectors(vectors, dims), "vectors")
    centroids = fit(kept, dims, k, rounds, seed, scale)
    if not centroids:
        return spark.createDataFrame([], schema)
    placed = materialise(assign(kept, centroids, dims, scale), "placed")
    discard(kept)
    # At most k rows, which come to the driver and go back as literals of a bounded table.
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = min(sum(sums.values()), LONG_MOST)
    rows = [(c, min(s, LONG_MOST), inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(*[c.split()[0] for c in schema.split(", ")])
