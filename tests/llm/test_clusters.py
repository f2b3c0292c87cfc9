"""Centroid clustering against plain loops, and its edge cases."""

import hashlib
import math
import random

import numpy as np

from quarry.llm import annulus


def brute(rows, dims, k, rounds, seed=3, scale=1024):
    kept = [(i, [math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cs = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(cs)), key=lambda c: (far(v, cs[c]), c))
    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(near(v), []).append(v)
        for c, vs in mine.items():
            cs[c] = [sum(col) // len(vs) for col in zip(*vs)]
    got = [(i, near(v), far(v, cs[near(v)])) for i, v in kept]
    top = annulus.LONG_MOST
    of = {c: min(top, sum(min(top, d) for _, e, d in got if e == c)) for _, c, _ in got}
    total = min(top, sum(min(top, d) for _, _, d in got))
    return sorted((str(i), c, min(top, d), of[c], total, hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in got)


def ours(spark, rows, dims, k, rounds):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in annulus.clustered(df, dims, k, rounds).collect())


def test_equals_loops(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 5, 0.7) for _ in range(6)]) for i in range(300)]
    assert ours(spark, rows, 6, 8, 4) == brute(rows, 6, 8, 4)


def test_ties_repeats_nulls_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(80)]
    rows += rows[:9] + [(None, [1.0, 0.0, 0.0])] * 2
    rows += [(90, None), (91, []), (92, [1.0, 2.0]), (93, [1.0, None, 1.0]), (94, [float("nan"), 0.0, 0.0]), (95, [float("inf"), 0.0, 0.0])]
    assert ours(spark, rows, 3, 8, 3) == brute(rows, 3, 8, 3)


def test_few_or_no_vectors(spark):
    rows = [(1, [0.5, 0.25]), (2, [-0.5, 0.0])]
    assert ours(spark, rows, 2, 8, 2) == brute(rows, 2, 8, 2)
    assert ours(spark, [], 2, 8, 2) == [] and ours(spark, [(1, None)], 2, 8, 2) == []


def test_components_beyond_longs(spark):
    rows = [(1, [1e300, -3e40]), (2, [1.0, 2.0]), (3, [1e15, 0.1]), (4, [1e308, -1e308]), (5, [-1e308, 1e308])]
    assert ours(spark, rows, 2, 2, 2) == brute(rows, 2, 2, 2)


def test_annulus_holds_the_nearest():
    rng = np.random.default_rng(3)
    for scale in (1, 5, 1000):
        cs = rng.integers(-scale, scale + 1, (40, 4)).tolist()
        x = rng.integers(-scale, scale + 1, (500, 4))
        far = ((x[:, None, :] - np.array(cs)[None]) ** 2).sum(2)
        number, best = annulus.Annulus(cs).nearest(x)
        assert (number == far.argmin(1)).all() and (best == far.min(1)).all()
    low, high = annulus.Annulus([[0, 0], [3, 4], [30, 40]]).range_of(np.array([6.0]), np.array([1.0]))
    assert (low[0], high[0]) == (1, 2)
