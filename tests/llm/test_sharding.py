"""Balance of shards beside heavy groups, and groups that outweigh a shard."""

import random
from collections import Counter, defaultdict
from itertools import product

from quarry.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string"


def shards_of(spark, rows, leaves):
    got = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), leaves=leaves).collect()
    texts = {r[0]: r[1] for r in rows}
    size, where, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        where[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size, where


def test_nearest_sum_is_the_nearest():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randint(1, 400) for _ in range(rng.randint(0, 9))]
        goal = rng.uniform(-50, sum(sizes) + 50)
        got = sum(s for s, k in zip(sizes, sharding.nearest_sum(sizes, goal)) if k)
        assert abs(got - goal) == min(abs(sum(s for s, k in zip(sizes, m) if k) - goal) for m in product((0, 1), repeat=len(sizes)))


def test_heavy_groups_leave_shards_equal(spark):
    rng = random.Random(4)
    rows = [("x" * rng.randint(1, 900), rng.choice("abcd")) for _ in range(500)]
    for k in range(6):  # groups of over half a shard
        rows += [(f"copy {k} " * 40, "a")] * rng.randint(70, 90)
    rng.shuffle(rows)
    size, _ = shards_of(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate(rows)], 8)
    assert len(size) == 8 and max(size.values()) * 8 / sum(size.values()) < 1.02


def test_a_group_over_a_share_stands_alone(spark):
    rng = random.Random(5)
    rows = [(i, "the same " * 20, None, None) for i in range(400)]
    rows += [(1000 + i, "w" * rng.randint(0, 60) + str(i), "en", "s") for i in range(600)]
    rows += [(5000, None, None, None), (5001, "", None, None)]
    size, where = shards_of(spark, rows, 8)
    assert where["the same " * 20] == {7}
    rest = [size[k] for k in range(7)]
    assert max(rest) * 7 / sum(rest) < 1.02


def test_fewer_texts_than_shards(spark):
    size, _ = shards_of(spark, [(i, f"text {i % 3}", "en", "s") for i in range(50)], 8)
    assert sum(size.values()) == 50 * (6 + 16)
