"""Families by propagation against the greedy loop, on one block that holds every path."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import families, settling
from quarry.runtime import positions


def greedy(rows):
    df = pd.DataFrame(sorted(rows, key=lambda r: (r[2], r[0])), columns=["id", "tokens", "rank"])
    out = families.greedy_groups(df)
    first = out.groupby("group")["id"].first()
    return {r.id: (first[r.group], r.relation) for r in out.itertuples()}


def ours(spark, rows):
    df = spark.createDataFrame(rows, "id long, tokens array<string>, rank long")
    return {r.id: (r.family, r.relation) for r in settling.first_groups(df).collect()}


@pytest.mark.parametrize("seed, alphabet, longest", [(1, "ab", 6), (2, "abc", 7), (3, "abcdefgh", 5)])
def test_equals_the_greedy_loop(spark, seed, alphabet, longest, monkeypatch):
    monkeypatch.setattr(settling, "BUCKET", 16)
    rng = random.Random(seed)
    rows = [(k, [rng.choice(alphabet) for _ in range(rng.randint(0, longest))], rng.randint(0, 40)) for k in range(150)]
    # Common beginnings and endings, with repeats where they meet.
    rows += [(k, list("ab") + [rng.choice(alphabet)] * (k % 4), k % 7) for k in range(150, 180)]
    rows += [(k, [rng.choice(alphabet), *(["a"] * (k % 3)), *"abcba"], k % 5) for k in range(180, 220)]
    assert ours(spark, rows) == greedy(rows)


def test_long_chain(spark):
    """Each path merges with the one before it only, by a shifted half."""
    rows = [(k, [f"t{k + j}" for j in range(5)], k) for k in range(30)]
    assert ours(spark, rows) == greedy(rows)


def test_odd_rows(spark):
    rows = [(1, [], 1), (2, None, 1), (3, ["x"], 1), (4, ["x"], 0)]
    assert ours(spark, rows) == {1: (1, "representative"), 2: (2, "representative"), 4: (4, "representative"), 3: (4, "duplicate")}
    assert ours(spark, []) == {}


def test_positions(spark):
    df = spark.createDataFrame([(k * 7919 % 1000, str(k % 3)) for k in range(1000)], "a long, b string").repartition(7)
    got = positions(df, [F.desc("b"), "a"]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1000)) and [(r.b, r.a) for r in got] == sorted(((r.b, r.a) for r in got), key=lambda x: (-int(x[0]), x[1]))
