"""Ways on from a judgment, ancestors on a stack, and the arcs' view under edits."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import resolving, views


def test_ancestors_equal_a_stack(spark):
    rng = random.Random(3)
    frames, want = [], set()
    for run in range(4):
        stack = []
        for pos in range(60):
            depth = rng.randint(0, min(len(stack), 6))
            stack[depth:] = [f"a{rng.randrange(9)}"]
            frames.append((run, pos, depth, stack[depth]))
            want |= {(run, pos, d, stack[d]) for d in range(depth)}
    df = spark.createDataFrame(frames, "run long, pos long, depth int, artifact string")
    assert {tuple(r) for r in resolving.ancestors(df, df.select("run", "pos", "depth")).collect()} == want
    with pytest.raises(Exception, match="deeper than 3"):
        resolving.ancestors(df, df, deepest=3).collect()


def test_every_way_on(spark):
    wishes = [(1, "search", None, False), (2, "artifact", "w", None), (3, "artifact", "seen", False), (4, "other", None, True), (5, "stop", None, False), (6, "stop", None, None), (7, "stop", None, True), (8, "search", None, False), (9, None, None, None), (10, "artifact", "nowhere", False), (11, "search", "x", True)]
    runs = range(1, 12)
    frames = [(r, p, d, a) for r in runs for p, d, a in ((0, 0, "root"), (1, 1, "old"), (2, 1, "mid"), (3, 2, "leaf"))]
    # The sibling "old" is closed, "leaf" is the current frame: neither's links count.
    links = [(r, "old", 0, "o") for r in runs] + [(r, "leaf", 0, "l") for r in runs] + [(4, "mid", 1, "m2"), (4, "mid", 0, "seen"), (4, "mid", 2, "m3"), (5, "root", 0, "r1"), (11, "mid", 0, None)]
    frontier = [(r, "w", 1.0) for r in runs if r not in (7, 10)] + [(6, "f", 2.0), (6, "e", 2.0), (3, "seen", 9.0)]
    hits = [(1, "h", 1.0), (1, "seen", 5.0), (8, "seen", 5.0), (11, "h", None)]
    candidates = [(r, c, p) for r in runs if r not in (7, 9) for c, p in (("c", 3.0), ("b", 3.0), ("seen", 8.0), (None, 9.0))]
    visited = [(r, v) for r in runs for v in ("seen", None)] * 2
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    pairs = "run long, id string, priority double"
    args = [make(wishes, "run long, type string, artifact string, dampened boolean"), make(frames, "run long, pos long, depth int, artifact string"), make(links, "run long, artifact string, ord long, id string"), make(frontier, pairs), make(hits, pairs), make(candidates, pairs), make(visited, "run long, id string")]
    got = {r.run: (r.id, r.outcome) for r in resolving.ways_on(*args).collect()}
    assert got == {
        1: ("h", "hit"),
        2: ("w", "wish"),
        3: ("b", "fallback"),
        4: ("m2", "ancestor"),
        5: ("r1", "backtrack"),
        6: ("e", "backtrack"),
        7: (None, "none"),
        8: ("b", "fallback"),
        9: (None, "none"),
        10: ("b", "fallback"),
        11: ("h", "hit"),
    }
    assert resolving.ways_on(args[0].limit(0), *args[1:]).count() == 0


ARC = "arc long, title string, path string, meaning string, entities array<struct<name string, schema string, fields array<string>>>, steps array<string>"


def some_arc(rng, arc):
    names = ["Order", " order", "Customer", "PARTY", None, ""]
    entities = [(rng.choice(names), rng.choice([None, "s"]), rng.choice([None, [], ["id"], ["id", "Id ", None, "note"]])) for _ in range(rng.randint(0, 3))]
    return (arc, rng.choice(["Buy", None]), rng.choice(["p1", " ", None]), rng.choice([None, "why"]), rng.choice([None, entities]), [rng.choice(["s", "t", None]) for _ in range(rng.randint(0, 3))])


def test_edits_equal_a_rebuild(spark):
    rng = random.Random(9)
    now = {k: some_arc(rng, k) for k in range(8)}
    make = lambda rows: spark.createDataFrame(list(rows), ARC)
    whole = lambda df: sorted(map(repr, df.collect()))
    view = views.contributions(make([*now.values(), (None, "nobody", None, None, None, ["s"])]))
    for _ in range(3):
        keys = rng.sample(range(12), 4)
        old = {k: now[k] for k in keys if k in now}
        new = {k: some_arc(rng, k) for k in keys if rng.random() < 0.7}
        change = views.changed(make(old.values()), make(new.values()))
        before = {(r.kind, r.id): r.n for r in views.shown(view).collect()}
        said = {(r.kind, r.id): r.action for r in views.actions(view, change).collect()}
        view = spark.createDataFrame(views.applied(view, change).collect(), view.schema)
        now = {k: v for k, v in now.items() if k not in keys} | new
        rebuilt = views.contributions(make(now.values()))
        assert whole(views.shown(view)) == whole(views.shown(rebuilt)) and whole(view.select(*views.KEYS, "n")) == whole(rebuilt.select(*views.KEYS, "n"))
        after = {(r.kind, r.id): r.n for r in views.shown(view).collect()}
        assert {k for k, a in said.items() if a == "insert"} == set(after) - set(before)
        assert {k for k, a in said.items() if a == "retract"} == set(before) - set(after)
    # An edit that changes nothing touches nothing; one that takes what isn't there is an error.
    same = make(now.values())
    assert views.changed(same, same).count() == 0
    with pytest.raises(Exception, match="isn't there"):
        views.applied(view, views.contributions(same).withColumn("n", -F.col("n") - 1)).collect()
    assert views.contributions(make([])).count() == 0
