"""A scout's runs by hand, against a plain loop, and with nulls, ties and empty tables."""

import random

from pyspark.sql import functions as F

from quarry.operators import choosing, scouting

ARC = "run int, arc string, pos int, title string, qualifies boolean, priority double, model string, started boolean, completed boolean, opportunity double, created int"
PATH = "run int, id string, pos int, path string, label string"
RANK = "run int, pos int, item string, priority double, likelihood double, novelty double, pursue boolean, title string"


def go(spark, arcs, paths, rankings, known):
    return scouting.scout(spark.createDataFrame(arcs, ARC), spark.createDataFrame(paths, PATH), spark.createDataFrame(rankings, RANK), spark.createDataFrame([(k,) for k in known], "path string"))


def arc(run, name, pos=0, title=None, qualifies=True, priority=None, model=None, started=False, completed=False, opportunity=0.0, created=0):
    return run, name, pos, title, qualifies, priority, model, started, completed, opportunity, created


def loop(arcs, paths, rankings, known):
    """The same for one run, item by item."""
    finite = lambda x: x is not None and abs(x) < float("inf")
    clamp = lambda x: min(1.0, max(0.0, x)) if finite(x) and x == x else 0.0
    waiting = [a for a in sorted(arcs, key=lambda a: (a[2], a[1])) if a[4] is not False and not (finite(a[5]) and a[6] == scouting.MODEL)][:50]
    batch = sorted(paths, key=lambda p: (p[2], p[1]))[:10]
    may = {"arc:" + a[1] for a in waiting} | {"path:" + p[1] for p in batch}
    ranked = sorted(((*r[:3], *map(clamp, r[3:6]), r[6] is not False, " ".join((r[7] or "").split())) for r in rankings if r[2] in may), key=lambda r: (-r[3], -(r[5] * r[4]), r[1], r[7]))
    priority = {a[1]: a[5] for a in arcs}
    for r in ranked:
        if r[2].startswith("arc:"):
            priority[r[2][4:]] = r[3]
    titles = {a[3].strip().lower() for a in arcs if a[3]}
    made = []
    for r in ranked:
        by = {p[1]: p for p in batch}
        if not r[2].startswith("path:") or not r[6] or r[4] < 0.55 or r[5] < 0.45 or len(made) >= 3 or by[r[2][5:]][3] not in known:
            continue
        title = r[7] or by[r[2][5:]][4] or r[2][5:]
        if title.lower() not in titles:
            titles.add(title.lower())
            made.append((r[2][5:], title, max(r[3:6]), r[3]))
    left = [(-(priority[a[1]] if finite(priority[a[1]]) else -1), bool(a[7]), -(a[9] or 0), a[10] or 0, a[1]) for a in arcs if not a[8]]
    left += [(-p, False, -c, 0, "path:" + i) for i, _, c, p in made]
    return priority, [m[:3] for m in made], {p[3] for p in batch if p[3]}, min(left)[4] if left else None


def test_equals_a_loop(spark):
    rng = random.Random(5)
    arcs, paths, rankings, known = [], [], [], [f"p{k}" for k in range(9)]
    for run in range(12):
        arcs += [arc(run, f"a{k}", rng.randrange(9), rng.choice([None, "One", " two ", "Three"]), rng.choice([True, True, None, False]), rng.choice([None, 0.3, 0.9, float("inf")]), rng.choice([None, scouting.MODEL]), rng.random() < 0.5, rng.random() < 0.3, rng.choice([None, 0.5, 0.7]), rng.choice([None, 1, 2])) for k in range(rng.randrange(0, 70))]
        paths += [(run, f"q{k}", rng.randrange(5), rng.choice([None, f"p{rng.randrange(12)}"]), rng.choice([None, "label", "other"])) for k in range(rng.randrange(0, 16))]
        for k in range(60):
            item = rng.choice([f"arc:a{rng.randrange(70)}", f"path:q{rng.randrange(16)}", "odd"])
            rankings.append((run, k, item, rng.choice([None, -1.0, 0.2, 0.8, 3.0]), rng.choice([0.5, 0.55, 0.9, None]), rng.choice([0.4, 0.45, 1.0]), rng.choice([True, None, False]), rng.choice([None, "ONE", "New  flow", "Third", "x"])))
    got = go(spark, arcs, paths, rankings, known)
    given = {(r.run, r.arc): r.priority for r in got.arcs.collect()}
    made = sorted((r.run, r.k, r.id, r.title, r.confidence) for r in got.created.collect())
    reviewed, following = {(r.run, r.path) for r in got.reviewed.collect()}, {r.run: r.arc for r in got.next.collect()}
    assert made and len(following) > 8
    for run in range(12):
        of = lambda rows: [r for r in rows if r[0] == run]
        priority, new, seen, then = loop(of(arcs), of(paths), of(rankings), known)
        assert {a: p for (r, a), p in given.items() if r == run and not a.startswith("path:")} == priority
        assert [m[2:] for m in made if m[0] == run] == new and following.get(run) == then
        assert {p for r, p in reviewed if r == run} == seen


def test_records_of_runs(spark):
    arcs = [arc(1, f"a{k}", k, qualifies=None if k else False) for k in range(12)] + [arc(None, "lost"), arc(2, "done", completed=True)]
    got = go(spark, arcs, [(3, "q", 1, "p", None), (3, "q2", 1, None, "L")], [(1, 1, "arc:a3", 0.4, None, None, None, None), (3, 1, "path:q", 0.0, 1.0, 1.0, None, None)], ["p"])
    assert {tuple(r) for r in got.runs.select("run", "offered", "ranked", "created", "next").collect()} == {(1, 0, 1, 0, "a3"), (2, 0, 0, 0, None), (3, 2, 0, 1, "path:q")}
    offered = scouting.unranked(spark.createDataFrame(arcs, ARC)).where("run = 1").orderBy("k").collect()
    assert [r.arc for r in offered] == [f"a{k}" for k in range(1, 9)]
    runs = spark.createDataFrame([(1, k, 0) for k in range(130)], "run int, step int, created int")
    assert sorted(r.step for r in scouting.history(runs).collect()) == list(range(10, 130))


def test_empty_tables(spark):
    got = go(spark, [], [], [], [])
    assert [df.count() for df in (got.arcs, got.created, got.reviewed, got.next, got.runs)] == [0] * 5


def test_priorities_with_nulls(spark):
    rows = spark.createDataFrame([("calls", "symbol", None, "placeOrder", 3), ("triggers", "external_boundary", None, None, 3), ("call_path", None, "a/b", "x", None), (None, "call_path_seed", None, None, 7), (None, None, None, None, None)], "relation string, kind string, path string, label string, n int")
    args = [F.col(c) for c in ("relation", "kind", "path", "label")]
    got = rows.select(choosing.flow_priority(*args).alias("f"), choosing.boundary_priority(*args).alias("b"), choosing.slice_priority(*args).alias("s"), choosing.path_priority(*args, F.col("n")).alias("p")).collect()
    assert [tuple(r) for r in got] == [(162, 162, 162, 162), (20, 200, 290, 290), (20, 20, 20, 120), (20, 20, 20, 127), (20, 20, 20, 20)]
