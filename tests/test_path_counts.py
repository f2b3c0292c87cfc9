"""Counted path graphs against listing, parts against plain search, and sizes no list could have."""

import random
from collections import Counter

import pytest

from quarry.operators import graph, path_counts


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(list(edges), "src string, dst string")


def reach(edges, a):
    seen, todo = {a}, [a]
    while todo:
        x = todo.pop()
        new = {d for s, d in edges if s == x and d is not None} - seen
        seen |= new
        todo += new
    return seen


def test_parts_equal_plain_search(spark):
    rng = random.Random(7)
    nodes = [f"n{k:02d}" for k in range(26)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(34)] + [("n00", "n00"), ("n01", None), ("n02", "gone"), ("n03", "n04"), ("n03", "n04")]
    known = [(a, b) for a, b in edges if b in nodes]
    to = {n: reach(known, n) for n in nodes}
    expect = {n: min(m for m in to[n] if n in to[m]) for n in nodes}
    got = {r.id: r.part for r in path_counts.strong_parts(*frames(spark, nodes, edges)).collect()}
    assert got == expect and len(set(got.values())) < len(nodes)


def test_counts_equal_listing(spark):
    rng = random.Random(8)
    nodes = [f"n{k:02d}" for k in range(12)] + ["alone"]
    edges = {(f"n{a:02d}", f"n{b:02d}") for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.25}
    n, e = frames(spark, nodes, edges)
    g = path_counts.PathGraph(n, e)
    listed = [tuple(r.path) for r in graph.maximal_paths(n, e).collect()]
    by_ends = Counter((p[0], p[-1]) for p in listed)
    assert {(r.root, r.leaf): int(r.paths) for r in g.pairs().collect()} == by_ends
    through = Counter(x for p in listed for x in p)
    rows = {r.id: r for r in g.counts().collect()}
    assert {k: int(r.through) for k, r in rows.items()} == through
    assert {k for k, r in rows.items() if r.is_root} == {p[0] for p in listed} and {k for k, r in rows.items() if r.is_leaf} == {p[-1] for p in listed}
    assert all(r.longest == max(len(p) - p.index(k) for p in listed if k in p) for k, r in rows.items())
    # Every path has a number, in the order of names.
    wanted = [(root, k) for root in {p[0] for p in listed} for k in range(-1, 1 + sum(p[0] == root for p in listed))]
    got = {}
    for r in g.numbered(spark.createDataFrame(wanted, "root string, number long")).collect():
        got.setdefault(r.root, []).append((int(r.number), tuple(r.path)))
    for root, paths in got.items():
        assert [p for _, p in sorted(paths)] == sorted(p for p in listed if p[0] == root)
    assert set(got) == {p[0] for p in listed}


def test_cycles_shrink_to_parts(spark):
    n, e = frames(spark, "abcdef", [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("b", "e"), ("f", "f")])
    g = path_counts.PathGraph(n, e)
    assert {(r.root, r.leaf, int(r.paths)) for r in g.pairs().collect()} == {("a", "d", 1), ("a", "e", 1), ("f", "f", 1)}
    rows = {r.id: (r.part, r.size) for r in g.counts().collect()}
    assert rows["b"] == rows["c"] == ("b", 2) and rows["f"] == ("f", 1)


@pytest.mark.parametrize("layers", [60])
def test_diamonds_are_counted(spark, layers):
    """2 ** layers paths: two nodes a layer, and a joint between layers."""
    edges = [x for k in range(layers) for s in "ab" for x in ((f"j{k:02d}", f"{s}{k:02d}"), (f"{s}{k:02d}", f"j{k + 1:02d}"))]
    n, e = frames(spark, sorted({x for p in edges for x in p}), edges)
    ((root, leaf, paths),) = [(r.root, r.leaf, int(r.paths)) for r in path_counts.PathGraph(n, e).pairs().collect()]
    assert (root, leaf, paths) == ("j00", f"j{layers:02d}", 2**layers)


def test_empty_graph(spark):
    n, e = frames(spark, [], [])
    g = path_counts.PathGraph(n, e)
    assert g.counts().count() == g.pairs().count() == 0


def test_a_dense_core_is_walked_by_levels(spark):
    """Every node has an edge to all later ones: nothing with many edges may go."""
    nodes = [f"n{k:02d}" for k in range(9)]
    n, e = frames(spark, nodes, [(a, b) for a in nodes for b in nodes if a < b])
    assert [int(r.paths) for r in path_counts.PathGraph(n, e).pairs().collect()] == [2**7]


def test_parts_of_a_shallow_graph_without_cycles_need_no_elimination(spark, monkeypatch):
    edges = [(f"{a}{i}", f"{b}{j}") for a, b in ("ab", "bc", "cd") for i in range(4) for j in range(4)]
    n, e = frames(spark, sorted({x for p in edges for x in p}), edges + edges[:3] + [("a0", "a0"), ("d1", None)])
    whole = {tuple(r) for r in path_counts.PathGraph(n, e).pairs().collect()}
    assert {(r, f, int(p)) for r, f, p in whole} == {(f"a{i}", f"d{j}", 16) for i in range(4) for j in range(4)}
    # Without a table of nodes, they are the ends of the edges.
    assert {tuple(r) for r in path_counts.PathGraph(None, e).pairs().collect()} == whole
    monkeypatch.setattr(path_counts, "_eliminate", None)
    assert all(r.id == r.part for r in path_counts.strong_parts(n, e).collect())


def test_big_tables_are_joined_by_hashes(spark, monkeypatch):
    """The same parts where node tables are joined by hashes."""
    monkeypatch.setattr(path_counts, "MANY", 0)
    n, e = frames(spark, "abcdef", [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f")])
    assert {tuple(r) for r in path_counts.strong_parts(n, e).collect()} == {("a", "a"), ("b", "b"), ("c", "b"), ("d", "d"), ("e", "d"), ("f", "f")}


def test_blocks_are_searched_on_their_own(spark, monkeypatch):
    """Small blocks in tasks; a large one, and edges without a block, by elimination."""
    rng = random.Random(12)
    edges = [(b, f"{b}{rng.randrange(9)}", f"{b}{rng.randrange(9)}") for b in "pqr" for _ in range(13)] + [("z", "z1", "z2"), ("z", "z2", "z3"), ("z", "z3", "z1"), ("z", "z3", "gone")]
    nodes = sorted({x for e in edges for x in e[1:]} - {"gone"}) + ["alone"]
    to = {n: reach([(a, b) for _, a, b in edges if b in nodes], n) for n in nodes}
    expect = {n: min(m for m in to[n] if n in to[m]) for n in nodes}
    n, _ = frames(spark, nodes, [("a", "b")])
    eliminate = path_counts._eliminate
    monkeypatch.setattr(path_counts, "_eliminate", None)
    e = spark.createDataFrame(edges, "block string, src string, dst string")
    assert {r.id: r.part for r in path_counts.strong_parts(n, e).collect()} == expect
    monkeypatch.setattr(path_counts, "_eliminate", eliminate)
    monkeypatch.setattr(path_counts, "BLOCK", 5)
    e = spark.createDataFrame([(b if b != "r" else None, s, d) for b, s, d in edges if b > "q"], "block string, src string, dst string")
    got = {r.id: r.part for r in path_counts.strong_parts(n, e).collect()}
    assert {k: v for k, v in got.items() if k[0] in "rz"} == {k: v for k, v in expect.items() if k[0] in "rz"}
