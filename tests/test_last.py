"""Packets, module bodies, loose families, scouting and nodes on small inputs."""

import itertools
import random

from pyspark.sql import functions as F

from quarry.operators import families, incremental, knowledge, projections, states


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


def test_canonical_packets(spark):
    s = spark.createDataFrame([(1, "f(a, int b = 2)", "if (x > 1) { return y; } <parameter name='p'/> <entity-find list=\"l\" condition='q'/><econdition field-name=\"s\" value=\"v\"/><econdition field-name='t'/>", "p.js", 1, 9), (2, "g()", "", "p.js", 10, 12)], "id int, signature string, body string, path string, start_line int, end_line int")
    refs = spark.createDataFrame([(1, 1, "writes", "E"), (1, 0, "calls", "h")], "id int, pos int, relation string, name string")
    got = {r.id: r for r in knowledge.canonical_packet(s, refs).collect()}
    assert (got[1].inputs, got[1].outputs, got[1].conditions) == (["a", "b", "p"], ["y", "l"], ["x > 1", "q", "s=v", "t"])
    assert (got[1].operations, got[1].effects, tuple(got[1].provenance)) == (["calls:h", "writes:E"], ["writes:E"], ("p.js", 1, 9))
    assert (got[2].operations, got[2].effects) == (["execute"], [])
    assert rows(knowledge.canonical_packet(s.drop("path", "start_line", "end_line")), "id", "operations") == [(1, ["execute"]), (2, ["execute"])]


def test_module_bodies(spark):
    text = "\n".join(["import x", "// no", "", "function f() {", "}", "run()", *(f"l{k}" for k in range(100))])
    f = spark.createDataFrame([("a", text), ("b", "# c\n\n")], "source string, text string")
    (r,) = incremental.module_bodies(f, spark.createDataFrame([("a", 4, 5)], "source string, start long, end long")).collect()
    assert r.line == 1 and r.body.split("\n") == ["import x", "run()", *(f"l{k}" for k in range(78))]


def test_description_budget(spark):
    entities = spark.createDataFrame([(f"e{k}", k) for k in range(8)], "entity string, ord int")
    fields = spark.createDataFrame([(f"e{k}", j, f"f{j}", "said" if k == 1 else None) for k in range(8) for j in range(25)], "entity string, pos int, field string, description string")
    got = rows(incremental.description_targets(entities, fields))
    assert len(got) == 54 and {e for e, *_ in got} == {"e0", "e2", "e3"} and max(p for _, p, _ in got) == 17
    left = iter([2, 1, 0, 5])
    assert incremental.passes(lambda: next(left)) == 3 and incremental.passes(lambda: 1) == 3


def test_loose_families_against_one_greedy_loop(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))] for _ in range(25)]
    paths = [t[:] for t in base] + [t[:-1] + ["z"] for t in base[:12]] + [["y"] + t[1:] for t in base[5:18]] + [t + ["x"] for t in base[:6]]
    df = spark.createDataFrame([(k, t, -len(t)) for k, t in enumerate(paths)], "id int, tokens array<string>, rank int")
    groups = []
    for k in sorted(range(len(paths)), key=lambda k: (-len(paths[k]), k)):
        home = next((g for g in groups if any(families._loose_shape(paths[m], paths[k]) != "independent" for m in g)), None)
        groups.append([k]) if home is None else home.append(k)
    want = {k: g[0] for g in groups for k in g}
    assert {r.id: r.family for r in families.loose_families(df).collect()} == want and len(groups) < len(paths)


def test_loose_shapes():
    shape = families._loose_shape
    assert shape([*"abcd"], [*"abcd"]) == "duplicate" and shape([*"ab"], [*"abc"]) == "independent"
    assert shape([*"xabcd"], [*"abcd"]) == "alternate_entrance" and shape([*"abcde"], [*"abcdx"]) == "branch"
    assert shape([*"xabcy"], [*"abc"]) == "normalized_variant"
    for a, b in itertools.product(["abcdef", "xabcde", "abxdef"], repeat=2):
        assert shape([*a], [*b]) == shape([*b], [*a])


def test_scout_loop(spark):
    ranked = spark.createDataFrame([(f"p{k:02}", k) for k in range(30)], "path string, rank int")
    judged = spark.createDataFrame([("p13", True, 0.4), ("p14", True, 0.9), ("p02", False, 1.0), ("p29", True, 1.0)], "path string, promoted boolean, worth double")
    seen, best = states.scout_loop(ranked, judged)
    assert seen.count() == 24 and rows(best) == [("p14",)]
    seen, best = states.scout_loop(ranked, judged.limit(0))
    assert seen.count() == 30 and best.count() == 0


def test_nodes_and_picks(spark):
    wanted = spark.createDataFrame([("Order",), ("None",)], "name string")
    fields = spark.createDataFrame([("order", f"f{k:02}", k) for k in range(20)] + [("order", "f19", 0)], "entity string, field string, score int")
    relations = spark.createDataFrame([("Order", "Item"), ("Party", " order"), ("Order", "Order")], "from string, to string")
    uses = spark.createDataFrame([(1, "Order"), (2, "order "), (2, "Item"), (3, "Item")], "arc int, entity string")
    got = {r.name: r for r in projections.entity_nodes(wanted, fields, relations, uses).collect()}
    assert got["Order"].fields[0] == "f19" and len(got["Order"].fields) == 18 and got["Order"].connected == ["Item", "Party"] and got["Order"].workflows == ["1", "2"]
    assert got["None"].fields == [] and got["None"].connected == []
    w = projections.workflow_nodes(spark.createDataFrame([(2,), (9,)], "arc int"), spark.createDataFrame([(2, 2, "b"), (2, 1, "a")], "arc int, ord int, step string"), uses)
    assert rows(w) == [(2, ["a", "b"], ["Item", "order"], ["1", "3"]), (9, [], [], [])]
    shown = relations.withColumn("relation", F.lit("r")).select("from", "relation", "to")
    assert rows(projections.retained(spark.createDataFrame([("item", "ORDER"), ("x", "y")], "from string, to string"), shown)) == [("Order", "r", "Item")]
