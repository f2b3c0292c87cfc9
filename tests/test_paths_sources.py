"""Paths that end outside, merged families, sources, links and decays on small inputs."""

import random

from pyspark.sql import functions as F

from quarry.operators import arcs, families, graph, knowledge, ranking
from quarry.sources import files


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


def test_paths_end_at_what_is_not_there(spark):
    nodes = spark.createDataFrame([(x,) for x in "ABCDPQ"], "id string")
    edges = spark.createDataFrame([("A", "B", "calls"), ("A", "C", "calls"), ("P", "Q", "calls"), ("Q", "P", "calls")], "src string, dst string, relation string")
    missing = spark.createDataFrame([("B", "stripe.charge", "calls"), ("B", "a.b", "calls"), ("C", "x", "reads"), ("A", "y", "calls")], "id string, name string, relation string")
    got = rows(graph.maximal_paths(nodes, edges, unresolved=missing))
    assert got == [(["A", "B"], "external:calls", "a.b,stripe.charge"), (["A", "C"], "end", None), (["D"], "end", None), (["P", "Q"], "cycle", "P")]


def test_separate_cycles_are_walked_at_once(spark):
    edges = spark.createDataFrame([(3 * k + a, 3 * k + b) for k in range(20) for a, b in ((0, 1), (1, 2), (2, 0))], "src int, dst int")
    nodes = spark.createDataFrame([(k,) for k in range(60)], "id int")
    got = rows(graph.maximal_paths(nodes, edges), "path")
    assert got == sorted((([3 * k, 3 * k + 1, 3 * k + 2],) for k in range(20)), key=repr)


def merged(spark, *paths):
    df = spark.createDataFrame([(k, list(t), -len(t)) for k, t in enumerate(paths)], "id int, tokens array<string>, rank int")
    return families.merged_families(df, families.path_families(df)).collect()


def test_merged_structures(spark):
    head = ["login", "actions", "script", "existing"]
    (r,) = merged(spark, [*head, "a"], [*head, "b"])
    assert (r.variants, r.entrances, r.prefix, r.branches, r.suffix) == (2, 0, head, [["a"], ["b"]], [])
    (r,) = merged(spark, [*head, "a", "merge"], [*head, "b", "merge"])
    assert (r.prefix, r.branches, r.suffix) == (head, [["a"], ["b"]], ["merge"])
    (r,) = merged(spark, ["a", "core", "s2", "s3", "s4"], ["x", "core", "s2", "s3", "s4"])
    assert (r.variants, r.entrances, r.duplicates, r.branches) == (1, 1, 0, None)
    tail = ["t1", "t2", "t3", "t4"]
    assert len(merged(spark, ["a", "b", "c", *tail], ["x", "y", "z", *tail])) == 2


def test_containers_against_all_pairs(spark):
    rng = random.Random(4)
    paths = [(k, [rng.choice("abc") for _ in range(rng.randint(0, 7))]) for k in range(80)]
    df = spark.createDataFrame([(k, t, k) for k, t in paths], "id int, tokens array<string>, ord int")
    want = []
    for k, t in paths:
        over = [(len(u), j) for j, u in paths if len(u) > len(t) and t and any(u[i : i + len(t)] == t for i in range(len(u)))]
        want += [(k, min(over)[1])] if over else []
    assert rows(ranking.minimal_container(df)) == sorted(want, key=repr)


def test_decay_against_a_loop(spark):
    rng = random.Random(3)
    log = [(k % 3, k, None if rng.random() < 0.3 else rng.random()) for k in range(90)] + [(9, 0, None)]
    want = {}
    for key, _, s in log:
        o = want.get(key, 0.0)
        want[key] = o * 0.985 if s is None else max(o * 0.96, s)
    got = {r.key: r.opportunity for r in arcs.decay(spark.createDataFrame(log, "key int, step int, score double"), "key", "step", "score").collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_dependencies(spark):
    text = spark.createDataFrame([("a", '<depends-on name="b"/><depends-on version="1" name=\'c\'/> runtime:component:d-1'), ("b", '<depends-on name="e"/>'), ("e", '<depends-on name="a"/>')], "component string, text string")
    d = files.dependencies(text)
    assert rows(d) == [("a", "b"), ("a", "c"), ("a", "d-1"), ("b", "e"), ("e", "a")]
    start = spark.createDataFrame([("b",)], "component string")
    assert [r[0] for r in rows(files.reachable(start, d))] == ["a", "b", "c", "d-1", "e"]
    hits = spark.createDataFrame([("q1", "x")], "query string, hit string")
    extra = spark.createDataFrame([("q1", "s1", "no"), ("q2", "s2", "late"), ("q2", "s1", "y"), ("q3", "s4", "too far")], "query string, source string, hit string")
    order = spark.createDataFrame([(f"s{k}", k) for k in range(1, 5)], "source string, ord int")
    assert rows(files.attach_missing(hits, extra, order)) == [("q1", "x"), ("q2", "y")]


def test_store_keeps_what_lasts(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    assert files.load_store(spark, folder) == files.STORE
    files.save_store(spark, folder, files.STORE | {"status": "exploring", "workflows": "[1]", "events": "[2]"})
    assert files.load_store(spark, folder) == files.STORE | {"workflows": "[1]"}
    files.save_store(spark, folder, files.STORE)
    assert files.load_store(spark, folder) == files.STORE


def test_directory_preview(spark):
    f = spark.createDataFrame([(x,) for x in ["a/b.py", "a/c/d.py", "a/c/e.txt", "a/f", "top", *(f"z/{k:02}.js" for k in range(12))]], "path string")
    got = {r.dir: r for r in files.directory_preview(f).collect()}
    assert set(got) == {"a", "z"} and (got["a"].descendants, got["a"].direct_files, got["a"].direct_dirs, got["a"].files) == (4, 2, 1, ["b.py", "f"])
    assert got["a"].extensions == {"": 1, ".py": 2, ".txt": 1} and got["z"].files == [f"{k:02}.js" for k in range(8)]


def test_links(spark):
    b = spark.createDataFrame([("ext", "c1"), ("ext", "c2")], "boundary string, caller string")
    e = spark.createDataFrame([("c1", "ext", "calls", 9), ("c1", "n", "calls", 5), ("c2", "n", "reads", 7), ("c2", "m", "calls", 6), ("z", "q", "calls", 9)], "src string, dst string, relation string, priority int")
    assert rows(knowledge.resume_candidates(b, e)) == [("ext", "m", "calls"), ("ext", "n", "reads")]
    links = spark.createDataFrame([("a", "b", "r", 0), ("a", "b", "r", 1), ("c", "b", "r", 0)], "src string, dst string, relationship string, pos int")
    ids = [r.id for r in knowledge.numbered_links(links).collect()]
    assert len(set(ids)) == 3 and all(x.startswith("relation:") and len(x) == 25 for x in ids)
    w = spark.createDataFrame([("w", "W", "closed"), ("v", "V", "open"), ("u", "U", "closed")], "arc string, title string, state string")
    l2 = spark.createDataFrame([("w", "e2", "uses", 2), ("w", "e1", "uses", 1), ("w", "s", "has", 0), ("v", "e1", "uses", 0)], "src string, dst string, relationship string, pos int")
    n = spark.createDataFrame([("e1", "entity", "E1"), ("e2", "entity", "E2"), ("s", "step", "S")], "id string, type string, name string")
    assert rows(knowledge.closed_workflows(w, l2, n)) == [("u", "U", [], []), ("w", "W", ["E1", "E2"], ["S"])]


def test_schema_candidates_with_context(spark):
    names = spark.createDataFrame([("Order",)], "name string")
    schemas = spark.createDataFrame([("OrderHeader",), ("SalesOrder",), ("Order",), ("Party",)], "schema string")
    fields = spark.createDataFrame([("Party", "orderId")], "schema string, field string")
    context = spark.createDataFrame([("Order", "Party", "workflow"), ("Order", "SalesOrder", "representation"), ("Order", "OrderHeader", "representation"), ("Gone", "Party", "workflow")], "name string, schema string, how string")
    assert {r.schema: r.score for r in ranking.candidate_schemas(names, schemas, fields).collect()} == {"OrderHeader": 8, "SalesOrder": 5, "Party": 3}
    assert {r.schema: r.score for r in ranking.candidate_schemas(names, schemas, fields, context=context).collect()} == {"OrderHeader": 9, "SalesOrder": 9, "Party": 10}
    assert spark.range(1).select(ranking.kind_adjustment(F.lit("screen"), structured=True)).first()[0] == 140
