"""Projections and lookups on small inputs."""

from pyspark.sql import functions as F

from quarry.operators import graph, incremental, knowledge


def test_markup_references(spark):
    body = '<service-call name="a.b#C"/><transition name="go"/><entity-find entity-name="Order"/><entity-make entity-name="Part"/><serve name="x"/>'
    df = spark.createDataFrame([(1, body)], "id int, body string")
    got = [(r.name, r.simple_name, r.relation) for r in knowledge.markup_references(df).orderBy("pos").collect()]
    assert got == [("a.b#C", "C", "calls"), ("go", "go", "routes_to"), ("Order", "Order", "reads"), ("Part", "Part", "writes")]
    assert knowledge.markup_references(df, most=2).count() == 2
    assert df.select(knowledge.entity_names(F.col("body")).alias("x")).first().x == ["Order", "Part"]


def test_packets_of_symbols(spark):
    df = spark.createDataFrame([(1, "async go(a, int b = 2, c: T)", "if (a > 1) { run(a); other.call(b) }\nreturn done;")], "id int, signature string, body string")
    p = knowledge.canonical_packet(df).first()
    assert p.inputs == ["a", "b", "c"] and p.operations == ["run", "other.call"] and p.conditions == ["a > 1"] and p.outputs == ["done"]


def test_concepts(spark):
    df = spark.createDataFrame([(1, "A sales order line and a Sales Order."), (2, "none")], "id int, text string")
    got = [(r.id, r.label) for r in knowledge.linked_concepts(df, ["sales order", "sales order line", "a"]).orderBy("pos").collect()]
    assert got == [(1, "sales order line"), (1, "Sales Order")]
    assert knowledge.linked_concepts(df, []).count() == 0


def test_filters(spark):
    e = spark.createDataFrame([("a", "b", "calls", "f", "g"), ("a", "b", "next_in_source", "f", "g"), ("a", "b", "next_in_source", "f", "f"), ("a", "b", "odd", "f", "f")], "src string, dst string, relation string, src_path string, dst_path string")
    assert knowledge.allowed_edges(e).count() == 2
    u = spark.createDataFrame([("service", " <service-call name='x'/>"), ("service", "<service verb='x'>"), ("code", "<service-call/>")], "kind string, body string")
    assert knowledge.real_services(u).count() == 2
    r = spark.createDataFrame([("a.b", "calls", False), ("plain", "calls", False), ("E x", "reads", False), ("y", "calls", True)], "name string, relation string, explicit boolean")
    assert {x.id for x in knowledge.boundary_nodes(r).collect()} == {"external:a.b", "external:E%20x", "external:y"}


def test_links_round_trip(spark):
    n = spark.createDataFrame([("a", [("b", "x"), ("c", "y"), ("b", "x")])], "id string, links array<struct<node:string,relationship:string>>")
    assert knowledge.gather_links(knowledge.flatten_links(n)).collect() == n.collect()


def test_arcs_and_representations(spark):
    arcs = spark.createDataFrame([("late", 2, [["p1"], ["p2"]]), ("early", 1, [[], ["p2", "p2"]])], "arc string, ord int, lists array<array<string>>")
    paths = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "path string")
    assert {tuple(r) for r in knowledge.arc_of_path(paths, arcs).collect()} == {("p1", "late"), ("p2", "early"), ("p3", None)}
    m = spark.createDataFrame([("Customer", "party"), ("Gone", "none")], "business string, physical string")
    f = spark.createDataFrame([("party", "id", "schema"), ("party", "n", "schema")], "entity string, field string, description string")
    said = spark.createDataFrame([("party", "n", "learned"), ("party", "id", "")], "entity string, field string, description string")
    assert {tuple(r) for r in knowledge.representations(m, f, said).collect()} == {("Customer", "party", "id", "schema"), ("Customer", "party", "n", "learned"), ("Gone", "none", None, None)}


def test_orders_and_choices(spark):
    s = spark.createDataFrame([(x,) for x in ("B", "a#1", "_z", "b", "A", "a")], "x string")
    assert [r.x for r in knowledge.collated(s, "x").collect()] == ["_z", "a", "A", "a#1", "b", "B"]
    score = lambda *rows: spark.createDataFrame(rows, "name string, score double")
    assert tuple(knowledge.start_choice(score(("e", 0.5)), score(("w", 0.5))).first()) == ("e", "entity", 0.5)
    steps = spark.createDataFrame([("a", ["a", "b"], ["a"]), ("c", ["a"], ["c"]), ("d", ["a"], ["c"])], "id string, path array<string>, visited array<string>")
    assert [r.edge for r in knowledge.back_edges(steps).orderBy("id").collect()] == ["cycle", "reuse", "new"]


def test_aliases_budgets_and_fingerprints(spark):
    a = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(9)] + [("x", "y"), ("y", "x")], "alias string, target string")
    got = {r.alias: r.target for r in graph.follow_aliases(a).collect()}
    assert all(got[f"n{k}"] == "n9" for k in range(9)) and set(got) >= {"x", "y"}
    rows = spark.createDataFrame([(g, k) for g in "ab" for k in range(5)], "g string, k int")
    assert incremental.budgeted(rows, "g", ["k", "g"], each=3, total=5).count() == 5
    done = rows.limit(4).select(F.sha1(F.to_json(F.struct("g", "k"))).alias("fingerprint"))
    assert incremental.not_attempted(rows, done, ["g", "k"]).count() == 6
