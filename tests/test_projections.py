"""Projections on small inputs."""

from pyspark.sql import functions as F

from quarry.operators import projections as p


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


def test_files(spark):
    files = spark.createDataFrame([("a.py", "x"), ("b.json", "{}"), ("c.md", "y" * 50000), ("d.bin", None), ("e.yml", "")], "path string, text string")
    symbols = spark.createDataFrame([("a.py", "g", 9), ("a.py", "f", 1)], "path string, name string, line int")
    values = spark.createDataFrame([("b.json", "k", "v", None), ("b.json", "j", "w", 1)], "path string, key string, value string, line int")
    got = {r.path: (r.kind, r.symbols, r.settings, r.excerpt and len(r.excerpt)) for r in p.file_views(files, symbols, values).collect()}
    assert got == {"a.py": ("source_file_index", ["f", "g"], None, None), "b.json": ("config_file", None, ["k=v", "j=w"], None), "c.md": ("text_file", None, None, 40000), "d.bin": ("opaque_file", None, None, None), "e.yml": ("config_file", None, [], None)}
    kinds = spark.createDataFrame([("dir:a/b",), ("xmlnode:x",), ("a/b#f",), ("a/b.c",), ("sym",)], "id string")
    kind, key = p.artifact_kind(F.col("id"))
    assert rows(kinds.select(kind.alias("k"), key.alias("v"))) == [("dir", "a/b"), ("path", "a/b.c"), ("symbol", "a/b#f"), ("symbol", "sym"), ("xmlnode", "x")]
    units = spark.createDataFrame([("f", 2, "b", 5), ("f", 1, "a", 5), ("f", 3, "$xml.q", 1)], "path string, id int, name string, line int")
    assert rows(p.units_by_line(units), "id", "place") == [(1, 1), (2, 2)] and rows(p.units_by_line(units, markup=True), "id") == [(3,)]
    packets = spark.createDataFrame([(1, "f"), (2, "g")], "id int, source string")
    assert rows(p.with_coverage(packets, spark.createDataFrame([("f", 5, 2)], "source string, total int, visited int")), "id", "uncovered") == [(1, 3), (2, 0)]
    best = p.inventory(spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "id int, priority int"), packets, most=2)
    assert rows(best, "id", "source") == [(1, "f"), (2, "g")]


def test_trees(spark):
    tree = spark.createDataFrame([("x", 1, "r", None, 0), ("x", 2, "a", 1, 1), ("x", 3, "b", 2, 2), ("x", 4, "a", 1, 1)], "path string, ordinal int, tag string, parent int, depth int")
    assert rows(p.markup_overview(tree), "ordinal", "children") == [(1, 2), (2, 1), (4, 0)]
    assert rows(p.markup_node(tree, spark.createDataFrame([("x", 1)], "path string, ordinal int")), "child", "tag") == [(2, "a"), (4, "a")]
    files = spark.createDataFrame([(x,) for x in ("a/b/c/d/e/f/g.py", "z/q/r.py", "z/q/s/t.py", "top.py", "")], "path string")
    assert rows(p.chain_targets(files)) == [("a", "a/b/c/d/e"), ("a/b", "a/b/c/d/e/f"), ("a/b/c", "a/b/c/d/e/f"), ("a/b/c/d", "a/b/c/d/e/f"), ("a/b/c/d/e", "a/b/c/d/e/f"), ("z", "z/q")]
    shallow = {r.directory: (r.depth, r.files) for r in p.shallow_tree(files).collect()}
    assert shallow[""] == (0, ["top.py"]) and shallow["z/q"] == (2, ["r.py"]) and shallow["a/b/c"] == (3, []) and "a/b/c/d" not in shallow


def test_flows(spark):
    paths = spark.createDataFrame(
        [(1, 4, 2, 1, None, "end", None, ["a"], [["b"], ["c"]], ["d"], None), (2, 2, None, None, None, "external:calls", ["s.t"], None, None, None, ["x", "y"]), (3, 1, None, None, None, "cycle", None, None, None, None, ["x"])],
        "id int, functions int, branch_variants int, entrances int, duplicates int, terminal string, calls array<string>, prefix array<string>, branches array<array<string>>, suffix array<string>, tokens array<string>",
    )
    got = p.compact_paths(paths)
    assert rows(got, "id", "variants", "terminal", "prefix", "sequence") == [(1, 3, "end", ["a"], None), (2, 1, "external:s.t", None, ["x", "y"]), (3, 1, "cycle", None, ["x"])]
    flows = paths.where("id = 1").select(F.lit("k").alias("arc"), "prefix", "branches", "suffix")
    wanted = spark.createDataFrame([("k", None), ("k", 1), ("k", 5), ("z", 0)], "arc string, branch int")
    assert rows(p.flow_observation(flows, wanted), "branch", "tokens") == [(1, ["a", "c", "d"]), (None, ["a", "b", "c", "d"])]
    packs = p.flow_packages(flows, spark.createDataFrame([("k", "E"), ("k", "E"), ("k", "none")], "arc string, entity string"), spark.createDataFrame([("E", k, f"f{k}") for k in range(100)], "entity string, pos int, field string"), spark.createDataFrame([("E", 0, "T")], "entity string, pos int, to string"))
    assert [(r.entity, len(r.fields), r.relations) for r in packs.collect()] == [("E", 80, ["T"])]
    prints = {r.id: r.fingerprint for r in p.fingerprints(got).collect()}
    assert len(set(prints.values())) == 3 and all(len(x) == 40 for x in prints.values())


def test_resolving(spark):
    symbols = spark.createDataFrame([(1, "run", "run", "src/jobs/a.js"), (2, "Run", "Run", "src/other/jobsRun.js"), (3, "pkg.run", "run", "src/x.js")], "id int, name string, simple_name string, path string")
    refs = spark.createDataFrame([("p", "run"), ("q", "jobs.run"), ("r", "nope/run"), ("s", "..")], "ref string, name string")
    assert rows(p.resolve_qualified(refs, symbols)) == [("p", 1), ("p", 2), ("p", 3), ("q", 1), ("q", 2)]
    reached = spark.createDataFrame([(1, 1, 0), (1, 9, 1)], "start int, id int, depth int")
    assert rows(p.compact_neighbourhood(reached, symbols.withColumn("signature", F.col("name")))) == [(1, 1, 0, "run"), (1, 9, 1, "")]
    schemas = spark.createDataFrame([("Order",), ("Order Item",)], "name string")
    relations = spark.createDataFrame([("order item", "Order", "", "al", "one", [("orderId", "id")]), ("Order", "Gone", "t", "", "", None), ("Order", "orderitem", "", None, None, None)], "from string, to string, title string, alias string, type string, pairs array<struct<field:string,related:string>>")
    assert rows(p.schema_relations(relations, schemas)) == [("Order Item", "al", "Order", "Join: Order Item.orderId = Order.id"), ("Order", "references", "Order Item", "The join fields are not declared.")]


def test_arcs_and_knowledge(spark):
    arcs = spark.createDataFrame([("a", "T", "forming", 5, None, [str(k) for k in range(10)], "o", 0.456)], "id string, title string, status string, progress int, trigger string, stages array<string>, outcome string, opportunity double")
    r = p.arc_board(arcs).first()
    assert (r.trigger, r.stages, r.opportunity) == ("", [str(k) for k in range(2, 10)], "0.46")
    h = spark.createDataFrame([("h", "t", None, "i", 0.5, "r", "hypothesis"), ("g", "t", "a", "i", 1.0, "r", "rejected")], "id string, title string, actor string, intent string, confidence double, reason string, status string")
    assert rows(p.hypothesis_board(h), "id", "actor", "confidence") == [("h", "", "0.50")]
    contexts = p.entity_contexts(spark.createDataFrame([("Order",)], "name string"), spark.createDataFrame([(k, "order ") for k in range(5)], "arc int, name string"), spark.createDataFrame([(0, 2, "ORDER", "s2"), (0, 1, "order", "s1")], "arc int, ord int, name string, step string"), spark.createDataFrame([(1, 1, "Order", "Item"), (1, 2, "X", "Y")], "arc int, ord int, from string, to string"))
    assert rows(contexts) == [("Order", 0, ["s1", "s2"], []), ("Order", 1, [], ["Order → Item"]), ("Order", 2, [], [])]
    found = spark.createDataFrame([("./a\\b.js", "Find Orders", "x"), ("c", None, "has-ORDERS!"), (None, "", "z")], "path string, query string, finding string")
    assert rows(p.findings_for(found, path=F.lit("a/b.js")), "finding") == [("x",)] and rows(p.findings_for(found, query=F.lit("orders")), "finding") == [("has-ORDERS!",), ("x",)]
    seeds = p.seed_projection(spark.createDataFrame([("a",), ("q",)], "arc string"), spark.createDataFrame([("a", "T", None, "p")], "arc string, title string, opportunity double, path string"), spark.createDataFrame([("p", "e", ["f", "g"])], "path string, entry string, sources array<string>"))
    assert rows(seeds) == [("a", "T", 0.0, "p", "e", "f")]
    more = p.accumulated(spark.createDataFrame([("a", ["x"], None), ("a", ["y", "x"], ["e"])], "arc string, objects array<string>, effects array<string>"), "arc", ["objects", "effects"])
    assert rows(more) == [("a", ["x", "y"], ["e"])]
    s = p.session_context(spark.createDataFrame([("s", ["a"], 1)], "session string, open array<string>, round int"))
    assert rows(s) == [("s", '{"open":["a"],"round":1}')]


def test_judgments(spark):
    good = '{"role": "story", "path": " p ", "meaning": " m ", "scores": [{"id": "a", "continuity": 1.7, "coherence": -1}], "next": {"type": "artifact", "id": "a"}}'
    replies = spark.createDataFrame([(1, good), (2, "not json"), (3, '{"role": "odd", "next": {"type": "fly"}, "scores": [{"id": "z"}]}'), (4, '{"role": "story", "next": {"type": "artifact", "id": "q"}}'), (5, None)], "step int, reply string")
    n = p.normalised(replies)
    got = {r.step: r for r in n.collect()}
    assert (got[1].role, got[1].path, got[1].meaning, got[1].next_type, got[1].next_id) == ("story", "p", "m", "artifact", "a")
    assert tuple(got[1].scores[0]) == ("a", 1.0, 0.0, 0.0) and (got[3].role, got[3].next_type) == ("unattached", "stop")
    offered = spark.createDataFrame([(1, "a"), (3, "a")], "step int, id string")
    assert {r.step: r.faults for r in p.faults(n, offered).collect()} == {1: [], 2: ["not_json"], 3: ["unknown_candidate", "unscored_candidate"], 4: ["story_without_path", "unknown_next"], 5: ["not_json"]}
