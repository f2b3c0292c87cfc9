"""Operators on small inputs: the cases that shared tables don't hold."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import arrays, text
from quarry.operators import arcs, evidence, extract, families, graph, incremental, schema_graph, search
from quarry.operators.components import connected_components
from quarry.plans.dataview import Item, Join, Link, UnevidencedJoin, View, compile_view, describe, friendly, sanitise
from quarry.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def paths_of(spark, edges, nodes=None):
    nodes = nodes or sorted({n for e in edges for n in e})
    n = spark.createDataFrame([(x,) for x in nodes], "id string")
    e = spark.createDataFrame(edges, "src string, dst string")
    return {("".join(r.path), r.terminal, r.target) for r in graph.maximal_paths(n, e).collect()}


@pytest.mark.parametrize(
    "edges, want",
    [
        (["AB", "AC", "BD", "CD"], {("ABD", "end", None), ("ACD", "end", None)}),
        (["AB", "BC", "CB"], {("ABC", "cycle", "B")}),
        (["AB", "XY", "YX"], {("AB", "end", None), ("XY", "cycle", "X")}),
    ],
)
def test_maximal_paths(spark, edges, want):
    assert paths_of(spark, [tuple(e) for e in edges]) == want


def test_paths_beyond_the_bound_are_an_error(spark):
    edges = [(f"{k:02d}{a}", f"{k + 1:02d}{b}") for k in range(8) for a in "ab" for b in "ab"]
    n = spark.createDataFrame([(x,) for x in {y for e in edges for y in e}], "id string")
    with pytest.raises(ValueError):
        graph.maximal_paths(n, spark.createDataFrame(edges, "src string, dst string"), most=100).count()


def test_suffix_elimination_leaves_no_suffix(spark):
    paths = ["ABCD", "BCD", "CD", "XCD", "ABC"]
    df = spark.createDataFrame([(list(p), "end", None) for p in paths], "path array<string>, terminal string, target string")
    assert sorted("".join(r.path) for r in graph.drop_suffixes(df).collect()) == ["ABC", "ABCD", "XCD"]
    assert graph.fragments(df).count() == len({p[i:] for p in paths for i in range(len(p))})


@pytest.mark.parametrize(
    "a, b, relation, prefix, suffix",
    [
        ("LASEA", "LASEB", "branch", 4, 0),
        ("LASEAM", "LASEBM", "branch", 4, 1),
        ("ACDEF", "XCDEF", "alternate_entrance", 0, 4),
        ("abcWXYZ", "defWXYZ", "shared_subflow", 0, 4),
        ("AB", "AB", "duplicate", 2, 0),
        ("AB", "CD", "independent", 0, 0),
        ("", "AB", "independent", 0, 0),
        ("ABAB", "AB", "branch", 2, 0),
    ],
)
def test_overlap_shapes(spark, a, b, relation, prefix, suffix):
    cols = [F.array(*map(F.lit, x)).cast("array<string>") for x in (a, b)]
    r = spark.range(1).select(*(c.alias(n) for c, n in zip(families.overlap_relation(*cols), "rapq"))).first()
    assert (r.r, r.p, r.q) == (relation, prefix, suffix)
    assert families._shape(list(a), list(b)) == relation


def test_families_keep_the_greedy_order(spark):
    rng = random.Random(3)
    rows = [(k, list("".join(rng.choice("AB") for _ in range(rng.randint(2, 6)))), k) for k in range(40)]
    got = {r.id: r.family for r in families.path_families(spark.createDataFrame(rows, "id long, tokens array<string>, rank long")).collect()}
    groups = []
    for k, tokens, _ in rows:
        home = next((g for g in groups if any(families._shape(m, tokens) in families.MERGEABLE for _, m in g)), None)
        if home is None:
            groups.append(home := [])
        home.append((k, tokens))
    assert got == {k: g[0][0] for g in groups for k, _ in g}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 380)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_noisy_or_properties(spark):
    rng = random.Random(2)
    for values in ([0.9, 0.5], [1.0, 0.2], [0.0], [float("inf"), 0.1], [float("nan"), 0.4], [rng.random() for _ in range(6)]):
        results = set()
        for order in itertools.islice(itertools.permutations(values), 3):
            df = spark.createDataFrame([(1, float(v)) for v in order], "k int, strength double")
            results.add(round(evidence.noisy_or(df, ["k"]).first().confidence, 9))
        assert len(results) == 1 and 0 <= results.pop() <= 1


def test_interval_union_is_idempotent(spark):
    rng = random.Random(8)
    rows = [(k % 3, s := rng.randrange(100), s + rng.randrange(8)) for k in range(60)]
    once = incremental.interval_union(spark.createDataFrame(rows, "k int, start long, end long"), ["k"])
    assert sorted(once.collect()) == sorted(incremental.interval_union(once, ["k"]).collect())
    cover = lambda rs: {(k, x) for k, s, e in rs for x in range(s, e + 1)}
    assert cover(once.collect()) == cover(rows)
    assert all(b.start > a.end + 1 for a, b in itertools.pairwise(sorted(once.collect())) if a.k == b.k)


def test_reuse_plan_states(spark):
    items = spark.createDataFrame([(1, ["./A/b.js"]), (2, ["c.js"]), (3, [])], "item int, files array<string>")
    changed = spark.createDataFrame([("a/b.js",)], "path string")
    assert sorted((r.item, r.decision) for r in incremental.reuse_plan(items, changed).collect()) == [(1, "review"), (2, "reuse"), (3, "review")]
    for state, decision in (("first", "review"), ("unchanged", "reuse"), ("unknown", "review"), ("unprepared", "none")):
        assert {r.decision for r in incremental.reuse_plan(items, changed, state).collect()} == {decision}


def test_normalisation(spark):
    maps = [("customerId", "id")]
    nodes = spark.createDataFrame(
        [
            ("e0", "entity", "Customer", None, None, False, 0),
            ("e1", "entity", "customer", None, None, True, 1),
            ("e2", "entity", "Order", None, None, True, 2),
            ("c", "concept", "CUSTOMER", None, None, False, 3),
            ("f1", "field", "customerId", "Order", "customerId", False, 4),
            ("f2", "field", "id", "customer", "id", False, 5),
            ("f3", "field", "id", "Someone", "id", False, 6),
        ],
        "id string, type string, name string, owner string, field string, resolved boolean, seq long",
    )
    links = spark.createDataFrame(
        [
            ("e2", "c", "places", "schema_fk", maps, 0),
            ("e2", "e1", "Places", "schema_fk", maps, 1),
            ("e2", "f1", "has field", "", [], 2),
            ("e1", "f2", "has field", "", [], 3),
            ("e2", "f3", "has field", "", [], 4),
            ("e2", "gone", "uses", "", [], 5),
            ("e1", "e2", "back", "schema_fk", [("nothing", "x")], 6),
        ],
        "src string, dst string, relationship string, kind string, maps array<struct<field:string,related:string>>, seq long",
    )
    n, li = schema_graph.normalise(nodes, links)
    assert sorted(r.id for r in n.collect()) == ["e0", "e1", "e2", "f1", "f2"]
    got = sorted((r.src, r.dst, r.kind, r.evidenced) for r in li.collect())
    assert got == [("e1", "e2", "schema_reference", False), ("e1", "f2", "", True), ("e2", "e1", "schema_fk", True), ("e2", "f1", "", True)]
    n2, l2 = schema_graph.normalise(n, li.drop("evidenced"))
    assert sorted(n2.collect()) == sorted(n.collect()) and sorted((r.src, r.dst, r.kind) for r in l2.collect()) == [g[:3] for g in got]
    assert [tuple(r) for r in schema_graph.navigation(n, li).collect()] == [("Order", "places", "customer", "customerId", "id")]


def test_key_maps_cascade(spark):
    rel = spark.createDataFrame(
        [("full", "A", "B", [("x", "y")]), ("same", "A", "B", [("k1", "")]), ("order", "A", "B", [("p", ""), ("q", "")]), ("none", "A", "B", [("zz", "")]), ("silent", "A", "B", [])],
        "rel string, from string, to string, maps array<struct<field:string,related:string>>",
    )
    fields = spark.createDataFrame([("B", "k1", True, 0), ("B", "k2", True, 1), ("A", "K2", False, 0), ("A", "p", False, 1)], "entity string, name string, is_pk boolean, ord int")
    got = sorted((r.rel, r.pos, r.field, r.related, r.implicit) for r in schema_graph.key_maps(rel, fields).collect())
    assert got == [("full", 0, "x", "y", False), ("order", 0, "p", "k1", True), ("order", 1, "q", "k2", True), ("same", 0, "k1", "k1", True), ("silent", 1, "k2", "k2", True)]


def test_views(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, l int, v string")
    b = spark.createDataFrame([(1, 1, 5.0), (1, 1, 7.0), (2, 2, 9.0)], "k int, l int, m double")
    links = [Link("a", "b", (("k", "k"), ("l", "l")))]
    view = View((Item("a", "v"), Item("b", "m", "total", "measure")), (Join("a.k", "b.k"),), group_by=("a.v",))
    assert [tuple(r) for r in compile_view(view, {"a": a, "b": b}, links).collect()] == [("x", 12.0)]
    with pytest.raises(UnevidencedJoin):
        compile_view(view, {"a": a, "b": b}, [])
    with pytest.raises(UnevidencedJoin):
        compile_view(View((Item("a", "v"), Item("b", "m"))), {"a": a, "b": b}, links)
    assert sanitise(view, []).missing == ("no evidenced join between a and b",)
    assert any("measure" in x for x in describe(sanitise(view, links)))
    assert friendly("Sales order") and not friendly("OrderService record") and not friendly("a.b")


def test_join_path():
    links = [("a", "b"), ("c", "b"), ("c", "d"), ("a", "x")]
    assert schema_graph.join_path(links, "a", "d") == ["a", "b", "c", "d"] and schema_graph.join_path(links, "a", "q") == []


def test_text_functions(spark):
    assert one(spark, text.identity_key(F.lit("Ｆｕｌｌ wídth-ﬁ 1"))) == "fullwídthfi1"
    assert one(spark, text.navigation_key(F.lit("../a\\b/Home.XML?x#y"))) == "home"
    assert one(spark, text.navigation_key(F.lit("."))) == "self" and one(spark, text.navigation_key(F.lit(""))) == ""
    assert one(spark, text.clamp01(F.lit(1.7))) == 1 and one(spark, text.clamp01(F.lit(float("nan")))) == 0 and one(spark, text.clamp01(F.lit(None))) == 0
    for signature, token in [
        ('<transition name="Go">', "transition:go"),
        ("<iterate list='x'>", ""),
        ('<conditional-response url="."/>', "navigate:self"),
        ('<entity-one value-field="Rec"/>', "entity-one:rec"),
        ("<subscreens-item location='L'/>", "subscreen:l"),
        ("Run  (A)", "code:run (a)"),
        ("", ""),
    ]:
        assert one(spark, text.flow_token(F.lit(signature))) == token
    assert one(spark, text.camel_words(F.lit("parseXMLFile_now2"))) == ["parse", "xml", "file", "now2"]
    assert one(spark, text.simple_name(F.lit("a.b.Svc#run"))) == "run"


def test_array_functions(spark):
    arr = lambda s: F.array(*map(F.lit, s)).cast("array<string>")
    assert one(spark, arrays.compress_runs(arr(["a", "a", "", "a", "b"]))) == ["a", "b"]
    assert one(spark, arrays.contiguous_at(arr("abcab"), arr("ab"))) == 0 and one(spark, arrays.contiguous_at(arr("abc"), arr("ac"))) == -1
    assert one(spark, arrays.ordered_matches(arr("axbyc"), arr("abz"))) == 2
    assert not one(spark, arrays.contains_run(arr("ab"), arr("ab"), strict=True))
    assert one(spark, arrays.longest_common_run(arr("xabcy"), arr("zabcw"))) == 3
    assert one(spark, arrays.last(arr("abc"), 2)) == ["b", "c"] and one(spark, arrays.last(arr("a"), 2)) == ["a"]


def test_search_tiers(spark):
    arr = lambda s: F.array(*map(F.lit, s.split())).cast("array<string>")
    for target, tier in [("hot gear", 5), ("hot gear now", 4), ("a hot gear", 3), ("hot x gear", 2), ("hot x", 1), ("gear", 0)]:
        assert one(spark, search.tier_of(arr(target), arr("hot gear"))[0]) == tier


def test_decisions(spark):
    a = spark.createDataFrame([(1, "b", 0.5, 0.9, 0.5, 0.5), (1, "a", 0.5, 0.1, 0.5, 0.5)], "packet int, id string, membership double, continuity double, coherence double, expected_gain double")
    n = spark.createDataFrame([(1, "x", 0.4), (1, "y", 4.0)], "packet int, id string, value double")
    low = spark.createDataFrame([(1, 0.5, 0.5, 0.5)], "packet int, new_arc double, new_business double, new_technical double")
    high = spark.createDataFrame([(1, 0.9, 0.2, 0.9)], low.schema)
    said = lambda nov, phase: tuple(arcs.decide(a, n, nov, phase).first())[1:3]
    assert said(low, "pass1") == ("select_arc", "a") and said(low, "pass2") == ("select_neighbour", "y")
    assert said(low, "scout") == ("continue_existing_arc", "a")  # equal isn't enough
    assert said(high, "scout") == ("open_new_arc_candidate", "technical")
    assert tuple(arcs.decide(a.limit(0), n.limit(0), low, "pass1").first())[1] == "no_arc_available"


def test_extraction(spark):
    rows = [
        ("a.py", "def outer(a, b):\n    x = 1\n\n    return inner(x)\n\ndef inner(x):\n    return x\n"),
        ("b.js", "export function go(x) {\n  if (x) { run('}'); }\n}\nconst f = (y) => { return process.env.HOME; }\nconst LIMIT_A = 5;\n"),
        ("c.xml", '<entities><entity entity-name="Order" package="p"><field name="orderId" type="id" is-pk="true"/><field name="note"/><relationship type="one" related="Party" title="Buyer"><key-map field-name="buyerId" related="partyId"/></relationship></entity></entities>'),
        ("d.yaml", "a:\n  b:\n    c: 1\n  d: x\n# no\ne: 2\n"),
        ("e.json", '{"a": {"b": [1, 2], "c": null}, "d": [{"x": 1}]}'),
        ("f.env", "KEY=v\n# c\nb.c : 2\n"),
        ("g.xml", "<a><b x='1'><c/></a><d>"),
        ("h.txt", None),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    pick = lambda *p: df.where(F.col("path").isin(*p))
    code = extract.extract(pick("a.py", "b.js", "h.txt"), "code")
    got = {r.name: (r.start_line, r.end_line) for r in code.collect()}
    assert got["outer"][0] == 1 and got["inner"][0] == 6 and got["go"] == (1, 3) and "f" in got and "if" not in got
    refs = {(r.symbol, r.name) for r in extract.call_references(code).collect()}
    assert {("outer", "inner"), ("go", "run")} <= refs and ("go", "if") not in refs
    assert [r.name for r in extract.environment_references(code.where("name = 'f'")).collect()] == ["$env.HOME"]
    assert [r.name for r in extract.constants(pick("b.js")).collect()] == ["LIMIT_A"]
    schema = [(r.row, r.name, r.is_pk) for r in extract.extract(pick("c.xml"), "entities").collect()]
    assert schema == [("entity", "p.Order", None), ("field", "orderId", True), ("field", "note", False), ("relationship", "Buyer", None)]
    assert [(r.key, r.value) for r in extract.extract(pick("d.yaml"), "settings").collect()] == [("a.b.c", "1"), ("a.d", "x"), ("e", "2")]
    assert [(r.key, r.value) for r in extract.extract(pick("e.json"), "settings").collect()] == [("a.b", "1, 2"), ("a.c", "null")]
    assert [(r.key, r.value) for r in extract.extract(pick("f.env"), "settings").collect()] == [("KEY", "v"), ("b.c", "2")]
    tree = extract.extract(pick("g.xml"), "markup")
    assert [(r.tag, r.parent, r.depth) for r in tree.orderBy("ordinal").collect()] == [("a", None, 0), ("b", 1, 1), ("c", 2, 2), ("d", None, 0)]
    assert extract.child_tags(tree).count() == 2


def test_sources(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([("1", 'a "q", b\nline'), ("2", None)], "k string, v string")
    files.write_csv(df, f"{base}/t.csv")
    assert sorted(r.k for r in files.read_tables(spark, base)["t"].collect()) == ["1", "2"]
    (tmp_path / "src/x").mkdir(parents=True)
    (tmp_path / "src/x/a.py").write_text("one\ntwo\nthree")
    (tmp_path / "src/b.py").write_text("big" * 100)
    (tmp_path / "src/c.bin").write_text("no")
    tree = files.source_files(spark, f"{base}/src", [".py"], most_bytes=50)
    assert [(r.path, r.text) for r in tree.collect()] == [("x/a.py", "one\ntwo\nthree")]
    assert [(r.line, r.text) for r in files.read_lines(tree, "x/a.py", 2, 9).collect()] == [(2, "two"), (3, "three")]
    assert files.read_lines(tree, "x", 1, 2).first().status == "directory" and files.read_lines(tree, "y", 1, 2).first().status == "missing"
    assert [tuple(r) for r in files.list_directory(tree, "").collect()] == [("dir", "x")]
    assert files.directory_preview(tree).first().extensions == {".py": 1}
    assert files.read_newest(spark, f"{base}/map") is None
    for k in (1, 2):
        assert files.write_version(spark.range(k), f"{base}/map") == k
    (tmp_path / "map/version-000003").mkdir()
    assert files.read_newest(spark, f"{base}/map").count() == 2
    files.append_events(df, f"{base}/log", 4)
    files.append_events(df, f"{base}/log", 4)
    assert files.read_events(spark, f"{base}/log", 4, "k string").count() == 4 and files.read_events(spark, f"{base}/log", 5, "k string").count() == 0
    assert files.next_number(spark, f"{base}/log") == 5


def test_streaming_state_equals_the_fold(spark, tmp_path):
    from quarry.streaming import replay

    rows = [(k, k % 3, float((k * 37) % 100)) for k in range(30)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = replay.event_stream(spark, f"file://{tmp_path}/in", df.schema)
    out = replay.run_to_memory(replay.opportunity_stream(stream), "opportunity_test", "update", f"file://{tmp_path}/ck")
    want = {}
    for _, u, v in rows:
        want[u] = max(want.get(u, 0.0) * 0.96, v / 100)
    assert {r.user_id: round(r.opportunity, 9) for r in out.collect()} == {u: round(v, 9) for u, v in want.items()}


def test_conversation_families_read_whole_texts(spark):
    from quarry.plans import graphs

    talks = {1: ["apple", "bear", "cat"], 2: ["ant", "bird", "cow"], 3: ["apple", "bear", "cat"], 4: ["apple", "bear", "crow"]}
    rows = [(c, k, "user", text) for c, texts in talks.items() for k, text in enumerate(texts)]
    got = {r.id: (r.family, r.relation) for r in graphs.families_of(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {1: (1, "representative"), 2: (2, "representative"), 3: (1, "duplicate"), 4: (1, "branch")}


def test_a_name_that_all_symbols_share_makes_no_pairs(spark):
    n = 60_000  # as pairs 3.6 billion
    symbols = spark.range(n).selectExpr("id", "concat('n', id) AS name", "'Same' AS simple_name", "concat('f', id % 1000) AS source")
    refs = symbols.where("id > 0").selectExpr("concat('r', id) AS ref", "concat('x', id) AS name", "'same' AS simple_name", "source")
    started = time.monotonic()
    got = graph.resolve_by_precedence(refs, symbols)
    assert got.where("symbol = int(substr(ref, 2)) % 1000").count() == n - 1
    assert time.monotonic() - started < 60
