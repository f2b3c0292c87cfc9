"""Source, markup and settings extraction on small inputs."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.operators import extract


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_blocks_end_where_they_balance():
    assert extract.braces_end("f() { a{b} '}' } x", 0) == 16
    assert extract.braces_end("f() { a" + "x" * 5000, 0) == 5007  # never closes: all of it
    assert extract.braces_end("f" + "x" * 5000, 0) == 2600 and extract.braces_end("abc", 1) == 3
    assert extract.braces_end('f() { "\\"}" }', 0) == 13
    text = "  def f():\n      a\n\n    b\n  c\n"
    assert text[: extract.indent_end(text, 0)] == "  def f():\n      a\n\n    b"
    assert extract.indent_end("def f():\n  a", 0) == 12


def test_symbols(spark):
    code = files(spark, ("a.py", "def f(x):\n  g(1)\n\ndef h():\n  pass\n"), ("b.js", "export async function run(a) { if (a) { call(a); } }\nconst go = (x) => { run(x); };\nclass A {\n  step(y) { this.go(y); }\n}\n"), (None, None))
    got = {(r.path, r.name, r.kind, r.start_line, r.end_line) for r in extract.extract(code, "code").collect()}
    assert got == {("a.py", "f", "function", 1, 3), ("a.py", "h", "function", 4, 6), ("b.js", "run", "function", 1, 1), ("b.js", "go", "function", 2, 2), ("b.js", "step", "method", 4, 4)}


XML = """<screen name="S" x='1'>
 <transition name="go"><actions><if condition="a"><service-call name="a.b#c"/></if>
  <else><set field="k" value="1"/></else></actions></transition>
 <widgets><section name="w"><entity-find entity-name="Order" list="l"/></section></widgets>
 <service verb="get" noun="All"></service>
</screen>"""


def test_nesting():
    nodes, parents, depths, ends = extract.nest(extract.tags("<a><b><c></b><d/></x></a><a>"))
    assert [n.name for n in nodes] == ["a", "b", "c", "d", "a"] and parents == [-1, 0, 1, 0, -1] and depths == [0, 1, 2, 1, 0]
    assert [e is None for e in ends] == [False, False, True, False, True]
    assert extract.nest(extract.tags("<?xml?><!-- x --><!DOCTYPE y>")) == ([], [], [], [])


def test_executable_steps_hang_on_the_nearest_one_that_runs(spark):
    rows = [(r.ordinal, r.tag, r.parent, r.line, r.identity) for r in extract.extract(files(spark, ("s.xml", XML)), "executable").orderBy("ordinal").collect()]
    assert rows == [(1, "screen", None, 1, "S"), (2, "transition", 1, 2, "go"), (3, "actions", 2, 2, ""), (4, "if", 3, 2, ""), (5, "service-call", 4, 2, "a.b#c"), (6, "else", 3, 3, ""), (7, "set", 6, 3, "k"), (8, "entity-find", 1, 4, "Order")]


def test_named_markup_and_units(spark):
    f = files(spark, ("s.xml", XML))
    named = {(r.name, r.kind) for r in extract.extract(f, "named").collect()}
    assert named == {("S", "screen"), ("go", "transition"), ("get#All", "service")}
    assert extract.extract(f, "named").where("name = 'go'").first().body.endswith("</transition>")
    units = {(r.tag, r.name, r.reference, r.relation) for r in extract.extract(f, "units").collect()}
    assert {("service-call", "a.b#c", "a.b#c", "calls"), ("entity-find", "Order", "Order", "reads"), ("transition", "go", "go", "routes_to"), ("if", "if-4", None, None), ("set", "k", None, None)} <= units


def test_entities(spark):
    text = '<entities><entity entity-name="A" package="p"><field name="id" type="id" is-pk="true"/><field name="id"/><relationship type="one" related="B"><key-map field-name="bId" related="id"/></relationship></entity><view-entity name="V"><alias name="x"/></view-entity><entity entity-name="open"></entities>'
    rows = [(r.entity, r.row, r.name, r.type, r.is_pk, r.related, r.pairs and [tuple(p) for p in r.pairs]) for r in extract.extract(files(spark, ("e.xml", text)), "entities").collect()]
    assert rows == [("A", "entity", "p.A", None, None, None, None), ("A", "field", "id", "id", True, None, None), ("A", "relationship", "one", "one", None, "B", [("bId", "id")]), ("V", "entity", "V", None, None, None, None), ("V", "field", "x", "derived", False, None, None)]


@pytest.mark.parametrize(
    "path, text, rows",
    [
        ("a.json", '{"a": {"b": [1, null, "x"], "c": 1.0, "d": [{"e": 1}], "f": true, "g": 2.5}, "h": null}', [("a.b", "1, , x"), ("a.c", "1"), ("a.f", "true"), ("a.g", "2.5"), ("h", "null")]),
        ("a.json", "{broken", []),
        ("a.yaml", "a:\n  b:\n    c: 1\n  # no: x\n  d: y\ne: 2\n", [("a.b.c", "1"), ("a.d", "y"), ("e", "2")]),
        ("a.properties", "k = v\n# no\nb.c: 2\n", [("k", "v"), ("b.c", "2")]),
        ("a.env", "", []),
    ],
)
def test_settings(path, text, rows):
    assert [(k, v) for _, k, v, _ in extract.settings(path, text)] == rows


def test_objects_in_lists():
    text = '{"a": [{"id": "x", "n": 1}, {"name": "y", "in": [{"q": 1}]}, 5, {"z": 0}]}'
    assert [(o, f) for _, o, f in extract.json_objects("p.json", text)] == [("a.x", ["id", "n"]), ("a.y", ["name", "in"]), ("a.3", ["z"]), ("a.1.in.0", ["q"])]


def test_references(spark):
    symbols = spark.createDataFrame(
        [
            ("src/a.js", "run", "run(); go(LIMIT_A); if (x) { cfg.db.host } <service-call name=\"s.t\"/> <entity-one entity-name='Q'/>"),
            ("src/a.js", "ui", "el.addEventListener('click', go); <b onPress={go}/>; bus.on('msg', take); p.then(ok).catch(bad); setTimeout(later, 5)"),
        ],
        "path string, name string, body string",
    )
    refs = [(r.symbol, r.name, r.relation) for r in extract.call_references(symbols.where("name = 'run'")).orderBy("pos").collect()]
    assert refs == [("run", "go", "calls"), ("run", "s.t", "calls"), ("run", "Q", "reads")]
    f = files(spark, ("src/a.js", "const LIMIT_A = 5;\nimport cfg from '../conf/app.json'\nconst y = require('./b.yml')"))
    assert [tuple(r) for r in extract.constant_references(symbols, extract.constants(f)).collect()] == [("src/a.js", "run", "LIMIT_A", "configured_by")]
    known = spark.createDataFrame([("conf/app.json", "DB.host"), ("src/b.yml", "k")], "path string, key string")
    assert [tuple(r) for r in extract.setting_references(f, symbols, known).collect()] == [("src/a.js", "run", "conf/app.json", "db.host")]
    edges = {(r.source, r.relation, r.target) for r in extract.callbacks(symbols).collect()}
    assert edges == {("ui", "registers", "$event.click"), ("$event.click", "triggers", "go"), ("ui", "registers", "$event.press"), ("$event.press", "triggers", "go"), ("ui", "registers", "$event.msg"), ("$event.msg", "handles", "take"), ("ui", "on_success", "ok"), ("ui", "on_error", "bad"), ("ui", "delayed_trigger", "later")}
    path = spark.range(1).select(extract.normal_path(F.lit("a/b"), F.lit("../../c/./d.json"))).first()[0]
    assert path == "c/d.json"


def test_extracted_columns_can_be_chosen(spark):
    texts = [(str(k), "<a x='1' y='2'><b/><c z=''></c></a>" * (k % 3)) for k in range(60)] + [("none", None)]
    files = spark.createDataFrame(texts, "path string, text string")
    every = extract.extract(files, "markup")
    some = extract.extract(files, "markup", only=("path", "parent", "attributes"))
    assert some.columns == ["path", "parent", "attributes"] and some.schema["attributes"] == every.schema["attributes"]
    assert sorted(map(str, some.collect())) == sorted(map(str, every.select(*some.columns).collect())) != []
    pairs = to_arrow_schema(some.schema).field("attributes").type
    assert extract._column((None, [], [("k", "v"), ("l", None)]), pairs).to_pylist() == [None, [], [{"key": "k", "value": "v"}, {"key": "l", "value": None}]]
    assert extract._column(([], None), pairs).to_pylist() == [[], None]
