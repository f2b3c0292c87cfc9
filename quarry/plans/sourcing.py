"""Sources, extraction, lookups and merges on texts and rows made from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import arrays
from quarry.operators import assembly, extract, graph, incremental, knowledge, projections, ranking
from quarry.plans.registry import query
from quarry.runtime import dealt, materialise, positions, scratch_path, table
from quarry.sources import files


def made(spark, sf_dir, name: str, path: str, text: str):
    """(path, text) of texts that an expression makes of a table's rows."""
    return table(spark, sf_dir, name).select(F.expr(path).alias("path"), F.expr(text).alias("text"))


# Sources ----------------------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), path)
    return files.read_csv(spark, path)


@query("SELECT 'nation' AS name, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'region', (SELECT count(*) FROM region)")
def csv_tables(spark, sf_dir):
    folder = scratch_path(spark, "tables")
    for name in ("nation", "region"):
        files.write_csv(table(spark, sf_dir, name), f"{folder}/{name}.csv")
    out = None
    for name, df in files.read_tables(spark, folder).items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation""")
def json_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    files.json_report(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.text(path)


@query("""SELECT 'r' || r_regionkey || '.txt' AS path, length(r_name) AS length, r_name AS text FROM region""")
def source_tree(spark, sf_dir):
    """A tree of files, one per region, listed by extension and size."""
    root = scratch_path(spark, "tree")
    for r in table(spark, sf_dir, "region").collect():  # five rows: one file each
        for kind in ("txt", "bin"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/r{r.r_regionkey}.{kind}")
            out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
            out.write(bytearray(r.r_name.encode()))
            out.close()
    return files.source_files(spark, root, [".txt"])


@query("""WITH d AS (SELECT text FROM documents WHERE doc_id = (SELECT arg_max(doc_id, n_chars * 1000000 - doc_id) FROM documents)), l AS (SELECT unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM d)
SELECT 'ok' AS status, line, text FROM l WHERE line BETWEEN 3 AND 60""")
def line_range(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    longest = d.orderBy(F.desc("n_chars"), "doc_id").first().doc_id
    return files.read_lines(d.select(F.col("doc_id").cast("string").alias("path"), "text"), str(longest), 3, 60)


@query("SELECT s_suppkey, s_name, s_acctbal > 0 AS fine FROM supplier")
def newest_version(spark, sf_dir):
    folder, s = scratch_path(spark, "versions"), table(spark, sf_dir, "supplier")
    files.write_version(s.select("s_suppkey", "s_name", F.lit(False).alias("fine")), folder)
    files.write_version(s.select("s_suppkey", "s_name", (F.col("s_acctbal") > 0).alias("fine")), folder)
    return files.read_newest(spark, folder)


@query("SELECT 'version-000001' AS name, true AS is_dir UNION ALL SELECT 'version-000002', true")
def version_listing(spark, sf_dir):
    folder, r = scratch_path(spark, "versions"), table(spark, sf_dir, "region")
    for _ in range(2):
        files.write_version(r, folder)
    return spark.createDataFrame([e for e in files.entries(spark, folder) if not e[0].startswith((".", "_"))], "name string, is_dir boolean")


@query("""SELECT CAST(event_id AS VARCHAR) || '.env' AS path, 'KIND' AS key, event_type AS value, 1 AS line FROM events UNION ALL SELECT CAST(event_id AS VARCHAR) || '.env', 'user.id', CAST(user_id AS VARCHAR), 3 FROM events""")
def flat_settings(spark, sf_dir):
    e = made(spark, sf_dir, "events", "concat(event_id, '.env')", r"concat('KIND = ', event_type, '\n# note\n user.id: ', user_id, '\nplain')")
    return extract.extract(e, "settings")


@query("""SELECT o_orderkey || '.yaml' AS path, 'order.who.id' AS key, CAST(o_custkey AS VARCHAR) AS value, 3 AS line FROM orders UNION ALL SELECT o_orderkey || '.yaml', 'order.status', o_orderstatus, 4 FROM orders UNION ALL SELECT o_orderkey || '.yaml', 'done', 'yes', 5 FROM orders""")
def nested_settings(spark, sf_dir):
    e = made(spark, sf_dir, "orders", "concat(o_orderkey, '.yaml')", r"concat('order:\n  who:\n    id: ', o_custkey, '\n  status: ', o_orderstatus, '\ndone: yes')")
    return extract.extract(e, "settings")


@query("""WITH o AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS path, repeat('in.', CAST(o_orderkey % 7 AS INT)) AS pre FROM orders WHERE o_orderkey % 11 <> 0)
SELECT path, pre || 'id' AS key, CAST(o_custkey AS VARCHAR) AS value FROM o
UNION ALL SELECT path, pre || 'tags', o_orderstatus || ', , ' || o_orderkey FROM o WHERE o_orderkey % 5 <> 0
UNION ALL SELECT path, pre || 'total', rtrim(rtrim(CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR), '0'), '.') FROM o
UNION ALL SELECT path, pre || 'open', CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END FROM o
UNION ALL SELECT path, pre || 'gone', 'null' FROM o
UNION ALL SELECT path, pre || 'who.' || o_orderpriority, 'said "' || o_custkey || '"' FROM o""")
def json_leaves(spark, sf_dir):
    """Orders as JSON: nested by their key, every 11th broken, every fifth with an object in a list."""
    from quarry.operators import json_leaves as leaves

    text = """concat(repeat('{"in": ', cast(o_orderkey % 7 AS int)), '{"id": ', o_custkey, ', "tags": ["', o_orderstatus, '", null, ', if(o_orderkey % 5 = 0, '{"x": 1}', cast(o_orderkey as string)), '], "total": ', cast(o_totalprice AS decimal(15, 2)),
      ', "open": ', o_orderstatus = 'O', ', "gone": null, "none": {}, "who": {"', o_orderpriority, '": "said ', chr(92), '"', o_custkey, chr(92), '""}', if(o_orderkey % 11 = 0, '', '}'), repeat('}', cast(o_orderkey % 7 AS int)))"""
    return leaves.leaves(made(spark, sf_dir, "orders", "cast(o_orderkey as string)", text))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS path, 'list.' || c_name AS object, 'id,n' AS fields FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'list.1', 'x' FROM customer""")
def json_objects(spark, sf_dir):
    c = made(spark, sf_dir, "customer", "cast(c_custkey as string)", """concat('{"list": [{"id": "', c_name, '", "n": 1}, {"x": 2}, 3]}')""")
    return extract.extract(c, "objects").withColumn("fields", F.array_join("fields", ","))


# Extraction -------------------------------------------------------------------------------


@query("""SELECT path, name, 'function' AS kind, start_line, end_line FROM (SELECT c_custkey || '.py' AS path, 'f' || c_custkey AS name, 1 AS start_line, 3 AS end_line FROM customer UNION ALL SELECT c_custkey || '.py', 'g', 4, 5 FROM customer)""")
def code_symbols(spark, sf_dir):
    c = made(spark, sf_dir, "customer", "concat(c_custkey, '.py')", r"concat('def f', c_custkey, '(x):\n  return ', c_nationkey, '\n\ndef g():\n  pass')")
    return extract.extract(c, "code").select("path", "name", "kind", "start_line", "end_line")


@query("""SELECT c_custkey || '.js' AS path, 'run' AS symbol, n AS name, r AS relation FROM customer, (VALUES ('other', 'calls'), ('Order', 'reads'), ('go', 'routes_to')) AS t(n, r) UNION ALL SELECT c_custkey || '.js', 'run', 'ns.' || c_mktsegment, 'calls' FROM customer""")
def call_references(spark, sf_dir):
    symbols = made(spark, sf_dir, "customer", "concat(c_custkey, '.js')", """concat('run() { other(', c_custkey, '); if (x) {} run(); <service-call name="ns.', c_mktsegment, '"/><entity-one entity-name="Order"/><transition name="go"> }')""")
    return extract.call_references(symbols.select("path", F.lit("run").alias("name"), F.col("text").alias("body"))).select("path", "symbol", "name", "relation")


@query("""SELECT p_partkey AS id, n AS name, n AS simple_name, r AS relation FROM part, (VALUES ('go', 'routes_to')) AS t(n, r) UNION ALL SELECT p_partkey, 'a.b#' || p_size, CAST(p_size AS VARCHAR), 'calls' FROM part UNION ALL SELECT p_partkey, p_type, p_type, 'writes' FROM part""")
def markup_references(spark, sf_dir):
    units = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("""concat('<transition name="go"/><service-call x="1" name="a.b#', p_size, '"/><create entity-name="', p_type, '"/>')""").alias("body"))
    return knowledge.markup_references(units).select("id", "name", "simple_name", "relation")


_LINES = "concat('<order id=\"', l_orderkey, '\"><head/>', array_join(lines, ''), '</order>')"


def order_markup(spark, sf_dir):
    """A small document per order: its lines, each with a part inside."""
    one = F.concat(F.lit('<line n="'), "l_linenumber", F.lit('"><part k="'), "l_partkey", F.lit('"/></line>'))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", one.alias("x"))))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda r: r.x).alias("lines"))  # an order's lines
    return o.select(F.col("l_orderkey").cast("string").alias("path"), F.expr(_LINES).alias("text"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem)
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS path, 1 AS ordinal, 'order' AS tag, NULL AS parent, 0 AS depth, 'id=' || l_orderkey AS attributes FROM l UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), 2, 'head', 1, 1, '' FROM l
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 1 + 2 * k, 'line', 1, 1, 'n=' || l_linenumber FROM l UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 2 + 2 * k, 'part', 1 + 2 * k, 2, 'k=' || l_partkey FROM l""")
def markup_hierarchy(spark, sf_dir):
    tree = extract.extract(order_markup(spark, sf_dir), "markup", only=("path", "ordinal", "tag", "parent", "depth", "attributes"))
    return tree.select("path", "ordinal", "tag", "parent", "depth", F.array_join(F.transform("attributes", lambda a: F.concat_ws("=", a.key, a.value)), ",").alias("attributes"))


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS path, 1 AS parent, 'line' AS tag, n FROM n UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 1, 'head', 1 FROM n UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 1 + 2 * k, 'part', 1 FROM l""")
def markup_children(spark, sf_dir):
    return extract.child_tags(extract.extract(order_markup(spark, sf_dir), "markup", only=("path", "tag", "parent")))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS path, t.o AS ordinal, t.tag, t.p AS parent, CASE WHEN t.o = 1 THEN n_name ELSE t.i END AS identity FROM nation, (VALUES (1, 'screen', NULL, ''), (2, 'actions', 1, ''), (3, 'service-call', 2, 'go'), (4, 'if', 1, ''), (5, 'set', 4, 'f')) AS t(o, tag, p, i)""")
def executable_markup(spark, sf_dir):
    x = made(spark, sf_dir, "nation", "cast(n_nationkey as string)", """concat('<screen name="', n_name, '"><widgets><actions><note><service-call name="go"/></note></actions></widgets><if condition="c"><x><set field="f"/></x></if></screen>')""")
    return extract.extract(x, "executable").select("path", "ordinal", "tag", "parent", "identity")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS path, n_name AS name, 'screen' AS kind FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'get#' || n_regionkey, 'service' FROM nation""")
def named_markup(spark, sf_dir):
    x = made(spark, sf_dir, "nation", "cast(n_nationkey as string)", """concat('<screen name="', n_name, '"/><service verb="get" noun="', n_regionkey, '"></service><actions><other name="no"/></actions>')""")
    return extract.extract(x, "named").select("path", "name", "kind")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS path, 1 AS ordinal, 'entity-one' AS tag, n_name AS name, n_name AS reference, 'reads' AS relation FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 2, 'if', 'if-2', NULL, NULL FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 3, 'set', 'k', NULL, NULL FROM nation""")
def markup_units(spark, sf_dir):
    x = made(spark, sf_dir, "nation", "cast(n_nationkey as string)", """concat('<a:entity-one entity-name="', n_name, '"/><if condition="x"><other/><set field="k"/></if>')""")
    return extract.extract(x, "units").select("path", "ordinal", "tag", "name", "reference", "relation")


@query("""SELECT n_name AS entity, 'entity' AS "row", 'geo.' || n_name AS name, NULL AS related FROM nation UNION ALL SELECT n_name, 'field', 'id', NULL FROM nation UNION ALL SELECT n_name, 'field', 'r' || n_regionkey, NULL FROM nation UNION ALL SELECT n_name, 'relationship', 'one', 'Region' FROM nation""")
def entity_definitions(spark, sf_dir):
    x = made(spark, sf_dir, "nation", "cast(n_nationkey as string)", """concat('<entity entity-name="', n_name, '" package="geo"><field name="id" is-pk="true"/><field name="r', n_regionkey, '"/><field name="id"/><relationship type="one" related="Region"><key-map field-name="r" related="id"/></relationship></entity>')""")
    return extract.extract(x, "entities").select("entity", "row", "name", "related")


@query("SELECT s_suppkey || '.js' AS path, 'LIMIT_' || s_nationkey AS name FROM supplier")
def constant_names(spark, sf_dir):
    return extract.constants(made(spark, sf_dir, "supplier", "concat(s_suppkey, '.js')", r"concat('export const LIMIT_', s_nationkey, ' = ', s_suppkey, ';\nconst lower = 1;\nlet UPPER = 2;')"))


@query("SELECT s_suppkey || '.js' AS path, 'f' AS symbol, 'LIMIT_' || s_nationkey AS name, 'configured_by' AS relation FROM supplier")
def constant_references(spark, sf_dir):
    text = r"concat('const LIMIT_', s_nationkey, ' = 1;\nconst OTHER = 2;')"
    known = extract.constants(made(spark, sf_dir, "supplier", "concat(s_suppkey, '.js')", text))
    symbols = made(spark, sf_dir, "supplier", "concat(s_suppkey, '.js')", "concat('return LIMIT_', s_nationkey, ' + ELSEWHERE;')").select("path", F.lit("f").alias("name"), F.col("text").alias("body"))
    return extract.constant_references(symbols, known)


@query("SELECT s_suppkey || '.js' AS path, 'f' AS symbol, '$env.KEY' || s_nationkey AS name, 'configured_by' AS relation FROM supplier")
def environment_references(spark, sf_dir):
    symbols = made(spark, sf_dir, "supplier", "concat(s_suppkey, '.js')", "concat('process.env.KEY', s_nationkey, ' || process.env.KEY', s_nationkey)").select("path", F.lit("f").alias("name"), F.col("text").alias("body"))
    return extract.environment_references(symbols)


@query("""SELECT s_suppkey || '.js' AS path, 'f' AS source, 'registers' AS relation, '$event.e' || s_nationkey AS target FROM supplier UNION ALL SELECT s_suppkey || '.js', '$event.e' || s_nationkey, 'handles', 'take' FROM supplier UNION ALL SELECT s_suppkey || '.js', 'f', 'on_success', 'ok' || s_nationkey FROM supplier""")
def callback_edges(spark, sf_dir):
    symbols = made(spark, sf_dir, "supplier", "concat(s_suppkey, '.js')", """concat("bus.on('e", s_nationkey, "', take); p.then(ok", s_nationkey, ")")""").select("path", F.lit("f").alias("name"), F.col("text").alias("body"))
    return extract.callbacks(symbols)


@query("SELECT p_partkey, 'a,b' || p_size || ',c' AS names FROM part")
def parameter_names(spark, sf_dir):
    signature = F.concat(F.lit("async f(a, int b"), "p_size", F.lit(" = 2, c: Type) {"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(knowledge.parameters(signature), ",").alias("names"))


@query("SELECT p_partkey, p_type || ',' || p_brand AS names FROM part")
def flow_entities(spark, sf_dir):
    text = F.concat(F.lit('<x entity-name="'), "p_type", F.lit('"/><y entity-name="'), "p_brand", F.lit('"/><z entity-name="'), "p_type", F.lit('"/>'))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(knowledge.entity_names(text), ",").alias("names"))


@query("""SELECT id, pos - 1 AS pos, label FROM (SELECT p_partkey AS id, unnest(l) AS label, generate_subscripts(l, 1) AS pos FROM (SELECT p_partkey, regexp_extract_all(p_name, '(?i)(hot gear|small widget|gear|rod)') AS l FROM part))""")
def prose_concepts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return knowledge.linked_concepts(p, ["gear", "hot gear", "rod", "small widget", "x"])


@query("""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS source, unnest(string_split_regex(text, '\\r?\\n')) AS t, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS line FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line) AS k FROM l WHERE trim(t) <> '' AND NOT regexp_matches(t, '^\\s*(//|/\\*|\\*|#)') AND line NOT BETWEEN 2 AND 3)
SELECT source, min(line) AS line, md5(string_agg(t, chr(10) ORDER BY line)) AS body FROM k WHERE k <= 80 GROUP BY 1""")
def module_bodies(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    ranges = d.select("source", F.lit(2).cast("long").alias("start"), F.lit(3).cast("long").alias("end"))
    return incremental.module_bodies(d, ranges).withColumn("body", F.md5("body"))


@query("""SELECT p_partkey AS id, 'n,p' || p_size AS inputs, 'y' AS outputs, 'x > ' || p_size AS conditions, 'writes:' || p_type AS effects, 'calls:' || p_brand || ',writes:' || p_type AS operations FROM part""")
def canonical_packets(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("f(n)").alias("signature"), F.expr("""concat('if (x > ', p_size, ') { return y; } <parameter name="p', p_size, '"/>')""").alias("body"), "p_type", "p_brand")
    refs = p.select("id", F.lit(0).alias("pos"), F.lit("calls").alias("relation"), F.col("p_brand").alias("name")).unionByName(p.select("id", F.lit(1).alias("pos"), F.lit("writes").alias("relation"), F.col("p_type").alias("name")))
    return knowledge.canonical_packet(p, refs).select("id", *(F.array_join(c, ",").alias(c) for c in ("inputs", "outputs", "conditions", "effects", "operations")))


# Filters and lookups ----------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_totalprice > 200000 THEN 'explored' ELSE 'identified' END AS state FROM orders")
def arc_states(spark, sf_dir):
    calls = F.when(F.col("o_totalprice") > 200000, 1).otherwise(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", ranking.arc_state(F.col("o_orderstatus") == "F", calls, F.lit(0)).alias("state"))


_RELATION = "CASE event_type WHEN 'view' THEN 'next_in_source' WHEN 'click' THEN 'calls' WHEN 'signup' THEN 'routes_to' ELSE 'mentions' END"


@query(f"""SELECT event_id FROM (SELECT event_id, {_RELATION} AS r, value FROM events) WHERE r IN ('calls', 'routes_to') OR (r = 'next_in_source' AND value < 50)""")
def allowed_edges(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("src"), F.col("event_id").alias("dst"), F.expr(_RELATION).alias("relation"), F.lit("a").alias("src_path"), F.when(F.col("value") < 50, "a").otherwise("b").alias("dst_path"))
    return knowledge.allowed_edges(e).select("event_id")


@query("""SELECT DISTINCT 'external:' || replace(name, ':', '%3A') AS id, name FROM (SELECT event_type || CASE WHEN value > 50 THEN ':x' ELSE '' END AS name, value, event_type FROM events) WHERE value > 300 OR event_type = 'view' OR (event_type = 'click' AND contains(name, ':'))""")
def boundary_nodes(spark, sf_dir):
    name = F.concat("event_type", F.when(F.col("value") > 50, ":x").otherwise(""))
    relation = F.when(F.col("event_type") == "view", "reads").when(F.col("event_type") == "click", "calls").otherwise("mentions")
    return knowledge.boundary_nodes(table(spark, sf_dir, "events").select(name.alias("name"), relation.alias("relation"), (F.col("value") > 300).alias("explicit")))


@query("SELECT event_id FROM events WHERE NOT (event_type = 'click' AND value > 50)")
def real_services(spark, sf_dir):
    body = F.when(F.col("value") > 50, " <service-call name='x'/>").otherwise("<service/>")
    return knowledge.real_services(table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "service").otherwise("other").alias("kind"), body.alias("body"))).select("event_id")


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS item, CAST(l_partkey AS VARCHAR) AS title, l_orderkey AS ord FROM lineitem WHERE l_discount >= 0.06 AND l_tax >= 0.05), f AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY ord, item) AS k FROM r WHERE CAST(title AS BIGINT) NOT IN (SELECT p_partkey FROM part WHERE p_size > 10))
SELECT title, ord FROM f WHERE k = 1 ORDER BY ord, item LIMIT 3""")
def promoted_paths(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.lit(True).alias("pursue"), (F.col("l_discount") * 10).alias("likelihood"), (F.col("l_tax") * 10).alias("novelty"), F.col("l_partkey").cast("string").alias("title"), F.col("l_orderkey").alias("ord"))
    titles = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("title"))
    return ranking.promote(r, titles).select("title", "ord")


@query("""SELECT s_suppkey AS ref, n_nationkey AS symbol, CASE WHEN s_nationkey < 10 THEN 110 ELSE 35 END AS score FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def service_names(spark, sf_dir):
    refs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref"), F.concat(F.lit("Geo.Area"), "s_nationkey", F.lit(".get#All")).alias("name"))
    folder = F.when(F.col("n_nationkey") < 10, "x/geo/").otherwise("geo/deep/")
    services = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("Get#all").alias("name"), F.concat(folder, F.lit("area"), "n_nationkey", F.lit(".xml")).alias("path"))
    services = services.withColumn("name", F.concat(F.lit("area"), "id", F.lit(".get#All"))).withColumn("name", F.expr("substring_index(name, '.', -1)"))
    return assembly.resolve_services(refs.withColumn("name", F.regexp_replace("name", r"\.get#All$", ".get#All")), services)


@query("""WITH u AS (SELECT DISTINCT o_custkey AS workflow, o_orderpriority AS entity FROM orders), r AS (SELECT 1 AS relation, '1-URGENT' AS f, '2-HIGH' AS t, NULL AS w UNION ALL SELECT 2, '3-MEDIUM', '5-LOW', NULL UNION ALL SELECT 3, 'x', 'y', 7)
SELECT a.workflow, r.relation FROM r JOIN u a ON a.entity = r.f JOIN u b ON b.entity = r.t AND b.workflow = a.workflow UNION SELECT w, relation FROM r WHERE w IS NOT NULL""")
def workflow_members(spark, sf_dir):
    uses = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("workflow"), F.col("o_orderpriority").alias("entity"))
    relations = spark.createDataFrame([(1, "1-URGENT", "2-HIGH", None), (2, "3-MEDIUM", "5-LOW", None), (3, "x", "y", 7)], "relation int, from string, to string, workflow long")
    return assembly.members_of(relations, uses)


@query("""SELECT o_orderkey AS relation, 'c' || o_custkey AS entity FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) UNION SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'""")
def entity_relations(spark, sf_dir):
    relations = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("relation"), F.concat(F.lit("c"), "o_custkey").alias("from"), F.col("o_orderstatus").alias("to"))
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("c"), "c_custkey").alias("entity"))
    return assembly.relations_of(relations, wanted.unionByName(spark.range(1).select(F.lit("P").alias("entity"))))


@query("""SELECT o_custkey AS workflow, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS entities, (SELECT string_agg(o_orderstatus, ',' ORDER BY o_orderkey) FROM orders s WHERE s.o_custkey = o.o_custkey) AS steps FROM orders o GROUP BY 1""")
def workflow_documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    uses = o.select(F.col("o_custkey").alias("workflow"), F.col("o_orderpriority").alias("entity"), F.col("o_orderkey").alias("ord"))
    fields = uses.select("entity").distinct().select("entity", F.lit("id").alias("field"), F.lit(0).alias("ord"))
    steps = o.select(F.col("o_custkey").alias("workflow"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("ord"))
    return assembly.workflow_documents(uses, fields, steps).select("workflow", F.array_join(F.transform("entities", lambda e: e["name"]), ",").alias("entities"), F.array_join("steps", ",").alias("steps"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS arc, l_partkey AS path FROM lineitem) SELECT p_partkey AS path, min(arc) AS arc FROM part LEFT JOIN l ON path = p_partkey GROUP BY 1""")
def arcs_of_paths(spark, sf_dir):
    arcs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("arc")).agg(F.array(F.collect_list("l_partkey")).alias("lists")).withColumn("ord", F.col("arc"))
    return knowledge.arc_of_path(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path")), arcs)


@query("""SELECT c_custkey AS business, n_name AS physical, 'key' AS field, CASE WHEN r_name LIKE 'A%' THEN r_name ELSE 'a ' || n_regionkey END AS description FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def stored_as(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    mappings = table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("business"), F.col("n_name").alias("physical"))
    fields = n.select(F.col("n_name").alias("entity"), F.lit("key").alias("field"), F.concat(F.lit("a "), "n_regionkey").alias("description"))
    return knowledge.representations(mappings, fields, n.where("r_name LIKE 'A%'").select(F.col("n_name").alias("entity"), F.lit("key").alias("field"), F.col("r_name").alias("description")))


@query("SELECT l_orderkey AS src, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, l_partkey AS dst, 'has' AS relationship FROM lineitem")
def flat_links(spark, sf_dir):
    """Edges gathered to adjacency lists and flattened again."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), pos.alias("pos"), F.col("l_partkey").alias("dst"), F.lit("has").alias("relationship"))
    return knowledge.flatten_links(knowledge.gather_links(edges))


# Merges and orders ------------------------------------------------------------------------


@query("""WITH p AS (SELECT conv_id, list(role ORDER BY turn) AS path, 'end' AS terminal FROM conversations GROUP BY 1) SELECT array_to_string(path, '>') AS path, terminal, min(conv_id) AS seq FROM p GROUP BY 1, 2""")
def equal_paths(spark, sf_dir):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r.role)
    p = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("seq")).agg(roles.alias("path")).withColumn("terminal", F.lit("end"))
    return graph.dedupe_paths(p).withColumn("path", F.array_join("path", ">"))


@query("""SELECT n_name AS entity, f AS name, min(ext * 100 + s) % 100 AS seq, min(ext * 100 + s) >= 100 AS extension FROM (SELECT n_name, 'id' AS f, 0 AS ext, 1 AS s FROM nation UNION ALL SELECT n_name, 'id', 1, 0 FROM nation UNION ALL SELECT n_name, 'f' || n_regionkey, 1, 2 FROM nation) GROUP BY 1, 2""")
def merged_schemas(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    part = lambda name, ext, seq: n.select(F.col("n_name").alias("entity"), name.alias("name"), F.lit(ext).alias("extension"), F.lit(seq).alias("seq"))
    return assembly.merge_schemas(part(F.lit("id"), False, 1).unionByName(part(F.lit("id"), True, 0)).unionByName(part(F.concat(F.lit("f"), "n_regionkey"), True, 2)))


@query("SELECT p_partkey AS item, min(p_partkey) OVER (PARTITION BY p_name) AS canonical FROM part")
def same_knowledge(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.lit("concept").alias("kind"), F.col("p_name").alias("label"), F.array().cast("array<string>").alias("names"), F.col("p_partkey").alias("ord"))
    return assembly.same_knowledge(p)


@query("""WITH c AS (SELECT p_partkey AS item, min(p_partkey) OVER (PARTITION BY p_name) AS canonical, p_type, p_brand FROM part)
SELECT canonical AS item, arg_max(p_type, length(p_type) * 1000000 - item) AS description, arg_max(p_brand, item) AS commit FROM c GROUP BY 1""")
def merged_knowledge(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.lit("concept").alias("kind"), F.col("p_name").alias("label"), F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("files"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("description"), F.col("p_brand").alias("commit"))
    return assembly.merge_knowledge(p, assembly.same_knowledge(p)).select("item", "description", "commit")


@query("""SELECT p_partkey FROM part WHERE sha1('{"p_name":"' || p_name || '","p_size":' || p_size || '}') NOT IN (SELECT sha1('{"p_name":"' || p_name || '","p_size":' || p_size || '}') FROM part WHERE p_brand = 'Brand#1')""")
def not_attempted(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tried = p.where("p_brand = 'Brand#1'").select(F.sha1(F.to_json(F.struct("p_name", "p_size"))).alias("fingerprint"))
    return incremental.not_attempted(p, tried, ["p_name", "p_size"]).select("p_partkey")


@query("""WITH o AS (SELECT o_custkey, o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), f AS (SELECT * FROM o ORDER BY rank LIMIT 60)
SELECT o_custkey AS entry, min(rank) AS rank, arg_min(o_orderkey, rank) AS best, len(list(rank)) - 1 AS others FROM f GROUP BY 1""")
def scout_groups(spark, sf_dir):
    ranked = positions(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"]).withColumn("rank", F.col("pos") + 1)
    g = ranking.scout_groups(ranked.select(F.col("o_custkey").alias("entry"), F.col("o_orderkey").alias("id"), "rank"), 20, branches=60)
    return g.select("entry", "rank", "best", F.size("branches").alias("others"))


@query("SELECT name, kind, score FROM (SELECT p_name AS name, 'entity' AS kind, max(p_size) AS score FROM part GROUP BY 1 UNION ALL SELECT c_name, 'workflow', 20 FROM customer) ORDER BY score DESC, kind, name LIMIT 1")
def start_choice(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.max("p_size").alias("score"))
    return knowledge.start_choice(p, table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lit(20).alias("score")))


@query("""SELECT arc, row_number() OVER (ORDER BY priority DESC, started, opportunity DESC, created) AS place FROM (SELECT s_suppkey AS arc, s_nationkey AS priority, s_acctbal < 0 AS started, s_acctbal AS opportunity, s_suppkey AS created FROM supplier WHERE s_acctbal < 9000)""")
def unfinished_arcs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("arc"), F.col("s_nationkey").cast("double").alias("priority"), (F.col("s_acctbal") < 0).alias("started"), (F.col("s_acctbal") >= 9000).alias("completed"), F.col("s_acctbal").alias("opportunity"), F.col("s_suppkey").alias("created"))
    placed = positions(ranking.unfinished(s), [F.desc("priority"), "started", F.desc("opportunity"), "created"])
    return placed.select("arc", (F.col("pos") + 1).alias("place"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'cycle' WHEN o_orderpriority = '1-URGENT' THEN 'reuse' ELSE 'new' END AS edge FROM orders""")
def back_edges(spark, sf_dir):
    id_ = F.col("o_orderkey")
    none = F.array().cast("array<bigint>")
    steps = table(spark, sf_dir, "orders").select(id_.alias("id"), F.when(F.col("o_orderstatus") == "F", F.array(id_)).otherwise(none).alias("path"), F.when(F.col("o_orderpriority") == "1-URGENT", F.array(id_)).otherwise(none).alias("visited"))
    return knowledge.back_edges(steps).select("id", "edge")


@query("""WITH RECURSIVE a AS (SELECT s_suppkey AS alias, s_suppkey // 2 AS target FROM supplier WHERE s_suppkey >= 2), r AS (SELECT alias, target FROM a UNION ALL SELECT r.alias, a.target FROM r JOIN a ON a.alias = r.target)
SELECT alias, min(target) AS target FROM r GROUP BY 1""")
def alias_targets(spark, sf_dir):
    return graph.follow_aliases(table(spark, sf_dir, "supplier").where("s_suppkey >= 2").select(F.col("s_suppkey").alias("alias"), F.expr("s_suppkey div 2").alias("target")))


@query("""SELECT l_orderkey AS story, step, row_number() OVER (PARTITION BY l_orderkey ORDER BY k, step) AS position FROM (SELECT l_orderkey, row_number() OVER w AS step, row_number() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) UNION ALL SELECT o_orderkey, 100, CASE o_orderstatus WHEN 'F' THEN 0.5 ELSE 1.5 END FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))""")
def placed_steps(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    none = F.lit(None)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    size = rows.count()
    lines = materialise(dealt(rows, size, "l_orderkey").select(F.col("l_orderkey").alias("story"), n.alias("step")), "lines")
    # Each story has one first line.
    stories = dealt(lines.where("step = 1").select("story"), size, "story")
    extra = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("story"), F.lit(100).alias("step"), F.lit(100).alias("ord"), F.lit(1).alias("anchor"), F.when(F.col("o_orderstatus") == "F", "before").otherwise("after").alias("place"))
    lines = lines.select("story", "step", F.col("step").alias("ord"), none.cast("int").alias("anchor"), none.cast("string").alias("place"))
    return assembly.insert_steps(lines.unionByName(dealt(extra, size, "story").join(stories, "story", "left_semi")))


@query("""SELECT DISTINCT o_custkey AS start, o_custkey AS src, l_partkey AS dst, CASE l_returnflag WHEN 'N' THEN 'next_in_source' ELSE 'calls' END AS relation, CASE l_returnflag WHEN 'N' THEN 0.2 ELSE 1.0 END AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey <> o_custkey""")
def weighted_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    relation = F.when(F.col("l_returnflag") == "N", "next_in_source").otherwise("calls")
    return assembly.weigh(rows.select(F.col("o_custkey").alias("start"), F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), relation.alias("relation")).distinct())


@query("""SELECT p_partkey AS ref, n_nationkey AS symbol FROM part JOIN nation ON p_size % 25 = n_nationkey WHERE p_size >= 25 OR n_regionkey < 3""")
def qualified_names(spark, sf_dir):
    leaf = (F.col("p_size") % 25).cast("string")
    refs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), F.when(F.col("p_size") >= 25, F.concat(F.lit("Sym"), leaf)).otherwise(F.concat(F.lit("Low."), F.lit("sym"), leaf)).alias("name"))
    folder = F.when(F.col("n_regionkey") < 3, "src/low/").otherwise("src/high/")
    symbols = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("sym"), "n_nationkey").alias("name"), F.concat(F.lit("sym"), "n_nationkey").alias("simple_name"), F.concat(folder, F.lit("f.js")).alias("path"))
    return projections.resolve_qualified(refs, symbols)


@query("""SELECT n_name AS "from", 'in' AS relation, r_name AS "to", 'Join: ' || n_name || '.r = ' || r_name || '.id' AS description FROM nation JOIN region ON r_regionkey = n_regionkey""")
def schema_relations(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pairs = F.array(F.struct(F.lit("r").alias("field"), F.lit("id").alias("related")))
    relations = n.join(F.broadcast(r), F.col("r_regionkey") == F.col("n_regionkey")).select(F.lower("n_name").alias("from"), F.lower("r_name").alias("to"), F.lit("in").alias("title"), F.lit("").alias("alias"), F.lit("one").alias("type"), pairs.alias("pairs"))
    gone = relations.withColumn("to", F.lit("nowhere"))
    return projections.schema_relations(relations.unionByName(gone), n.select(F.col("n_name").alias("name")).unionByName(r.select(F.col("r_name").alias("name"))))


@query("""WITH p AS (SELECT conv_id, list(role ORDER BY turn) AS a FROM conversations GROUP BY 1), q AS (SELECT a.conv_id, a.a AS x, b.a AS y FROM p a JOIN p b ON b.conv_id = a.conv_id + 1),
l AS (SELECT conv_id, x, y, unnest(range(1, len(x) + 1)) AS i FROM q), m AS (SELECT conv_id, x, y, i, unnest(range(1, len(x) - i + 2)) AS n FROM l)
SELECT conv_id, max(CASE WHEN contains(',' || array_to_string(y, ',') || ',', ',' || array_to_string(x[i:i + n - 1], ',') || ',') THEN n ELSE 0 END) AS run FROM m GROUP BY 1""")
def common_runs(spark, sf_dir):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r.role)
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(roles.alias("a"))
    nxt = p.select((F.col("conv_id") - 1).alias("conv_id"), F.col("a").alias("b"))
    return p.join(nxt, "conv_id").select("conv_id", arrays.longest_common_run(F.col("a"), F.col("b")).alias("run"))


@query("""SELECT DISTINCT p_type AS entity, 0 AS pos, p_type || 'x' AS field FROM part WHERE p_type IN (SELECT p_type FROM (SELECT DISTINCT p_type FROM part) ORDER BY p_type LIMIT 5)""")
def description_targets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    entities = p.select(F.col("p_type").alias("entity")).distinct().withColumn("ord", F.lit(0))
    field = lambda pos, name, said: entities.select("entity", F.lit(pos).alias("pos"), name.alias("field"), said.alias("description"))
    fields = field(0, F.concat("entity", F.lit("x")), F.lit(" ")).unionByName(field(1, F.lit("known"), F.lit("what it is")))
    return incremental.description_targets(entities, fields)
