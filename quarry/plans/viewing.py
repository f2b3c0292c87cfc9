"""Projections of symbols, flows, arcs and knowledge on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import arcs as arc_operators
from quarry.operators import projections
from quarry.plans.registry import query
from quarry.runtime import table


def lines_of_customers(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


@query("""WITH n AS (SELECT o_custkey AS src, l_partkey AS dst, max(l_quantity) AS priority, CASE max(l_quantity) > 25 WHEN true THEN 'calls' ELSE 'reads' END AS relation FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
k AS (SELECT src, string_agg(dst || '/' || relation, ',' ORDER BY priority DESC, dst) AS near FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY priority DESC, dst) AS k FROM n) WHERE k <= 18 GROUP BY 1)
SELECT w.id, CASE WHEN c.c_custkey IS NULL THEN 'missing' ELSE c_mktsegment END AS kind, CASE WHEN c.c_custkey IS NULL THEN CAST(w.id AS VARCHAR) ELSE 'customer#' || c_name END AS path, substr(coalesce(d.text, ''), 1, 2600) AS excerpt, coalesce(near, '') AS near
FROM (SELECT DISTINCT doc_id AS id FROM documents) w LEFT JOIN customer c ON c_custkey = w.id LEFT JOIN documents d ON d.doc_id = c.c_custkey LEFT JOIN k ON k.src = w.id""")
def symbol_observations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    symbols = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("path"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind")).join(docs, "id", "left").withColumnRenamed("text", "body")
    n = lines_of_customers(spark, sf_dir).groupBy(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.max("l_quantity").alias("priority"))
    n = n.withColumn("relation", F.when(F.col("priority") > 25, "calls").otherwise("reads"))
    out = projections.observations(docs, symbols, n)
    return out.select("id", "kind", "path", "excerpt", F.array_join(F.transform("neighbours", lambda x: F.concat_ws("/", x.dst, x.relation)), ",").alias("near"))


@query("""SELECT (SELECT count(*) FROM part) AS symbols, (SELECT count(DISTINCT p_brand) FROM part) AS files, (SELECT string_agg(p_partkey, ',' ORDER BY p_retailprice DESC, p_partkey) FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 24)) AS entries""")
def repository_orientation(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"), F.col("p_retailprice").alias("priority"))
    return projections.orientation(p).withColumn("entries", F.array_join("entries", ","))


@query("""SELECT p_partkey AS id, p_brand || '#' || p_name AS path, 'search' AS relation, p_name AS label, substr('of size ' || p_size || '; ' || p_type, 1, 260) AS hint FROM part""")
def candidate_descriptors(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.lit("symbol").alias("kind"), F.col("p_type").alias("signature"), "p_size")
    return p.select(*projections.descriptor(F.lit("search"), F.concat(F.lit("of size "), F.col("p_size")))).drop("kind")


@query("""WITH b AS (SELECT o_custkey AS src, l_partkey AS dst, max(l_extendedprice) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N' GROUP BY 1, 2), k AS (SELECT src, string_agg(dst, ',' ORDER BY p DESC, dst) AS called FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY p DESC, dst) AS k FROM b) WHERE k <= 18 GROUP BY 1)
SELECT c_custkey AS id, c_name AS body, coalesce(called, '') AS called FROM customer LEFT JOIN k ON src = c_custkey""")
def function_details(spark, sf_dir):
    relation = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "R", "writes").otherwise("called_by")
    edges = lines_of_customers(spark, sf_dir).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), relation.alias("relation"), F.col("l_extendedprice").alias("priority"))
    symbols = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("body"))
    return projections.function_details(symbols, edges).withColumn("called", F.coalesce(F.array_join("called", ","), F.lit("")))


@query("""WITH f AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') AS path FROM pages), p AS (SELECT path, string_split(path, '/') AS p FROM f WHERE path <> ''),
a AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS directory, k AS depth FROM (SELECT p, unnest(range(0, least(len(p) - 1, 3) + 1)) AS k FROM p)),
h AS (SELECT directory, string_agg(name, ',' ORDER BY name) AS files FROM (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY name) AS k FROM (SELECT DISTINCT array_to_string(p[1:len(p) - 1], '/') AS directory, p[len(p)] AS name FROM p WHERE len(p) - 1 < 3)) WHERE k <= 12 GROUP BY 1)
SELECT a.directory, a.depth, coalesce(files, '') AS files FROM a LEFT JOIN h ON h.directory = a.directory""")
def shallow_tree(spark, sf_dir):
    f = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/+$", "").alias("path")).distinct()
    return projections.shallow_tree(f).withColumn("files", F.array_join("files", ","))


@query("""WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS tokens FROM conversations)
SELECT conv_id, turn, array_to_string(CASE WHEN list_position(tokens, 'the') > 0 THEN tokens[1:list_position(tokens, 'the')] ELSE tokens END, ' ') AS clipped FROM t""")
def clipped_paths(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(projections.clip_at(F.split("text", " "), F.lit("the")), " ").alias("clipped"))


@query("""SELECT src, dst, relation, row_number() OVER (PARTITION BY src ORDER BY relation || ':' || CAST(dst AS VARCHAR)) AS place FROM (SELECT DISTINCT o_custkey AS src, l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'calls' ELSE 'writes' END AS relation FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A') WHERE dst IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def executable_edges(spark, sf_dir):
    relation = F.when(F.col("l_returnflag") == "A", "calls").otherwise("writes")
    edges = lines_of_customers(spark, sf_dir).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), relation.alias("relation")).distinct()
    return projections.executable_edges(edges, table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("id")), ["calls", "routes_to"])


@query("""WITH e AS (SELECT source AS id, min(doc_id) AS ord, lang AS entity FROM documents WHERE lang <> '' GROUP BY 1, 3), f AS (SELECT source AS id, text AS field, min(doc_id) AS ord FROM documents WHERE trim(text) <> '' GROUP BY 1, 2)
SELECT id, (SELECT string_agg(entity, ',' ORDER BY ord, entity) FROM e WHERE e.id = d.id) AS entities, (SELECT string_agg(length(field), ',' ORDER BY ord, field) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, field) AS k FROM f) x WHERE x.id = d.id AND k <= 30) AS lengths FROM (SELECT DISTINCT source AS id FROM documents) d""")
def arc_summaries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("ord"), "lang", "text")
    none = d.limit(0).select("id", "ord", F.lit("").alias("from"), F.lit("").alias("relation"), F.lit("").alias("to"))  # documents have no relations
    out = projections.arc_summaries(d.select("id", F.col("id").alias("title"), F.lit("").alias("intent")).distinct(), d.withColumnRenamed("lang", "entity"), d.withColumnRenamed("text", "field"), none)
    return out.select("id", F.array_join("entities", ",").alias("entities"), F.array_join(F.transform("field_names", F.length), ",").alias("lengths"))


@query("""WITH e AS (SELECT user_id AS arc, event_id AS ord, props, event_type FROM events), a AS (SELECT user_id AS arc, CASE WHEN max(value) > 300 THEN 'broadly_complete' WHEN count(*) >= 30 THEN 'building' ELSE 'early' END AS status FROM events GROUP BY 1)
SELECT a.arc, status, a.arc || '-e' || row_number() OVER (PARTITION BY a.arc ORDER BY ord) AS step, props AS artifact, event_type AS meaning FROM a JOIN e ON e.arc = a.arc""")
def story_projection(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.groupBy(F.col("user_id").alias("arc")).agg(F.when(F.max("value") > 300, "broadly_complete").otherwise("forming").alias("status"), F.count("*").alias("progress"))
    return projections.story_projection(a, e.select(F.col("user_id").alias("arc"), F.col("event_id").alias("ord"), F.col("props").alias("artifact"), F.col("event_type").alias("meaning")))


@query("""SELECT 'workflow' AS type, c_custkey AS id, c_name AS label, c_mktsegment AS commit, c_mktsegment AS validated FROM customer UNION ALL SELECT 'rule', o_orderkey, o_orderpriority, o_orderstatus, 'v' FROM orders
UNION ALL SELECT 'concept', p_partkey, p_name, p_brand, p_brand FROM part WHERE p_size > 25 UNION ALL SELECT 'persistent_data', s_suppkey, s_name, NULL, NULL FROM supplier""")
def knowledge_items(spark, sf_dir):
    def rows(name, id_, label, commit, validated=None, **more):
        text = lambda c: F.lit(None).cast("string") if c is None else c
        return table(spark, sf_dir, name).select(F.col(id_).alias("id"), F.col(label).alias("label"), text(commit).alias("commit"), text(validated).alias("validated"), F.array().cast("array<string>").alias("files"), *(c.alias(k) for k, c in more.items()))

    kind = F.when(F.col("p_size") > 25, "business_concept").otherwise("technical")
    return projections.knowledge_items(rows("customer", "c_custkey", "c_name", F.col("c_mktsegment")), rows("orders", "o_orderkey", "o_orderpriority", F.col("o_orderstatus"), F.lit("v")), rows("part", "p_partkey", "p_name", F.col("p_brand"), kind=kind), rows("supplier", "s_suppkey", "s_name", None)).drop("files")


@query("""WITH e AS (SELECT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem), b AS (SELECT src AS id, dst AS node FROM e UNION SELECT dst, src FROM e)
SELECT id, node, kind FROM (SELECT b.*, s.kind, row_number() OVER (PARTITION BY id ORDER BY b.node) AS k FROM b JOIN (SELECT s_suppkey + 1000000 AS node, s_name AS kind FROM supplier UNION ALL SELECT p_partkey, p_brand FROM part) s ON s.node = b.node WHERE id IN (SELECT p_partkey FROM part UNION ALL SELECT s_suppkey + 1000000 FROM supplier WHERE s_acctbal > 5000)) WHERE k <= 30""")
def one_hop(spark, sf_dir):
    far = (F.col("s_suppkey") + 1000000).alias("node")
    parts, suppliers = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    nodes = suppliers.select(far, F.col("s_name").alias("kind")).unionByName(parts.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("kind")))
    wanted = parts.select(F.col("p_partkey").alias("id")).unionByName(suppliers.where("s_acctbal > 5000").select(far.alias("id")))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"))
    return projections.one_hop(wanted, edges, nodes)


_KEYS = list(arc_operators.CHECKLIST)
_KEY = "list_extract([" + ", ".join(f"'{k}'" for k in _KEYS) + "], CAST(doc_id % 10 AS INT) + 1)"


@query(f"""SELECT doc_id // 10 AS story, trim(regexp_replace({_KEY}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) || ': ' || CASE WHEN toxic = 1 THEN 'toxic' ELSE 'partial' END AS gap FROM labels WHERE quality <> 1""")
def remaining_gaps(spark, sf_dir):
    key = F.get(F.array(*map(F.lit, _KEYS)), (F.col("doc_id") % 10).cast("int"))
    rows = table(spark, sf_dir, "labels").select(F.expr("doc_id div 10").alias("story"), key.alias("key"), F.when(F.col("quality") == 1, "supported").otherwise("partial").alias("status"), F.when(F.col("toxic") == 1, "toxic").alias("summary"))
    return projections.remaining_gaps(rows)


@query("""SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS incomplete, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS reviewed""")
def learning_progress(spark, sf_dir):
    return projections.learning_progress(table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("closed")), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path")))


@query("""SELECT c_custkey AS id, substr(trim(c_name), 1, 110) AS name, coalesce(nullif(trim(d.text[1:0] || coalesce(d.source, '')), ''), c_mktsegment) AS description, c_mktsegment AS state FROM customer LEFT JOIN documents d ON d.doc_id = c_custkey WHERE c_acctbal >= 0""")
def workflow_catalogue(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("c_custkey"), F.col("source").alias("intent"))
    c = table(spark, sf_dir, "customer").join(docs, "c_custkey", "left")
    return projections.workflow_catalogue(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), "intent", F.col("c_mktsegment").alias("outcome"), F.col("c_mktsegment").alias("state"), (F.col("c_acctbal") < 0).alias("hidden")))


@query("""WITH e AS (SELECT DISTINCT p_name AS name FROM part WHERE NOT regexp_matches(p_name, '\\b(?:service|services|record|records|result|results|output|retrieved|created)\\b', 'i') AND regexp_matches(p_name, '^[A-Za-z][A-Za-z0-9 _-]*$'))
SELECT DISTINCT p.p_name AS "from", p.p_type AS relation, q.p_name AS "to" FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1 WHERE p.p_name IN (SELECT name FROM e) AND q.p_name IN (SELECT name FROM e)""")
def schema_navigation(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("to"))
    relations = p.join(nxt, "p_partkey").select(F.col("p_name").alias("from"), F.col("p_type").alias("relation"), "to")
    return projections.schema_navigation(p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("description")), relations)[1]


@query("""WITH g AS (SELECT o_custkey AS session, o_orderkey AS ord, p_name AS entity FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1),
k AS (SELECT session, string_agg(entity, ', ' ORDER BY ord, entity) AS names FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord, entity) AS k FROM g WHERE entity <> '') WHERE k <= 5 GROUP BY 1)
SELECT o.session, 'data_analytics' AS intent, CASE WHEN names IS NOT NULL THEN 'The walk found ' || names || ', but no view with their fields was completed.' ELSE 'The walk found too few fields for a reliable view.' END AS answer FROM (SELECT DISTINCT o_custkey AS session FROM orders) o LEFT JOIN k ON k.session = o.session""")
def fallback_answers(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("entity"))
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").join(names, "l_partkey").select(F.col("l_orderkey").alias("ord"), "entity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("ord"))
    return projections.fallback_answer(orders.join(first, "ord", "left"))
