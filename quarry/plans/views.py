"""Schema graph and compiled data views over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import schema_graph
from quarry.plans.dataview import Item, Join, Link, View, compile_view
from quarry.plans.registry import query
from quarry.runtime import table

#: What the star tables' evidence supports.
LINKS = [
    Link("orders", "customer", (("o_custkey", "c_custkey"),)),
    Link("lineitem", "orders", (("l_orderkey", "o_orderkey"),)),
    Link("lineitem", "part", (("l_partkey", "p_partkey"),)),
    Link("lineitem", "supplier", (("l_suppkey", "s_suppkey"),)),
    Link("customer", "nation", (("c_nationkey", "n_nationkey"),)),
    Link("supplier", "nation", (("s_nationkey", "n_nationkey"),)),
    Link("nation", "region", (("n_regionkey", "r_regionkey"),)),
]


def compiled(spark, sf_dir, view):
    names = {i.entity for i in view.select} | {e for j in view.joins for e in (j.left, j.right)}
    return compile_view(view, {n: table(spark, sf_dir, n) for n in names}, LINKS)


@query("SELECT c_mktsegment, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def view_revenue_by_segment(spark, sf_dir):
    v = View(
        (Item("customer", "c_mktsegment"), Item("lineitem", "l_extendedprice", "revenue", "measure")),
        (Join("lineitem", "orders"), Join("orders", "customer")),
        group_by=("customer.c_mktsegment",),
        order_by=(("revenue", "desc"),),
    )
    return compiled(spark, sf_dir, v).withColumn("revenue", F.round("revenue", 2))


@query("SELECT r_name, count(s_suppkey) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def view_suppliers_by_region(spark, sf_dir):
    v = View((Item("region", "r_name"), Item("supplier", "s_suppkey", "suppliers", "measure", "count")), (Join("supplier", "nation"), Join("nation", "region")), group_by=("region.r_name",))
    return compiled(spark, sf_dir, v)


@query("SELECT p_brand, round(avg(l_quantity), 6) AS quantity, max(l_discount) AS discount FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1")
def view_returns_by_brand(spark, sf_dir):
    v = View((Item("part", "p_brand"), Item("lineitem", "l_quantity", "quantity", "measure", "avg"), Item("lineitem", "l_discount", "discount", "measure", "max")), (Join("lineitem", "part"),), filters=("l_returnflag = 'R'",), group_by=("part.p_brand",))
    return compiled(spark, sf_dir, v).withColumn("quantity", F.round("quantity", 6))


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def view_large_orders(spark, sf_dir):
    v = View((Item("orders", "o_orderkey", role="key"), Item("customer", "c_name"), Item("orders", "o_totalprice")), (Join("orders", "customer"),), filters=("o_totalprice > 300000",))
    return compiled(spark, sf_dir, v)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def view_order_states(spark, sf_dir):
    v = View((Item("orders", "o_orderstatus"), Item("orders", "o_orderpriority")), group_by=("orders.o_orderstatus", "orders.o_orderpriority"))
    return compiled(spark, sf_dir, v)


_GRAPH = "SELECT 'N' || n_nationkey AS id, n_name AS name, n_regionkey AS r FROM nation"


def _graph(spark, sf_dir):
    """Nations as entities and shadow concepts, their keys as fields, some foreign, and a
    foreign key to the region's entity, valid where the field is owned."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    none = F.lit(None).cast("string")
    node = lambda df, p, kind, key, name, owner=none, field=none: df.select(F.concat(F.lit(p), key).alias("id"), F.lit(kind).alias("type"), name.alias("name"), owner.alias("owner"), field.alias("field"), F.lit(kind == "entity").alias("resolved"), F.col(key).cast("long").alias("seq"))
    nodes = node(n, "N", "entity", "n_nationkey", F.col("n_name")).unionByName(node(n, "C", "concept", "n_nationkey", F.lower(F.regexp_replace("n_name", "_", " "))))
    nodes = nodes.unionByName(node(r, "R", "entity", "r_regionkey", F.col("r_name"))).unionByName(node(r, "K", "field", "r_regionkey", F.lit("r_regionkey"), F.col("r_name"), F.lit("r_regionkey")))
    owner = F.when(F.col("n_nationkey") % 4 == 0, F.lit("someone else")).otherwise(F.col("n_name"))
    nodes = nodes.unionByName(node(n, "F", "field", "n_nationkey", F.lit("n_regionkey"), owner, F.lit("n_regionkey")))
    maps = F.array(F.struct(F.lit("n_regionkey").alias("field"), F.lit("r_regionkey").alias("related")))
    link = lambda df, a, ak, b, bk, rel, kind, m, s: df.select(F.concat(F.lit(a), ak).alias("src"), F.concat(F.lit(b), bk).alias("dst"), F.lit(rel).alias("relationship"), F.lit(kind).alias("kind"), m.alias("maps"), (F.col(ak) * 10 + s).cast("long").alias("seq"))
    empty = F.array().cast("array<struct<field:string,related:string>>")
    links = link(n, "N", "n_nationkey", "F", "n_nationkey", "has field", "", empty, 0).unionByName(link(r, "R", "r_regionkey", "K", "r_regionkey", "has field", "", empty, 1))
    for k in (2, 3):  # twice the same
        links = links.unionByName(link(n, "N", "n_nationkey", "R", "n_regionkey", "references", "schema_fk", maps, k))
    return nodes, links.unionByName(link(n, "R", "n_regionkey", "C", "n_nationkey", "mentions", "", empty, 4))


@query(f"""WITH n AS (SELECT * FROM nation)
SELECT 'N' || n_nationkey AS src, 'F' || n_nationkey AS dst, 'has field' AS relationship, '' AS kind, true AS evidenced FROM n WHERE n_nationkey % 4 <> 0
UNION ALL SELECT 'R' || r_regionkey, 'K' || r_regionkey, 'has field', '', true FROM region
UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'references', CASE WHEN n_nationkey % 4 = 0 THEN 'schema_reference' ELSE 'schema_fk' END, n_nationkey % 4 <> 0 FROM n
UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, 'mentions', '', true FROM n""")
def graph_normalize(spark, sf_dir):
    return schema_graph.normalise(*_graph(spark, sf_dir))[1].select("src", "dst", "relationship", "kind", "evidenced")


@query("""SELECT 'N' || n_nationkey AS id, 'entity' AS type FROM nation UNION ALL SELECT 'R' || r_regionkey, 'entity' FROM region UNION ALL SELECT 'K' || r_regionkey, 'field' FROM region
UNION ALL SELECT 'F' || n_nationkey, 'field' FROM nation WHERE n_nationkey % 4 <> 0""")
def graph_normalize_nodes(spark, sf_dir):
    return schema_graph.normalise(*_graph(spark, sf_dir))[0].select("id", "type")


@query("SELECT n_name AS \"from\", 'references' AS relationship, r_name AS \"to\", 'n_regionkey' AS field, 'r_regionkey' AS related FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0")
def graph_projection(spark, sf_dir):
    return schema_graph.navigation(*schema_graph.normalise(*_graph(spark, sf_dir)))


@query("""WITH p AS (SELECT n_nationkey AS k, n_name, n_regionkey AS r FROM nation)
SELECT n_name AS rel, 0 AS pos, 'n_regionkey' AS field, CASE WHEN k % 3 = 0 THEN 'r_regionkey' WHEN k % 3 = 1 THEN 'n_regionkey' ELSE 'r_regionkey' END AS related, k % 3 <> 0 AS implicit FROM p""")
def schema_key_maps(spark, sf_dir):
    """Three kinds of declaration: a full pair, a field that the target names too, and a
    field that falls back to the target's only key."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    related = F.when(F.col("n_nationkey") % 3 == 0, "r_regionkey").otherwise("")
    relations = n.select(F.col("n_name").alias("rel"), F.col("n_name").alias("from"), F.concat(F.lit("region"), F.col("n_nationkey") % 3).alias("to"), F.array(F.struct(F.lit("n_regionkey").alias("field"), related.alias("related"))).alias("maps"))
    rows = [(f"region{k}", name, pk, i) for k in range(3) for i, (name, pk) in enumerate([("r_regionkey", True), ("n_regionkey" if k == 1 else "r_name", False)])]
    fields = spark.createDataFrame(rows, "entity string, name string, is_pk boolean, ord int")
    return schema_graph.key_maps(relations, fields)


@query("""WITH u AS (SELECT DISTINCT event_type AS w, props AS e FROM events), p AS (SELECT a.w AS a, b.w AS b, a.e FROM u a JOIN u b ON a.e = b.e AND a.w <> b.w)
SELECT a, b, count(*) AS shared, (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT e FROM p q WHERE q.a = p.a AND q.b = p.b ORDER BY e LIMIT 8)) AS entities FROM p GROUP BY a, b""")
def related_workflows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("workflow"), F.col("props").alias("entity"))
    return schema_graph.related_workflows(e).withColumn("entities", F.array_join("entities", ","))
