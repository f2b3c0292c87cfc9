"""Graph and call-path operators on edges derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import arrays, text
from quarry.operators import families, graph, path_counts
from quarry.operators.path_counts import PathGraph
from quarry.plans.registry import query
from quarry.runtime import table

_STEPS = "SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"
_TRANSITIONS = f"SELECT DISTINCT src, dst FROM ({_STEPS}) WHERE dst IS NOT NULL AND src <> dst"
_TREE = """SELECT 'R' || r_regionkey AS src, 'N' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier"""
_TREE_NODES = f"SELECT src AS id FROM ({_TREE}) UNION SELECT dst FROM ({_TREE})"


def transitions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return e.where("dst IS NOT NULL AND src <> dst").distinct()


def tree(spark, sf_dir):
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    id_ = lambda p, c: F.concat(F.lit(p), F.col(c))
    down = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(id_("R", "r_regionkey").alias("src"), id_("N", "n_nationkey").alias("dst"))
    return down.unionByName(s.select(id_("N", "s_nationkey").alias("src"), id_("S", "s_suppkey").alias("dst")))


def ends(edges):
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@query("SELECT conv_id, turn AS src, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst, 'next_in_source' AS relation FROM conversations QUALIFY dst IS NOT NULL")
def next_in_source(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("id"))
    e = graph.next_in_source(c, "conv_id", "turn", "id")
    return e.select("src.conv_id", F.col("src.turn").alias("src"), F.col("dst.turn").alias("dst"), "relation")


@query("""WITH n AS (SELECT l_orderkey AS p, l_linenumber AS o, o_orderstatus AS tag, l_orderkey * 1000 + l_linenumber AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
d AS (SELECT DISTINCT p, id, tag FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY id) AS r, lead(id) OVER (PARTITION BY p ORDER BY id) AS nx FROM d)
SELECT p * 1000 AS src, id AS dst, CASE WHEN tag = 'F' THEN 'routes_to' ELSE 'calls' END AS relation FROM k WHERE r = 1 OR tag <> 'O'
UNION ALL SELECT id, nx, 'returns_to' FROM k WHERE nx IS NOT NULL AND tag = 'O'""")
def sibling_sequence(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct(), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    tag = F.when(F.col("o_orderstatus") == "F", "screen").when(F.col("o_orderstatus") == "O", "form").otherwise("if")
    n = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") * 1000).alias("parent"), tag.alias("parent_tag"), F.col("l_linenumber").alias("ord"))
    return graph.sibling_sequence(n)


@query(f"""WITH e AS ({_TREE}) SELECT n.id, coalesce(d, 0) AS in_degree, d IS NULL AS is_root FROM ({_TREE_NODES}) n LEFT JOIN (SELECT dst, count(*) AS d FROM e GROUP BY 1) c ON c.dst = n.id""")
def in_degree_roots(spark, sf_dir):
    e = tree(spark, sf_dir)
    return graph.in_degree(ends(e), e)


@query(f"SELECT DISTINCT dst AS symbol, src AS caller, 'called_by' AS relation FROM ({_TRANSITIONS})")
def callers(spark, sf_dir):
    return graph.callers(transitions(spark, sf_dir))


@query(f"""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM ({_TREE}) UNION SELECT dst, src FROM ({_TREE})),
w AS (SELECT DISTINCT 'R' || r_regionkey AS start, 'R' || r_regionkey AS id, 0 AS depth FROM region UNION SELECT w.start, e.b, depth + 1 FROM w JOIN e ON e.a = w.id WHERE depth < 3)
SELECT start, id, min(depth) AS depth FROM w GROUP BY 1, 2""")
def khop_neighborhood(spark, sf_dir):
    start = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"))
    return graph.neighbourhood(tree(spark, sf_dir), start, 3)


_DAG_PATHS = f"""RECURSIVE e AS ({_TREE}), p AS (
 SELECT [id] AS path, id AS tip FROM ({_TREE_NODES}) WHERE id NOT IN (SELECT dst FROM e)
 UNION ALL SELECT list_append(path, dst), dst FROM p JOIN e ON e.src = p.tip), m AS (SELECT path FROM p WHERE tip NOT IN (SELECT src FROM e))"""
_CYCLE_PATHS = f"""RECURSIVE e AS ({_TRANSITIONS}), p AS (
 SELECT [min(src)] AS path, min(src) AS tip, CAST(NULL AS VARCHAR) AS target FROM e
 UNION ALL SELECT CASE WHEN list_contains(path, dst) THEN path ELSE list_append(path, dst) END, dst, CASE WHEN list_contains(path, dst) THEN dst END FROM p JOIN e ON e.src = p.tip WHERE target IS NULL)"""


@query(f"WITH {_DAG_PATHS} SELECT array_to_string(path, '>') AS path, 'end' AS terminal FROM m")
def maximal_paths_dag(spark, sf_dir):
    e = tree(spark, sf_dir)
    return graph.maximal_paths(ends(e), e).select(F.array_join("path", ">").alias("path"), "terminal")


@query(f"WITH {_CYCLE_PATHS} SELECT array_to_string(path, '>') AS path, 'cycle' AS terminal, target FROM p WHERE target IS NOT NULL")
def maximal_paths_cycle(spark, sf_dir):
    e = transitions(spark, sf_dir)
    return graph.maximal_paths(ends(e), e).select(F.array_join("path", ">").alias("path"), "terminal", "target")


def supply(spark, sf_dir):
    """Regions, nations, suppliers, parts and brands as a graph without cycles."""
    id_ = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    made = table(spark, sf_dir, "lineitem").select(id_("S", "l_suppkey").alias("src"), id_("P", "l_partkey").alias("dst"))
    brands = table(spark, sf_dir, "part").select(id_("P", "p_partkey").alias("src"), F.col("p_brand").alias("dst"))
    return tree(spark, sf_dir).unionByName(made).unionByName(brands)


@query("""WITH s AS (SELECT DISTINCT 'R' || n_regionkey AS root, l_suppkey AS s FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
u AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), d AS (SELECT s.root, p_brand AS leaf, count(*) AS n FROM s JOIN u USING (s) JOIN part ON p_partkey = p GROUP BY 1, 2),
x AS (SELECT 'R' || n_regionkey AS root, 'S' || s_suppkey AS leaf, 1 AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey NOT IN (SELECT s FROM u)
 UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, 1 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
 UNION ALL SELECT 'P' || p_partkey, p_brand, 1 FROM part WHERE p_partkey NOT IN (SELECT p FROM u) UNION ALL SELECT 'S' || s, p_brand, count(*) FROM u JOIN part ON p_partkey = p WHERE s NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2)
SELECT root, leaf, CAST(n AS BIGINT) AS paths FROM d UNION ALL SELECT root, leaf, CAST(n AS BIGINT) FROM x""")
def path_pair_counts(spark, sf_dir):
    return PathGraph(None, supply(spark, sf_dir)).pairs().withColumn("paths", F.col("paths").cast("long"))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT user_id || ':' || props AS id FROM events), e AS (SELECT DISTINCT src, dst FROM (SELECT user_id || ':' || props AS src, lead(user_id || ':' || props) OVER (PARTITION BY user_id ORDER BY event_id) AS dst, value FROM events) WHERE dst IS NOT NULL AND value > 15),
r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
SELECT n.id, coalesce(min(x.b), n.id) AS part FROM n LEFT JOIN (SELECT x.a, least(x.a, x.b) AS b FROM r x JOIN r y ON y.a = x.b AND y.b = x.a) x ON x.a = n.id GROUP BY n.id""")
def strong_parts(spark, sf_dir):
    """Each user's artifacts by the steps that lead from one to another and back."""
    own = F.concat_ws(":", F.col("user_id").cast("string"), "props")
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select(own.alias("id"), F.lead(own).over(w).alias("dst"), "value", F.col("user_id").alias("block"))
    return path_counts.strong_parts(rows.select("id"), rows.where("dst IS NOT NULL AND value > 15").select("block", F.col("id").alias("src"), "dst"))


_SUFFIXED = f"WITH {_DAG_PATHS}, x AS (SELECT path FROM m UNION ALL SELECT list_slice(path, 2, len(path)) FROM m WHERE len(path) > 1)"


@query(f"""{_SUFFIXED}, d AS (SELECT DISTINCT path FROM x), s AS (SELECT DISTINCT list_slice(path, i, len(path)) AS path FROM (SELECT path, unnest(range(2, len(path) + 1)) AS i FROM d))
SELECT array_to_string(path, '>') AS path FROM d WHERE path NOT IN (SELECT path FROM s)""")
def strict_suffix_elimination(spark, sf_dir):
    e = tree(spark, sf_dir)
    p = graph.maximal_paths(ends(e), e)
    cut = p.where(F.size("path") > 1).select(F.slice("path", 2, 1 << 20).alias("path"), "terminal", "target")
    return graph.drop_suffixes(p.unionByName(cut).distinct()).select(F.array_join("path", ">").alias("path"))


@query(f"""WITH {_DAG_PATHS}, s AS (SELECT DISTINCT list_slice(path, i, len(path)) AS path FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM m))
SELECT path[1] AS symbol, CASE WHEN len(path) = 1 THEN 'end' END AS terminal, count(*) AS n FROM s GROUP BY 1, 2""")
def fragment_count(spark, sf_dir):
    e = tree(spark, sf_dir)
    return graph.fragments(graph.maximal_paths(ends(e), e)).groupBy("symbol", "terminal").agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT DISTINCT lower(k) AS k, p_partkey FROM (SELECT p_name AS k, p_partkey FROM part UNION ALL SELECT string_split(p_name, ' ')[2], p_partkey FROM part)),
r AS (SELECT DISTINCT lower(p_name) AS ref FROM part)
SELECT ref, p_partkey AS symbol, k FROM (SELECT ref, p_partkey, row_number() OVER (PARTITION BY ref ORDER BY p_partkey) AS k FROM r JOIN i ON i.k = r.ref) WHERE k <= 4""")
def name_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    symbols = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.get(F.split("p_name", " "), F.lit(1)).alias("simple_name"), F.col("p_partkey").alias("ord"))
    refs = p.select(F.lower("p_name").alias("ref"), F.col("p_name").alias("name")).distinct()
    return graph.resolve_names(refs, symbols)


@query("""WITH s AS (SELECT p_partkey AS id, p_name AS name, string_split(p_name, ' ')[2] AS simple, p_brand AS src FROM part),
r AS (SELECT DISTINCT p_brand || ':' || p_name AS ref, p_name AS name, string_split(p_name, ' ')[2] AS simple, p_brand AS src FROM part),
a AS (SELECT ref, min(CASE WHEN s.src = r.src THEN id END) AS near, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS only FROM r JOIN s ON s.name = r.name GROUP BY 1),
b AS (SELECT ref, min(CASE WHEN s.src = r.src THEN id END) AS near, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS only FROM r JOIN s ON s.simple = r.simple GROUP BY 1)
SELECT r.ref, coalesce(a.near, a.only, b.near, b.only) AS symbol FROM r LEFT JOIN a ON a.ref = r.ref LEFT JOIN b ON b.ref = r.ref WHERE coalesce(a.near, a.only, b.near, b.only) IS NOT NULL""")
def precedence_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.get(F.split("p_name", " "), F.lit(1)).alias("simple_name"), F.col("p_brand").alias("source"))
    refs = p.select(F.concat_ws(":", "source", "name").alias("ref"), "name", "simple_name", "source").distinct()
    return graph.resolve_by_precedence(refs, p)


@query("SELECT o_orderkey AS ref FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def unresolved_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"))
    return graph.unresolved(refs, table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("ref")).distinct())


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'transition:view' WHEN 'click' THEN 'service:do.click#' || user_id WHEN 'signup' THEN 'navigate:home'
 WHEN 'purchase' THEN 'entity-find:order' ELSE 'code:error (x)' END AS token FROM events""")
def flow_tokens(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    signature = (
        F.when(F.col("event_type") == "view", F.lit('<transition name="View">'))
        .when(F.col("event_type") == "click", F.concat(F.lit("<service-call name='do.Click#"), "user_id", F.lit("'/>")))
        .when(F.col("event_type") == "signup", F.lit('<default-response url="../app/Home.xml?x=1"/>'))
        .when(F.col("event_type") == "purchase", F.lit('<entity-find entity-name="Order" list="a"/>'))
        .otherwise(F.lit("Error  (x)"))
    )
    return e.select("event_id", text.flow_token(signature).alias("token"))


@query("""WITH s AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, ts, event_id FROM events)
SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS tokens FROM s WHERE before IS NULL OR before <> event_type GROUP BY 1""")
def run_compression(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x.event_type).alias("t"))
    return e.select("user_id", F.array_join(arrays.compress_runs(F.col("t")), ">").alias("tokens"))


_ROLES = """SELECT conv_id AS id, list(role || ':' || md5(text) ORDER BY turn) AS t FROM conversations GROUP BY 1"""


def role_paths(spark, sf_dir):
    """Per conversation its turns in order, each as the role and a hash of the whole text."""
    c = table(spark, sf_dir, "conversations")
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.md5("text")).alias("x"))))
    return c.groupBy(F.col("conv_id").alias("id")).agg(F.transform(rows, lambda r: r.x).alias("tokens"))


@query(f"""WITH p AS ({_ROLES}),
c AS (SELECT a.id AS a, b.id AS b, a.t AS x, b.t AS y FROM p a JOIN p b ON a.id < b.id AND (a.t = b.t OR (len(a.t) > 1 AND len(b.t) > 1 AND (list_slice(a.t, 1, 2) = list_slice(b.t, 1, 2) OR list_slice(a.t, -2, -1) = list_slice(b.t, -2, -1))))),
l AS (SELECT *, least(len(x), len(y)) AS s, len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: list_slice(x, 1, i) = list_slice(y, 1, i))) AS p,
 len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: list_slice(x, -i, -1) = list_slice(y, -i, -1))) AS q FROM c),
z AS (SELECT *, greatest(0, least(q, s - p)) AS f FROM l)
SELECT a, b, CASE WHEN x = y THEN 'duplicate' WHEN p >= 2 AND p / s > 0.5 THEN 'branch' WHEN f >= 2 AND f / s > 0.5 AND greatest(len(x), len(y)) - f <= 2 THEN 'alternate_entrance' WHEN f >= 2 AND f / s > 0.5 THEN 'shared_subflow' ELSE 'independent' END AS relation,
 p AS prefix_length, CASE WHEN x = y THEN 0 ELSE f END AS suffix_length FROM z""")
def overlap_shape(spark, sf_dir):
    return families.overlap_pairs(role_paths(spark, sf_dir)).drop("ratio")


def turn_paths(conversations):
    """Per conversation its turns in order, each as the role and a hash of the whole text."""
    said = F.concat_ws(":", "role", F.coalesce(F.sha2("text", 256), F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("turn", said.alias("x"))))
    return conversations.groupBy(F.col("conv_id").alias("id")).agg(F.transform(rows, lambda r: r.x).alias("tokens"))


def families_of(conversations):
    """Families of conversations; of equal ones the least takes part and the others follow it."""
    whole = turn_paths(conversations)
    same = F.sha2(F.concat_ws("\x1e", "tokens"), 256)
    groups = whole.groupBy(same.alias("same")).agg(F.min_by("tokens", "id").alias("tokens"), F.min("id").alias("least"))
    found = families.path_families(groups.select(F.col("least").alias("id"), "tokens", (-F.size("tokens")).alias("rank")))
    members = whole.select("id", same.alias("same")).join(groups.select("same", "least"), "same")
    relation = F.when(F.col("m.id") == F.col("f.id"), F.col("f.relation")).otherwise("duplicate")
    return members.alias("m").join(found.alias("f"), F.col("m.least") == F.col("f.id")).select("m.id", "f.family", relation.alias("relation"))


@query("""WITH RECURSIVE w AS (SELECT conv_id AS id, list(role || ':' || coalesce(md5(text), '') ORDER BY turn) AS t FROM conversations GROUP BY 1),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY len(t) DESC, id) AS pos FROM (SELECT t, min(id) AS id FROM w GROUP BY t)),
l AS (SELECT a.pos AS a, b.pos AS b, a.t AS x, b.t AS y, least(len(a.t), len(b.t)) AS s, len(list_filter(range(1, least(len(a.t), len(b.t)) + 1), lambda i: list_slice(a.t, 1, i) = list_slice(b.t, 1, i))) AS p,
 len(list_filter(range(1, least(len(a.t), len(b.t)) + 1), lambda i: list_slice(a.t, -i, -1) = list_slice(b.t, -i, -1))) AS q FROM o a JOIN o b ON a.pos < b.pos AND (a.t[1] = b.t[1] OR a.t[-1] = b.t[-1])),
e AS MATERIALIZED (SELECT a, b, CASE WHEN p >= 2 AND p / s > 0.5 THEN 'branch' ELSE 'alternate_entrance' END AS relation FROM (SELECT *, greatest(0, least(q, s - p)) AS f FROM l)
 WHERE (p >= 2 AND p / s > 0.5) OR (f >= 2 AND f / s > 0.5 AND greatest(len(x), len(y)) - f <= 2)),
r AS (SELECT pos, pos AS to_ FROM o UNION SELECT r.pos, e.a FROM r JOIN e ON e.b = r.to_),
g AS MATERIALIZED (SELECT pos, min(to_) AS head FROM r GROUP BY pos),
m AS (SELECT e.b AS pos, arg_min(e.relation, e.a) AS relation FROM e JOIN g x ON x.pos = e.a JOIN g y ON y.pos = e.b WHERE x.head = y.head GROUP BY 1)
SELECT w.id, h.id AS family, CASE WHEN w.id <> o.id THEN 'duplicate' WHEN g.head = o.pos THEN 'representative' ELSE m.relation END AS relation FROM w JOIN o ON o.t = w.t JOIN g ON g.pos = o.pos JOIN o h ON h.pos = g.head LEFT JOIN m ON m.pos = o.pos""")
def path_families(spark, sf_dir):
    return families_of(table(spark, sf_dir, "conversations"))
