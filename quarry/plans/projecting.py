"""Projections, lookups and filters on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import knowledge
from quarry.plans.registry import query
from quarry.runtime import table


@query(r"""WITH m AS (SELECT page_id AS id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages)
SELECT id, count(*) AS links, count(DISTINCT url) AS targets FROM m GROUP BY 1""")
def page_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("url"))
    return p.groupBy("id").agg(F.count("*").alias("links"), F.count_distinct("url").alias("targets"))


@query("""WITH k AS (SELECT DISTINCT event_type AS language, props AS name FROM events WHERE value > 200), o AS (SELECT DISTINCT props AS name FROM events WHERE event_type <> 'view' AND value < 0.2)
SELECT event_id, event_type AS language, props AS name FROM events e WHERE props IN (SELECT name FROM o) OR NOT EXISTS (SELECT 1 FROM k WHERE k.language = e.event_type AND k.name = e.props)""")
def builtin_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    refs = e.select("event_id", F.col("event_type").alias("language"), F.col("props").alias("name"))
    hidden = e.where("value > 200").select(F.col("event_type").alias("language"), F.col("props").alias("name"))
    return knowledge.without_builtins(refs, hidden, e.where("event_type <> 'view' AND value < 0.2").select(F.col("props").alias("name")))


@query("SELECT c_custkey AS name, n_name AS schema FROM customer JOIN nation ON c_nationkey = n_nationkey")
def schema_ladder(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("geo.nation "), F.col("c_nationkey")).alias("name"))
    schemas = n.select(F.col("n_name").alias("schema"), F.concat(F.lit("x."), "n_name").alias("full_name"), F.col("n_nationkey").alias("seq"))
    found = knowledge.schema_ladder(c.select("name").distinct(), schemas)
    return c.join(found, "name").select(F.col("c_custkey").alias("name"), "schema")


@query("SELECT user_id, event_id, event_type AS type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type IN ('signup', 'purchase')) WHERE k = 1")
def latest_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("type"), "value")
    return knowledge.latest_of(e, ["user_id"], ["signup", "purchase"], "event_id")


@query("""WITH f AS (SELECT user_id, event_type || props AS node, min(event_id) AS pos FROM events GROUP BY 1, 2)
SELECT user_id, node, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS k FROM f) WHERE k <= 8""")
def trail_compaction(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.concat("event_type", "props").alias("node"), F.col("event_id").alias("pos"))
    return knowledge.compact_trail(e, ["user_id"])


@query("""WITH u AS (SELECT o_custkey AS entry, o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS rank FROM orders)
SELECT entry, rank, count(*) AS unseen FROM u WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) GROUP BY 1, 2 ORDER BY rank, entry LIMIT 12""")
def widening_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entry")).agg(F.min("o_orderkey").alias("rank"), F.collect_list("o_orderkey").alias("ids"))
    return knowledge.unseen_first(o, table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("id")))


@query("SELECT count(*) FILTER (l IS NOT NULL) AS learned, count(*) AS total, CAST(round(100 * count(*) FILTER (l IS NOT NULL) / count(*)) AS INT) AS percent FROM (SELECT DISTINCT d.doc_id, l.doc_id AS l FROM documents d LEFT JOIN (SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE n_chars > 5000) l ON l.doc_id = d.doc_id)")
def learning_coverage(spark, sf_dir):
    d, x = (table(spark, sf_dir, t).select(F.col("doc_id").alias("path")) for t in ("documents", "labels"))
    arcs = table(spark, sf_dir, "documents").where("n_chars > 5000").select(F.col("doc_id").alias("path"))
    return knowledge.learned_share(d, x, arcs)


@query("""SELECT event_type AS "from", props AS relation, CAST(user_id % 10 AS VARCHAR) AS "to", arg_min(event_id, CASE WHEN value > 100 THEN 0 ELSE 1 END * 1000000000 + event_id) AS seq FROM events GROUP BY 1, 2, 3""")
def relation_edges(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("from"), F.col("props").alias("relation"), (F.col("user_id") % 10).cast("string").alias("to"), F.when(F.col("value") > 100, "schema_fk").otherwise("business").alias("kind"), F.array(F.struct(F.lit("a").alias("field"))).alias("maps"), F.col("event_id").alias("seq"))
    return knowledge.relation_edges(e).select("from", "relation", "to", "seq")


@query("SELECT n_name AS arc, greatest(0.3, coalesce(max(c_acctbal), 0) / 10000) AS opportunity FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def best_opportunity(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    arcs = n.select(F.col("n_name").alias("arc"), F.lit(0.3).cast("double").alias("opportunity"))
    scores = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("arc"), (F.col("c_acctbal") / 10000).alias("score"))
    return knowledge.best_opportunity(arcs, scores)
