"""Priorities, signals and gates on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import ranking
from quarry.plans.graphs import role_paths
from quarry.plans.registry import query
from quarry.runtime import table

_REL = "CASE event_type WHEN 'view' THEN 'reads' WHEN 'click' THEN 'calls' WHEN 'signup' THEN 'triggers' WHEN 'purchase' THEN 'writes' ELSE 'other' END"
_PRI = "CASE event_type WHEN 'view' THEN 98 WHEN 'click' THEN 110 WHEN 'signup' THEN 130 WHEN 'purchase' THEN 102 ELSE 20 END"


@query(f"""WITH n AS (SELECT DISTINCT user_id AS src, props AS dst, {_REL} AS relation, {_PRI} AS p FROM events), b AS (SELECT src, dst, max(p) AS priority, arg_max(relation, p) AS relation FROM n GROUP BY 1, 2)
SELECT * FROM (SELECT src, dst, priority, relation, row_number() OVER (PARTITION BY src ORDER BY priority DESC, dst) AS k FROM b) WHERE k <= 18""")
def nearest_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.col("props").alias("dst"), F.expr(_REL).alias("relation")).distinct()
    return ranking.nearest(e)


@query("""SELECT p_partkey, CASE WHEN p_size = 1 THEN 25 ELSE 0 END + CASE WHEN p_type = 'SMALL' THEN 35 ELSE 0 END
 + CASE WHEN regexp_matches(lower(p_name || ' ' || p_brand), 'route|handler|controller|screen|transition|service|process|submit|create|place|checkout|order|approve|import|export|run|execute') THEN 20 ELSE 0 END
 - CASE WHEN regexp_matches(lower(p_name || ' ' || p_brand), 'test|spec|mock|fixture|util|helper') THEN 15 ELSE 0 END + least(15, p_size) AS priority FROM part""")
def entry_priority(spark, sf_dir):
    kind = F.when(F.col("p_type") == "SMALL", "service").otherwise("method")
    return table(spark, sf_dir, "part").select("p_partkey", ranking.entry_priority(F.col("p_name"), F.col("p_brand"), kind, F.col("p_size") - 1, F.col("p_size")).alias("priority"))


@query("SELECT source, count(*) AS total, count(l.doc_id) AS visited, count(*) - count(l.doc_id) AS uncovered FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1")
def file_coverage(spark, sf_dir):
    units = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"))
    return ranking.coverage(units, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("""SELECT source, arg_min(d.doc_id, (CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) * 1000000000000000 - n_chars * 1000000 + d.doc_id) AS id FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1""")
def representative_unit(spark, sf_dir):
    units = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("priority"))
    return ranking.representative(units, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("""WITH f AS (SELECT user_id AS packet, event_type AS arc, max(value) / 1000 AS score FROM events GROUP BY 1, 2), x AS (SELECT user_id AS packet, CASE WHEN user_id % 3 = 0 THEN 'view' WHEN user_id % 3 = 1 THEN 'NEW' ELSE '' END AS best FROM events GROUP BY 1),
t AS (SELECT packet, arc, score FROM (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY score DESC, arc) AS k FROM f) WHERE k = 1)
SELECT x.packet, CASE WHEN f.score >= 0.25 THEN x.best WHEN t.score >= 0.25 THEN t.arc WHEN x.best = 'NEW' THEN 'NEW' END AS arc FROM x LEFT JOIN f ON f.packet = x.packet AND f.arc = x.best LEFT JOIN t ON t.packet = x.packet""")
def evidence_arc(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    fits = e.groupBy(F.col("user_id").alias("packet"), F.col("event_type").alias("arc")).agg((F.max("value") / 1000).alias("score"))
    best = F.when(F.col("packet") % 3 == 0, "view").when(F.col("packet") % 3 == 1, "NEW").otherwise("")
    return ranking.select_arc(fits, e.select(F.col("user_id").alias("packet")).distinct().withColumn("best", best))


@query("""WITH s AS (SELECT user_id AS arc, event_id AS step, value / 300 AS s, event_type AS t, lag(value / 300, 1) OVER w AS a, lag(value / 300, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT arc, step, CASE WHEN s > 0.9 THEN 'complete' WHEN coalesce(b > a AND a > s AND b - s >= 0.1, false) THEN 'declining' WHEN s < 0.25 THEN 'weak' WHEN step % 7 = 0 THEN 'exhausted' WHEN t = 'error' AND s < 0.45 THEN 'drift' ELSE '' END AS reason FROM s""")
def scout_signal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = e.select(F.col("user_id").alias("arc"), F.col("event_id").alias("step"), (F.col("value") / 300).alias("score"), (F.col("event_id") % 7).alias("candidates"), F.when(F.col("event_type") == "error", "technical").otherwise("business").alias("classification"), (F.col("value") / 300 > 0.9).alias("complete"))
    return ranking.signal_reason(t).select("arc", "step", "reason")


@query("""WITH c AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS st, count(*) FILTER (o_orderstatus = 'O') AS en, count(*) FILTER (o_orderstatus = 'P') AS pe, count(DISTINCT o_orderpriority) - 1 AS re, count(*) FILTER (o_totalprice > 400000) AS ef, max(o_totalprice) > 300000 AS oc FROM orders GROUP BY 1),
d AS (SELECT *, CAST(st >= 2 AS INT) + CAST(en >= 2 AS INT) + CAST(pe >= 1 AS INT) + CAST(re >= 1 AS INT) + CAST(ef >= 1 AS INT) AS dims FROM c), e AS (SELECT *, dims >= 2 OR st >= 3 OR (en >= 2 AND oc) AS ok FROM d)
SELECT k AS custkey, dims AS dimensions, ok AS sufficient, CASE WHEN st > 0 AND pe < 3 AND ok THEN 'closed' WHEN st > 0 AND pe < 3 THEN 'needs_more_evidence' ELSE 'open' END AS closure FROM e""")
def evidence_depth(spark, sf_dir):
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(n("F").alias("st"), n("O").alias("en"), n("P").alias("pe"), (F.count_distinct("o_orderpriority") - 1).alias("re"), F.count(F.when(F.col("o_totalprice") > 400000, 1)).alias("ef"), (F.max("o_totalprice") > 300000).alias("oc"))
    dims, ok = ranking.evidence_depth(*(F.col(x) for x in ("st", "en", "pe", "re", "ef", "oc")))
    pending = F.when(F.col("pe") < 3, 0).otherwise(1)
    return c.select("custkey", dims.alias("dimensions"), ok.alias("sufficient"), ranking.closure(F.lit(True), F.col("st") > 0, pending, ok).alias("closure"))


_ROLES = "SELECT conv_id AS id, list(role || ':' || md5(text) ORDER BY turn) AS t FROM conversations GROUP BY 1"


@query(f"""WITH p AS ({_ROLES}), c AS (SELECT a.id AS child, b.id AS parent, len(b.t) AS n FROM p a JOIN p b ON a.id <> b.id AND len(b.t) > len(a.t) AND list_contains(b.t, a.t[1])
 WHERE len(list_filter(range(1, len(b.t) - len(a.t) + 2), lambda i: list_slice(b.t, i, i + len(a.t) - 1) = a.t)) > 0)
SELECT child, arg_min(parent, n * 1000000000 + parent) AS parent FROM c GROUP BY 1""")
def minimal_container(spark, sf_dir):
    return ranking.minimal_container(role_paths(spark, sf_dir).withColumn("ord", F.col("id")))


@query(f"""WITH p AS (SELECT id, unnest(list_distinct(t)) AS symbol, len(t) AS n FROM ({_ROLES}))
SELECT symbol, arg_min(id, -n * 1000000000 + id) AS path FROM p GROUP BY 1""")
def path_of_symbol(spark, sf_dir):
    return ranking.path_of_symbol(role_paths(spark, sf_dir).withColumnRenamed("tokens", "symbols"))


@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER w AS BIGINT) AS total_prompt, CAST(sum(turn) OVER w AS BIGINT) AS total_calls FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def usage_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("prompt"), F.col("turn").alias("calls"))
    return ranking.running_usage(c, "conv_id", "turn", ["prompt", "calls"])


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part), s AS (SELECT DISTINCT replace(p_name, ' ', '') AS schema FROM part UNION SELECT DISTINCT p_type FROM part),
f AS (SELECT DISTINCT p_type AS schema, lower(unnest(string_split(p_name, ' '))) || 'id' AS field FROM part WHERE p_size > 45),
c AS (SELECT name, schema, CASE WHEN starts_with(lower(schema), lower(name)) THEN 8 ELSE 5 END AS score FROM w JOIN s ON contains(lower(schema), lower(name)) AND lower(schema) <> lower(name)
 UNION ALL SELECT name, schema, 3 FROM w JOIN f ON field = lower(name) || 'id' WHERE lower(schema) <> lower(name)),
b AS (SELECT name, schema, sum(score) AS score FROM c GROUP BY 1, 2 UNION ALL SELECT DISTINCT unnest(string_split(p_name, ' ')), p_brand, 9 FROM part WHERE p_size = 50)
SELECT * FROM (SELECT name, schema, max(score) AS score, row_number() OVER (PARTITION BY name ORDER BY max(score) DESC, schema) AS k FROM b GROUP BY 1, 2) WHERE k <= 8""")
def candidate_schemas(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    word = F.explode(F.split("p_name", " ")).alias("name")
    schemas = p.select(F.regexp_replace("p_name", " ", "").alias("schema")).union(p.select("p_type")).distinct()
    fields = p.where("p_size > 45").select(F.col("p_type").alias("schema"), word).select("schema", F.concat("name", F.lit("Id")).alias("field"))
    stored = p.where("p_size = 50").select(word, F.col("p_brand").alias("schema"), F.lit("representation").alias("how")).distinct()
    return ranking.candidate_schemas(p.select(word).distinct(), schemas, fields, context=stored)


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 45 WHEN 'click' THEN 50 WHEN 'error' THEN -30 ELSE 0 END AS plain, CASE event_type WHEN 'view' THEN 135 WHEN 'click' THEN 140 WHEN 'error' THEN -75 WHEN 'signup' THEN 140 ELSE -70 END AS structured FROM events""")
def kind_adjustments(spark, sf_dir):
    kind = F.expr("CASE event_type WHEN 'view' THEN 'module_init' WHEN 'click' THEN 'ui_event' WHEN 'error' THEN 'config_value' WHEN 'signup' THEN 'screen' ELSE 'xml_entity_one' END")
    return table(spark, sf_dir, "events").select("event_id", ranking.kind_adjustment(kind).alias("plain"), ranking.kind_adjustment(kind, structured=True).alias("structured"))
