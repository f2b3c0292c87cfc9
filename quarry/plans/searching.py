"""Searches over documents, parts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import search
from quarry.plans.registry import query
from quarry.runtime import table


@query("""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT path, line_no, substr(trim(regexp_replace(line, '\\s+', ' ', 'g')), 1, 220) AS snippet FROM l WHERE contains(lower(path || ' ' || line), 'tion') AND contains(lower(path || ' ' || line), 'the ') ORDER BY path, line_no LIMIT 8""")
def line_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return search.line_search(d, ["tion", "the "])


@query("""WITH s AS (SELECT doc_id AS id, 5 * (CAST(contains(lower(source), 'src1') AS INT) + CAST(contains(lower(source), 'en') AS INT)) + CAST(contains(lower(text), 'src1') AS INT) + CAST(contains(lower(text), 'en') AS INT) AS score FROM documents)
SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 12""")
def symbol_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("header"), F.col("text").alias("body"))
    return search.symbol_search(d, ["src1", "en"])


@query("""WITH p AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part),
t AS (SELECT *, CASE WHEN w = ['hot', 'gear'] THEN 5 WHEN w[1] = 'hot' AND w[2] = 'gear' THEN 4
 WHEN contains(' ' || p_name || ' ', ' hot gear ') THEN 3 WHEN list_position(w, 'hot') > 0 AND list_contains(list_slice(w, list_position(w, 'hot') + 1, len(w)), 'gear') THEN 2
 WHEN list_contains(w, 'hot') THEN 1 ELSE 0 END AS tier FROM p)
SELECT p_partkey AS id, p_name AS name, tier, CASE WHEN tier >= 2 THEN 2 ELSE 1 END AS matched FROM t WHERE tier > 0 ORDER BY tier DESC, matched DESC, name, id LIMIT 12""")
def tiered_search(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return search.tiered_search(p, "hot gear")


@query("""WITH p AS (SELECT p_partkey, p_name, list_filter(string_split(lower(p_name), ' '), lambda x: length(x) > 1) AS w FROM part)
SELECT p_partkey, round((CAST(len(list_filter(w, lambda x: x = 'small' OR starts_with(x, 'small') OR (length(x) >= 4 AND starts_with('small', x)))) > 0 AS INT)
 + CAST(len(list_filter(w, lambda x: x = 'widgets' OR starts_with(x, 'widgets') OR (length(x) >= 4 AND starts_with('widgets', x)))) > 0 AS INT)) / 2
 + CASE WHEN contains(lower(p_name), 'small widgets') THEN 0.8 ELSE 0 END, 6) AS score FROM p""")
def lexical_score(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(search.lexical_score("small widgets", F.col("p_name")), 6).alias("score"))


@query("""WITH t AS (SELECT conv_id, turn, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos, unnest(string_split(text, ' ')) AS token FROM conversations),
n AS (SELECT *, max(CAST(token IN ('the', 'de') AS INT)) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM t)
SELECT conv_id, turn, pos, token, coalesce(pos - lag(pos) OVER (PARTITION BY conv_id, turn ORDER BY pos) > 1, false) AS gap_before FROM n WHERE near = 1""")
def match_preview(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    return search.match_preview(t, F.col("token").isin("the", "de"), ["conv_id", "turn"])


@query("""WITH f AS (SELECT p_brand AS entity, p_name AS field, p_type AS description, p_size = 1 AS is_pk, p_partkey FROM part),
s AS (SELECT *, CASE WHEN is_pk THEN 5 ELSE 0 END + 3 * (CAST(contains(lower(field || ' ' || description), 'small') AS INT) + CAST(contains(lower(field || ' ' || description), 'item') AS INT) + CAST(contains(lower(field || ' ' || description), 'product') AS INT))
 + CASE WHEN regexp_matches(lower(field || ' ' || description), 'quantity|amount|total|price|date|status|region|state|country|geo|address|postal') THEN 2 ELSE 0 END AS score FROM f),
g AS (SELECT entity, field, max(score) AS score FROM s GROUP BY 1, 2)
SELECT entity, field, score FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, field) AS k FROM g) WHERE k <= 18""")
def field_rank(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity"), F.col("p_name").alias("field"), F.col("p_type").alias("description"), (F.col("p_size") == 1).alias("is_pk"))
    terms = search.question_terms(F.lit("a small item"))
    scored = p.withColumn("score", search.field_score(F.col("field"), F.col("description"), F.col("is_pk"), terms)).groupBy("entity", "field").agg(F.max("score").alias("score"))
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy(F.desc("score"), "field")
    return scored.withColumn("k", F.row_number().over(w)).where("k <= 18").drop("k")


@query("""SELECT c_custkey, lower(regexp_replace(regexp_replace(c_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')) AS words FROM customer""")
def camel_words(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(text.camel_words(F.col("c_name")), " ").alias("words"))


@query("""SELECT page_id, lower(regexp_replace(CASE WHEN p = '' THEN '' WHEN strpos(p, '/') = 0 THEN p ELSE regexp_extract(p, '([^/]*)$', 1) END, '\\.xml$', '')) AS nav
FROM (SELECT page_id, regexp_replace(regexp_extract(trim(url), '^([^?#]*)', 1), '/+$', '') AS p FROM pages)""")
def navigation_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.navigation_key(F.col("url")).alias("nav"))
