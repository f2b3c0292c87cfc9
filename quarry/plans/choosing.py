"""Predicates, candidate orders and searches on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import search_words
from quarry.operators import arcs, choosing, predicates, ranking, search
from quarry.plans.registry import query
from quarry.runtime import table

_PLUMBING = predicates.PLUMBING
_NAMES = "SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT url FROM pages UNION ALL SELECT text FROM benchmark)"


@query(rf"""WITH n AS ({_NAMES}), c AS (SELECT name, substr(trim(regexp_replace(coalesce(name, ''), '\s+', ' ', 'g')), 1, 100) AS v FROM n)
SELECT name, v <> '' AND NOT regexp_matches(v, '[.#/:()]') AND NOT regexp_matches(v, '\b(?:{_PLUMBING})\b', 'i') AS friendly FROM c""")
def friendly_names(spark, sf_dir):
    t = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("name"))
    names = t("part", "p_name").unionByName(t("customer", "c_name")).unionByName(t("pages", "url")).unionByName(t("benchmark", "text")).distinct()
    return names.select("name", predicates.friendly_name(F.col("name")).alias("friendly"))


@query("""SELECT event_id, event_type NOT IN ('error', 'view') AND NOT (event_type = 'signup' AND value < 40) AND value < 250 AS business FROM events""")
def business_arcs(spark, sf_dir):
    mark = F.when(F.col("event_type") == "error", "Technical").when(F.col("event_type") == "view", "technical_flow")
    other = F.when((F.col("event_type") == "signup") & (F.col("value") < 40), "clearly_NOT_business")
    qualifies = F.when(F.col("value") >= 250, False)
    return table(spark, sf_dir, "events").select("event_id", predicates.business_arc([mark, other], qualifies).alias("business"))


@query("""SELECT d.doc_id, coalesce(l.toxic = 0 AND least(1, n_chars / 2000) >= 0.55, false) AND coalesce(source, '') <> '' AND coalesce(lang, '') <> '' AND coalesce(text, '') <> '' AS admitted
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def admission(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kind = F.when(F.col("toxic") == 0, "business_flow").otherwise("technical_flow")
    return d.select("doc_id", predicates.admitted(kind, F.least(F.lit(1.0), F.col("n_chars") / 2000), F.col("source"), F.col("lang"), F.col("text")).alias("admitted"))


@query("SELECT l_orderkey, l_linenumber, l_discount * 10 >= 0.5 AND l_tax * 12.5 >= 0.55 AS promoted FROM lineitem")
def scout_promotion(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", predicates.scouted(F.col("l_discount") * 10, F.col("l_tax") * 12.5).alias("promoted"))


_KEYS = list(arcs.CHECKLIST)
_KEY = "list_extract([" + ", ".join(f"'{k}'" for k in _KEYS) + "], CAST(doc_id % 10 AS INT) + 1)"
_STATUS = "CASE WHEN quality = 1 AND toxic = 0 THEN 'supported' WHEN quality = 1 THEN 'not_applicable' ELSE 'partial' END"


@query(
    f"""WITH c AS (SELECT doc_id // 10 AS story, map_from_entries(list(({_KEY}, {_STATUS}))) AS s FROM labels GROUP BY 1),
r AS (SELECT c.story, list_filter([{", ".join(f"CASE WHEN coalesce(s['{k}'], '') IN ('supported', 'not_applicable') THEN NULL ELSE '{k} is ' || coalesce(s['{k}'], 'missing') END" for k in _KEYS)},
 CASE WHEN coalesce(s['evidenceCoverage'], '') <> 'supported' THEN 'evidenceCoverage must be supported' END, CASE WHEN d.doc_id IS NULL THEN 'final workflow synthesis is missing' END,
 CASE WHEN coalesce(d.lang, '') = '' THEN 'workflow trigger is missing' END, CASE WHEN coalesce(d.source, '') = '' THEN 'workflow outcome is missing' END, CASE WHEN coalesce(d.text, '') = '' THEN 'workflow narrative is missing' END],
 lambda x: x IS NOT NULL) AS reasons FROM c LEFT JOIN documents d ON d.doc_id = c.story)
SELECT story, array_to_string(reasons, '; ') AS reasons, len(reasons) = 0 AS complete FROM r"""
)
def completion_gate(spark, sf_dir):
    key = F.get(F.array(*map(F.lit, _KEYS)), (F.col("doc_id") % 10).cast("int"))
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "supported").when(F.col("quality") == 1, "not_applicable").otherwise("partial")
    rows = table(spark, sf_dir, "labels").select(F.expr("doc_id div 10").alias("story"), key.alias("k"), status.alias("s"))
    stories = rows.groupBy("story").agg(F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias("status"))  # ten entries at most
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("story"), F.struct(F.col("lang").alias("trigger"), F.col("source").alias("outcome"), F.col("text").alias("description")).alias("synthesis"))
    reasons = predicates.completion_reasons(F.col("status"), F.col("synthesis"))
    out = stories.join(d, "story", "left").select("story", reasons.alias("r"))
    return out.select("story", F.array_join("r", "; ").alias("reasons"), (F.size("r") == 0).alias("complete"))


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l.l_orderkey, l_linenumber, CASE WHEN l_quantity - 1 = floor(l_quantity - 1) AND l_quantity - 1 >= 0 AND l_quantity - 1 < n THEN CAST(l_quantity - 1 AS INT) END AS branch FROM lineitem l JOIN n ON n.l_orderkey = l.l_orderkey""")
def unresolved_branches(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    n = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return rows.join(n, "l_orderkey").select("l_orderkey", "l_linenumber", predicates.branch_index(F.col("l_quantity") - 1, F.col("n")).alias("branch"))


_FRONTIER = "SELECT page_id, CASE WHEN ends_with(url, '/') THEN 'dir:' || url WHEN ends_with(url, '.html') THEN 'file:' || url ELSE url END AS id, regexp_extract(url, '://([^/?#]*)', 1) AS source FROM pages"


@query(f"""WITH f AS ({_FRONTIER}), v AS (SELECT f.id FROM f JOIN labels l ON l.doc_id = f.page_id)
SELECT id, source FROM f WHERE (starts_with(id, 'dir:') OR starts_with(id, 'file:')) AND source <> 'blog.tionsh.example.com' AND id NOT IN (SELECT id FROM v)""")
def broad_candidates(spark, sf_dir):
    url = F.col("url")
    f = table(spark, sf_dir, "pages").select("page_id", F.when(url.endswith("/"), F.concat(F.lit("dir:"), url)).when(url.endswith(".html"), F.concat(F.lit("file:"), url)).otherwise(url).alias("id"), F.regexp_extract(url, "://([^/?#]*)", 1).alias("source"))
    visited = f.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi")
    return predicates.broad_candidates(f.drop("page_id"), visited, F.lit("blog.tionsh.example.com"))


@query("""WITH j AS (SELECT o_custkey AS business, o_orderkey AS candidate FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT DISTINCT c_custkey AS business, o_orderkey AS candidate FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0)
SELECT * FROM j WHERE (business, candidate) IN (SELECT (business, candidate) FROM o)""")
def whitelisted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("business"), F.col("o_orderkey").alias("candidate"), "o_orderstatus")
    offered = o.drop("o_orderstatus").join(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("business")), "business")
    return predicates.known_pairs(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), offered, ["business", "candidate"])


def _case(column: str, points: dict[str, int], other: int) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in points.items()) + f" ELSE {other} END"


_REL = "CASE event_type WHEN 'view' THEN 'reads' WHEN 'click' THEN 'reference' WHEN 'signup' THEN 'triggers' WHEN 'purchase' THEN 'contains' ELSE 'calls' END"


@query(f"""WITH e AS (SELECT event_id, {_REL} AS relation, lower(event_type || ' ' || coalesce(url, '')) AS t, lower(coalesce(url, '')) AS p, CASE WHEN value > 100 THEN 'external_boundary' WHEN value > 50 THEN 'directory' ELSE 'symbol' END AS kind FROM events LEFT JOIN pages ON page_id = user_id)
SELECT event_id, {_case("relation", choosing.FILE_RELATIONS, 0)} + CASE WHEN kind = 'directory' THEN 12 + CASE WHEN regexp_matches(p, '{choosing.FLOW_PLACES}') THEN 28 ELSE 0 END ELSE 0 END
 + CASE WHEN regexp_matches(p, '{choosing.CODE_FILES}') THEN 10 ELSE 0 END - CASE WHEN regexp_matches(p, '{choosing.PLAIN_FILES}') THEN 22 ELSE 0 END AS file_priority,
 {_case("relation", choosing.SLICE_RELATIONS, 20)} + {_case("kind", {"symbol": 30, "external_boundary": 180}, 0)} + {_case("relation", choosing.SEMANTIC_RELATIONS, 0)}
 + CASE WHEN regexp_matches(t, '{choosing.ACTING_NAMES}') THEN 12 ELSE 0 END - CASE WHEN regexp_matches(t, '{choosing.AIDING_NAMES}') THEN 15 ELSE 0 END AS slice_priority FROM e""")
def candidate_priorities(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("user_id"), "url")
    e = table(spark, sf_dir, "events").join(pages, "user_id", "left")
    kind = F.when(F.col("value") > 100, "external_boundary").when(F.col("value") > 50, "directory").otherwise("symbol")
    relation, path, label = F.expr(_REL), F.col("url"), F.col("event_type")
    return e.select("event_id", choosing.file_priority(relation, kind, path, label).alias("file_priority"), choosing.slice_priority(relation, kind, path, label).alias("slice_priority"))


_KINDS = "CASE CAST(user_id AS BIGINT) % 4 WHEN 0 THEN 'symbol' WHEN 1 THEN 'external_boundary' WHEN 2 THEN 'semantic_function' ELSE 'call_path_seed' END"


@query(f"""WITH e AS (SELECT event_id, {_REL} AS relation, lower(event_type || ' ' || coalesce(url, '')) AS t, {_KINDS} AS kind, CAST(floor(value) AS BIGINT) AS n FROM events LEFT JOIN pages ON page_id = event_id),
f AS (SELECT *, {_case("relation", choosing.SLICE_RELATIONS, 20)} + CASE WHEN kind = 'symbol' THEN 30 ELSE 0 END + CASE WHEN regexp_matches(t, '{choosing.ACTING_NAMES}') THEN 12 ELSE 0 END - CASE WHEN regexp_matches(t, '{choosing.AIDING_NAMES}') THEN 15 ELSE 0 END AS flow FROM e),
b AS (SELECT *, flow + CASE WHEN kind = 'external_boundary' THEN 180 ELSE 0 END AS boundary FROM f),
s AS (SELECT *, boundary + CASE WHEN kind = 'semantic_function' THEN 20 ELSE 0 END + {_case("relation", choosing.SEMANTIC_RELATIONS, 0)} AS semantic FROM b)
SELECT event_id, flow, boundary, semantic, CASE WHEN kind = 'call_path_seed' THEN 120 + n ELSE semantic END AS paths FROM s""")
def candidate_variants(spark, sf_dir):
    """One candidate by the four rules for symbols: kinds by user, functions of a path by value."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("event_id"), "url")
    e = table(spark, sf_dir, "events").join(pages, "event_id", "left")
    args = F.expr(_REL), F.expr(_KINDS), F.col("url"), F.col("event_type")
    n = F.floor("value").cast("long")
    return e.select("event_id", choosing.flow_priority(*args).alias("flow"), choosing.boundary_priority(*args).alias("boundary"), choosing.slice_priority(*args).alias("semantic"), choosing.path_priority(*args, n).alias("paths"))


_CANDIDATES = "SELECT c_nationkey AS src, c_custkey AS id, c_mktsegment = 'BUILDING' AS is_local, c_acctbal AS priority FROM customer"


@query(f"""WITH c AS ({_CANDIDATES}), v AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
SELECT src, id, is_local, priority, k FROM (SELECT *, row_number() OVER (PARTITION BY src, is_local ORDER BY priority DESC, id) AS k FROM c WHERE id NOT IN (SELECT o_custkey FROM v)) WHERE k <= CASE WHEN is_local THEN 10 ELSE 4 END""")
def candidate_mix(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").alias("is_local"), F.col("c_acctbal").alias("priority"))
    visited = c.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct(), "id")
    return choosing.mixed(c, visited)


@query("""WITH c AS (SELECT l_orderkey AS src, l_linenumber AS id, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 0 END AS depth, l_extendedprice AS priority FROM lineitem),
t AS (SELECT *, min(coalesce(depth, 1 << 30)) OVER (PARTITION BY src) AS tier FROM c)
SELECT src, id, depth, priority, k FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY priority DESC, id) AS k FROM t WHERE coalesce(depth, 1 << 30) = tier) WHERE k <= CASE WHEN depth IS NULL THEN 4 ELSE 10 END""")
def stack_candidates(spark, sf_dir):
    depth = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 0)
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("id"), depth.alias("depth"), F.col("l_extendedprice").alias("priority"))
    return choosing.stacked(c)


@query("SELECT id, len(s) AS functions, array_to_string(s, ' → ') AS signature FROM (SELECT doc_id AS id, string_split(text, chr(10)) AS s FROM documents) ORDER BY functions DESC, signature, id LIMIT 40")
def ranked_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("signatures"))
    return choosing.ranked_paths(d, 40)


@query("SELECT id, novelty, likelihood, novelty * likelihood AS worth FROM (SELECT event_id AS id, least(1, value / 200) AS novelty, least(1, value / 300) AS likelihood FROM events) ORDER BY worth DESC, id LIMIT 25")
def scout_order(spark, sf_dir):
    one = lambda n: F.least(F.lit(1.0), F.col("value") / n)
    return choosing.scout_order(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), one(200).alias("novelty"), one(300).alias("likelihood")), 25)


@query("""WITH s AS (SELECT user_id AS packet, event_type AS id, 0.45 * least(1, max(value) / 400) + 0.45 * least(1, min(value) / 5) + 0.1 * least(1, count(*) / 20) AS fit FROM events GROUP BY 1, 2),
o AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 20), v AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 300)
SELECT packet, id, round(fit, 6) AS fit FROM (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY fit DESC, id) AS k FROM s WHERE (packet, id) IN (SELECT (user_id, event_type) FROM o) AND (packet, id) NOT IN (SELECT (user_id, event_type) FROM v)) WHERE k = 1 AND fit >= 0.25""")
def scored_choice(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "packet", "event_type": "id"})
    s = e.groupBy("packet", "id").agg((F.max("value") / 400).alias("continuity"), (F.min("value") / 5).alias("coherence"), (F.count("*") / 20).alias("expected_gain"))
    return choosing.best_fit(s, e.where("value > 20"), e.where("value > 300")).withColumn("fit", F.round("fit", 6))


@query("""SELECT packet, id FROM (SELECT o_custkey AS packet, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY least(1, o_totalprice / 500000) DESC, o_orderkey) AS k FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'F') WHERE k = 1""")
def discovery_choice(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("packet"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("likelihood"), (F.col("o_orderpriority") != "5-LOW").alias("pursue"), F.when(F.col("o_orderstatus") == "F", "qualified").otherwise("candidate").alias("status"))
    return choosing.discovery_choice(o)


@query("""SELECT arc, id FROM (SELECT o_custkey AS arc, l_partkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC, l_linenumber, l_partkey) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE p_size > 10 AND (o_custkey, l_partkey) NOT IN (SELECT (o_custkey, l_partkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')) WHERE k = 1""")
def pending_candidate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    frames = rows.select(F.col("o_custkey").alias("arc"), F.col("o_orderkey").alias("frame"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("id"), "l_returnflag")
    frontier = frames.join(table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("id")), "id", "left_semi")
    return choosing.pending(frames.drop("l_returnflag"), frontier, frames.where("l_returnflag = 'R'"))


@query("""SELECT o_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS path_ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20) GROUP BY 1""")
def unrepresented_paths(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x.l_partkey).alias("path_ids"))
    lines = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", "left_semi")
    return choosing.unrepresented(lines, table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("path_id")))


@query("SELECT l_partkey AS path_id FROM lineitem UNION SELECT p_partkey FROM part WHERE p_retailprice > 1000")
def reviewed_paths(spark, sf_dir):
    return choosing.reviewed(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path_id")), table(spark, sf_dir, "part").where("p_retailprice > 1000").select(F.col("p_partkey").alias("path_id")))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM events WHERE event_type <> 'view'")
def filtered_ordinals(spark, sf_dir):
    return choosing.ordinals(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") != "view").drop("event_type")


def _lexical(words: list[str], text: str) -> str:
    """The lexical score of a text column in SQL, its words in ``w``."""
    one = lambda q: f"CAST(len(list_filter(w, lambda x: x = '{q}' OR ({len(q)} >= 4 AND starts_with(x, '{q}')) OR (length(x) >= 4 AND starts_with('{q}', x)))) > 0 AS INT)"
    return f"(CASE WHEN len(w) = 0 THEN 0 ELSE ({' + '.join(map(one, words))}) / {len(words)} + CASE WHEN contains(lower({text}), '{' '.join(words)}') THEN 0.8 ELSE 0 END END)"


_STOP = ", ".join(f"'{w}'" for w in "a an and are as at be by for from how in is it last of on or the to was what when where which why with want know".split())
_WORDS = f"list_distinct(list_filter(string_split_regex(lower(h), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP})))"


@query(f"""WITH h AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS h, count(*) AS functions FROM conversations GROUP BY 1), w AS (SELECT *, {_WORDS} AS w FROM h)
SELECT conv_id, functions, round({_lexical(["heat", "tion"], "h")}, 6) AS score FROM w WHERE {_lexical(["heat", "tion"], "h")} > 0 ORDER BY score DESC, functions DESC, conv_id LIMIT 12""")
def path_search(spark, sf_dir):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), " ")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(text.alias("h"), F.count("*").alias("functions"))  # turns of one conversation
    return search.ranked_search(c, "heat tion", F.col("h"), F.desc("functions"), "conv_id").select("conv_id", "functions", F.round("score", 6).alias("score"))


@query(f"""WITH h AS (SELECT p_partkey, p_retailprice AS priority, p_name || ' ' || p_brand || ' ' || p_type AS h FROM part), w AS (SELECT *, {_WORDS} AS w FROM h)
SELECT p_partkey, priority, round({_lexical(["small", "gear"], "h")}, 6) AS score FROM w WHERE {_lexical(["small", "gear"], "h")} > 0 ORDER BY score DESC, priority DESC, p_partkey LIMIT 12""")
def workflow_search(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("h", F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return search.ranked_search(p, "small gear", F.col("h"), F.desc("p_retailprice"), "p_partkey").select("p_partkey", F.col("p_retailprice").alias("priority"), F.round("score", 6).alias("score"))


@query("""SELECT p_partkey AS id, score FROM (SELECT p_partkey, CAST(contains(h, 'small') AS INT) + CAST(contains(h, 'brand#1') AS INT) + CAST(contains(h, 'zzz') AS INT) AS score FROM (SELECT p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_type) AS h FROM part)) WHERE score > 0 ORDER BY score DESC, id LIMIT 12""")
def canonical_search(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type")
    return search.term_count(p, ["small", "Brand#1", "zzz"])


@query(f"""WITH t AS (SELECT conv_id, turn, t, list_transform(t, lambda x: len(list_filter(list_filter(string_split_regex(lower(x), '[^a-z0-9]+'), lambda y: length(y) > 1 AND y NOT IN ({_STOP})), lambda y: starts_with(y, 'heat') OR (length(y) >= 4 AND starts_with('heat', y)))) > 0) AS m FROM (SELECT conv_id, turn, string_split(text, ' ') AS t FROM conversations)),
k AS (SELECT *, list_transform(m, lambda x, i: x OR coalesce(CASE WHEN i > 1 THEN m[i - 1] END, false) OR coalesce(m[i + 1], false)) AS k FROM t),
o AS (SELECT conv_id, turn, CASE WHEN NOT list_contains(k, true) THEN t[1:5] ELSE list_concat(flatten(list_transform(k, lambda x, i: CASE WHEN NOT x THEN [] WHEN i > list_position(k, true) AND NOT k[i - 1] THEN ['…', substr(trim(regexp_replace(t[i], '\\s+', ' ', 'g')), 1, 160)] ELSE [substr(trim(regexp_replace(t[i], '\\s+', ' ', 'g')), 1, 160)] END)), CASE WHEN k[len(k)] THEN [] ELSE ['…'] END)[1:13] END AS preview FROM k)
SELECT conv_id, turn, array_to_string(preview, '|') AS preview FROM o""")
def path_preview(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("tokens"))
    return search.path_previews(c, ["conv_id", "turn"], ["heat"]).withColumn("preview", F.array_join("preview", "|"))


@query("""WITH n AS (SELECT o_custkey AS src, l_suppkey AS dst, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'R' THEN 'writes' ELSE 'uses' END AS relation, CASE l_returnflag WHEN 'A' THEN 100 WHEN 'R' THEN 90 ELSE 20 END AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey),
b AS (SELECT src, dst, max(p) AS priority, arg_max(relation, p) AS relation FROM n GROUP BY 1, 2)
SELECT * FROM (SELECT src, dst, priority, relation, row_number() OVER (PARTITION BY src ORDER BY priority DESC, dst) AS k FROM b) WHERE k <= 18""")
def symbol_neighbours(spark, sf_dir):
    relation = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "R", "writes").otherwise("uses")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = rows.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), relation.alias("relation"))
    return ranking.nearest(edges, priorities=ranking.SYMBOL_PRIORITY)


@query("""SELECT user_id, least(96, greatest(CASE WHEN c > 18 THEN 90 ELSE 0 END, CASE WHEN s > 0 THEN 12 ELSE 0 END + least(42, 7 * v) + CASE WHEN p > 12 THEN 16 ELSE 0 END)) AS progress
FROM (SELECT user_id, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY 1)""")
def arc_progress_complete(spark, sf_dir):
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(n("signup").alias("s"), n("view").alias("v"), n("purchase").alias("p"), n("click").alias("c"))
    return g.select("user_id", arcs.arc_progress(F.col("s") > 0, F.col("v"), F.col("p") > 12, F.lit(0), F.lit(0), F.col("c") > 18).alias("progress"))


@query("""WITH s AS (SELECT l_orderkey AS story, count(*) AS n, 0.45 * avg(l_discount * 10) + 0.35 * avg(l_tax * 12.5) + 0.2 * avg(l_quantity / 50) AS q FROM lineitem GROUP BY 1)
SELECT story, CASE WHEN o_orderstatus = 'F' THEN 100 ELSE round(least(96, 88 * (1 - exp(-n / 4.5)) * (0.55 + 0.45 * q))) END AS progress FROM s JOIN orders ON o_orderkey = story""")
def story_progress_closed(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("story"), (F.col("l_discount") * 10).alias("continuity"), (F.col("l_tax") * 12.5).alias("coherence_gain"), (F.col("l_quantity") / 50).alias("placement_confidence"))
    s = arcs.story_quality(steps, "story").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("story"), "o_orderstatus"), "story")
    none = F.lit(0)
    return s.select("story", arcs.story_progress(F.col("steps"), F.col("quality"), none, none, none, none, F.col("o_orderstatus") == "F").alias("progress"))
