"""Evidence, identity, merging and incremental operators on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import arrays, text
from quarry.operators import evidence, extract, incremental
from quarry.plans.registry import query
from quarry.runtime import scratch_path, table
from quarry.sources import files

_STRENGTHS = "CASE event_type WHEN 'view' THEN 0.35 WHEN 'click' THEN 0.52 WHEN 'signup' THEN 0.78 WHEN 'purchase' THEN 0.9 ELSE 0.1 END"


@query(f"SELECT user_id, round(1 - product(1 - s), 6) AS confidence FROM (SELECT DISTINCT user_id, event_type, props, {_STRENGTHS} AS s FROM events) GROUP BY user_id")
def noisy_or_confidence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "props", F.expr(_STRENGTHS).cast("double").alias("strength"), F.col("event_id").alias("seq"))
    e = evidence.dedupe_evidence(e, ["user_id", "event_type", "props"])
    return evidence.noisy_or(e, ["user_id"]).select("user_id", F.round("confidence", 6).alias("confidence"))


@query("SELECT user_id, event_type, props, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2, 3")
def evidence_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "props", "event_id", "value", F.col("event_id").alias("seq"))
    return evidence.dedupe_evidence(e, ["user_id", "event_type", "props"]).drop("seq")


@query("""WITH a AS (SELECT o_custkey, o_orderstatus, o_orderpriority AS alias, min(o_orderkey) AS s FROM orders GROUP BY 1, 2, 3)
SELECT l.o_custkey, l.o_orderstatus, l.o_totalprice, x.aliases FROM (SELECT o_custkey, o_orderstatus, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2) l
JOIN (SELECT o_custkey, o_orderstatus, string_agg(alias, '|' ORDER BY s, alias) AS aliases FROM a GROUP BY 1, 2) x ON l.o_custkey = x.o_custkey AND l.o_orderstatus = x.o_orderstatus""")
def object_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority").alias("alias"), F.col("o_orderkey").alias("seq"))
    return evidence.merge_objects(o, ["o_custkey", "o_orderstatus"], ["o_totalprice"], "alias").withColumn("aliases", F.array_join("aliases", "|"))


@query("SELECT o_custkey AS \"from\", o_orderstatus AS relation, o_orderpriority AS \"to\", arg_max(o_totalprice, o_orderkey) AS o_totalprice, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2, 3")
def relation_collapse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("from"), F.col("o_orderstatus").alias("relation"), F.col("o_orderpriority").alias("to"), "o_totalprice", "o_orderkey", F.col("o_orderkey").alias("seq"))
    return evidence.collapse_relations(o).drop("seq")


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '[ \\n]')) AS word FROM documents)
SELECT key, word AS canonical FROM (SELECT lower(word) AS key, word, row_number() OVER (PARTITION BY lower(word) ORDER BY word = lower(word), doc_id, word) AS k FROM w WHERE word <> '') WHERE k = 1""")
def entity_canonical(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \\n]")).alias("word"), "doc_id").where("word <> ''")
    return evidence.canonical_names(w.withColumn("key", F.lower("word")).withColumn("seq", F.struct("doc_id", "word")), "key", "word")


@query(r"SELECT url, regexp_replace(lower(url), '[^\p{L}\p{N}]+', '', 'g') AS identity, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS ascii FROM pages")
def identity_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", text.identity_key(F.col("url")).alias("identity"), text.ascii_key(F.col("url")).alias("ascii"))


@query(r"SELECT n_name, 'entity:' || substr(sha1('entity|' || r_name || '|' || regexp_replace(lower(n_name), '[^\p{L}\p{N}]+', '', 'g')), 1, 16) AS id FROM nation JOIN region ON n_regionkey = r_regionkey")
def semantic_ids(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_name", text.semantic_id(F.lit("entity"), F.col("r_name"), F.col("n_name")).alias("id"))


@query(r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS clipped FROM c""")
def clip_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clip(F.col("text"), 60).alias("clipped"))


@query("SELECT lang AS key, coalesce(arg_min(source, doc_id) FILTER (source <> ''), '') AS description FROM documents GROUP BY 1")
def entity_catalog(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("key"), "source", F.col("doc_id").alias("seq"))
    return evidence.entity_catalog(d, "key", "source")


@query("SELECT user_id, event_type, max(value) AS confidence, arg_max(props, event_id) AS props FROM events GROUP BY 1, 2")
def representation_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "props", "value", F.col("event_id").alias("seq"))
    return evidence.merge_representations(e, ["user_id", "event_type"], "props", "value")


@query("SELECT doc_id, 'labelled' AS origin FROM labels UNION ALL SELECT doc_id, 'plain' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def preferred_union(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("origin"))
    b = table(spark, sf_dir, "documents").select("doc_id", F.lit("plain").alias("origin"))
    return evidence.prefer(a, b, ["doc_id"])


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey // 10 AS s, o_orderkey // 10 + o_orderkey % 40 AS e FROM orders),
f AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -100) + 1 THEN 1 ELSE 0 END AS n FROM r),
g AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT k AS custkey, min(s) AS "start", max(e) AS "end" FROM g GROUP BY k, i""")
def interval_union(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.expr("o_orderkey div 10").alias("start"), F.expr("o_orderkey div 10 + o_orderkey % 40").alias("end"))
    return incremental.interval_union(r, ["custkey"])


_PATHS = r"SELECT page_id, regexp_extract(url, '^[^:]*://([^?#]*)', 1) AS path FROM pages"


def page_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1).alias("path"))


@query(f"""WITH p AS (SELECT string_split(path, '/') AS a FROM ({_PATHS})),
x AS (SELECT DISTINCT array_to_string(list_slice(a, 1, i), '/') AS dir FROM (SELECT a, unnest(range(1, len(a))) AS i FROM p))
SELECT dir, len(string_split(dir, '/')) AS depth FROM x""")
def ancestor_dirs(spark, sf_dir):
    return incremental.ancestor_dirs(page_paths(spark, sf_dir))


@query(f"""WITH p AS ({_PATHS}), d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path FROM p),
u AS (SELECT string_split(path, '/')[1] AS path, 1 AS f, 0 AS t FROM p UNION ALL SELECT string_split(path, '/')[1], 0, 1 FROM d)
SELECT CASE WHEN path = '' THEN '.' ELSE path END AS path, CAST(sum(f) AS BIGINT) AS files_changed, CAST(sum(t) AS BIGINT) AS trees_changed FROM u GROUP BY 1""")
def top_level_changes(spark, sf_dir):
    p = page_paths(spark, sf_dir)
    trees = p.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path")).distinct()
    return incremental.top_level_changes(p, trees)


@query("""WITH b AS (SELECT source || '/' || (doc_id % 50) AS path, max(n_chars) AS h FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1),
a AS (SELECT source || '/' || (doc_id % 50) AS path, max(n_chars) AS h FROM documents WHERE lang IN ('en', 'de') GROUP BY 1)
SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM b FULL JOIN a ON a.path = b.path WHERE b.h IS DISTINCT FROM a.h""")
def tree_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", F.col("doc_id") % 50))
    side = lambda *langs: d.where(F.col("lang").isin(*langs)).groupBy("path").agg(F.max("n_chars").alias("hash"))
    return incremental.tree_diff(side("en", "fr"), side("en", "de"))


@query("""WITH i AS (SELECT user_id AS item, event_type || '/' || props AS f FROM events GROUP BY ALL), ch AS (SELECT DISTINCT event_type || '/' || props AS f FROM events WHERE value > 250),
h AS (SELECT item, count(*) AS n FROM i WHERE f IN (SELECT f FROM ch) GROUP BY 1)
SELECT u.item, CASE WHEN n > 0 THEN 'review' ELSE 'reuse' END AS decision, CASE WHEN n > 0 THEN 'evidence changed' ELSE 'no evidence file changed' END AS reason, coalesce(n, 0) AS touched
FROM (SELECT DISTINCT item FROM i) u LEFT JOIN h ON h.item = u.item""")
def changed_evidence(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("path", F.concat_ws("/", "event_type", "props"))
    items = e.groupBy(F.col("user_id").alias("item")).agg(F.collect_set("path").alias("files"))
    return incremental.reuse_plan(items, e.where("value > 250").select("path"))


@query("""WITH r AS (SELECT o_custkey AS source, o_orderkey AS s, o_orderkey + 3 AS e FROM orders WHERE o_orderstatus = 'F'), l AS (SELECT o_custkey AS source, o_orderkey AS line FROM orders)
SELECT source, line FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source = l.source AND l.line BETWEEN s AND e)""")
def uncovered_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "source")
    ranges = o.where("o_orderstatus = 'F'").select("source", F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 3).alias("end"))
    return incremental.uncovered(o.select("source", F.col("o_orderkey").alias("line")), ranges)


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def json_flatten(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("text"))
    return extract.extract(e, "json").select(F.col("path").cast("long").alias("event_id"), "key", "value")


@query()
def xml_hierarchy(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    return extract.extract(p, "markup").select("path", "ordinal", "tag", "parent", "depth", "start", "end")


@query()
def child_tag_counts(spark, sf_dir):
    return extract.child_tags(xml_hierarchy(spark, sf_dir))


@query(r"SELECT page_id, unnest(list_distinct(regexp_extract_all(url, '([\w.-]+(?:/[\w.-]+)+\.[A-Za-z0-9]+)', 1))) AS file FROM pages")
def evidence_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.evidence_files(F.col("url"))).alias("file"))


@query("SELECT conv_id, count(*) AS events, string_agg(role, '>' ORDER BY turn) AS roles, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def episode_replay(spark, sf_dir):
    """The conversations, appended to an event log as an episode and read back."""
    log = scratch_path(spark, "episodes")
    files.append_events(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), log, files.next_number(spark, log))
    c = files.read_events(spark, log, files.numbers(spark, log)[-1], "conv_id long, turn long, role string")
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))  # the turns of one conversation
    return c.groupBy("conv_id").agg(F.count("*").alias("events"), F.array_join(F.transform(rows, lambda r: r.role), ">").alias("roles"), F.max_by("role", "turn").alias("last_role"))


@query("SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY 1, 2")
def newest_snapshot(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return files.newest_by(e.select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], "ts")


@query(r"""WITH t AS (SELECT DISTINCT user_id, event_type, props FROM events)
SELECT user_id, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT user_id, event_type AS x FROM t UNION SELECT DISTINCT user_id, props FROM t) GROUP BY 1""")
def ordered_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"), F.collect_set("props").alias("b"))
    return e.select("user_id", F.array_join(F.array_sort(arrays.ordered_union(F.col("a"), F.col("b"))), ",").alias("items"))


@query("""WITH p AS (SELECT regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') AS path FROM pages), h AS (SELECT min(string_split(path, '/')[1]) AS h FROM p WHERE contains(path, '/')),
r AS (SELECT substr(path, length(h) + 2) AS r FROM p, h WHERE starts_with(path, h || '/'))
SELECT DISTINCT CASE WHEN contains(r, '/') THEN 'dir' ELSE 'file' END AS kind, string_split(r, '/')[1] AS name FROM r WHERE r <> '' ORDER BY kind, name LIMIT 120""")
def directory_listing(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/+$", "").alias("path"))
    host = paths.where(F.contains("path", F.lit("/"))).agg(F.min(F.substring_index("path", "/", 1))).first()[0]
    return files.list_directory(paths, host or "")
