"""Folds over logs on the shared tables: events, orders and conversations as logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import states
from quarry.plans.registry import query
from quarry.runtime import table


@query("""WITH s AS (SELECT user_id AS run, event_id AS step, event_type, value, row_number() OVER w AS n, coalesce(max(CAST(event_type = 'purchase' AND value > 150 OR value < 1 AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT run, step, n FROM s WHERE n <= 60 AND past = 0""")
def exploration_steps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), ((F.col("event_type") == "purchase") & (F.col("value") > 150)).alias("closed"), F.when(F.col("value") < 1, 0).otherwise(5).alias("frontier"), F.lit(False).alias("stop"))
    return states.exploration(e).select("run", "step", "n")


@query("""WITH g AS (SELECT user_id AS run, event_id AS step, props, value, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) > 1 AS blocked FROM events WHERE event_type <> 'error'),
s AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS n, coalesce(max(CAST(value > 200 AND NOT blocked AS INT)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM g)
SELECT run, step, n, blocked FROM s WHERE n <= 24 AND past = 0""")
def workflow_rounds(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("props").alias("evidence"), (F.col("event_type") != "error").alias("valid"), (F.col("value") > 200).alias("complete"))
    return states.rounds(e).select("run", "step", "n", "blocked")


@query("""WITH f AS (SELECT o_custkey AS run, l_partkey AS id, min(o_orderkey) AS ord FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2),
v AS (SELECT DISTINCT o_custkey AS run, l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
i AS (SELECT o_custkey AS run, l_partkey AS id, min(o_orderkey) AS ord FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' AND (o_custkey, l_partkey) NOT IN (SELECT (run, id) FROM v) AND (o_custkey, l_partkey) NOT IN (SELECT (run, id) FROM f) GROUP BY 1, 2),
u AS (SELECT *, 0 AS part FROM f UNION ALL SELECT *, 1 FROM i)
SELECT run, id, part, age FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY part DESC, ord DESC, id DESC) AS age FROM u) WHERE age <= 12""")
def frontier_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("run"), F.col("l_partkey").alias("id"), F.col("o_orderkey").alias("ord"), "o_orderstatus", "l_returnflag")
    known = rows.where("o_orderstatus = 'F'").groupBy("run", "id").agg(F.min("ord").alias("ord"))
    return states.merge_frontier(known, rows.where("o_orderstatus <> 'F'").select("run", "ord", F.col("id")), rows.where("l_returnflag = 'R'"), most=12).select("run", "id", "part", "age")


@query("""WITH s AS (SELECT o_custkey AS path, o_orderkey AS step, o_orderpriority AS branch, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'bounded' END AS status, least(1, o_totalprice / 500000) AS q FROM orders),
b AS (SELECT path, branch, arg_max(status, step) AS status FROM s GROUP BY 1, 2),
c AS (SELECT path, count(*) AS branches, count(*) FILTER (status = 'open') AS open FROM b GROUP BY 1),
g AS (SELECT path, count(*) AS steps, avg(q) * 0.45 + avg(q) * 0.35 + 0.1 AS quality FROM s GROUP BY 1),
p AS (SELECT path, steps, open, round(greatest(0, least(96, 88 * (1 - exp(-steps / 4.5)) * (0.55 + 0.45 * quality) * (0.68 + 0.32 * (branches - open) / branches) - 5 * open))) AS progress FROM g JOIN c USING (path))
SELECT path, steps, open, progress, CASE WHEN progress >= 82 THEN 'closing' WHEN progress >= 30 THEN 'building' ELSE 'early' END AS status FROM p""")
def story_states(spark, sf_dir):
    q = F.least(F.lit(1.0), F.col("o_totalprice") / 500000)
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("bounded")
    none = F.lit(None).cast("string")
    deltas = table(spark, sf_dir, "orders").select(F.lit(1).alias("run"), F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("step"), none.alias("title"), q.alias("continuity"), q.alias("coherence_gain"), F.lit(0.5).alias("placement_confidence"), F.col("o_orderpriority").alias("branch"), status.alias("branch_status"), none.alias("question"), F.array().cast("array<string>").alias("resolves"), none.alias("closes"))
    return states.stories(deltas).select("path", "steps", "open", "progress", "status")


@query("""WITH s AS (SELECT conv_id AS path, turn AS step, trim(text) AS t, role FROM conversations), a AS (SELECT path, t, max(step) AS step FROM s WHERE role = 'user' AND t <> '' GROUP BY 1, 2),
r AS (SELECT path, t, max(step) AS at FROM s WHERE role <> 'user' GROUP BY 1, 2)
SELECT path, step, question FROM (SELECT a.path, a.step, a.t AS question, row_number() OVER (PARTITION BY a.path ORDER BY a.step DESC, a.t) AS k FROM a LEFT JOIN r ON r.path = a.path AND r.t = a.t WHERE r.at IS NULL OR r.at < a.step) WHERE k <= 8""")
def open_questions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.col("role") == "user"
    deltas = c.select(F.lit(1).alias("run"), F.col("conv_id").alias("path"), F.col("turn").alias("step"), F.when(said, F.col("text")).alias("question"), F.when(~said, F.array(F.trim("text"))).alias("resolves"))
    return states.questions(deltas).drop("run")


@query("""WITH s AS (SELECT user_id AS run, lower(event_type) AS key, event_id AS step, value FROM events), h AS (SELECT run, key, max(least(1, value / 300)) AS confidence, min(step) AS created, least(40, count(DISTINCT step)) AS evidence FROM s GROUP BY 1, 2),
j AS (SELECT o_custkey AS run, CASE o_orderstatus WHEN 'F' THEN 'view' WHEN 'O' THEN 'click' ELSE 'signup' END AS key, o_orderkey AS step, CASE WHEN o_orderpriority = '1-URGENT' THEN 'reject' WHEN o_orderpriority = '2-HIGH' THEN 'admit' ELSE 'wait' END AS decision, o_totalprice > 100000 AS qualifies FROM orders),
f AS (SELECT *, decision = 'reject' OR (decision = 'admit' AND qualifies) AS final FROM j), d AS (SELECT run, key, arg_min(decision, step) AS decision FROM f WHERE final GROUP BY 1, 2)
SELECT h.run, h.key, round(h.confidence, 6) AS confidence, h.evidence, CASE d.decision WHEN 'reject' THEN 'rejected' WHEN 'admit' THEN 'admitted' ELSE 'hypothesis' END AS status, 'hyp-' || row_number() OVER (PARTITION BY h.run ORDER BY h.created, h.key) AS id FROM h LEFT JOIN d ON d.run = h.run AND d.key = h.key""")
def hypothesis_states(spark, sf_dir):
    none = F.lit(None).cast("string")
    seeds = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.initcap("event_type").alias("title"), (F.col("value") / 300).alias("confidence"), none.alias("actor"), none.alias("intent"), none.alias("reason"), F.col("event_id").alias("artifact"))
    title = F.when(F.col("o_orderstatus") == "F", "view").when(F.col("o_orderstatus") == "O", "click").otherwise("signup")
    decision = F.when(F.col("o_orderpriority") == "1-URGENT", "reject").when(F.col("o_orderpriority") == "2-HIGH", "admit").otherwise("wait")
    said = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("step"), title.alias("title"), decision.alias("decision"), (F.col("o_totalprice") > 100000).alias("qualifies"), F.lit(None).cast("double").alias("confidence"))
    return states.hypotheses(seeds, said).select("run", "key", F.round("confidence", 6).alias("confidence"), "evidence", "status", "id")


@query("""WITH c AS (SELECT o_custkey AS arc, o_orderkey AS step, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderkey % 7 AS INT) END AS branch, [CAST(o_orderkey % 7 AS INT), CAST(floor(o_totalprice) % 9 AS INT)] AS unresolved, CASE o_orderpriority WHEN '1-URGENT' THEN 'complete' ELSE 'inspect_branches' END AS action FROM orders),
s AS (SELECT arc, count(*) FILTER (branch IS NULL) AS whole_calls, count(branch) AS branch_calls, coalesce(list_sort(list(DISTINCT branch) FILTER (branch IS NOT NULL)), []) AS interpreted, arg_max(unresolved, step) AS u, arg_max(action, step) AS action, arg_max(coalesce(branch, -1), step) AS last FROM c GROUP BY 1),
p AS (SELECT *, list_sort(list_distinct(list_filter(u, lambda x: NOT list_contains(interpreted, x)))) AS pending FROM s)
SELECT arc, whole_calls, branch_calls, array_to_string(interpreted, ',') AS interpreted, array_to_string(pending, ',') AS pending, action = 'complete' OR (last >= 0 AND len(pending) = 0) AS completed FROM p""")
def flow_states(spark, sf_dir):
    n = (F.col("o_orderkey") % 7).cast("int")
    calls = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("arc"), F.col("o_orderkey").alias("step"), F.when(F.col("o_orderstatus") != "P", n).alias("branch"), F.array(n, (F.floor("o_totalprice") % 9).cast("int")).alias("unresolved"), F.when(F.col("o_orderpriority") == "1-URGENT", "complete").otherwise("inspect_branches").alias("action"))
    return states.flow_states(calls).withColumn("interpreted", F.array_join("interpreted", ",")).withColumn("pending", F.array_join("pending", ","))


@query("""SELECT workflow, state FROM (SELECT o_custkey AS workflow, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS c, arg_max(o_totalprice, o_orderkey) AS state FROM orders GROUP BY 1) WHERE s <> 'P' AND c = '1-URGENT'""")
def checkpoints(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("workflow"), F.col("o_orderkey").alias("step"), F.when(F.col("o_orderstatus") == "P", "clear").otherwise("save").alias("action"), F.col("o_orderpriority").alias("commit"), F.col("o_totalprice").alias("state"))
    return states.checkpoint(log, F.lit("1-URGENT"))


@query("""WITH k AS (SELECT source AS workflow, lang AS path, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 350) AS finding, min(doc_id) AS step FROM documents WHERE trim(text) <> '' GROUP BY 1, 2, 3)
SELECT workflow, path, finding, step FROM (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY step DESC) AS k FROM k) WHERE k <= 24""")
def compact_findings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("workflow"), F.col("doc_id").alias("step"), F.col("lang").alias("path"), F.lit(None).cast("string").alias("symbol"), F.col("text").alias("finding"))
    return states.compact_findings(d).drop("symbol")


@query("""WITH s AS (SELECT l_partkey AS start, min(CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS since FROM lineitem GROUP BY 1),
r AS (SELECT l.l_partkey AS start, l_orderkey AS step, max(l_discount) * 10 AS likelihood, s.since FROM lineitem l JOIN s ON s.start = l.l_partkey WHERE s.since IS NULL OR l_orderkey <= s.since OR l_returnflag = 'R' GROUP BY 1, 2, 4)
SELECT start, round(least(1, arg_max(likelihood, step)), 6) AS confidence, CASE WHEN max(since) IS NOT NULL THEN 'qualified' ELSE 'candidate' END AS status FROM r GROUP BY 1""")
def discovery_starts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("start"), F.col("l_orderkey").alias("step"), (F.col("l_returnflag") == "R").alias("qualifies")).agg((F.max("l_discount") * 10).alias("likelihood"))
    rows = rows.withColumn("title", F.lit("t")).withColumn("pursue", F.lit(True))
    # An order may name a part twice, once returned: its updates at that step count together.
    both = rows.groupBy("start", "step").agg(F.max("qualifies").alias("qualifies"), F.max("likelihood").alias("all"), F.max(F.when(F.col("qualifies"), F.col("likelihood"))).alias("own"))
    first = both.where("qualifies").groupBy("start").agg(F.min("step").alias("since"))
    both = both.join(first, "start", "left").withColumn("likelihood", F.when(F.col("step") > F.col("since"), F.coalesce("own", "all")).otherwise(F.col("all")))
    return states.discovery_starts(both.withColumn("title", F.lit("t")).withColumn("pursue", F.lit(True))).select("start", F.round("confidence", 6).alias("confidence"), "status")


@query("""SELECT l_suppkey AS artifact, arg_max(l_comment, k) AS meaning FROM (SELECT l_suppkey, l_shipdate::VARCHAR || ':' || l_orderkey || ':' || l_linenumber || ':' || l_partkey AS l_comment, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey AS k FROM lineitem) GROUP BY 1""")
def last_meanings(spark, sf_dir):
    said = F.concat_ws(":", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), "l_orderkey", "l_linenumber", "l_partkey")
    log = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("artifact"), (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("step"), said.alias("meaning"), F.lit("").alias("role"), F.lit("").alias("path"))
    return states.meanings(log).select("artifact", "meaning")


@query("""WITH v AS (SELECT DISTINCT o_custkey AS run, l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
x AS (SELECT o_custkey AS run, l_partkey AS id, max(l_extendedprice) AS p, max(l_discount) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE (o_custkey, l_partkey) NOT IN (SELECT (run, id) FROM v) GROUP BY 1, 2),
h AS (SELECT run, id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY p DESC, id) AS k FROM x WHERE q >= 0.08) WHERE k = 1), c AS (SELECT run, id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY p DESC, id) AS k FROM x) WHERE k = 1)
SELECT c_custkey AS run, CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN coalesce(h.id, c.id) ELSE c.id END AS id FROM customer LEFT JOIN h ON h.run = c_custkey LEFT JOIN c ON c.run = c_custkey""")
def resolved_actions(spark, sf_dir):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "stop").when(F.col("c_mktsegment") == "MACHINERY", "search").otherwise("artifact")
    actions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), kind.alias("type"), F.lit(-1).cast("long").alias("artifact"))
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("run"), F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("priority"), "l_discount", "l_returnflag")
    best = rows.groupBy("run", "id").agg(F.max("priority").alias("priority"), F.max("l_discount").alias("q"))
    return states.resolved_action(actions, best, best.where("q >= 0.08"), best, rows.where("l_returnflag = 'R'"))
