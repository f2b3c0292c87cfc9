"""Reconciliation passes, ids that never move, and scout runs on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import reconciling, scouting
from quarry.plans.registry import query
from quarry.runtime import dealt, materialise, scratch_path, table

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(f"""WITH names AS (SELECT lower(c_name) AS name, c_mktsegment, c_acctbal, c_nationkey, c_custkey FROM customer),
candidates AS (SELECT name, c_mktsegment AS schema FROM names WHERE c_acctbal > -500 UNION SELECT name, n_name FROM names JOIN nation ON n_nationkey = c_nationkey),
contexts AS MATERIALIZED (SELECT DISTINCT name, {_DAY} AS context FROM orders JOIN names ON c_custkey = o_custkey WHERE o_orderstatus <> 'F'),
said AS (SELECT name, c_mktsegment AS schema, CASE WHEN c_acctbal > 6000 THEN 1 WHEN c_acctbal > 3000 THEN 2 ELSE 3 END AS since FROM names WHERE c_acctbal < 8500 UNION SELECT name, 'FURNITURE', 1 FROM names WHERE c_acctbal > 9000),
o1 AS MATERIALIZED (SELECT name FROM (SELECT DISTINCT name FROM contexts) WHERE name IN (SELECT name FROM candidates)),
m1 AS MATERIALIZED (SELECT DISTINCT name, schema FROM said JOIN candidates USING (name, schema) WHERE since <= 1 AND name IN (FROM o1)),
k1 AS MATERIALIZED (SELECT DISTINCT context, schema FROM contexts JOIN m1 USING (name)),
o2 AS MATERIALIZED (SELECT DISTINCT name FROM contexts JOIN k1 USING (context) WHERE name IN (FROM o1) AND name NOT IN (SELECT name FROM m1)),
m2 AS MATERIALIZED (SELECT DISTINCT name, schema FROM said JOIN candidates USING (name, schema) WHERE since <= 2 AND name IN (FROM o2)),
k2 AS MATERIALIZED (SELECT DISTINCT context, schema FROM contexts JOIN m2 USING (name) EXCEPT FROM k1),
o3 AS MATERIALIZED (SELECT DISTINCT name FROM contexts JOIN k2 USING (context) WHERE name IN (FROM o1) AND name NOT IN (SELECT name FROM m1) AND name NOT IN (SELECT name FROM m2)),
m3 AS MATERIALIZED (SELECT DISTINCT name, schema FROM said JOIN candidates USING (name, schema) WHERE since <= 3 AND name IN (FROM o3)),
h AS (SELECT 1 AS step, (SELECT count(*) FROM o1) AS offered, (SELECT count(*) FROM m1) AS mapped UNION ALL SELECT 2, (SELECT count(*) FROM o2), (SELECT count(*) FROM m2) UNION ALL SELECT 3, (SELECT count(*) FROM o3), (SELECT count(*) FROM m3))
SELECT 'mapping' AS kind, name, schema, CAST(NULL AS INT) AS step, CAST(NULL AS BIGINT) AS offered, CAST(NULL AS BIGINT) AS mapped FROM (FROM m1 UNION ALL FROM m2 UNION ALL FROM m3)
UNION ALL SELECT 'attempt', name, NULL, NULL, NULL, NULL FROM o1 UNION ALL SELECT 'run', NULL, NULL, step, offered, mapped FROM h WHERE offered > 0""")
def reconciliation_passes(spark, sf_dir):
    """Customers as names, their segment and nation as schemas, the days they order as contexts:
    what is mapped on a day is new evidence for whoever orders on it.  A recorded judgment holds
    from a pass on, so later passes map names that earlier ones left open."""
    c = table(spark, sf_dir, "customer").withColumn("name", F.lower("c_name"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("schema"))
    candidates = c.where("c_acctbal > -500").select("name", F.col("c_mktsegment").alias("schema"), F.lit(2).alias("score"))
    candidates = candidates.unionByName(c.join(F.broadcast(nation), "c_nationkey").select("name", "schema", F.lit(1).alias("score")))
    every = table(spark, sf_dir, "orders")
    orders = every.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("c_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("context"))
    by_customer = lambda df: dealt(df, every.count(), "c_custkey", least=spark.sparkContext.defaultParallelism)
    since = F.when(F.col("c_acctbal") > 6000, 1).when(F.col("c_acctbal") > 3000, 2).otherwise(3)
    said = c.where("c_acctbal < 8500").select("name", F.col("c_mktsegment").alias("schema"), since.alias("since"))
    said = said.unionByName(c.where("c_acctbal > 9000").select("name", F.lit("FURNITURE").alias("schema"), F.lit(1).alias("since")))
    got = reconciling.reconcile(
        c.select("name", F.col("c_custkey").alias("ord")), candidates, by_customer(orders).join(by_customer(c.select("c_custkey", "name")), "c_custkey").select("name", "context"),
        lambda offered, step: said.where(F.col("since") <= step).select("name", "schema"), most=None,
    )
    rows = "kind string, name string, schema string, step int, offered long, mapped long"
    none = [F.lit(None).cast(t).alias(n) for n, t in (("step", "int"), ("offered", "long"), ("mapped", "long"))]
    # Three passes at most: the history is that many rows.
    history = spark.createDataFrame([("run", None, None, *run) for run in got.runs], rows)
    mapped = got.mappings.select(F.lit("mapping").alias("kind"), "name", "schema", *none)
    return mapped.unionByName(got.ledger.select(F.lit("attempt").alias("kind"), "name", F.lit(None).cast("string").alias("schema"), *none)).unionByName(history)


@query("""WITH e AS (SELECT user_id AS run, props AS name, min(event_id) FILTER (event_type = 'signup') AS f, min(event_id) AS seq FROM events WHERE user_id IS NOT NULL AND props IS NOT NULL GROUP BY ALL),
o AS (SELECT run, name, row_number() OVER (PARTITION BY run ORDER BY f, name) AS n FROM e WHERE f IS NOT NULL)
SELECT run, name, seq, coalesce((SELECT max(n) FROM o WHERE o.run = e.run), 0) + row_number() OVER (PARTITION BY run ORDER BY seq, name) AS n FROM e WHERE f IS NULL""")
def allocated_ids(spark, sf_dir):
    """Numbers of each user's artifacts: signups' come from an earlier run, the others' from a
    stream that stops half-way and goes on from its checkpoint."""
    from quarry.streaming import exploring

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("props").alias("name"), "event_type").where("run IS NOT NULL")
    first = events.where("event_type = 'signup' AND name IS NOT NULL").groupBy("run", "name").agg(F.min("seq").alias("seq"))
    earlier = materialise(first.select("run", "name", F.expr("row_number() OVER (PARTITION BY run ORDER BY seq, name)").cast("long").alias("n")), "earlier")
    half = events.agg(F.avg("seq")).first()[0] or 0.0
    parts, out, check = (scratch_path(spark, n) for n in ("named", "numbers", "stream"))
    schema = "run long, seq long, name string"
    for rows in (events.where(F.col("seq") < half), events.where(F.col("seq") >= half)):
        rows.select("run", "seq", "name").write.mode("append").parquet(parts)
        exploring.run_to_files(exploring.allocated(spark.readStream.schema(schema).parquet(parts), earlier), out, check)
    return spark.read.schema("run long, name string, seq long, n long").parquet(out)


_RANKED = """SELECT o_custkey AS run, o_orderkey AS pos, CASE WHEN o_orderstatus = 'O' THEN 'path:' ELSE 'arc:' END || o_orderkey AS item, least(1, o_totalprice / 400000) AS priority,
 month(o_orderdate) / 12 AS likelihood, day(o_orderdate) / 30 AS novelty, day(o_orderdate) % 5 <> 0 AS pursue, CASE WHEN month(o_orderdate) > 3 THEN '  Flow  ' || month(o_orderdate) || ' ' END AS title FROM orders"""


@query(f"""WITH o AS (SELECT *, o_custkey AS run FROM orders), a AS (SELECT run, o_orderkey AS arc, o_orderstatus = 'P' AS started, CASE WHEN day(o_orderdate) % 3 = 0 THEN o_totalprice / 500000 END AS had, day(o_orderdate) % 2 = 0 AS current,
  'FLOW ' || month(o_orderdate) AS title, month(o_orderdate) = 1 AS completed, o_totalprice AS opportunity, o_orderpriority <> '5-LOW' AS qualifies FROM o WHERE o_orderstatus <> 'O'),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY arc) AS k FROM a WHERE qualifies AND NOT (had IS NOT NULL AND current)) WHERE k <= 50),
p AS (SELECT * FROM (SELECT run, o_orderkey AS id, o_orderkey % 97 AS path, o_orderpriority AS label, row_number() OVER (PARTITION BY run ORDER BY o_totalprice, o_orderkey) AS k FROM o WHERE o_orderstatus = 'O') WHERE k <= 10),
r AS (SELECT * EXCLUDE (priority, likelihood, novelty), greatest(0, least(1, priority)) AS priority, least(1, likelihood) AS likelihood, least(1, novelty) AS novelty FROM ({_RANKED}) WHERE (run, item) IN (SELECT (run, 'arc:' || arc) FROM u UNION ALL SELECT (run, 'path:' || id) FROM p)),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY priority DESC, novelty * likelihood DESC, pos) AS k FROM r),
c AS (SELECT n.run, p.id, p.path, coalesce(trim(regexp_replace(title, '\\s+', ' ', 'g')), p.label) AS title, n.likelihood, n.novelty, n.priority, n.k FROM n JOIN p ON p.run = n.run AND n.item = 'path:' || p.id WHERE pursue AND likelihood >= 0.55 AND novelty >= 0.45 AND p.path > 20),
d AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.run = c.run AND lower(a.title) = lower(c.title)) QUALIFY row_number() OVER (PARTITION BY run, lower(title) ORDER BY k) = 1),
made AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k) AS nth FROM d QUALIFY nth <= 3),
x AS (SELECT a.run, CAST(a.arc AS VARCHAR) AS arc, a.started, a.completed, a.opportunity, coalesce(n.priority, a.had) AS priority, a.arc AS created FROM a LEFT JOIN n ON n.run = a.run AND n.item = 'arc:' || a.arc
  UNION ALL SELECT run, 'path:' || id, false, false, greatest(likelihood, novelty, priority), priority, 0 FROM made),
following AS (SELECT run, arc FROM x WHERE NOT completed QUALIFY row_number() OVER (PARTITION BY run ORDER BY coalesce(priority, -1) DESC, started, opportunity DESC, created, arc) = 1)
SELECT 'arc' AS kind, run, arc AS id, NULL AS title, priority AS value FROM x UNION ALL SELECT 'created', run, CAST(id AS VARCHAR), title, greatest(likelihood, novelty, priority) FROM made
UNION ALL SELECT DISTINCT 'reviewed', run, CAST(path AS VARCHAR), NULL, CAST(NULL AS DOUBLE) FROM p UNION ALL SELECT 'next', run, arc, NULL, NULL FROM following
UNION ALL SELECT 'offered', run, NULL, NULL, count(*) FROM p GROUP BY run UNION ALL SELECT 'ranked', run, NULL, NULL, count(*) FROM n WHERE starts_with(item, 'arc:') GROUP BY run""")
def scout_rankings(spark, sf_dir):
    """Customers as runs: finished and pending orders are workflows, open ones unseen paths."""
    o = table(spark, sf_dir, "orders")
    run, day, month = F.col("o_custkey").alias("run"), F.dayofmonth("o_orderdate"), F.month("o_orderdate")
    key = F.col("o_orderkey")
    path = (key % 97).cast("string").alias("path")
    arcs = o.where("o_orderstatus <> 'O'").select(
        run, key.cast("string").alias("arc"), key.alias("pos"), F.concat(F.lit("FLOW "), month).alias("title"), (F.col("o_orderpriority") != "5-LOW").alias("qualifies"), F.when(day % 3 == 0, F.col("o_totalprice") / 500000).alias("priority"),
        F.when(day % 2 == 0, scouting.MODEL).otherwise("older").alias("model"), (F.col("o_orderstatus") == "P").alias("started"), (month == 1).alias("completed"), F.col("o_totalprice").alias("opportunity"), key.alias("created"),
    )
    paths = o.where("o_orderstatus = 'O'").select(run, key.cast("string").alias("id"), F.col("o_totalprice").alias("pos"), path, F.col("o_orderpriority").alias("label"))
    kind = F.when(F.col("o_orderstatus") == "O", "path:").otherwise("arc:")
    said = o.select(
        run, key.alias("pos"), F.concat(kind, key).alias("item"), (F.col("o_totalprice") / 400000).alias("priority"), (month / 12).alias("likelihood"), (day / 30).alias("novelty"),
        (day % 5 != 0).alias("pursue"), F.when(month > 3, F.concat(F.lit("  Flow  "), month, F.lit(" "))).alias("title"),
    )
    got = scouting.scout(arcs, paths, said, o.where(key % 97 > 20).select(path))
    row = lambda kind, df, id_=None, title=None, value=None: df.select(F.lit(kind).alias("kind"), "run", (F.col(id_) if id_ else F.lit(None)).cast("string").alias("id"), (F.col(title) if title else F.lit(None)).cast("string").alias("title"), (F.col(value) if value else F.lit(None)).cast("double").alias("value"))
    out = row("arc", got.arcs, "arc", value="priority").unionByName(row("created", got.created, "id", "title", "confidence"))
    out = out.unionByName(row("reviewed", got.reviewed, "path")).unionByName(row("next", got.next, "arc"))
    return out.unionByName(row("offered", got.runs.where("offered > 0"), value="offered")).unionByName(row("ranked", got.runs.where("ranked > 0"), value="ranked"))
