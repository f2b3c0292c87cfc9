"""Scores, schedules, decays and decisions on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import clamp01
from quarry.operators import arcs
from quarry.plans.registry import query
from quarry.runtime import table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("score", F.col("value") / 300)


@query("""SELECT user_id, event_id, coalesce(a > v AND b > a AND b - v >= 0.1, false) AS declining FROM (SELECT user_id, event_id, value / 300 AS v,
 lag(value / 300, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS a, lag(value / 300, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)""")
def declining_signal(spark, sf_dir):
    return arcs.declining(events(spark, sf_dir).select("user_id", "event_id", "score"), "user_id", "event_id", "score").drop("score")


@query("SELECT user_id, event_id, age FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events) WHERE age <= 12")
def ring_buffer(spark, sf_dir):
    return arcs.last_rows(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 12)


_DECAY = """SELECT user_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(CASE WHEN event_type = 'error' THEN -1.0 ELSE value / 300 END ORDER BY event_id)), lambda a, x: CASE WHEN x < 0 THEN a * 0.985 ELSE greatest(a * 0.96, x) END) AS o FROM events GROUP BY 1"""


@query(f"SELECT user_id, round(o, 6) AS opportunity FROM ({_DECAY})")
def opportunity_decay(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("score", F.when(F.col("event_type") != "error", F.col("score")))
    return arcs.decay(e, "user_id", "event_id", "score").withColumn("opportunity", F.round("opportunity", 6))


@query("""WITH a AS (SELECT user_id AS arc, avg(value) / 300 AS o, count(*) % 15 AS age, min(value) > 2 AS complete, max(event_id) AS last FROM events GROUP BY 1),
p AS (SELECT *, o + least(0.15, age * 0.015) AS priority FROM a)
SELECT arc, round(priority, 6) AS priority FROM p WHERE priority >= 0.25 AND (NOT complete OR priority >= 0.45)""")
def fairness_schedule(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("arc")).agg((F.avg("value") / 300).alias("opportunity"), (F.count("*") % 15).alias("age"), (F.min("value") > 2).alias("complete"), F.max("event_id").alias("last"))
    return arcs.next_arc(a).select("arc", F.round("priority", 6).alias("priority"))


@query("""SELECT user_id, least(96, CASE WHEN s > 0 THEN 12 ELSE 0 END + least(42, 7 * v) + CASE WHEN p > 12 THEN 16 ELSE 0 END + CASE WHEN c > 10 THEN least(10, 4 + 2 * (c - 10)) ELSE 0 END + CASE WHEN e > 10 THEN least(10, 4 + 2 * (e - 10)) ELSE 0 END) AS progress
FROM (SELECT user_id, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'view') % 8 AS v, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)""")
def arc_progress(spark, sf_dir):
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(n("signup").alias("s"), (n("view") % 8).alias("v"), n("purchase").alias("p"), n("click").alias("c"), n("error").alias("e"))
    over = lambda c: F.greatest(F.lit(0), F.col(c) - 10)
    return g.select("user_id", arcs.arc_progress(F.col("s") > 0, F.col("v"), F.col("p") > 12, over("c"), over("e")).alias("progress"))


@query("""WITH s AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS b, least(1, avg(length(text)) / 2000) AS q, count(*) FILTER (role = 'assistant') AS c FROM conversations GROUP BY 1),
x AS (SELECT *, 88 * (1 - exp(-n / 4.5)) * (0.55 + 0.45 * q) AS base, least(b, c) AS done FROM s)
SELECT conv_id, round(greatest(0, least(96, CASE WHEN b > 0 THEN base * (0.68 + 0.32 * done / b) - 5 * (b - done) ELSE base END - least(18, 4 * (n % 3))))) AS progress FROM x""")
def story_progress(spark, sf_dir):
    role = lambda r: F.count(F.when(F.col("role") == r, 1))
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), role("user").alias("b"), role("assistant").alias("c"), F.least(F.lit(1.0), F.avg(F.length("text")) / 2000).alias("q"))
    done = F.least("b", "c")
    return s.select("conv_id", arcs.story_progress(F.col("n"), F.col("q"), F.col("b"), done, F.col("b") - done, F.col("n") % 3).alias("progress"))


_WEIGHTS = ", ".join(f"('{k}', {w})" for k, w in arcs.CHECKLIST.items())
_ITEM = "list_extract([" + ", ".join(f"'{k}'" for k in arcs.CHECKLIST) + "], CAST(doc_id % 10 AS INT) + 1)"


@query(f"""WITH w(item, weight) AS (VALUES {_WEIGHTS}), r AS (SELECT doc_id // 10 AS story, {_ITEM} AS item, CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 1 THEN 0.5 ELSE 0 END AS part FROM labels)
SELECT story, round(sum(weight * part)) AS percent FROM r JOIN w ON w.item = r.item GROUP BY 1""")
def checklist_percent(spark, sf_dir):
    names = F.array(*map(F.lit, arcs.CHECKLIST))
    rows = table(spark, sf_dir, "labels").select(F.expr("doc_id div 10").alias("story"), F.get(names, (F.col("doc_id") % 10).cast("int")).alias("item"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "supported").when(F.col("quality") == 1, "partial").otherwise("missing").alias("status"))
    weights = spark.createDataFrame(list(arcs.CHECKLIST.items()), "item string, weight int")
    return arcs.checklist_percent(rows, "story", "item", "status", weights)


@query("SELECT event_id, greatest(0, least(1, value / 100)) AS unit FROM events")
def clamp_normalize(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", clamp01(F.col("value") / 100).alias("unit"))


_SCORES = """SELECT user_id AS packet, event_type AS id, least(1, avg(value) / 200) AS membership, least(1, max(value) / 400) AS continuity, least(1, min(value) / 5) AS coherence, least(1, count(*) / 20) AS expected_gain FROM events GROUP BY 1, 2"""
_NOVELTY = "SELECT user_id AS packet, least(1, avg(value) / 100) AS new_arc, least(1, max(value) / 300) AS new_business, least(1, min(value)) AS new_technical FROM events GROUP BY 1"


def packets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.groupBy(F.col("user_id").alias("packet"), F.col("event_type").alias("id")).agg((F.avg("value") / 200).alias("membership"), (F.max("value") / 400).alias("continuity"), (F.min("value") / 5).alias("coherence"), (F.count("*") / 20).alias("expected_gain"))
    n = e.groupBy(F.col("user_id").alias("packet")).agg((F.avg("value") / 100).alias("new_arc"), (F.max("value") / 300).alias("new_business"), F.min("value").alias("new_technical"))
    near = a.select("packet", "id", F.col("continuity").alias("value"))
    return a, near, n


def _best(weights: str) -> str:
    return f"b AS (SELECT packet, id, round(v + 1e-9, 6) AS v FROM (SELECT packet, id, {weights} AS v, row_number() OVER (PARTITION BY packet ORDER BY {weights} DESC, id) AS k FROM ({_SCORES})) WHERE k = 1)"


_PASS1 = "(membership * 0.5 + coherence * 0.25 + expected_gain * 0.25)"


@query(f"""WITH {_best(_PASS1)}, n AS (SELECT *, new_arc * 0.4 + new_business * 0.4 + new_technical * 0.2 AS v FROM ({_NOVELTY}))
SELECT n.packet, CASE WHEN n.v > b.v THEN 'open_new_arc_candidate' ELSE 'continue_existing_arc' END AS action, CASE WHEN n.v > b.v THEN CASE WHEN new_business >= new_technical THEN 'business' ELSE 'technical' END ELSE b.id END AS target, round(greatest(n.v + 1e-9, b.v), 6) AS value FROM n JOIN b ON b.packet = n.packet""")
def student_policy_scout(spark, sf_dir):
    return arcs.decide(*packets(spark, sf_dir), "scout").withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query(f"WITH {_best(_PASS1)} SELECT packet, 'select_arc' AS action, id AS target, v AS value FROM b")
def student_policy_pass1(spark, sf_dir):
    return arcs.decide(*packets(spark, sf_dir), "pass1").withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query(f"WITH {_best('continuity')} SELECT packet, 'select_neighbour' AS action, id AS target, v AS value FROM b")
def student_policy_pass2(spark, sf_dir):
    return arcs.decide(*packets(spark, sf_dir), "pass2").withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """The streaming replay's windows, run to the end; its result equals a batch's."""
    from quarry.runtime import scratch_path
    from quarry.streaming import replay

    source = table(spark, sf_dir, "events")
    stream = replay.table_stream(spark, sf_dir, "events", source.schema)
    name = "windows_" + scratch_path(spark, "").rpartition("-")[2]
    out = replay.run_to_memory(replay.windowed_counts(stream), name, "complete", scratch_path(spark, "stream"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
