"""Running loops on the shared tables: events as streams of judgments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.plans.registry import query
from quarry.runtime import scratch_path, table


def run_topology(events):
    """Each user's events as a graph: the next event's artifact is a neighbour, the first one's
    is the root, and a type of event finds the artifacts that it ever had."""
    from quarry.streaming import exploring

    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = events.select(F.col("user_id").alias("run"), "event_id", F.col("props").alias("src"), F.lead("props").over(w).alias("dst"), "value", "event_type")
    edges = rows.where("dst IS NOT NULL").select("run", "src", "dst", F.col("value").alias("priority"))
    roots = rows.groupBy("run").agg(F.min_by("src", "event_id").alias("id"))
    return exploring.topology(edges, roots, rows.select("run", F.col("event_type").alias("query"), F.col("src").alias("id"), F.col("value").alias("priority")))


def run_judgments(events):
    kind = F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "purchase", "artifact").when((F.col("event_type") == "error") & (F.col("value") > 150), "stop").otherwise("any")
    wish = F.when(F.col("event_type") == "click", F.when(F.col("value") < 30, "view").otherwise("signup")).otherwise(F.col("props"))
    branch = F.when(F.col("event_type").isin("view", "signup"), F.col("props"))
    return events.select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("story"),
        branch.alias("branch"),
        F.when(F.col("value") < 60, "closed").otherwise("open").alias("branch_status"),
        ((F.col("event_type") == "purchase") & (F.col("value") > 60)).alias("closes"),
        kind.alias("next_type"),
        wish.alias("next_id"),
    )


_BEST = "list_sort(list_transform({0}, lambda x: {{'m': -x.priority, 'id': x.id, 'p': x.priority}}))[1]"
_IDS = "list_transform({0}, lambda x: x.id)"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS run, event_id, props AS src, lead(props) OVER (PARTITION BY user_id ORDER BY event_id) AS dst, value, event_type FROM events),
t AS MATERIALIZED (SELECT run, artifact, list({{'id': id, 'priority': p}} ORDER BY id) AS near FROM (SELECT run, artifact, id, max(p) AS p FROM (
  SELECT run, src AS artifact, dst AS id, value AS p FROM e WHERE dst IS NOT NULL UNION ALL SELECT run, 'search:' || event_type, src, value FROM e) GROUP BY ALL) GROUP BY ALL),
j AS MATERIALIZED (SELECT user_id AS run, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS story,
  CASE WHEN event_type IN ('view', 'signup') THEN props END AS branch, value < 60 AS shut, event_type = 'purchase' AND value > 60 AS closes,
  CASE WHEN event_type = 'click' THEN 'search' WHEN event_type = 'purchase' THEN 'artifact' WHEN event_type = 'error' AND value > 150 THEN 'stop' ELSE 'any' END AS kind,
  CASE WHEN event_type = 'click' THEN CASE WHEN value < 30 THEN 'view' ELSE 'signup' END ELSE props END AS wish FROM events),
r AS (SELECT run, arg_min(src, event_id) AS root FROM e GROUP BY run),
s AS (SELECT r.run, 0 AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS observed, root AS next, coalesce(t.near, []) AS frontier, CAST([] AS VARCHAR[]) AS visited,
    CAST([] AS VARCHAR[]) AS branches, 0 AS shown, 0 AS candidates, 'exploring' AS status
  FROM r LEFT JOIN t ON t.run = r.run AND t.artifact = r.root
UNION ALL SELECT run, n, seq, observed, CASE WHEN status = 'closed' THEN NULL ELSE target END, CASE WHEN status = 'closed' THEN seen_frontier ELSE list_filter(reached, lambda x: target IS NULL OR x.id <> target) END, visited, branches,
    len(CASE WHEN status = 'closed' THEN seen_frontier ELSE list_filter(reached, lambda x: target IS NULL OR x.id <> target) END), candidates,
    CASE WHEN status = 'closed' THEN 'closed' WHEN target IS NULL THEN 'no_frontier' WHEN n = 60 THEN 'budget_exhausted' ELSE 'exploring' END
  FROM (SELECT *, CASE WHEN kind = 'stop' THEN NULL ELSE coalesce(wanted, CASE WHEN here IS NULL OR far.p > here.p THEN far.id ELSE here.id END) END AS target
   FROM (SELECT *, CASE WHEN kind = 'search' THEN {_BEST.format('list_filter(hits, lambda x: NOT list_contains(visited, x.id))')}.id WHEN kind = 'artifact' AND list_contains({_IDS.format('list_filter(seen_frontier, lambda x: NOT list_contains(visited, x.id))')}, wish) THEN wish END AS wanted,
      {_BEST.format('list_filter(near, lambda x: NOT list_contains(visited, x.id))')} AS here,
      {_BEST.format('list_filter(reached, lambda x: NOT list_contains(visited, x.id) AND NOT list_contains(' + _IDS.format('near') + ', x.id))')} AS far
    FROM (SELECT *, CASE WHEN kind = 'search' THEN list_slice(list_concat(seen_frontier, list_filter(hits, lambda x: NOT list_contains({_IDS.format('seen_frontier')}, x.id) AND NOT list_contains(visited, x.id))), -120, -1) ELSE seen_frontier END AS reached,
        len(list_distinct({_IDS.format('list_filter(list_concat(near, seen_frontier), lambda x: NOT list_contains(visited, x.id))')})) AS candidates,
        CASE WHEN closes AND len(list_filter(branches, lambda b: starts_with(b, story || ':'))) = 0 THEN 'closed' END AS status
      FROM (SELECT run, n, seq, observed, story, kind, wish, closes, near, hits, visited, list_slice(list_concat(frontier, list_filter(near, lambda x: NOT list_contains({_IDS.format('frontier')}, x.id) AND NOT list_contains(visited, x.id))), -120, -1) AS seen_frontier,
          CASE WHEN branch IS NULL THEN branches WHEN shut THEN list_filter(branches, lambda b: b <> story || ':' || branch) ELSE list_distinct(list_append(branches, story || ':' || branch)) END AS branches
        FROM (SELECT j.*, s.next AS observed, s.frontier, s.branches, CASE WHEN list_contains(s.visited, s.next) THEN s.visited ELSE list_append(s.visited, s.next) END AS visited, coalesce(a.near, []) AS near, coalesce(h.near, []) AS hits
          FROM s JOIN j ON j.run = s.run AND j.n = s.n + 1 AND s.status = 'exploring' LEFT JOIN t a ON a.run = s.run AND a.artifact = s.next LEFT JOIN t h ON h.run = s.run AND h.artifact = 'search:' || j.wish AND j.kind = 'search'))))))
SELECT run, seq, CAST(n AS INT) AS step, observed, CAST(shown AS INT) AS frontier, CAST(candidates AS INT) AS candidates, next, status FROM s WHERE n > 0""")
def exploration_loop(spark, sf_dir):
    """The loop over a stream of judgments; its rows are read from the sink's files."""
    from quarry.streaming import exploring, replay

    source = table(spark, sf_dir, "events")
    judged = run_judgments(replay.table_stream(spark, sf_dir, "events", source.schema))
    path = scratch_path(spark, "exploration")
    exploring.run_to_files(exploring.explored(judged, run_topology(source)), path, scratch_path(spark, "stream"))
    return spark.read.schema(exploring.OUTPUT).parquet(path)


_TYPES = ["click", "error", "purchase", "signup", "view"]


def event_ticks(events):
    """Each event as one tick: types are titles, the number in its properties steers the rest."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = lambda n: F.element_at(F.array(*map(F.lit, _TYPES)), (n % 5 + 1).cast("int"))
    own = F.array_position(F.array(*map(F.lit, _TYPES)), F.col("event_type"))
    fit = lambda title, a, b, c: F.struct(title.alias("title"), a.cast("double").alias("continuity"), b.cast("double").alias("coherence"), c.cast("double").alias("gain"))
    none = F.lit(None)
    v = F.col("value")
    return events.select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") / 64).alias("step"),
        F.array(fit(F.col("event_type"), v / 200, (k % 10) / 10, F.lit(0.5)), fit(kind(own), F.lit(0.3), F.lit(0.2), none)).alias("fits"),
        F.array(fit(kind(k + 2), v / 400, F.lit(0.4), F.lit(0.1))).alias("candidates"),
        F.array(F.struct(F.initcap("event_type").alias("title"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("qualifies"), (v / 300).alias("confidence"))).alias("seeds"),
        F.array(F.struct(kind(k).alias("title"), F.when(k < 20, "admit").when(k >= 90, "reject").otherwise("wait").alias("decision"), F.when(k % 2 == 0, k / 100).alias("confidence"))).alias("verdicts"),
        F.when(k % 7 == 0, "NEW").when(k % 2 == 1, F.col("event_type")).otherwise("").alias("best"),
        F.when(k == 5, " by  hand ").alias("trigger"),
        F.when(v > 200, "done").alias("outcome"),
        F.array(F.concat(F.lit("s"), (k % 4).cast("string"))).alias("stages"),
        F.array(F.concat(F.lit("e"), (k % 3).cast("string"))).alias("entities"),
        F.when(k % 11 == 0, F.array(F.lit("r"))).alias("relations"),
        F.when(v > 150, "broadly_complete").alias("status"),
        F.col("props").alias("artifact"),
    )


_KIND = "['click', 'error', 'purchase', 'signup', 'view'][CAST(({0}) % 5 + 1 AS INT)]"
_CLAMP = "greatest(0, least(1, {0}))"
_HAS = "len(list_filter({0}, lambda x: x.title = {1})) > 0"
_FEW = "CASE WHEN len({0}) > 0 THEN least(10, 4 + 2 * len({0})) ELSE 0 END"
_ARC = "{{'title': {0}, 'n': CAST(len({1}) + 1 AS BIGINT), 'opp': CAST({2} AS DOUBLE), 'status': {3}, 'progress': 0, 'tr': '', 'oc': '', 'st': CAST([] AS VARCHAR[]), 'en': CAST([] AS VARCHAR[]), 're': CAST([] AS VARCHAR[]), 'ev': [artifact], 'last': CAST(0 AS BIGINT), 'up': step}}"
_NONE = "CAST([] AS STRUCT(title VARCHAR, n BIGINT, opp DOUBLE, status VARCHAR, progress INT, tr VARCHAR, oc VARCHAR, st VARCHAR[], en VARCHAR[], re VARCHAR[], ev VARCHAR[], last BIGINT, up BIGINT)[])"
_MORE = "CASE WHEN list_contains(x.{0}, {1}) THEN x.{0} ELSE list_append(x.{0}, {1}) END"


@query(f"""WITH RECURSIVE t AS MATERIALIZED (SELECT user_id AS run, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id // 64 AS step, event_type AS f1, list_position({_TYPES}, event_type) AS own, k, value AS v, props AS artifact,
    0.45 * {_CLAMP.format('value / 200')} + 0.45 * ((k % 10) / 10) + 0.1 * 0.5 AS s1, 0.45 * 0.3 + 0.45 * 0.2 AS s2 FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events)),
s AS (SELECT DISTINCT run, CAST(0 AS BIGINT) AS n, {_NONE} AS arcs, {_NONE} AS hyps, '' AS active, CAST(0 AS BIGINT) AS step, CAST(-1 AS BIGINT) AS seq FROM t
UNION ALL SELECT run, n, list_transform(a5, lambda x: struct_update(x, last := CASE WHEN x.title = chosen THEN step ELSE x.last END)), hyps, coalesce(chosen, ''), step, seq FROM (
 SELECT *, coalesce(list_sort(list_transform(list_filter(a5, lambda x: (x.status <> 'broadly_complete' OR x.opp >= 0.45) AND (x.opp + least(0.15, 0.015 * greatest(0, step - x.last)) >= 0.25 OR x.title = liked)),
     lambda x: {{'p': -(x.opp + least(0.15, 0.015 * greatest(0, step - x.last))), 'l': x.last, 'n': x.n, 'title': x.title}}))[1].title, liked) AS chosen FROM (
 SELECT * EXCLUDE (hyps), hyps, coalesce(ev, nullif(active, '')) AS liked, list_transform(a4, lambda x: CASE WHEN x.title = ev THEN struct_update(x, progress := CAST(greatest(x.progress, least(96, greatest(
      CASE WHEN x.tr <> '' THEN 12 ELSE 0 END + least(42, 7 * len(x.st)) + CASE WHEN x.oc <> '' THEN 16 ELSE 0 END + {_FEW.format('x.en')} + {_FEW.format('x.re')}, CASE WHEN x.status = 'broadly_complete' THEN 90 ELSE 0 END))) AS INT)) ELSE x END) AS a5 FROM (
 SELECT * EXCLUDE (a3, hyps), hyps, list_transform(a3, lambda x: CASE WHEN x.title = ev THEN struct_update(x, tr := CASE WHEN k = 5 THEN 'by hand' ELSE x.tr END, oc := CASE WHEN v > 200 THEN 'done' ELSE x.oc END, st := {_MORE.format('st', "'s' || (k % 4)")}, en := {_MORE.format('en', "'e' || (k % 3)")},
      re := CASE WHEN k % 11 = 0 THEN {_MORE.format('re', "'r'")} ELSE x.re END, status := CASE WHEN v > 150 THEN 'broadly_complete' ELSE x.status END, ev := list_slice({_MORE.format('ev', 'artifact')}, -80, -1), up := step) ELSE x END) AS a4 FROM (
 SELECT *, CASE WHEN k % 7 <> 0 AND k % 2 = 1 AND s1 >= 0.25 AND {_HAS.format('a3', 'f1')} THEN f1 WHEN s1 >= 0.25 AND (s1 >= s2 OR NOT {_HAS.format('a3', 'f2')}) AND {_HAS.format('a3', 'f1')} THEN f1
      WHEN s2 >= 0.25 AND {_HAS.format('a3', 'f2')} AND (s2 > s1 OR NOT {_HAS.format('a3', 'f1')}) THEN f2 WHEN k % 7 = 0 AND k % 3 = 0 THEN f1 END AS ev FROM (
 SELECT * EXCLUDE (a2), list_transform(a2, lambda x: CASE WHEN x.title = {_KIND.format('k + 2')} THEN struct_update(x, opp := greatest(x.opp, 0.45 * {_CLAMP.format('v / 400')} + 0.45 * 0.4 + 0.1 * 0.1)) ELSE x END) AS a3 FROM (
 SELECT * EXCLUDE (a1, h1), CASE WHEN k % 3 <> 0 THEN a1 WHEN {_HAS.format('a1', 'f1')} THEN list_transform(a1, lambda x: CASE WHEN x.title = f1 THEN struct_update(x, opp := greatest(x.opp, c)) ELSE x END)
      ELSE list_append(a1, {_ARC.format('f1', 'a1', 'greatest(0.35, c)', "'forming'")}) END AS a2,
    CASE WHEN k % 3 = 0 AND NOT {_HAS.format('a1', 'f1')} THEN list_transform(h1, lambda x: CASE WHEN x.title = f1 THEN struct_update(x, status := 'admitted') ELSE x END)
      WHEN k % 3 <> 1 OR {_HAS.format('a1', 'f1')} THEN h1 WHEN {_HAS.format('h1', 'f1')} THEN list_transform(h1, lambda x: CASE WHEN x.title = f1 THEN struct_update(x, opp := greatest(x.opp, c), up := step, ev := list_slice({_MORE.format('ev', 'artifact')}, -40, -1)) ELSE x END)
      ELSE list_append(h1, {_ARC.format('f1', 'h1', 'c', "'hypothesis'")}) END AS hyps FROM (
 SELECT * EXCLUDE (a0, h0), CASE WHEN judged AND k < 20 THEN list_append(a0, {_ARC.format('vt', 'a0', 'greatest(0.35, vc)', "'forming'")}) ELSE a0 END AS a1,
    CASE WHEN judged THEN list_transform(h0, lambda x: CASE WHEN x.title = vt THEN struct_update(x, opp := vc, up := step, status := CASE WHEN k < 20 THEN 'admitted' WHEN k >= 90 THEN 'rejected' ELSE 'hypothesis' END) ELSE x END) ELSE h0 END AS h1 FROM (
 SELECT *, len(list_filter(h0, lambda x: x.title = vt AND x.status = 'hypothesis')) > 0 AS judged, CASE WHEN k % 2 = 0 THEN k / 100 ELSE list_filter(h0, lambda x: x.title = vt)[1].opp END AS vc FROM (
 SELECT t.*, s.active, s.hyps AS h0, {_KIND.format('own')} AS f2, {_KIND.format('k')} AS vt, {_CLAMP.format('v / 300')} AS c,
    list_transform(s.arcs, lambda x: struct_update(x, opp := CASE WHEN x.title = t.f1 THEN greatest(x.opp * 0.96, s1) WHEN x.title = {_KIND.format('own')} THEN greatest(x.opp * 0.96, s2) ELSE x.opp * 0.985 END)) AS a0
   FROM s JOIN t ON t.run = s.run AND t.n = s.n + 1)))))))))),
e AS (SELECT * FROM s WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC) = 1)
SELECT run, 'arc' AS kind, 'arc-' || x.n AS id, x.n, x.title, round(x.opp, 6) AS opportunity, x.status, x.progress, x.tr AS trigger, x.oc AS outcome, array_to_string(x.st, ',') AS stages, array_to_string(x.en, ',') AS entities, array_to_string(x.re, ',') AS relations, array_to_string(x.ev, ',') AS evidence, x.last, x.up AS updated FROM (SELECT run, unnest(arcs) AS x FROM e)
UNION ALL SELECT run, 'hypothesis', 'hyp-' || x.n, x.n, x.title, round(x.opp, 6), x.status, 0, '', '', '', '', '', array_to_string(x.ev, ','), 0, x.up FROM (SELECT run, unnest(hyps) AS x FROM e)
UNION ALL SELECT run, 'run', coalesce('arc-' || list_filter(arcs, lambda x: x.title = active)[1].n, ''), seq, '', 0, '', 0, '', '', '', '', '', '', 0, step FROM e""")
def scheduler_ticks(spark, sf_dir):
    """The scheduler's table after a stream of ticks, the events' files a batch each."""
    from quarry.streaming import replay, ticking

    folder = scratch_path(spark, "ticks")
    events = replay.table_stream(spark, sf_dir, "events", table(spark, sf_dir, "events").schema)
    ticking.consume(event_ticks(events), folder, scratch_path(spark, "stream"))
    lists = {c: F.array_join(c, ",") for c in ("stages", "entities", "relations", "evidence")}
    return ticking.read_state(spark, folder).withColumns({"title": F.lower("title"), "opportunity": F.round("opportunity", 6), **lists})


@query("""WITH f AS (SELECT user_id AS run, event_id AS pos, props AS artifact, value, event_type, sum(CAST(event_type = 'signup' AS INT)) OVER w AS epoch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS MATERIALIZED (SELECT *, sum(CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY run, epoch ORDER BY pos) AS depth FROM f),
here AS (SELECT run, max(pos) AS pos, arg_max(depth, pos) AS depth, arg_max(artifact, pos) AS artifact, arg_max(event_type, pos) AS kind, arg_max(value, pos) AS v FROM d GROUP BY run),
w AS (SELECT *, CASE kind WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'artifact' WHEN 'error' THEN 'stop' ELSE 'other' END AS type, kind <> 'error' AND v < 25 AS dampened FROM here),
seen AS (SELECT DISTINCT user_id AS run, props AS id FROM events WHERE value > 40),
links AS (SELECT user_id AS run, props AS artifact, event_id AS ord, lead(props) OVER (PARTITION BY user_id ORDER BY event_id) AS id FROM events),
open_ AS (SELECT a.run, a.depth, a.artifact FROM d a JOIN w ON w.run = a.run AND a.pos < w.pos AND a.depth < w.depth WHERE (w.dampened OR w.type = 'stop') AND NOT EXISTS (SELECT 1 FROM d b WHERE b.run = a.run AND b.pos > a.pos AND b.pos <= w.pos AND b.depth <= a.depth)),
res AS (SELECT o.run, arg_min(l.id, (-o.depth, l.ord, l.id)) AS resume FROM open_ o JOIN links l ON l.run = o.run AND l.artifact = o.artifact AND l.id IS NOT NULL WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.run = o.run AND s.id = l.id) GROUP BY 1),
c AS (SELECT user_id AS run, props AS id, event_type, value AS p FROM events e WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.run = e.user_id AND s.id = e.props)),
b AS (SELECT run, arg_min(id, (-p, id)) FILTER (event_type = 'view') AS hit, arg_min(id, (-p, id)) FILTER (event_type <> 'view') AS other, arg_min(id, (-p, id)) FILTER (event_type IN ('signup', 'error', 'purchase')) AS far, list(DISTINCT id) FILTER (event_type IN ('signup', 'error', 'purchase')) AS front FROM c GROUP BY 1),
x AS (SELECT w.*, resume, hit, other, far, CASE WHEN list_contains(front, artifact) THEN artifact END AS own FROM w LEFT JOIN res USING (run) LEFT JOIN b USING (run))
SELECT run, CASE WHEN type = 'stop' THEN coalesce(resume, far) WHEN dampened AND resume IS NOT NULL THEN resume WHEN type = 'search' AND hit IS NOT NULL THEN hit WHEN type = 'artifact' AND own IS NOT NULL THEN own ELSE other END AS id,
 CASE WHEN type = 'stop' THEN CASE WHEN coalesce(resume, far) IS NULL THEN 'none' ELSE 'backtrack' END WHEN dampened AND resume IS NOT NULL THEN 'ancestor' WHEN type = 'search' AND hit IS NOT NULL THEN 'hit' WHEN type = 'artifact' AND own IS NOT NULL THEN 'wish' WHEN other IS NULL THEN 'none' ELSE 'fallback' END AS outcome FROM x""")
def ways_on(spark, sf_dir):
    """Each user's events as a walk: signups begin at the root, errors stay beside, others go down."""
    from quarry.operators import resolving

    run = F.col("user_id").alias("run")
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    epochs = e.withColumn("epoch", F.sum((F.col("event_type") == "signup").cast("int")).over(w))
    down = F.col("event_type").isin("view", "click", "purchase").cast("int")
    frames = epochs.select(run, F.col("event_id").alias("pos"), F.sum(down).over(Window.partitionBy("user_id", "epoch").orderBy("event_id")).alias("depth"), F.col("props").alias("artifact"))
    last = e.groupBy(run).agg(F.max_by(F.struct("event_type", "value", "props"), "event_id").alias("l"))
    kind = F.col("l.event_type")
    wishes = last.select("run", F.when(kind == "click", "search").when(kind == "purchase", "artifact").when(kind == "error", "stop").otherwise("other").alias("type"), F.col("l.props").alias("artifact"), ((kind != "error") & (F.col("l.value") < 25)).alias("dampened"))
    links = e.select(run, F.col("props").alias("artifact"), F.col("event_id").alias("ord"), F.lead("props").over(w).alias("id"))
    some = lambda where: e.where(where).select(run, F.col("props").alias("id"), F.col("value").alias("priority"))
    return resolving.ways_on(wishes, frames, links, some("event_type IN ('signup', 'error', 'purchase')"), some("event_type = 'view'"), some("event_type <> 'view'"), some("value > 40").select("run", "id"))


_EDITED = """SELECT o_custkey AS arc, o_orderstatus, o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus <> 'F'"""


@query(f"""WITH o AS ({_EDITED}), e AS (SELECT arc, o_orderpriority AS name, max(o_orderstatus = 'P') AS schema, list(DISTINCT o_orderstatus) AS fields FROM o GROUP BY 1, 2),
h AS (SELECT arc, count(*) AS n, list(o_orderpriority ORDER BY o_orderkey) AS steps FROM o GROUP BY 1), k AS (SELECT arc, lower(trim(name)) AS k, * FROM e),
c AS (SELECT 'workflow' AS kind, 'workflow:' || arc AS id, 'arc' AS evidence, 'Customer ' || arc AS name FROM h UNION ALL SELECT 'workflow', 'workflow:' || arc, 'call_path', 'path ' || n FROM h
UNION ALL SELECT 'entity', 'entity:' || k, CASE WHEN schema THEN 'schema_definition' ELSE 'llm_inference' END, name FROM k UNION ALL SELECT 'link', 'workflow:' || arc || '|uses entity|entity:' || k, 'executable_code', 'uses entity' FROM k
UNION ALL SELECT 'field', 'field:' || k || '.' || lower(f), CASE WHEN schema THEN 'schema_definition' ELSE 'llm_inference' END, f FROM (SELECT *, unnest(fields) AS f FROM k)
UNION ALL SELECT 'link', 'entity:' || k || '|has field|field:' || k || '.' || lower(f), CASE WHEN schema THEN 'schema_definition' ELSE 'llm_inference' END, 'has field' FROM (SELECT *, unnest(fields) AS f FROM k)
UNION ALL SELECT 'step', 'step:' || arc || ':' || (i - 1), 'llm_interpretation', s FROM (SELECT arc, unnest(steps) AS s, unnest(range(1, len(steps) + 1)) AS i FROM h)
UNION ALL SELECT 'link', 'workflow:' || arc || '|has step|step:' || arc || ':' || (i - 1), 'llm_interpretation', 'has step' FROM (SELECT arc, unnest(range(1, len(steps) + 1)) AS i FROM h)),
g AS (SELECT kind, id, evidence, name, count(*) AS n FROM c GROUP BY ALL), v AS (SELECT kind, id, evidence, sum(n) AS n, min((CASE WHEN kind = 'workflow' AND evidence <> 'arc' THEN 1 ELSE 0 END, -n, name)) AS best FROM g GROUP BY ALL)
SELECT kind, id, min(best)[3] AS name, string_agg(evidence || ':' || CAST(n AS BIGINT), ',' ORDER BY evidence || ':' || CAST(n AS BIGINT)) AS evidence, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY kind, id""")
def arc_view(spark, sf_dir):
    """Customers' orders as arcs, built from all of them and edited to those still open: the SQL
    builds the edited arcs' view anew."""
    from quarry.operators import views

    o = table(spark, sf_dir, "orders")

    def arcs(rows):
        e = rows.groupBy("o_custkey", "o_orderpriority").agg(F.max((F.col("o_orderstatus") == "P").cast("int")).alias("p"), F.collect_set("o_orderstatus").alias("fields"))
        e = e.groupBy(F.col("o_custkey").alias("arc")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("name"), F.when(F.col("p") == 1, "schema").alias("schema"), "fields")).alias("entities"))
        s = rows.groupBy(F.col("o_custkey").alias("arc")).agg(F.count("*").alias("k"), F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x.o_orderpriority).alias("steps"))
        return s.join(e, "arc").select("arc", F.concat(F.lit("Customer "), "arc").alias("title"), F.concat(F.lit("path "), "k").alias("path"), F.lit(None).cast("string").alias("meaning"), "entities", "steps")

    before, after = arcs(o), arcs(o.where("o_orderstatus <> 'F'"))
    return views.shown(views.applied(views.contributions(before), views.changed(before, after)))


_TALLY = "user_id long, event_type string, n long, first long, last long, ids long"


@query("SELECT user_id, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL")
def stopped_tallies(spark, sf_dir):
    """Tallies of a stream that is stopped after its first batch and then goes on: the SQL counts
    all events once, so nothing may be lost or taken twice."""
    from quarry.runtime import shared_dir
    from quarry.streaming import replay, stopping

    source = table(spark, sf_dir, "events")
    parts, control = scratch_path(spark, "parts"), scratch_path(spark, "control")
    source.repartitionByRange(4, "event_id").write.parquet(parts)
    # Four batches, into however many files the events went.
    each = -(-len(spark.read.parquet(parts).inputFiles()) // 4)
    place = lambda: stopping.saved(spark, f"{shared_dir(spark)}/tallies", "events", parts)

    def put(rows, number):
        folder = place().state
        if number not in stopping.versions(rows.sparkSession, folder):
            new = rows.select("user_id", "event_type", F.lit(1).cast("long").alias("n"), F.col("event_id").alias("first"), F.col("event_id").alias("last"), F.col("event_id").alias("ids"))
            both = stopping.newest(rows.sparkSession, folder, _TALLY, number).unionByName(new)
            sums = both.groupBy("user_id", "event_type").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("ids").alias("ids"))
            sums.write.mode("overwrite").parquet(f"{folder}/batch-{number:09d}")
        if number == 0:
            stopping.request(rows.sparkSession, control, "tallies", "stop")

    events = replay.event_stream(spark, parts, source.schema, max(1, each))
    stopping.run(events, "tallies", control, place(), put)
    stopping.request(spark, control, "tallies", "run")
    stopping.run(events, "tallies", control, place(), put)
    return stopping.newest(spark, place().state, _TALLY)
