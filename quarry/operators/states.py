"""State machines of an exploration, as folds over ordered logs.

A judgment (what a language model said at a step) is a row, so a state after all steps is a
set of aggregates: the latest text that isn't empty, unions, counts, and the last few rows.
Nothing is replayed row by row; where order matters inside a key, a window over the key says
what held at a step.  Logs are keyed by ``run`` unless stated otherwise, steps are unique
within a key, and ties go to the lesser id.  Empty logs give empty states; null texts count
as empty, null scores as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import clamp01, humanize, label_key
from quarry.operators.arcs import last_rows, next_arc, story_progress
from quarry.operators.choosing import pending
from quarry.operators.ranking import unfinished


def _text(c: str | Column) -> Column:
    """A trimmed text; null if there is nothing in it."""
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def latest(value: str | Column, step: str = "step") -> Column:
    """The newest text that isn't empty."""
    v = _text(value)
    return F.max_by(v, F.when(v.isNotNull(), F.col(step)))


def until(log: DataFrame, key: str, step: str, stop: Column, most: int) -> DataFrame:
    """The rows of each key up to its first that stops, and ``most`` at most."""
    w = Window.partitionBy(key).orderBy(step)
    before = F.coalesce(F.max(F.when(stop, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return log.withColumn("n", F.row_number().over(w)).withColumn("past", before).where((F.col("n") <= most) & (F.col("past") == 0)).drop("past")


def exploration(log: DataFrame, most: int = 60) -> DataFrame:
    """Steps that a run takes: it ends with a closed story, an empty frontier or a stop.
    log: run, step, closed, frontier, stop."""
    over = F.coalesce("closed", F.lit(False)) | (F.col("frontier") == 0) | F.coalesce("stop", F.lit(False))
    return until(log, "run", "step", over, most)


def rounds(log: DataFrame, most: int = 24) -> DataFrame:
    """Rounds of a workflow that count.  A round with bad output is tried again on the same
    evidence and doesn't count; evidence seen in an earlier good round is blocked; the gate's
    consent ends the workflow.  log: run, step, evidence, valid, complete."""
    good = log.where(F.coalesce("valid", F.lit(False)))
    seen = F.row_number().over(Window.partitionBy("run", "evidence").orderBy("step")) > 1
    return until(good.withColumn("blocked", seen), "run", "step", F.coalesce("complete", F.lit(False)) & ~F.col("blocked"), most)


def merge_frontier(frontier: DataFrame, items: DataFrame, visited: DataFrame, most: int = 120) -> DataFrame:
    """The frontier with new ids behind it, the last ``most`` of each run.  Ids that it has,
    or that were visited, aren't added again.  frontier, items: run, ord, id; visited: run, id."""
    fresh = items.where(_text("id").isNotNull()).join(visited.select("run", "id").distinct(), ["run", "id"], "left_anti").join(frontier.select("run", "id").distinct(), ["run", "id"], "left_anti")
    fresh = fresh.groupBy("run", "id").agg(F.min("ord").alias("ord")).withColumn("part", F.lit(1))
    old = frontier.select("run", "id", "ord").withColumn("part", F.lit(0))
    w = Window.partitionBy("run").orderBy(F.desc("part"), F.desc("ord"), F.desc("id"))
    return old.unionByName(fresh).withColumn("age", F.row_number().over(w)).where(F.col("age") <= most)


#: How many of each kind of note a run keeps.
KEPT = {"orientation": 24, "unattached": 40, "parked": 40, "assignment": 200, "trajectory": 80}


def routed(deltas: DataFrame, locked: bool = False) -> DataFrame:
    """deltas with ``route``: orientation, unattached, parked or story.  With ``locked``, a
    story other than the active one is parked.  deltas: run, step, role, path, title, active."""
    known = F.col("role").isin("orientation", "story") & ~((F.col("role") == "story") & F.col("path").eqNullSafe("UNATTACHED"))
    nameless = (F.col("path").isNull() | (F.col("path") == "NEW")) & _text("title").isNull()
    other = F.lit(locked) & F.col("active").isNotNull() & ~F.col("path").eqNullSafe(F.col("active"))
    story = F.when(other, "parked").when(nameless, "unattached").otherwise("story")
    return deltas.withColumn("route", F.when(~F.coalesce(known, F.lit(False)), "unattached").when(F.col("role") == "orientation", "orientation").otherwise(story))


def notes(deltas: DataFrame) -> DataFrame:
    """The last notes of each run by route, as many as ``KEPT`` says; those without a meaning
    aren't kept.  deltas: as routed gives, with meaning."""
    said = deltas.where((F.col("route") != "story") & _text("meaning").isNotNull())
    w = Window.partitionBy("run", "route").orderBy(F.desc("step"))
    most = F.when(F.col("route") == "orientation", KEPT["orientation"]).otherwise(KEPT["unattached"])
    return said.withColumn("age", F.row_number().over(w)).where(F.col("age") <= most)


def open_branches(deltas: DataFrame) -> DataFrame:
    """deltas with ``open``: how many branches of the story are open after each.
    deltas: run, path, step, branch, branch_status (open, closed or bounded; null keeps it,
    a new branch is open)."""
    w = Window.partitionBy("run", "path", "branch").orderBy("step")
    status = F.coalesce(F.last("branch_status", ignorenulls=True).over(w), F.lit("open"))
    is_open = F.when(F.col("branch").isNull(), 0).when(status == "open", 1).otherwise(0)
    rows = deltas.withColumn("now", is_open)
    change = F.col("now") - F.coalesce(F.lag("now").over(w), F.lit(0))
    rows = rows.withColumn("change", F.when(F.col("branch").isNull(), 0).otherwise(change))
    return rows.withColumn("open", F.sum("change").over(Window.partitionBy("run", "path").orderBy("step"))).drop("now", "change")


def questions(deltas: DataFrame, most: int = 8) -> DataFrame:
    """Questions still open, the last ``most`` of a story: asked and not resolved since.
    deltas: run, path, step, question, resolves (texts)."""
    asked = deltas.where(_text("question").isNotNull()).groupBy("run", "path", F.trim("question").alias("question")).agg(F.max("step").alias("step"))
    solved = deltas.select("run", "path", F.col("step").alias("at"), F.explode("resolves").alias("question")).groupBy("run", "path", "question").agg(F.max("at").alias("at"))
    left = asked.join(solved, ["run", "path", "question"], "left").where("at IS NULL OR at < step")
    w = Window.partitionBy("run", "path").orderBy(F.desc("step"), "question")
    return left.withColumn("age", F.row_number().over(w)).where(F.col("age") <= most).select("run", "path", "step", "question")


def stories(deltas: DataFrame) -> DataFrame:
    """(run, path, title, steps, open, progress, status) of each story after all its deltas.

    A story closes when a delta that closes it finds no branch open; it stays closed.
    deltas: run, step, path, title, continuity, coherence_gain, placement_confidence, branch,
    branch_status, question, resolves, closes."""
    one = lambda c: F.coalesce(clamp01(F.col(c)), F.lit(0.0))
    quality = F.avg(one("continuity")) * 0.45 + F.avg(one("coherence_gain")) * 0.35 + F.avg(one("placement_confidence")) * 0.20
    rows = open_branches(deltas)
    shut = F.max((F.col("closes").eqNullSafe("story") & (F.col("open") == 0)).cast("int")) == 1
    state = rows.groupBy("run", "path").agg(latest("title").alias("title"), F.count("*").alias("steps"), quality.alias("quality"), F.max_by("open", "step").alias("open"), F.countDistinct("branch").alias("branches"), shut.alias("closed"))
    asked = questions(deltas).groupBy("run", "path").agg(F.count("*").alias("asked"))
    state = state.join(asked, ["run", "path"], "left").withColumn("asked", F.coalesce("asked", F.lit(0)))
    done = F.col("branches") - F.col("open")
    state = state.withColumn("progress", story_progress(F.col("steps"), F.col("quality"), F.col("branches"), done, F.col("open"), F.col("asked"), F.col("closed")))
    status = F.when(F.col("closed"), "closed").when(F.col("progress") >= 82, "closing").when(F.col("progress") >= 30, "building").otherwise("early")
    return state.select("run", "path", "title", "steps", "open", "progress", status.alias("status"))


def dependencies(deltas: DataFrame) -> DataFrame:
    """(run, path, label, scope, contract): what a story's subflows depend on, a label once;
    external once said stays so.  deltas: run, path, step, label, scope, contract, meaning."""
    label = F.coalesce(_text("label"), _text("meaning"), F.lit("Semantic dependency"))
    external = F.max(F.coalesce(F.col("scope") == "external", F.lit(False)).cast("int")) == 1
    return deltas.groupBy("run", "path", label.alias("label")).agg(F.when(external, "external").otherwise("local").alias("scope"), latest("contract").alias("contract"))


def boundary_subflow(deltas: DataFrame) -> DataFrame:
    """Judgments on unresolved external references become subflows of the active story, with
    least scores and a contract; they never start a search.
    deltas: run, step, kind, active, reference, continuity, coherence_gain, contract, meaning,
    summary, next_type, next_id, resume_id."""
    at = F.col("kind").eqNullSafe("external_boundary") & F.col("active").isNotNull()
    onward = F.when((F.col("next_type") == "artifact") & _text("next_id").isNotNull(), F.col("next_id")).otherwise(F.col("resume_id"))
    floor = lambda c, least: F.when(at, F.greatest(F.lit(least), F.coalesce(F.col(c), F.lit(least)))).otherwise(F.col(c))
    return deltas.select(
        "run",
        "step",
        F.when(at, "subflow").alias("relation"),
        F.when(at, F.col("active")).alias("path"),
        floor("continuity", 0.75).alias("continuity"),
        floor("coherence_gain", 0.55).alias("coherence_gain"),
        F.when(at, F.coalesce(_text("reference"), F.lit("External dependency"))).alias("label"),
        F.when(at, F.substring(F.coalesce(_text("contract"), _text("meaning"), _text("summary")), 1, 500)).alias("contract"),
        F.when(at, F.when(onward.isNull(), "stop").otherwise("artifact")).otherwise(F.col("next_type")).alias("next_type"),
        F.when(at, onward).otherwise(F.col("next_id")).alias("next_id"),
    )


def threads(assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the last 200 assignments of a run, the last 80 of each thread).  assignments: run,
    step, thread, artifact, continuity, coherence, gain."""
    own = assignments.where(~F.col("thread").isin("NEW", "UNATTACHED"))
    w = Window.partitionBy("run", "thread").orderBy(F.desc("step"))
    return last_rows(assignments, "run", "step", KEPT["assignment"]), own.withColumn("age", F.row_number().over(w)).where(F.col("age") <= KEPT["trajectory"])


def backtrack(frames: DataFrame, current: DataFrame, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """(arc, id): where to go on after the current artifact is dropped from the stack: the
    newest frame with work left, else the best of the frontier.
    frames: arc, frame, artifact, pos, id; current: arc, artifact; frontier: arc, id, priority;
    visited: arc, id."""
    left = frames.join(current, ["arc", "artifact"], "left_anti")
    near = pending(left, left, visited).withColumnRenamed("id", "near")
    fresh = frontier.join(visited.select("arc", "id").distinct(), ["arc", "id"], "left_anti")
    far = fresh.groupBy("arc").agg(F.min_by("id", F.struct((-F.col("priority")).alias("p"), F.col("id").alias("i"))).alias("far"))
    return current.select("arc").distinct().join(near, "arc", "left").join(far, "arc", "left").select("arc", F.coalesce("near", "far").alias("id"))


def numbered(rows: DataFrame, key: str, order: list, prefix: str, begin: int = 1) -> DataFrame:
    """rows with ``id``: the prefix and a number, from ``begin`` on, within their key."""
    return rows.withColumn("id", F.concat(F.lit(f"{prefix}-"), (F.row_number().over(Window.partitionBy(key).orderBy(*order)) + begin - 1).cast("string")))


def hypotheses(seeds: DataFrame, judgments: DataFrame) -> DataFrame:
    """(run, key, id, title, confidence, actor, intent, reason, evidence, status).

    Seeds of one title, case aside, are one hypothesis with the highest confidence and the
    newest texts.  The first judgment that rejects it, or admits it as a use case, decides.
    seeds: run, step, title, confidence, actor, intent, reason, artifact; judgments: run,
    step, title, decision, qualifies, confidence."""
    key = F.lower(_text("title")).alias("key")
    rows = seeds.where(_text("title").isNotNull()).withColumn("key", key)
    seen = F.size(F.collect_set("artifact"))
    state = rows.groupBy("run", "key").agg(
        F.min_by(F.trim("title"), "step").alias("title"), F.max(F.coalesce(clamp01(F.col("confidence")), F.lit(0.0))).alias("confidence"), latest("actor").alias("actor"), latest("intent").alias("intent"), latest("reason").alias("reason"), F.least(F.lit(40), seen).alias("evidence"), F.min("step").alias("created")
    )
    final = (F.col("decision") == "reject") | ((F.col("decision") == "admit") & F.coalesce("qualifies", F.lit(False)))
    said = judgments.where(_text("title").isNotNull()).withColumn("key", key).withColumn("final", F.coalesce(final, F.lit(False)))
    last = F.min(F.when(F.col("final"), F.col("step"))).over(Window.partitionBy("run", "key"))
    said = said.withColumn("until", last).where("until IS NULL OR step <= until")
    verdict = said.groupBy("run", "key").agg(F.max_by("decision", F.when(F.col("final"), F.col("step"))).alias("decision"), F.max_by(clamp01(F.col("confidence")), F.when(F.col("confidence").isNotNull(), F.col("step"))).alias("said"))
    out = state.join(verdict, ["run", "key"], "left")
    status = F.when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "admit", "admitted").otherwise("hypothesis")
    out = out.withColumn("status", status).withColumn("confidence", F.coalesce("said", "confidence")).drop("decision", "said")
    return numbered(out, "run", ["created", "key"], "hyp").drop("created")


def opportunities(arcs: DataFrame, fits: DataFrame) -> DataFrame:
    """arcs with their opportunity raised to the best fit of any candidate.
    arcs: arc, opportunity, ...; fits: arc, score."""
    best = fits.groupBy("arc").agg(F.max("score").alias("best"))
    return arcs.join(best, "arc", "left").withColumn("opportunity", F.greatest(F.coalesce("opportunity", F.lit(0.0)), F.coalesce("best", F.lit(0.0)))).drop("best")


def merged_arcs(updates: DataFrame) -> DataFrame:
    """(arc, title, trigger, outcome, stages, entities, status) after all updates: the newest
    texts, lists united.  updates: arc, step, title, trigger, outcome, stages, entities,
    status."""
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    known = F.when(F.col("status").isin("forming", "broadly_complete", "unresolved"), F.col("status"))
    return updates.groupBy("arc").agg(latest("title").alias("title"), latest("trigger").alias("trigger"), latest("outcome").alias("outcome"), united("stages").alias("stages"), united("entities").alias("entities"), F.coalesce(latest(known), F.lit("forming")).alias("status"))


def tick(arcs: DataFrame, fits: DataFrame) -> DataFrame:
    """Arcs in the order in which they may run after one judgment: opportunities are raised
    first.  arcs: arc, opportunity, age, complete, last; fits: arc, score."""
    return next_arc(opportunities(arcs, fits))


def handoff(arcs: DataFrame, completed) -> DataFrame:
    """Unfinished arcs in order after one is completed: that one has no opportunity left.
    arcs: arc, priority, started, completed, opportunity, created."""
    done = F.col("arc") == F.lit(completed)
    return unfinished(arcs.withColumn("completed", F.coalesce("completed", F.lit(False)) | done))


def flow_states(calls: DataFrame) -> DataFrame:
    """(arc, whole_calls, branch_calls, interpreted, pending, completed) after all calls on
    whole flows: pending are the branches that the newest call left unresolved and no call has
    interpreted.  calls: arc, step, branch (null: the whole flow), unresolved (array<int>),
    action."""
    state = calls.groupBy("arc").agg(F.count(F.when(F.col("branch").isNull(), 1)).alias("whole_calls"), F.count("branch").alias("branch_calls"), F.array_sort(F.collect_set("branch")).alias("interpreted"), F.max_by(F.struct("branch", "unresolved", "action"), "step").alias("last"))
    left = F.array_sort(F.array_except(F.coalesce("last.unresolved", F.array().cast("array<int>")), "interpreted"))
    state = state.withColumn("pending", left)
    over = F.col("last.action").isin("complete", "scout") | (F.col("last.branch").isNotNull() & (F.size("pending") == 0))
    return state.select("arc", "whole_calls", "branch_calls", "interpreted", "pending", F.coalesce(over, F.lit(False)).alias("completed"))


def base_closure(completed: Column, calls: Column, pending_branches: Column, progress: Column) -> Column:
    """The plain rule for closing a flow."""
    return (pending_branches == 0) & (completed | ((calls > 0) & (progress >= 90)))


def checkpoint(log: DataFrame, commit: Column) -> DataFrame:
    """The newest checkpoint of each workflow, if it is of that commit and wasn't cleared.
    log: workflow, step, action (save or clear), commit, state."""
    last = log.groupBy("workflow").agg(F.max_by(F.struct("action", "commit", "state"), "step").alias("c"))
    return last.where((F.col("c.action") == "save") & F.col("c.commit").eqNullSafe(commit)).select("workflow", F.col("c.state").alias("state"))


def snapshots(log: DataFrame) -> DataFrame:
    """The newest saved walk of each arc.  log: arc, step, state."""
    return log.groupBy("arc").agg(F.max_by("state", "step").alias("state"))


def compact_findings(findings: DataFrame, most: int = 24) -> DataFrame:
    """The last ``most`` different findings of each workflow, at their first place.
    findings: workflow, step, path, symbol, finding."""
    kept = findings.where(_text("finding").isNotNull()).groupBy("workflow", "path", "symbol", F.substring(F.trim(F.regexp_replace("finding", r"\s+", " ")), 1, 350).alias("finding")).agg(F.min("step").alias("step"))
    return last_rows(kept, "workflow", "step", most).drop("age")


def workflow_plan(workflows: DataFrame, reuse: DataFrame, bootstrap: tuple[str, str] = ("customer-places-order", "Customer places an order")) -> DataFrame:
    """(id, name, mode, status) of the tasks: workflows to review and to reuse; with nothing
    known a first one, and with nothing to review the first follower that isn't known.
    workflows: ord, id, name, next_ids; reuse: id, verdict (review or reuse)."""
    known = workflows.join(reuse, "id").select("ord", "id", "name", F.col("verdict").alias("mode"), F.when(F.col("verdict") == "review", "pending").otherwise("reused").alias("status"))
    nothing = workflows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).cast("long").alias("ord"), F.lit(bootstrap[0]).alias("id"), F.lit(bootstrap[1]).alias("name"))
    each = workflows.select("ord", F.posexplode("next_ids").alias("pos", "id"))
    idle = known.agg(F.count(F.when(F.col("status") == "pending", 1)).alias("n")).where("n = 0").select(F.lit(1).alias("idle"))
    one = each.join(workflows.select("id"), "id", "left_anti").orderBy("ord", "pos").limit(1)
    follower = one.join(F.broadcast(idle)).select(F.col("ord").cast("long").alias("ord"), "id", humanize(F.col("id")).alias("name"))
    new = nothing.unionByName(follower).select("ord", "id", "name", F.lit("discover").alias("mode"), F.lit("pending").alias("status"))
    return known.select(F.col("ord").cast("long").alias("ord"), "id", "name", "mode", "status").unionByName(new)


def task_states(tasks: DataFrame, log: DataFrame, recorded: DataFrame) -> DataFrame:
    """(id, status) after a log of starts and finishes; a finish counts only once the workflow
    was recorded, otherwise it is an error and the task goes on.
    tasks: id, status; log: id, step, action; recorded: id, step."""
    known = recorded.groupBy("id").agg(F.min("step").alias("since"))
    done = (F.col("action") == "finish") & (F.col("since") <= F.col("step"))
    state = log.join(known, "id", "left").groupBy("id").agg(F.max(F.coalesce(done, F.lit(False)).cast("int")).alias("done"), F.max((F.col("action") == "start").cast("int")).alias("started"), F.max(((F.col("action") == "finish") & ~F.coalesce(done, F.lit(False))).cast("int")).alias("early"))
    out = tasks.join(state, "id", "left")
    status = F.when(F.col("status") == "reused", "reused").when(F.col("done") == 1, "complete").when(F.col("early") == 1, "error").when(F.col("started") == 1, "in_progress").otherwise(F.col("status"))
    return out.select("id", status.alias("status"))


def prioritised(arcs: DataFrame, target, step: int) -> DataFrame:
    """arcs with one raised to the highest priority and scheduled now.
    arcs: arc, priority, opportunity, last."""
    hit = F.col("arc") == F.lit(target)
    return arcs.withColumn("priority", F.when(hit, 1.0).otherwise(F.col("priority"))).withColumn("opportunity", F.when(hit, 1.0).otherwise(F.col("opportunity"))).withColumn("last", F.when(hit, step).otherwise(F.col("last")))


def resolved_action(actions: DataFrame, frontier: DataFrame, hits: DataFrame, candidates: DataFrame, visited: DataFrame) -> DataFrame:
    """(run, id): where a judgment's wish leads.  A search goes to its best hit, an artifact
    to itself if it waits in the frontier, both unvisited; otherwise to the best candidate;
    a stop leads nowhere (null).  actions: run, type, artifact; frontier: run, id; hits,
    candidates: run, id, priority; visited: run, id."""
    seen = visited.select("run", "id").distinct()
    order = F.struct((-F.col("priority")).alias("p"), F.col("id").alias("i"))
    best = lambda rows, name: rows.join(seen, ["run", "id"], "left_anti").groupBy("run").agg(F.min_by("id", order).alias(name))
    waits = frontier.join(seen, ["run", "id"], "left_anti").select("run", F.col("id").alias("artifact"), F.col("id").alias("wish")).distinct()
    rows = actions.join(waits, ["run", "artifact"], "left").join(best(hits, "hit"), "run", "left").join(best(candidates, "other"), "run", "left")
    wanted = F.when(F.col("type") == "search", F.col("hit")).when(F.col("type") == "artifact", F.col("wish"))
    return rows.select("run", F.when(~F.col("type").eqNullSafe("stop"), F.coalesce(wanted, "other")).alias("id"))


def discovery_starts(updates: DataFrame) -> DataFrame:
    """(start, title, confidence, status) after all updates; once qualified, only updates that
    qualify it again count.  updates: start, step, title, likelihood, qualifies, pursue."""
    yes = F.coalesce("qualifies", F.lit(False))
    first = F.min(F.when(yes, F.col("step"))).over(Window.partitionBy("start"))
    rows = updates.withColumn("since", first).where(F.col("since").isNull() | (F.col("step") <= F.col("since")) | yes)
    state = rows.groupBy("start").agg(latest("title").alias("title"), F.max_by(clamp01(F.col("likelihood")), F.when(F.col("likelihood").isNotNull(), F.col("step"))).alias("confidence"), F.max("since").alias("since"), F.max_by(F.coalesce("pursue", F.lit(True)), "step").alias("pursue"))
    return state.select("start", "title", "confidence", F.when(F.col("since").isNotNull(), "qualified").when(~F.col("pursue"), "deprioritized").otherwise("candidate").alias("status"))


def meanings(log: DataFrame) -> DataFrame:
    """The last judgment on each artifact.  log: step, artifact, meaning, role, path."""
    return log.groupBy("artifact").agg(F.max_by(F.struct("meaning", "role", "path"), "step").alias("m")).select("artifact", "m.*")


def scout_run(rankings: DataFrame, offered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rankings of offered paths, best first; all offered paths, now reviewed).
    rankings: path, novelty, likelihood, title; offered: path."""
    own = rankings.join(offered.select("path").distinct(), "path", "left_semi")
    worth = clamp01(F.col("novelty")) * clamp01(F.col("likelihood"))
    return own.withColumn("worth", worth).orderBy(F.desc("worth"), "path"), offered.select("path").distinct()


def reconciled(names: DataFrame, judgments: DataFrame, offered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted matches, attempts).  Only pairs that were offered count; every name that was
    judged is an attempt under the fingerprint of its candidates.
    names: name; judgments: name, candidate, accepted; offered: name, candidate."""
    ok = judgments.where(F.coalesce("accepted", F.lit(False))).join(offered.distinct(), ["name", "candidate"], "left_semi")
    prints = offered.distinct().groupBy("name").agg(F.sha1(F.array_join(F.array_sort(F.collect_set("candidate")), "|")).alias("fingerprint"))
    tried = judgments.select("name").distinct().join(names.select("name").distinct(), "name").join(prints, "name")
    return ok.select("name", "candidate").distinct(), tried


def schema_catalogue(schemas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of all schemas: a node for each entity and field, a link from an entity
    to each field, and one for each relationship to a known entity.
    schemas: entity, row (entity, field or relationship), name, related."""
    key = lambda c: label_key(F.col(c))
    entities = schemas.select(key("entity").alias("entity")).distinct()
    fields = schemas.where("row = 'field'").select(key("entity").alias("entity"), key("name").alias("name")).distinct()
    nodes = entities.select(F.lit("entity").alias("type"), F.col("entity").alias("id")).unionByName(fields.select(F.lit("field").alias("type"), F.concat_ws(".", "entity", "name").alias("id")))
    held = fields.select(F.col("entity").alias("src"), F.concat_ws(".", "entity", "name").alias("dst"), F.lit("has_field").alias("relation"))
    joined = schemas.where("row = 'relationship'").select(key("entity").alias("src"), key("related").alias("dst"), F.coalesce(_text("name"), F.lit("references")).alias("relation")).distinct()
    return nodes, held.unionByName(joined.join(entities.select(F.col("entity").alias("dst")), "dst", "left_semi").select("src", "dst", "relation"))


def arc_objects(arcs: DataFrame, entities: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, links) that an arc means: the workflow, its entities (one for all arcs that
    name it) and its steps.  arcs: arc, title; entities: arc, entity; steps: arc, ord, name."""
    e = entities.where(_text("entity").isNotNull()).select("arc", F.concat(F.lit("entity:"), label_key(F.col("entity"))).alias("id"), F.trim("entity").alias("name"))
    s = steps.select("arc", F.concat(F.lit("step:"), F.col("arc"), F.lit(":"), F.col("ord").cast("string")).alias("id"), F.col("name"), "ord")
    objects = arcs.select(F.concat(F.lit("workflow:"), "arc").alias("id"), F.lit("workflow").alias("type"), F.col("title").alias("name"))
    objects = objects.unionByName(e.groupBy("id").agg(F.min("name").alias("name")).select("id", F.lit("entity").alias("type"), "name")).unionByName(s.select("id", F.lit("step").alias("type"), "name"))
    flow = F.concat(F.lit("workflow:"), F.col("arc")).alias("src")
    links = e.select(flow, F.col("id").alias("dst"), F.lit("uses").alias("relation")).distinct()
    after = F.lag("id").over(Window.partitionBy("arc").orderBy("ord"))
    chain = s.withColumn("src", after).where("src IS NOT NULL").select("src", F.col("id").alias("dst"), F.lit("then").alias("relation"))
    return objects, links.unionByName(s.select(flow, F.col("id").alias("dst"), F.lit("has_step").alias("relation"))).unionByName(chain)


def enriched(names: DataFrame, canonical: DataFrame, fields: DataFrame, most: int = 80) -> DataFrame:
    """(arc, entity, schema, fields): an arc's entity names by their canonical entity, a name
    once, with the schema's first ``most`` fields.  names: arc, name; canonical: name, entity;
    fields: entity, pos, field."""
    key = label_key(F.col("name"))
    to = canonical.select(key.alias("key"), F.col("entity").alias("schema")).dropDuplicates(["key"])
    rows = names.withColumn("key", key).join(to, "key", "left").select("arc", F.coalesce("schema", F.trim("name")).alias("entity"), "schema").distinct()
    listed = fields.where(F.col("pos") < most).groupBy(F.col("entity").alias("schema")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field"))), lambda x: x.field).alias("fields"))
    return rows.join(listed, "schema", "left").select("arc", "entity", "schema", F.coalesce("fields", F.array().cast("array<string>")).alias("fields"))


def restored(runs: DataFrame) -> DataFrame:
    """(repo, snapshot, stopped): the newest snapshot of each repository of the right version,
    and whether its run was asked to stop after it.  runs: repo, saved, snapshot, valid, stop."""
    ok = runs.groupBy("repo").agg(F.max_by(F.struct("snapshot", "saved"), F.when(F.coalesce("valid", F.lit(False)), F.col("saved"))).alias("s"), F.max(F.when(F.coalesce("stop", F.lit(False)), F.col("saved"))).alias("asked"))
    return ok.where("s.snapshot IS NOT NULL").select("repo", "s.snapshot", F.coalesce(F.col("asked") >= F.col("s.saved"), F.lit(False)).alias("stopped"))


def scout_loop(ranked: DataFrame, judged: DataFrame, size: int = 12) -> tuple[DataFrame, DataFrame]:
    """(reviewed paths, the window's promoted path): windows of ``size`` paths by rank are
    looked at until one holds a path that is judged worth an arc; the best of that window.
    ranked: path, rank (from 0, without gaps); judged: path, promoted, worth."""
    rows = ranked.join(judged, "path", "left").withColumn("window", F.floor(F.col("rank") / size))
    good = rows.where(F.coalesce("promoted", F.lit(False)))
    first = good.agg(F.min("window").alias("until"))
    seen = rows.join(F.broadcast(first)).where(F.col("until").isNull() | (F.col("window") <= F.col("until")))
    best = good.join(F.broadcast(first), F.col("window") == F.col("until")).orderBy(F.desc("worth"), "rank").limit(1)
    return seen.select("path"), best.select("path")
