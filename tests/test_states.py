"""State folds on small logs, against what a step-by-step replay gives."""

from quarry.operators import states


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


def test_routes_and_notes(spark):
    deltas = spark.createDataFrame(
        [(1, 1, "orientation", None, None, None, "o"), (1, 2, "story", "NEW", "T", None, "s"), (1, 3, "story", "NEW", " ", None, "x"), (1, 4, "story", "UNATTACHED", "T", None, "u"), (1, 5, "other", "p", "T", None, ""), (1, 6, "story", "p", "T", "q", "park"), (1, 7, "story", "q", "T", "q", "s2"), (1, 8, None, None, None, None, None)],
        "run int, step int, role string, path string, title string, active string, meaning string",
    )
    free = {r.step: r.route for r in states.routed(deltas).collect()}
    assert free == {1: "orientation", 2: "story", 3: "unattached", 4: "unattached", 5: "unattached", 6: "story", 7: "story", 8: "unattached"}
    locked = states.routed(deltas, locked=True)
    assert {r.step: r.route for r in locked.collect()} == free | {6: "parked"}
    assert rows(states.notes(locked), "step", "route", "age") == [(1, "orientation", 1), (3, "unattached", 2), (4, "unattached", 1), (6, "parked", 1)]


def test_stories_close_only_without_open_branches(spark):
    schema = "run int, step int, path string, title string, continuity double, coherence_gain double, placement_confidence double, branch string, branch_status string, question string, resolves array<string>, closes string"
    s = lambda step, path, title=None, branch=None, status=None, question=None, resolves=(), closes=None: (1, step, path, title, 1.0, 1.0, 1.0, branch, status, question, list(resolves), closes)
    log = [s(1, "a", "A"), s(2, "a", branch="b"), s(3, "a", closes="story"), s(4, "a", branch="b", status="closed"), s(5, "a", closes="story"), s(6, "a", "A2"), s(7, "c", "C", branch="x", question="why"), s(8, "c", branch="x", closes="story"), s(9, "c", question="how", resolves=["why"])]
    deltas = spark.createDataFrame(log, schema)
    assert {r.step: r.open for r in states.open_branches(deltas).collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1, 8: 1, 9: 1}
    got = {r.path: r for r in states.stories(deltas).collect()}
    assert (got["a"].title, got["a"].status, got["a"].progress, got["a"].steps) == ("A2", "closed", 100.0, 6)
    progress = 88 * (1 - 2.718281828459045 ** (-3 / 4.5)) * 0.68 - 5 - 4
    assert (got["c"].status, got["c"].open, got["c"].progress) == ("early", 1, float(round(progress)))
    assert rows(states.questions(deltas), "path", "question") == [("c", "how")]
    assert states.stories(deltas.limit(0)).count() == 0


def test_dependencies_and_boundaries(spark):
    d = spark.createDataFrame([(1, "p", 1, "db", "local", "", None), (1, "p", 2, "db", "external", "c1", None), (1, "p", 3, "db", "local", " ", None), (1, "p", 4, None, None, None, "m")], "run int, path string, step int, label string, scope string, contract string, meaning string")
    assert rows(states.dependencies(d), "label", "scope", "contract") == [("db", "external", "c1"), ("m", "local", None)]
    b = spark.createDataFrame(
        [(1, 1, "external_boundary", "p", "pay", 0.2, 0.9, "", "m", "s", "search", None, "r"), (1, 2, "symbol", "p", "x", 0.2, 0.1, "", "", "", "search", None, "r"), (1, 3, "external_boundary", "p", None, None, None, "c", "", "", "artifact", "n", None), (1, 4, "external_boundary", "p", None, 0.8, 0.1, None, None, None, None, None, None)],
        "run int, step int, kind string, active string, reference string, continuity double, coherence_gain double, contract string, meaning string, summary string, next_type string, next_id string, resume_id string",
    )
    assert rows(states.boundary_subflow(b), "step", "relation", "continuity", "coherence_gain", "label", "contract", "next_type", "next_id") == [
        (1, "subflow", 0.75, 0.9, "pay", "m", "artifact", "r"), (2, None, 0.2, 0.1, None, None, "search", None), (3, "subflow", 0.75, 0.55, "External dependency", "c", "artifact", "n"), (4, "subflow", 0.8, 0.55, "External dependency", None, "stop", None)]


def test_threads_and_backtracking(spark):
    log = spark.createDataFrame([(1, k, "t" if k % 2 else "NEW", f"a{k}", 0.1, 0.1, 0.1) for k in range(1, 251)], "run int, step int, thread string, artifact string, continuity double, coherence double, gain double")
    every, own = states.threads(log)
    assert every.count() == 200 and own.count() == 80 and own.agg({"step": "min"}).first()[0] == 91
    frames = spark.createDataFrame([("x", 1, "f1", 0, "a"), ("x", 1, "f1", 1, "b"), ("x", 2, "f2", 0, "c"), ("x", 3, "f3", 0, "d"), ("y", 1, "g", 0, "e")], "arc string, frame int, artifact string, pos int, id string")
    current = spark.createDataFrame([("x", "f3"), ("y", "g"), ("z", "h")], "arc string, artifact string")
    frontier = spark.createDataFrame([("y", "m", 1), ("y", "n", 5), ("y", "o", 9)], "arc string, id string, priority int")
    visited = spark.createDataFrame([("x", "c"), ("x", "a"), ("y", "o")], "arc string, id string")
    assert rows(states.backtrack(frames, current, frontier, visited)) == [("x", "b"), ("y", "n"), ("z", None)]


def test_arcs(spark):
    arcs = spark.createDataFrame([("a", 0.2, 3, False, 1), ("b", 0.1, 0, False, 2), ("c", 0.5, 0, True, 0)], "arc string, opportunity double, age int, complete boolean, last int")
    fits = spark.createDataFrame([("b", 0.6), ("b", 0.3), ("c", 0.1)], "arc string, score double")
    assert {r.arc: r.opportunity for r in states.opportunities(arcs, fits).collect()} == {"a": 0.2, "b": 0.6, "c": 0.5}
    assert [r.arc for r in states.tick(arcs, fits).collect()] == ["b", "c"]
    todo = spark.createDataFrame([("a", None, True, False, 0.5, 1), ("b", 1.0, False, None, 0.0, 2), ("c", None, None, False, 0.1, 3)], "arc string, priority double, started boolean, completed boolean, opportunity double, created int")
    assert [r.arc for r in states.handoff(todo, "b").collect()] == ["c", "a"]
    up = spark.createDataFrame([("a", 1, "T", "", None, ["x"], ["e"], "odd"), ("a", 2, " ", "t", "o", ["y", "x"], ["f"], "unresolved")], "arc string, step int, title string, trigger string, outcome string, stages array<string>, entities array<string>, status string")
    assert rows(states.merged_arcs(up)) == [("a", "T", "t", "o", ["x", "y"], ["e", "f"], "unresolved")]
    assert rows(states.prioritised(todo.withColumn("last", todo.created), "c", 9), "arc", "priority", "last") == [("a", None, 1), ("b", 1.0, 2), ("c", 1.0, 9)]
    closing = spark.createDataFrame([(True, 0, 0, 0), (False, 1, 0, 90), (False, 1, 1, 95), (False, 0, 0, 95)], "done boolean, calls int, open int, progress int")
    assert [r[0] for r in closing.select(states.base_closure(*(closing[c] for c in closing.columns))).collect()] == [True, True, False, False]


def test_plans_and_tasks(spark):
    w = spark.createDataFrame([(1, "a", "A", ["b", "new-flow"]), (2, "b", "B", ["other"])], "ord int, id string, name string, next_ids array<string>")
    reuse = spark.createDataFrame([("a", "reuse"), ("b", "review")], "id string, verdict string")
    assert rows(states.workflow_plan(w, reuse), "id", "mode", "status") == [("a", "reuse", "reused"), ("b", "review", "pending")]
    idle = spark.createDataFrame([("a", "reuse"), ("b", "reuse")], "id string, verdict string")
    assert ("new-flow", "new flow", "discover", "pending") in rows(states.workflow_plan(w, idle), "id", "name", "mode", "status")
    assert rows(states.workflow_plan(w.limit(0), reuse.limit(0)), "id", "mode") == [("customer-places-order", "discover")]
    tasks = spark.createDataFrame([(x, "pending") for x in "abcd"] + [("e", "reused")], "id string, status string")
    log = spark.createDataFrame([("a", 1, "start"), ("a", 4, "finish"), ("b", 1, "start"), ("c", 2, "finish"), ("e", 1, "start")], "id string, step int, action string")
    recorded = spark.createDataFrame([("a", 3), ("c", 9)], "id string, step int")
    assert rows(states.task_states(tasks, log, recorded)) == [("a", "complete"), ("b", "in_progress"), ("c", "error"), ("d", "pending"), ("e", "reused")]


def test_scouting_and_reconciling(spark):
    rank = spark.createDataFrame([("p", 0.5, 2.0, "t"), ("q", 0.9, 0.9, "t"), ("r", 1.0, 1.0, "t")], "path string, novelty double, likelihood double, title string")
    ranked, seen = states.scout_run(rank, spark.createDataFrame([("p",), ("q",), ("s",)], "path string"))
    assert [r.path for r in ranked.collect()] == ["q", "p"] and rows(seen) == [("p",), ("q",), ("s",)]
    names = spark.createDataFrame([("n",), ("m",)], "name string")
    offered = spark.createDataFrame([("n", "A"), ("n", "B"), ("m", "A")], "name string, candidate string")
    said = spark.createDataFrame([("n", "B", True), ("n", "C", True), ("m", "A", None), ("x", "A", True)], "name string, candidate string, accepted boolean")
    ok, tried = states.reconciled(names, said, offered)
    assert rows(ok) == [("n", "B")] and [r[0] for r in rows(tried)] == ["m", "n"]


def test_catalogue_objects_and_snapshots(spark):
    schemas = spark.createDataFrame([("A", "entity", "A", None), ("A", "field", "id", None), ("A", "field", "id", None), ("A", "relationship", "", "b"), ("A", "relationship", "far", "Z"), ("B", "entity", "B", None)], "entity string, row string, name string, related string")
    nodes, links = states.schema_catalogue(schemas)
    assert rows(nodes) == [("entity", "a"), ("entity", "b"), ("field", "a.id")] and rows(links) == [("a", "a.id", "has_field"), ("a", "b", "references")]
    arcs = spark.createDataFrame([("1", "T")], "arc string, title string")
    objects, edges = states.arc_objects(arcs, spark.createDataFrame([("1", "E"), ("1", " e"), ("1", None)], "arc string, entity string"), spark.createDataFrame([("1", 1, "s"), ("1", 2, "t")], "arc string, ord int, name string"))
    assert rows(objects, "id") == [("entity:e",), ("step:1:1",), ("step:1:2",), ("workflow:1",)]
    assert rows(edges) == [("step:1:1", "step:1:2", "then"), ("workflow:1", "entity:e", "uses"), ("workflow:1", "step:1:1", "has_step"), ("workflow:1", "step:1:2", "has_step")]
    full = states.enriched(spark.createDataFrame([("1", "Cust "), ("1", "cust"), ("1", "Odd")], "arc string, name string"), spark.createDataFrame([("cust", "Customer")], "name string, entity string"), spark.createDataFrame([("Customer", 1, "b"), ("Customer", 0, "a")], "entity string, pos int, field string"))
    assert rows(full) == [("1", "Customer", "Customer", ["a", "b"]), ("1", "Odd", None, [])]
    runs = spark.createDataFrame([("r", 1, "x", True, False), ("r", 2, "y", True, None), ("r", 3, "z", False, True), ("s", 1, "w", None, True)], "repo string, saved int, snapshot string, valid boolean, stop boolean")
    assert rows(states.restored(runs)) == [("r", "y", True)]
    assert rows(states.snapshots(spark.createDataFrame([("a", 1, "p"), ("a", 2, "q")], "arc string, step int, state string"))) == [("a", "q")]
