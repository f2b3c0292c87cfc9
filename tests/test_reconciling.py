"""Reconciliation passes against one plain loop, and what a second pass reads."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import reconciling


def plain(names, candidates, contexts, judged, passes, most):
    """(mappings, history): every pass looks at all names."""
    mapped, tried, runs = {}, {}, []
    order = sorted({(o, n) for n, o in names if n})
    for step in range(1, passes + 1):
        offers = []
        for _, n in order:
            own = sorted({c for m, c in contexts if m == n and c})
            options = sorted({(s, k) for m, s, k in candidates if m == n})
            if n in mapped or not own or not options:
                continue
            used = sorted({(c, s) for c in own for m, d in contexts if d == c for s in mapped.get(m, ())}) + [c for c in own]
            mark = (tuple(options), tuple(map(str, used)))
            if tried.get(n) != mark and n not in [o[0] for o in offers]:
                offers.append((n, options, mark))
        offers = offers[:most]
        if not offers:
            break
        new = {}
        for n, options, mark in offers:
            tried[n] = mark
            said = [s for m, s, k in judged if m == n and k <= step and s in {o[0] for o in options}]
            if said:
                new[n] = set(said)
        mapped |= new
        runs.append((step, len(offers), sum(map(len, new.values()))))
        if not new:
            break
    return {(n, s) for n, ss in mapped.items() for s in ss}, runs


@pytest.mark.parametrize("most", [None, 4])
def test_equals_a_loop(spark, most):
    rng = random.Random(11)
    names = [(f"n{k}", k % 5) for k in range(14)] + [("n3", 0), (None, 1)]
    candidates = [(f"n{rng.randrange(14)}", f"S{rng.randrange(5)}", rng.randrange(3)) for _ in range(40)]
    contexts = [(f"n{rng.randrange(14)}", f"c{rng.randrange(6)}") for _ in range(22)] + [("n1", None)]
    # A judgment is made from its step on: later passes see more.
    judged = [(f"n{rng.randrange(14)}", f"S{rng.randrange(6)}", rng.choice([1, 1, 2, 3])) for _ in range(30)]
    said = spark.createDataFrame(judged, "name string, schema string, since int")
    seen = []

    def judge(offered, step):
        seen.append({r.name for r in offered.collect()})
        return said.where(F.col("since") <= step)

    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = reconciling.reconcile(make(names, "name string, ord int"), make(candidates, "name string, schema string, score int"), make(contexts, "name string, context string"), judge, most=most)
    mappings, runs = plain(names, candidates, contexts, judged, 3, most)
    assert {tuple(r) for r in got.mappings.collect()} == mappings and got.runs == runs and len(runs) > 1
    # Nothing is offered twice under one fingerprint, and a name's last attempt is kept once.
    ledger = got.ledger.collect()
    assert len(ledger) == len({r.name for r in ledger}) == len(set().union(*seen))
    # With the same evidence a further call offers only what was left over.
    more = reconciling.reconcile(make(names, "name string, ord int"), make(candidates, "name string, schema string, score int"), make(contexts, "name string, context string"), judge, before=got, passes=1, most=most)
    assert more.runs[: len(runs)] == runs


def test_names_without_new_evidence_are_not_offered_again(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    names = make([("Order ", 1), ("order", 2), ("party", 3), ("stock", 4)], "name string, ord int")
    candidates = make([(n, "S", 1) for n in ("order", "party", "stock")], "name string, schema string, score int")
    contexts = make([("order", "buy"), ("party", "buy"), ("stock", "store")], "name string, context string")
    offers = []

    def judge(offered, step):
        offers.append(sorted(r.name for r in offered.collect()))
        return make([("ORDER", "S"), ("order", "not offered"), ("unknown", "S"), ("stock", None)], "name string, schema string")

    got = reconciling.reconcile(names, candidates, contexts, judge, most=None)
    assert offers == [["order", "party", "stock"], ["party"]] and got.runs == [(1, 3, 1), (2, 1, 0)]
    assert [tuple(r) for r in got.mappings.collect()] == [("order", "S")]
    none = reconciling.reconcile(names.limit(0), candidates, contexts, judge)
    assert none.mappings.count() == 0 and none.runs == []


def joined_rows(spark, after=-1):
    """(last execution, most rows that a join put out in those after ``after``)."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran, most = store.executionsList(), 0
    ids = [ran.apply(k).executionId() for k in range(ran.size())]
    for i in (i for i in ids if i > after):
        nodes, values = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(k) for k in range(metrics.size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return max(ids, default=-1), most


def test_no_name_is_joined_with_every_schema_of_its_contexts(spark):
    """Names times the schemas of a context that they share was what a task held."""
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    names = [f"n{k}" for k in range(400)]
    said = make([(f"n{k}", f"S{k}") for k in range(40)], "name string, schema string")
    began, _ = joined_rows(spark)
    got = reconciling.reconcile(make([(n, k) for k, n in enumerate(names)], "name string, ord int"), make([(n, "S" + n[1:], 1) for n in names], "name string, schema string, score int"), make([(n, "day") for n in names], "name string, context string"), lambda offered, step: said, most=None)
    assert got.runs == [(1, 400, 40), (2, 360, 0)] and got.mappings.count() == 40
    assert 0 < joined_rows(spark, began)[1] <= 400


def test_sums_that_grow_by_passes_are_those_of_all_mappings_at_once(spark):
    """A name's fingerprint doesn't tell in which passes its contexts gained their schemas."""
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    names = make([(n, 1) for n in "abcde"], "name string, ord int")
    candidates = make([(n, s, 1) for n in "abcde" for s in "ST"], "name string, schema string, score int")
    contexts = make([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("c", "x"), ("d", "y"), ("d", "z"), ("e", "z"), ("e", "z"), ("e", None)], "name string, context string")
    said = make([("a", "S", 1), ("b", "S", 2), ("b", "T", 2)], "name string, schema string, since int")
    judge = lambda offered, step: said.where(F.col("since") <= step).select("name", "schema")
    got = reconciling.reconcile(names, candidates, contexts, judge, most=None)
    assert got.runs == [(1, 5, 1), (2, 2, 2), (3, 2, 0)]
    empty = reconciling.Reconciled(got.mappings, got.ledger.limit(0), [])
    once = reconciling.reconcile(names, candidates, contexts, judge, before=empty, passes=1, most=None)
    ledger = {r.name: r.fingerprint for r in got.ledger.collect()}
    assert {r.name: r.fingerprint for r in once.ledger.collect()} == {n: ledger[n] for n in "cde"}


def test_history_is_kept_short(spark):
    runs = spark.createDataFrame([("r", k, 1, 0) for k in range(100)] + [("q", 1, 1, 1)], "repo string, step int, offered int, mapped int")
    got = reconciling.run_history(runs).collect()
    assert sorted(r.step for r in got if r.repo == "r") == list(range(20, 100)) and len(got) == 81
