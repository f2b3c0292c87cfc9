"""Loops in keyed state: restarts, replays, limits and odd rows."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.plans import running
from quarry.runtime import table
from quarry.streaming import exploring, replay, ticking

SF = "/root/testdata/sf0.001"
JUDGED = "run long, seq long, story string, branch string, branch_status string, closes boolean, next_type string, next_id string"


@pytest.fixture()
def event_files(spark, tmp_path):
    """The events in four files in order, to be taken a batch each."""
    events = table(spark, SF, "events")
    last = events.agg(F.max("event_id")).first()[0]
    for k in range(4):
        part = events.where((F.col("event_id") * 4 / (last + 1)).cast("int") == k)
        part.coalesce(1).write.parquet(str(tmp_path / "parts" / f"p{k}"))
    files = [next((tmp_path / "parts" / f"p{k}").glob("*.parquet")) for k in range(4)]

    def give(folder, n, begin=0):
        (tmp_path / folder).mkdir(exist_ok=True)
        for k in range(begin, n):
            path = tmp_path / folder / f"f{k}.parquet"
            path.write_bytes(files[k].read_bytes())
            # A stream takes files by age.
            os.utime(path, (1_000_000 + k, 1_000_000 + k))
        return str(tmp_path / folder)

    return events, give


def stream(spark, events, folder):
    return replay.event_stream(spark, folder, events.schema)


def test_restarted_exploration_equals_one_run(spark, tmp_path, event_files):
    events, give = event_files
    start = running.run_topology(events)
    loop = lambda folder: exploring.explored(running.run_judgments(stream(spark, events, folder)), start)
    read = lambda name: {tuple(r) for r in spark.read.schema(exploring.OUTPUT).parquet(str(tmp_path / name)).collect()}
    exploring.run_to_files(loop(give("cut", 2)), str(tmp_path / "a"), str(tmp_path / "ca"))
    half = read("a")
    exploring.run_to_files(loop(give("cut", 4, 2)), str(tmp_path / "a"), str(tmp_path / "ca"))
    whole = {tuple(r) for r in running.exploration_loop(spark, SF).collect()}
    assert half < whole and read("a") == whole


def explore(spark, tmp_path, judged, edges, roots, hits=(), name="x", **kwargs):
    folder = tmp_path / name
    spark.createDataFrame(judged, JUDGED).coalesce(1).write.parquet(str(folder / "in"))
    start = exploring.topology(spark.createDataFrame(edges, "run long, src string, dst string, priority double"), spark.createDataFrame(roots, "run long, id string"), spark.createDataFrame(list(hits), "run long, query string, id string, priority double"))
    rows = spark.readStream.schema(JUDGED).parquet(str(folder / "in"))
    exploring.run_to_files(exploring.explored(rows, start, **kwargs), str(folder / "out"), str(folder / "check"))
    got = spark.read.schema(exploring.OUTPUT).parquet(str(folder / "out")).orderBy("run", "step").collect()
    return [(r.run, r.step, r.observed, r.next, r.status) for r in got]


def test_choices_of_a_run(spark, tmp_path):
    say = lambda run, seq, kind=None, to=None, branch=None, state=None, closes=None: (run, seq, "s", branch, state, closes, kind, to)
    edges = [(r, a, b, p) for r in (1, 2, 3, 4) for a, b, p in (("r", "x", 1.0), ("r", "y", 1.0), ("r", "x", 0.5), ("x", "z", 0.1), ("z", None, 9.0))]
    roots = [(r, "r") for r in (1, 2, 3, 4)] + [(5, None)]
    judged = [
        say(1, 1), say(1, 2, "artifact", "r"), say(1, 3, "artifact", "y"), say(1, 4), say(1, 5),
        say(2, 10, "search", "q"), say(2, 11, "search", None), say(2, 12, "stop"), say(2, 13),
        say(3, 1, branch="b"), say(3, 2, closes=True), say(3, 3, branch="b", state="bounded", closes=True), say(3, 4),
        say(4, 2), say(4, 1, "artifact", "y"),
        say(5, 1), say(6, 1),
    ]
    got = explore(spark, tmp_path, judged, edges, roots, [(2, "q", "far", 0.0), (2, "q", "r", 5.0)])
    assert [g for g in got if g[0] == 1] == [(1, 1, "r", "x", "exploring"), (1, 2, "x", "y", "exploring"), (1, 3, "y", "z", "exploring"), (1, 4, "z", None, "no_frontier")]
    assert [g for g in got if g[0] == 2] == [(2, 1, "r", "far", "exploring"), (2, 2, "far", "x", "exploring"), (2, 3, "x", None, "no_frontier")]
    assert [g[4] for g in got if g[0] == 3] == ["exploring", "exploring", "closed"]
    assert [g for g in got if g[0] == 4] == [(4, 1, "r", "y", "exploring"), (4, 2, "y", "x", "exploring")]
    assert not [g for g in got if g[0] > 4]


def test_limits_of_steps_and_frontier(spark, tmp_path):
    edges = [(1, f"n{k:03d}", f"n{k + 1:03d}", 1.0) for k in range(80)] + [(2, "r", f"m{k}", float(k)) for k in range(6)]
    judged = [(run, k, "s", None, None, False, None, None) for run in (1, 2) for k in range(80)]
    got = explore(spark, tmp_path, judged, edges, [(1, "n000"), (2, "r")], keep=3)
    assert len([g for g in got if g[0] == 1]) == 60 and got[59][4] == "budget_exhausted"
    # The root's neighbours are merged before and in the first step: those cut off come back.
    assert [g[3] for g in got if g[0] == 2] == ["m5", "m2", "m1", "m0", None]


def test_numbers_never_move(spark, tmp_path):
    schema = "run long, seq long, name string"
    earlier = spark.createDataFrame([(1, "old", 7)], "run long, name string, n long")

    def go(k, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        named = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        exploring.run_to_files(exploring.allocated(named, earlier), str(tmp_path / "out"), str(tmp_path / "check"))
        return {(r.run, r.name): (r.seq, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    first = go(0, [(1, 5, "b"), (1, 5, "a"), (1, 6, "old"), (2, 1, "z"), (1, 7, None), (1, 9, "b")])
    assert first == {(1, "a"): (5, 8), (1, "b"): (5, 9), (2, "z"): (1, 1)}
    assert go(1, [(1, 1, "earlier"), (2, 2, "y"), (2, 3, "z")]) == first | {(1, "earlier"): (1, 10), (2, "y"): (2, 2)}


def state_of(df):
    return sorted((repr(r) for r in df.collect()))


def test_replayed_and_restarted_ticks_change_nothing(spark, tmp_path, event_files):
    events, give = event_files
    ticks = lambda folder: running.event_ticks(stream(spark, events, folder))
    ticking.consume(ticks(give("cut", 2)), str(tmp_path / "t"), str(tmp_path / "c"))
    ticking.consume(ticks(give("cut", 4, 2)), str(tmp_path / "t"), str(tmp_path / "c"))
    assert len(ticking.versions(spark, str(tmp_path / "t"))) == 4
    end = ticking.read_state(spark, str(tmp_path / "t"))
    once = ticking.ticked(spark.createDataFrame([], ticking.STATE), running.event_ticks(events))
    assert state_of(end) == state_of(once)
    # A batch again, and a batch whose version was not finished.
    last = ticking.versions(spark, str(tmp_path / "t"))[-1]
    part = running.event_ticks(spark.read.schema(events.schema).parquet(f"{tmp_path}/cut/f3.parquet"))
    before = state_of(end)
    assert not ticking.upsert(part, last, str(tmp_path / "t"))
    (tmp_path / "t" / f"batch-{last:09d}" / "_SUCCESS").unlink()
    assert ticking.versions(spark, str(tmp_path / "t"))[-1] == last - 1
    assert ticking.upsert(part, last, str(tmp_path / "t")) and state_of(ticking.read_state(spark, str(tmp_path / "t"))) == before
    # Ticks that were seen are passed over by the fold itself.
    assert state_of(ticking.ticked(ticking.read_state(spark, str(tmp_path / "t")), running.event_ticks(events))) == before


def tick(seq, **kwargs):
    blank = {"run": 1, "seq": seq, "step": seq, "fits": None, "candidates": None, "seeds": None, "verdicts": None, "best": None, "trigger": None, "outcome": None, "stages": None, "entities": None, "relations": None, "status": None, "artifact": None}
    return tuple((blank | kwargs).values())


def test_scheduling_by_hand(spark):
    fit = lambda title, s: (title, s, s, s)
    ticks = [
        tick(1, seeds=[("Place  order", True, 0.5), ("Cancel", True, None), ("Refund", False, 0.2), ("Noise", None, 1.0), (None, True, 1.0), (" ", True, 1.0)], artifact="a1"),
        tick(2, fits=[fit("CANCEL", 0.9), fit("unknown", 1.0), (None, 1.0, 1.0, 1.0)], stages=["one", None, "one", " two "], trigger="t", artifact="a2"),
        tick(3, verdicts=[("refund", "admit", None), ("refund", "reject", None), ("nothing", "admit", 1.0)], best="NEW", seeds=[("refund", True, 0.1)], outcome="o"),
        tick(4, candidates=[fit("refund", 1.0), fit("refund", 0.1)]),
        tick(4, run=None),
    ]
    got = {(r.kind, r.id): r for r in ticking.ticked(spark.createDataFrame([], ticking.STATE), spark.createDataFrame(ticks, ticking.TICK)).collect()}
    assert sorted(r.id for r in got.values() if r.kind != "run") == ["arc-1", "arc-2", "arc-3", "hyp-1"]
    order, cancel, refund = (got["arc", f"arc-{k}"] for k in (1, 2, 3))
    assert (order.title, cancel.title, refund.title) == ("Place order", "Cancel", "Refund")
    assert order.opportunity == pytest.approx(0.5 * 0.985**3) and cancel.opportunity == pytest.approx(0.9 * 0.985**2) and refund.opportunity == 1.0
    assert (cancel.stages, cancel.evidence, cancel.progress) == (["one", "two"], ["a1", "a2"], 12 + 14)
    assert refund.outcome == "o" and got["hypothesis", "hyp-1"].status == "admitted"
    (run,) = [r for r in got.values() if r.kind == "run"]
    assert run.id == "arc-3" and refund.last == 4 and cancel.last == 3 and order.last == 1
    assert ticking.ticked(spark.createDataFrame([], ticking.STATE), spark.createDataFrame([], ticking.TICK)).count() == 0


def test_a_table_of_many_files_is_few_batches(spark, tmp_path):
    """Each batch rewrites or loads the runs' state, so their number must not grow with the files."""
    from quarry.streaming import replay

    for k in range(11):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    batches = []
    stream = replay.table_stream(spark, str(tmp_path), "events", "id long")
    query = stream.writeStream.foreachBatch(lambda rows, number: batches.append(rows.count())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(batches) == 110 and len(batches) <= replay.BATCHES
