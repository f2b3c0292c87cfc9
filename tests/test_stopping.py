"""Streams stopped between batches: nothing lost, nothing twice, restored only where it fits."""

import pytest
from pyspark.sql import functions as F

from quarry.plans import running
from quarry.streaming import stopping, ticking
from tests.test_running import event_files, stream  # noqa: F401


def board(spark, folder):
    return sorted(map(str, ticking.read_state(spark, folder).collect()))


def test_a_stopped_scheduler_goes_on(spark, tmp_path, event_files):  # noqa: F811
    events, give = event_files
    folder, control, base = give("in", 4), str(tmp_path / "control"), str(tmp_path / "base")
    ticks = running.event_ticks(stream(spark, events, folder))
    whole = str(tmp_path / "whole")
    ticking.consume(ticks, whole, str(tmp_path / "check"))
    seen = []

    def put(rows, number):
        seen.append(number)
        ticking.upsert(rows, number, stopping.saved(spark, base, "events", "1").state)
        if number == 1:
            stopping.request(spark, control, "other", "run")
            stopping.request(spark, control, "job", "stop")

    place = stopping.saved(spark, base, "events", "1")
    assert (place.first, place.restored) == (0, None)
    assert stopping.run(ticks, "job", control, place, put) == "stopped" and seen == [0, 1]
    # Still told to stop: nothing begins.
    assert stopping.run(ticks, "job", control, stopping.saved(spark, base, "events", "1"), put) == "stopped" and seen == [0, 1]
    half = board(spark, place.state)
    stopping.request(spark, control, "job", "run")
    again = stopping.saved(spark, base, "events", "1")
    assert (again.checkpoint, again.first, again.restored) == (place.checkpoint, 0, 1)
    assert stopping.run(ticks, "job", control, again, put) == "done" and seen == [0, 1, 2, 3]
    assert half != board(spark, whole) == board(spark, place.state)
    # The checkpoint is lost: the version is restored, and the input read again changes nothing.
    (tmp_path / "base").rename(tmp_path / "kept")
    run = next((tmp_path / "kept").iterdir())
    (tmp_path / "base" / run.name).mkdir(parents=True)
    (run / "state").rename(tmp_path / "base" / run.name / "state")
    restored = stopping.saved(spark, base, "events", "1")
    assert (restored.first, restored.restored) == (4, 3)
    assert stopping.run(ticks, "job", control, restored, put) == "done" and seen[4:] == [4, 5, 6, 7]
    assert board(spark, restored.state) == board(spark, whole)
    # Another revision begins anew.
    assert stopping.saved(spark, base, "events", "2").restored is None


def test_a_waiting_stream_stops(spark, tmp_path, event_files):  # noqa: F811
    events, give = event_files
    control, base, taken = str(tmp_path / "control"), str(tmp_path / "base"), []

    def put(rows, number):
        taken.append(rows.count())
        stopping.request(spark, control, "job", "stop")

    rows = stream(spark, events, give("in", 1))
    assert stopping.run(rows, "job", control, stopping.saved(spark, base, "events", "1"), put, every="0 seconds", look=0.2) == "stopped"
    assert len(taken) == 1


def test_errors_are_not_stops(spark, tmp_path, event_files):  # noqa: F811
    events, give = event_files

    def put(rows, number):
        raise RuntimeError("no room")

    with pytest.raises(Exception, match="no room"):
        stopping.run(stream(spark, events, give("in", 1)), "job", str(tmp_path / "c"), stopping.saved(spark, str(tmp_path / "b"), "e", "1"), put)
    for job, told in ((None, "stop"), ("", "stop"), ("job", None), ("job", "pause")):
        with pytest.raises(ValueError):
            stopping.request(spark, str(tmp_path / "c"), job, told)
    assert stopping.command(spark, str(tmp_path / "c"), "job") == "run"


def test_the_last_command_counts(spark, tmp_path):
    control = str(tmp_path / "control")
    rows = [("a", "stop", 1), ("a", "run", 2), ("b", "run", 5), ("b", "stop", 5), (None, "stop", 9)]
    spark.createDataFrame(rows, stopping.CONTROL).write.parquet(control)
    assert [stopping.command(spark, control, j) for j in ("a", "b", "c")] == ["run", "stop", "run"]
    assert spark.read.parquet(control).where(F.col("job").isNull()).count() == 1
