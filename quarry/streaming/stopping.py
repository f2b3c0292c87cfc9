"""Stopping a running stream between its batches, and going on from what it saved.

A stop is asked for in a control table, so whoever can write there can stop a job on any machine.
The job looks before each batch: the batch under way is finished, the next isn't begun, and its
offsets stay uncommitted in the checkpoint, so a later start runs it.  A job that waits for input
looks between its triggers.

What a job saves belongs to one source at one revision: its folder is named by both, so another
revision begins anew.  A start goes on from the newest checkpoint there; where the versions are
left and no checkpoint, it restores the newest version and reads the input again under batch numbers
that follow it, which is right for sinks that pass over what they have seen.

The last command of a job counts, a stop before a run of the same moment; without any it runs.
A null job or command is an error.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.files import entries, exists
from quarry.streaming.ticking import versions

CONTROL = "job string, command string, at long"
COMMANDS = ("run", "stop")


class StopRequested(Exception):
    """Ends a stream at a batch that is not to begin."""


def request(spark: SparkSession, control: str, job: str, command: str) -> None:
    """Append a command for a job to the control table."""
    if not job or command not in COMMANDS:
        raise ValueError(f"a job and one of {COMMANDS} are needed, not {job!r} and {command!r}")
    spark.createDataFrame([(job, command, time.time_ns())], CONTROL).coalesce(1).write.mode("append").parquet(control)


def command(spark: SparkSession, control: str, job: str) -> str:
    """A job's last command."""
    if not exists(spark, control):
        return "run"
    told = spark.read.schema(CONTROL).parquet(control).where(F.col("job") == job)
    return told.agg(F.max_by("command", F.struct("at", "command"))).first()[0] or "run"


@dataclass(frozen=True)
class Saved:
    """Where a job's versions and checkpoint are, the number of its checkpoint's first batch, and
    the newest version it begins with (None: none)."""

    state: str
    checkpoint: str
    first: int
    restored: int | None


def saved(spark: SparkSession, base: str, source: str, revision: str) -> Saved:
    """What there is of a source at a revision, below ``base``."""
    folder = f"{base}/{hashlib.sha1(f'{source}@{revision}'.encode()).hexdigest()}"
    state = f"{folder}/state"
    known = versions(spark, state)
    begun = [n for n, is_dir in entries(spark, folder) if is_dir and n.startswith("checkpoint-")] if exists(spark, folder) else []
    first = max((int(n[11:]) for n in begun), default=known[-1] + 1 if known else 0)
    return Saved(state, f"{folder}/checkpoint-{first:09d}", first, known[-1] if known else None)


def newest(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest committed version (of the batches before one, if given); empty without one."""
    known = [v for v in versions(spark, folder) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{folder}/batch-{known[-1]:09d}") if known else spark.createDataFrame([], schema)


def run(rows: DataFrame, job: str, control: str, place: Saved, put: Callable[[DataFrame, int], object], every: str | None = None, look: float = 5.0) -> str:
    """Give a stream's batches to ``put`` with their numbers, until the input that is there was
    taken ('done') or a stop was asked for ('stopped').  ``put`` must change nothing where it saved
    a number before.  With ``every`` (an interval) the stream waits for more input instead."""
    spark = rows.sparkSession
    stopped: list[int] = []

    def batch(part: DataFrame, number: int) -> None:
        if command(spark, control, job) == "stop":
            stopped.append(number)
            raise StopRequested(f"{job} was asked to stop before batch {number}")
        put(part, place.first + number)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", place.checkpoint).trigger(**trigger).start()
    try:
        while not query.awaitTermination(look):
            if not query.status["isTriggerActive"] and command(spark, control, job) == "stop":
                query.stop()
                stopped.append(-1)
    except StreamingQueryException:
        if not stopped:
            raise
    return "stopped" if stopped else "done"
