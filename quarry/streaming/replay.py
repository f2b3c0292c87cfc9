"""Structured Streaming replays of the event logs (an extension: the state machines fold
event by event; here a micro-batch at a time)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources.files import entries


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder)


#: Batches that a table of part files is taken in: each batch costs as much as its state.
BATCHES = 4


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of part files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        files = sum(f.endswith(".parquet") and not is_dir for f, is_dir in entries(spark, f"{folder}/{name}.parquet"))
        return event_stream(spark, f"{folder}/{name}.parquet", schema, max(1, -(-files // BATCHES)))
    return event_stream(spark, folder, schema, glob=f"{name}.parquet")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window, with a watermark for late events."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def opportunity_stream(events: DataFrame) -> DataFrame:
    """Per user a running opportunity: the larger of 0.96 times the last and the event's
    score.  State is one number per key, and grows with keys, not events."""

    def fold(key, frames, state: GroupState):
        value = state.get[0] if state.exists else 0.0
        n = state.get[1] if state.exists else 0
        for frame in frames:
            for s in frame.sort_values("event_id")["value"]:
                value, n = max(value * 0.96, float(s) / 100), n + 1
        state.update((value, n))
        yield pd.DataFrame({"user_id": [key[0]], "opportunity": [value], "events": [n]})

    return events.select("user_id", "event_id", "value").groupBy("user_id").applyInPandasWithState(fold, "user_id long, opportunity double, events long", "value double, n long", "update", GroupStateTimeout.NoTimeout)


def run_to_memory(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process all that there is and return the sink's table."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def snapshots(df: DataFrame, path: str, checkpoint: str):
    """Broadcast whole-state snapshots: each micro-batch replaces the table of its number,
    so a batch that runs again changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/snapshot={number}")

    return df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
