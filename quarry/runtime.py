"""Session helpers shared by every operator: scratch space, materialisation, sizing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named by ``spark.checkpoint.dir``; only where that is unset and the master
    is local (tests) is a temporary folder made and registered.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here,
    and a lost executor takes no rows with it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that a task sorts or groups where ``dealt`` deals them.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys, least: int = 1) -> DataFrame:
    """``df`` dealt by ``keys`` over a number of tasks in proportion to ``rows``, which adaptive
    execution doesn't merge: what a task holds stays the same, however large the input.
    There are ``least`` tasks at least."""
    return df.repartition(max(least, 1 + rows // TASK_ROWS), *keys)


def positions(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """``df`` with ``name``: each row's place, from 0 and without gaps, in an order of all rows.

    Rows are dealt by ranges of the order and sorted there; a partition's rows are counted on,
    and no task sees more than its range.  Rows that tie in the whole order get any of their
    places."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = materialise(dealt.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ordered")
    # A row per partition.
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound the bytes of a batch that goes to a Python worker, for this session: rows may
    be long, and a batch of 10,000 of them needn't fit in memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = "".join(c for c in spark.conf.get(key) if c.isdigit())
    if not now or int(now) > most:
        spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
