"""Where a judgment's wish leads, with all its ways out, and ancestors on a stack of frames.

A run's frames are a log of a depth-first walk: each has a place and a depth, one more than its
parent's at most.  A frame is open at a later place if nothing as shallow came between; so the
ancestor of a place at some depth is the last frame of that depth before it.  A place asks every
depth above its own, and one window per run and depth answers: an as-of lookup over intervals
that are never written down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ancestors(frames: DataFrame, places: DataFrame, deepest: int = 1000) -> DataFrame:
    """(run, pos, depth, artifact) of the frames that are open above some places, nearest at the
    greatest depth.  frames: run, pos, depth, artifact; places: run, pos, depth (of a frame
    there).  Places below ``deepest`` raise an error; a null depth has no ancestors."""
    deep = F.when(F.col("depth") > deepest, F.raise_error(F.lit(f"a frame is deeper than {deepest}"))).otherwise(F.col("depth"))
    asked = places.where("depth > 0").select("run", "pos", F.explode(F.sequence(F.lit(0), deep.cast("int") - 1)).alias("depth"), F.lit(None).cast(frames.schema["artifact"].dataType).alias("artifact"), F.lit(1).alias("asks"))
    rows = frames.select("run", "pos", F.col("depth").cast("int").alias("depth"), "artifact", F.lit(0).alias("asks")).unionByName(asked)
    before = Window.partitionBy("run", "depth").orderBy("pos", "asks").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("asks") == 0, F.struct("pos", "artifact")), ignorenulls=True).over(before)
    return rows.withColumn("above", last).where("asks = 1 AND above IS NOT NULL").select("run", "pos", "depth", F.col("above.artifact").alias("artifact"))


def _best(rows: DataFrame, seen: DataFrame, name: str) -> DataFrame:
    order = F.struct((-F.coalesce("priority", F.lit(0.0))).alias("p"), F.col("id").alias("i"))
    return rows.where("id IS NOT NULL").join(seen, ["run", "id"], "left_anti").groupBy("run").agg(F.min_by("id", order).alias(name))


def ways_on(wishes: DataFrame, frames: DataFrame, links: DataFrame, frontier: DataFrame, hits: DataFrame, candidates: DataFrame, visited: DataFrame) -> DataFrame:
    """(run, id, outcome): the next artifact of each wish, and how it was found.

    - ``hit``: a search goes to its best unvisited hit;
    - ``wish``: an artifact goes to itself if it waits in the frontier, unvisited;
    - ``ancestor``: a dampened branch goes to the first link left of the nearest ancestor frame
      that has one;
    - ``backtrack``: a stop leaves the current frame and goes on like that, and then to the best
      of the frontier;
    - ``fallback``: whatever else, a blocked revisit and a search without hits among them, goes
      to the best candidate;
    - ``none``: nothing is left (a null id).

    The current frame is a run's last.  Ties of priority go to the lesser id, null priorities
    count as 0, a null type as other, null dampening as none; repeated rows count once.
    wishes: run, type (search, artifact, stop or other), artifact, dampened, a row per run;
    frames: run, pos, depth, artifact; links: run, artifact, ord, id; frontier, hits,
    candidates: run, id, priority; visited: run, id."""
    seen = visited.select("run", "id").where("id IS NOT NULL").distinct()
    asks = wishes.where(F.coalesce("dampened", F.lit(False)) | (F.col("type") == "stop")).select("run")
    here = frames.join(asks, "run", "left_semi").groupBy("run").agg(F.max("pos").alias("pos"), F.max_by("depth", "pos").alias("depth"))
    above = ancestors(frames, here).select("run", "depth", "artifact")
    left = above.join(links, ["run", "artifact"]).where("id IS NOT NULL").join(seen, ["run", "id"], "left_anti")
    resume = left.groupBy("run").agg(F.min_by("id", F.struct((-F.col("depth")).alias("d"), F.col("ord").alias("o"), F.col("id").alias("i"))).alias("resume"))
    waits = frontier.join(seen, ["run", "id"], "left_anti").select("run", F.col("id").alias("artifact"), F.col("id").alias("own")).distinct()
    rows = wishes.join(waits, ["run", "artifact"], "left").join(resume, "run", "left")
    for table, name in ((hits, "hit"), (candidates, "other"), (frontier, "far")):
        rows = rows.join(_best(table, seen, name), "run", "left")
    kind = F.coalesce("type", F.lit("other"))
    way = lambda id_, outcome: F.when(F.col(id_).isNotNull(), F.struct(F.col(id_).alias("id"), F.lit(outcome).alias("outcome")))
    stop = F.when(kind == "stop", F.coalesce(way("resume", "backtrack"), way("far", "backtrack")))
    damped = F.when((kind != "stop") & F.coalesce("dampened", F.lit(False)), way("resume", "ancestor"))
    wanted = F.when(kind == "search", way("hit", "hit")).when(kind == "artifact", way("own", "wish"))
    chosen = F.coalesce(stop, damped, wanted, F.when(kind != "stop", way("other", "fallback")))
    return rows.withColumn("w", chosen).select("run", F.col("w.id").alias("id"), F.coalesce("w.outcome", F.lit("none")).alias("outcome"))
