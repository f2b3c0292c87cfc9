"""A scout's priority runs, for all runs at once: what is offered, ranked, promoted and next.

A run offers its first workflows that have no priority of the present model and its first unseen
paths.  A judgment ranks what was offered.  Ranked workflows take their priority; ranked paths
that are worth it become workflows, unless their title exists; all offered paths count as
reviewed; and the unfinished workflow of the highest priority is next.

Runs may hold any number of workflows and paths: what is offered is bounded, so only bounded
rows are ranked, and the rest is joined by run and title or aggregated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import clamp01, clip
from quarry.operators.arcs import last_rows

#: Workflows offered and accepted, paths offered, workflows that one run creates,
#: what a path must reach, runs in the history, and the model's name.
OFFERED, ACCEPTED, PATHS, CREATED = 8, 50, 10, 3
LIKELIHOOD, NOVELTY = 0.55, 0.45
HISTORY = 120
MODEL = "business-priority-v1"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _first(rows: DataFrame, keys: list[str], order: list, most: int, name: str = "k") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most)


def unranked(arcs: DataFrame, most: int = OFFERED, model: str = MODEL) -> DataFrame:
    """(run, arc, k): each run's first workflows without a finite priority of this model.  A
    null ``qualifies`` counts as yes.  arcs: run, arc, pos, qualifies, priority, model."""
    open_ = F.coalesce("qualifies", F.lit(True)) & ~(_finite(F.col("priority").cast("double")) & F.col("model").eqNullSafe(model))
    return _first(arcs.where(F.col("arc").isNotNull() & open_), ["run"], ["pos", "arc"], most).select("run", "arc", "k")


def normalised(rankings: DataFrame, arcs: DataFrame, paths: DataFrame) -> DataFrame:
    """The rankings of what may be ranked (``arc:`` and ``path:`` items), their numbers in [0, 1],
    with their place ``k`` by priority, then worth, then ``pos``.
    rankings: run, pos, item, priority, likelihood, novelty, pursue, title; arcs: run, arc;
    paths: run, id."""
    known = arcs.select("run", F.concat(F.lit("arc:"), "arc").alias("item")).unionByName(paths.select("run", F.concat(F.lit("path:"), "id").alias("item")))
    numbers = {c: clamp01(F.col(c)) for c in ("priority", "likelihood", "novelty")}
    rows = rankings.join(known.distinct(), ["run", "item"], "left_semi").withColumns(numbers)
    rows = rows.withColumns({"pursue": F.coalesce("pursue", F.lit(True)), "title": F.coalesce(clip(F.col("title"), 180, False), F.lit(""))})
    order = [F.desc("priority"), F.desc(F.col("novelty") * F.col("likelihood")), "pos", "title"]
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy(*order)))


@dataclass
class Scouted:
    """arcs: the input's with their new priorities, and those created; created: run, id, path,
    title, confidence, k; reviewed: run, path; next: run, arc; runs: run, offered, ranked,
    created, next."""

    arcs: DataFrame
    created: DataFrame
    reviewed: DataFrame
    next: DataFrame
    runs: DataFrame


def scout(arcs: DataFrame, candidates: DataFrame, rankings: DataFrame, known: DataFrame, model: str = MODEL) -> Scouted:
    """One priority run of every run.  A workflow that is ranked twice keeps the ranking that
    comes last in order; of new ones with the same title the first counts; a created workflow's
    name is ``path:`` and its candidate, and a path without an entry in ``known`` isn't promoted.
    Rows without a run are dropped; a run with nothing unfinished has no next workflow.
    arcs: run, arc, pos, title, qualifies, priority, model, started, completed, opportunity,
    created; candidates: run, id, pos, path, label (one path each); rankings as in
    ``normalised``; known: path."""
    arcs, candidates = (df.where("run IS NOT NULL") for df in (arcs, candidates))
    text = lambda c: F.col(c).cast("string").alias(c)
    arcs = arcs.withColumns({"arc": text("arc"), "priority": F.col("priority").cast("double")})
    offered = _first(candidates.where("id IS NOT NULL").withColumn("id", text("id")), ["run"], ["pos", "id"], PATHS, "place")
    ranked = normalised(rankings, unranked(arcs, ACCEPTED, model), offered)

    own = F.when(F.col("item").startswith("arc:"), F.expr("substr(item, 5)"))
    given = ranked.withColumn("arc", own).where("arc IS NOT NULL").groupBy("run", "arc").agg(F.max_by("priority", "k").alias("given"))
    # A run's rankings are bounded, so the many workflows aren't sorted to meet them.
    applied = arcs.join(given, ["run", "arc"], "left")
    applied = applied.withColumns({"model": F.when(F.col("given").isNotNull(), model).otherwise(F.col("model")), "priority": F.coalesce("given", "priority")}).drop("given")

    key = lambda c: F.lower(F.trim(c))
    titles = arcs.select("run", key("title").alias("key")).where("key IS NOT NULL").distinct()
    worth = F.col("pursue") & (F.col("likelihood") >= LIKELIHOOD) & (F.col("novelty") >= NOVELTY)
    good = ranked.where(worth & F.col("item").startswith("path:")).withColumn("id", F.expr("substr(item, 6)"))
    good = good.join(offered.select("run", "id", "path", "label"), ["run", "id"]).join(known.select("path").distinct(), "path", "left_semi")
    named = good.withColumn("title", F.when(F.col("title") != "", F.col("title")).otherwise(clip(F.coalesce("label", "id"), 180, False))).withColumn("key", key("title")).where("key <> ''")
    fresh = _first(named.join(titles, ["run", "key"], "left_anti"), ["run", "key"], ["k"], 1, "again")
    made = _first(fresh, ["run"], ["k"], CREATED, "nth").select("run", "id", "path", "title", F.greatest("likelihood", "novelty", "priority").alias("confidence"), "priority", F.col("nth").alias("k"))

    blank = {c: F.lit(None).cast(t).alias(c) for c, t in applied.dtypes}
    values = {
        "run": F.col("run"), "arc": F.concat(F.lit("path:"), "id"), "title": F.col("title"), "qualifies": F.lit(True), "priority": F.col("priority"),
        "model": F.lit(model), "started": F.lit(False), "completed": F.lit(False), "opportunity": F.col("confidence"),
    }
    new = made.select(*(values.get(c, b).cast(t).alias(c) for (c, b), (_, t) in zip(blank.items(), applied.dtypes)))
    every = applied.unionByName(new)

    left = every.where(~F.coalesce("completed", F.lit(False)))
    high = F.when(_finite(F.col("priority")), F.col("priority")).otherwise(-1.0)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    order = F.struct((-high).alias("p"), F.coalesce("started", F.lit(False)).alias("s"), (-number("opportunity")).alias("o"), number("created").alias("c"), F.col("arc").alias("a"))
    following = left.groupBy("run").agg(F.min_by("arc", order).alias("arc"))

    reviewed = offered.where("path IS NOT NULL").select("run", "path").distinct()
    count = lambda df, name: df.groupBy("run").agg(F.count("*").alias(name))
    all_ = arcs.select("run").unionByName(candidates.select("run")).distinct()
    runs = all_.join(count(offered, "offered"), "run", "left").join(count(ranked.where(own.isNotNull()), "ranked"), "run", "left").join(count(made, "created"), "run", "left")
    runs = runs.na.fill(0, ["offered", "ranked", "created"]).join(following.select("run", F.col("arc").alias("next")), "run", "left")
    return Scouted(every, made.drop("priority"), reviewed, following, runs)


def history(runs: DataFrame, most: int = HISTORY) -> DataFrame:
    """The last records of each run.  runs: run, step and what a run leaves."""
    return last_rows(runs, "run", "step", most).drop("age")
