"""Scores, schedules and decisions over business arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import clamp01

#: What each part of a decision's score weighs.
WEIGHTS = {
    "pass1": {"membership": 0.50, "coherence": 0.25, "expected_gain": 0.25},
    "pass2": {"continuity": 0.45, "coherence": 0.30, "expected_gain": 0.25},
    "fit": {"continuity": 0.45, "coherence": 0.45, "expected_gain": 0.10},
    "novelty": {"new_arc": 0.40, "new_business": 0.40, "new_technical": 0.20},
}


def weighted(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total += clamp01(F.col(name)) * w
    return total / sum(weights.values())


def arc_progress(trigger: Column, stages: Column, outcome: Column, entities: Column, relations: Column, complete: Column | None = None) -> Column:
    """Percent: 12 for a trigger, 7 a stage up to 42, 16 for an outcome, and up to 10 each
    for entities and relations; 96 at most.  Broadly ``complete`` arcs have 90 at least."""
    few = lambda n: F.when(n > 0, F.least(F.lit(10), 4 + 2 * n)).otherwise(0)
    found = F.when(trigger, 12).otherwise(0) + F.least(F.lit(42), 7 * stages) + F.when(outcome, 16).otherwise(0) + few(entities) + few(relations)
    if complete is not None:
        found = F.when(complete, F.greatest(found, F.lit(90))).otherwise(found)
    return F.least(F.lit(96), found)


#: What makes a story's steps good.
QUALITY = {"continuity": 0.45, "coherence_gain": 0.35, "placement_confidence": 0.20}


def story_quality(steps: DataFrame, story: str) -> DataFrame:
    """(story, steps, quality): the weighted means of the steps' scores, nulls as 0."""
    means = sum((F.avg(F.coalesce(F.col(name), F.lit(0.0))) * w for name, w in QUALITY.items()), F.lit(0.0))
    return steps.groupBy(story).agg(F.count("*").alias("steps"), means.alias("quality"))


def story_progress(steps: Column, quality: Column, branches: Column, covered: Column, open_branches: Column, questions: Column, closed: Column | None = None) -> Column:
    """Saturating in the number of steps, scaled by quality and branch coverage, less what
    is open; 100 for ``closed`` stories, whatever they hold."""
    base = 88 * (1 - F.exp(-steps / 4.5)) * (0.55 + 0.45 * quality)
    held = F.when(branches > 0, base * (0.68 + 0.32 * covered / branches) - 5 * open_branches).otherwise(base)
    done = F.least(F.lit(96.0), held - F.least(F.lit(18), 4 * questions))
    progress = F.when(steps > 0, F.round(F.greatest(F.lit(0.0), done))).otherwise(0.0)
    return progress if closed is None else F.when(closed, 100.0).otherwise(progress)


def declining(scores: DataFrame, key: str, step: str, score: str, drop: float = 0.10) -> DataFrame:
    """Rows that end three strictly falling scores with a total fall of at least ``drop``."""
    w = Window.partitionBy(key).orderBy(step)
    one, two = F.lag(score, 1).over(w), F.lag(score, 2).over(w)
    return scores.withColumn("declining", F.coalesce((one > F.col(score)) & (two > one) & (two - F.col(score) >= drop), F.lit(False)))


def last_rows(rows: DataFrame, key: str, step: str, most: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(step))
    return rows.withColumn("age", F.row_number().over(w)).where(F.col("age") <= most)


def decay(scores: DataFrame, key: str, step: str, score: str) -> DataFrame:
    """Opportunity after all steps: seen, max(0.96 x before, score); a null score is a step
    that didn't see the arc, 0.985 x before.

    That is the greatest score, each shrunk by all the steps after it, so a sum of logarithms
    over a window and a maximum do; no key's rows meet in one."""
    after = Window.partitionBy(key).orderBy(F.desc(step)).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.count(score).over(after), F.lit(0))
    steps = F.coalesce(F.count("*").over(after), F.lit(0))
    shrunk = F.col(score).cast("double") * F.pow(F.lit(0.96), seen) * F.pow(F.lit(0.985), steps - seen)
    return scores.select(key, shrunk.alias("_s")).groupBy(key).agg(F.greatest(F.lit(0.0), F.coalesce(F.max("_s"), F.lit(0.0))).alias("opportunity"))


def fairness(opportunity: Column, age: Column) -> Column:
    return opportunity + F.least(F.lit(0.15), age * 0.015)


def next_arc(arcs: DataFrame, least: float = 0.25, complete_least: float = 0.45) -> DataFrame:
    """Arcs that may run next, best first; ties go to the one scheduled least recently.
    arcs: arc, opportunity, age, complete, last."""
    ranked = arcs.withColumn("priority", fairness(F.col("opportunity"), F.col("age")))
    ok = (F.col("priority") >= least) & (~F.col("complete") | (F.col("priority") >= complete_least))
    return ranked.where(ok).orderBy(F.desc("priority"), "last", "arc")


def decide(arcs: DataFrame, neighbours: DataFrame, novelty: DataFrame, phase: str) -> DataFrame:
    """(packet, action, target, value) for each packet.

    scout opens a new arc only if novelty strictly beats the best arc; pass1 takes the best
    arc, pass2 the best neighbour; ties go to the first id.
    arcs: packet, id, scores; neighbours: packet, id, value; novelty: packet, new_arc,
    new_business, new_technical."""
    value = weighted(WEIGHTS["pass2" if phase == "pass2" else "pass1"])
    best = arcs.select("packet", "id", value.alias("value")).groupBy("packet").agg(F.min_by(F.struct("id", "value"), F.struct((-F.col("value")).alias("v"), F.col("id").alias("i"))).alias("arc"))
    all_ = novelty.join(best, "packet", "left")
    if phase == "scout":
        new = weighted(WEIGHTS["novelty"])
        opens = F.col("arc").isNull() | (new > F.col("arc.value"))
        return all_.select("packet", F.when(opens, "open_new_arc_candidate").otherwise("continue_existing_arc").alias("action"), F.when(opens, F.when(clamp01(F.col("new_business")) >= clamp01(F.col("new_technical")), "business").otherwise("technical")).otherwise(F.col("arc.id").cast("string")).alias("target"), F.when(opens, new).otherwise(F.col("arc.value")).alias("value"))
    if phase == "pass1":
        return all_.select("packet", F.when(F.col("arc").isNull(), "no_arc_available").otherwise("select_arc").alias("action"), F.col("arc.id").cast("string").alias("target"), F.coalesce("arc.value", F.lit(0.0)).alias("value"))
    v = clamp01(F.col("value"))
    near = neighbours.groupBy("packet").agg(F.min_by(F.struct("id", v.alias("value")), F.struct((-v).alias("v"), F.col("id").alias("i"))).alias("n"))
    both = novelty.select("packet").join(near, "packet", "left")
    return both.select("packet", F.when(F.col("n").isNull(), "no_neighbour_available").otherwise("select_neighbour").alias("action"), F.col("n.id").cast("string").alias("target"), F.coalesce("n.value", F.lit(0.0)).alias("value"))


#: What the checklist of a complete workflow weighs, in percent.
CHECKLIST = {
    "trigger": 10,
    "actors": 10,
    "concepts": 10,
    "steps": 20,
    "rules": 15,
    "persistentReads": 10,
    "persistentWrites": 10,
    "outcome": 7,
    "nextWorkflow": 3,
    "evidenceCoverage": 5,
}


def checklist_percent(rows: DataFrame, key: str, item: str, status: str, weights: DataFrame) -> DataFrame:
    """Supported and not applicable count whole, partial half."""
    part = F.when(F.col(status).isin("supported", "not_applicable"), 1.0).when(F.col(status) == "partial", 0.5).otherwise(0.0)
    return rows.join(F.broadcast(weights), item).groupBy(key).agg(F.round(F.sum(F.col("weight") * part)).alias("percent"))
