"""Conditions on names, arcs, judgments and branches (columns and frames)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import clamp01, clip
from quarry.operators.arcs import CHECKLIST

#: Words of names that mean plumbing.
PLUMBING = "service|services|record|records|result|results|output|retrieved|read/updated"


def friendly_name(name: Column) -> Column:
    """Whether a name reads like a business thing; null doesn't.  (``dataview.friendly`` is
    the stricter test for entities of a view.)"""
    v = F.substring(clip(F.coalesce(name, F.lit("")), 100, ellipsis=False), 1, 100)
    return (v != "") & ~v.rlike(r"[.#/:()]") & ~v.rlike(rf"(?i)\b(?:{PLUMBING})\b")


def business_arc(marks: list[Column], qualifies: Column) -> Column:
    """Not marked as technical or as no business, and not said not to qualify."""
    out = F.coalesce(qualifies, F.lit(True))
    for mark in marks:
        m = F.lower(F.coalesce(mark, F.lit("")))
        out &= ~m.isin("technical", "technical_flow") & ~F.contains(m, F.lit("not_business"))
    return out


def known_pairs(judgments: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """Judgments on what was offered; others are dropped."""
    return judgments.join(offered.select(*keys).distinct(), keys, "left_semi")


def _said(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def admitted(classification: Column, confidence: Column, *texts: Column) -> Column:
    """A business flow of enough confidence whose texts are all there."""
    out = F.coalesce((classification == "business_flow") & (confidence >= 0.55), F.lit(False))
    for t in texts:
        out &= _said(t)
    return out


def scouted(novelty: Column, likelihood: Column) -> Column:
    return (clamp01(novelty) >= 0.5) & (clamp01(likelihood) >= 0.55)


def completion_reasons(status: Column, synthesis: Column) -> Column:
    """What keeps a workflow from being complete, as sentences in a fixed order; none: it is.
    status: map from checklist key to status; synthesis: struct (trigger, outcome,
    description), null if there is none."""
    lines = [(~F.coalesce(status[k].isin("supported", "not_applicable"), F.lit(False)), F.concat(F.lit(f"{k} is "), F.coalesce(F.nullif(status[k], F.lit("")), F.lit("missing")))) for k in CHECKLIST]
    lines.append((~status["evidenceCoverage"].eqNullSafe("supported"), F.lit("evidenceCoverage must be supported")))
    lines.append((synthesis.isNull(), F.lit("final workflow synthesis is missing")))
    parts = (("trigger", "trigger"), ("outcome", "outcome"), ("description", "narrative"))
    lines += [(~_said(synthesis[field]), F.lit(f"workflow {name} is missing")) for field, name in parts]
    return F.array_compact(F.array(*(F.when(bad, text) for bad, text in lines)))


def branch_index(raw: Column, branches: Column) -> Column:
    """A number as the index of one of so many branches; null if it is none."""
    ok = (raw == F.floor(raw)) & (raw >= 0) & (raw < branches)
    return F.when(ok, raw.cast("int"))


def broad_candidates(frontier: DataFrame, visited: DataFrame, source: Column) -> DataFrame:
    """Directories and files that weren't visited and lie outside the current source.
    frontier: id, source; visited: id."""
    wide = frontier.where(F.col("id").startswith("dir:") | F.col("id").startswith("file:"))
    return wide.where(~F.col("source").eqNullSafe(source)).join(visited.select("id").distinct(), "id", "left_anti")
