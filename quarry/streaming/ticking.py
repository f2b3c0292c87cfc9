"""The arc scheduler as micro-batches: each batch upserts a versioned table, once.

A version of the table is a folder named by the batch that wrote it, and is made from the one
before it, so a batch that runs again finds its own version and changes nothing.  A version
counts once Spark's commit marker is in it.

A tick takes one judgment: arcs it fits gain by the fit, all others decay; judged hypotheses
are admitted or rejected, new arcs and hypotheses get the run's next numbers; candidates raise
opportunities; the arc that the evidence belongs to takes up the update; and the next arc is
chosen by opportunity and by how long it has waited.  That choice is part of the next tick's
state, so ticks of a run follow each other; runs are independent, and a batch brings each run's
arcs and its ticks together in one task by one cogroup.  A run holds tens of arcs.

Ticks of a run come in order of ``seq``, over batches as well; ``step`` is what waiting is
measured in.  Null scores count as 0, null or
empty titles as none; ties of fits go to the arc that is named first, ties of priority to the
one scheduled least recently, then to the older one.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quarry.sources.files import entries, exists

_FIT = "array<struct<title string, continuity double, coherence double, gain double>>"
#: A judgment: fits and candidates name arcs by title, ``verdicts`` judge hypotheses.
TICK = f"run long, seq long, step long, fits {_FIT}, candidates {_FIT}, seeds array<struct<title string, qualifies boolean, confidence double>>, verdicts array<struct<title string, decision string, confidence double>>, best string, trigger string, outcome string, stages array<string>, entities array<string>, relations array<string>, status string, artifact string"
#: An arc, a hypothesis, or (kind run) a run's own counters and active arc.
STATE = "run long, kind string, id string, n long, title string, opportunity double, status string, progress int, trigger string, outcome string, stages array<string>, entities array<string>, relations array<string>, evidence array<string>, last long, updated long"

#: What a fit weighs, how opportunity decays, what an arc needs to run, and how
#: many pieces of evidence arcs and hypotheses keep.
FIT_WEIGHTS = (0.45, 0.45, 0.10)
SEEN_DECAY, UNSEEN_DECAY = 0.96, 0.985
NEW_LEAST, FIT_LEAST, RUN_LEAST, COMPLETE_LEAST = 0.35, 0.25, 0.25, 0.45
WAIT_GAIN, WAIT_MOST = 0.015, 0.15
ARC_EVIDENCE, HYPOTHESIS_EVIDENCE = 80, 40


def clamp(x) -> float:
    return 0.0 if x is None or not math.isfinite(x) else max(0.0, min(1.0, float(x)))


def fit_score(fit) -> float:
    return sum(w * clamp(fit[k]) for w, k in zip(FIT_WEIGHTS, ("continuity", "coherence", "gain")))


def clean(text) -> str:
    return " ".join(text.split()) if isinstance(text, str) else ""


def items(values) -> list:
    return [] if values is None else list(values)


def united(old, new) -> list[str]:
    return list(dict.fromkeys(t for v in [*items(old), *items(new)] if (t := clean(v))))


def progress_of(arc: dict) -> int:
    few = lambda n: min(10, 4 + 2 * n) if n else 0
    p = (12 if arc["trigger"] else 0) + min(42, 7 * len(arc["stages"])) + (16 if arc["outcome"] else 0) + few(len(arc["entities"])) + few(len(arc["relations"]))
    return min(96, max(p, 90) if arc["status"] == "broadly_complete" else p)


class Board:
    """One run's arcs and hypotheses, in the order of their numbers."""

    def __init__(self, run: int, rows: list[dict]):
        self.run = run
        for row in rows:
            row |= {c: list(row[c]) for c in ("stages", "entities", "relations", "evidence")}
        by = lambda kind: {r["title"].lower(): r for r in sorted(rows, key=lambda r: r["n"]) if r["kind"] == kind}
        self.arcs, self.hypotheses = by("arc"), by("hypothesis")
        self.own = next((r for r in rows if r["kind"] == "run"), None) or self._row("run", "", -1, "", 0)

    def _row(self, kind: str, id_: str, n: int, title: str, step: int) -> dict:
        return {"run": self.run, "kind": kind, "id": id_, "n": n, "title": title, "opportunity": 0.0, "status": "", "progress": 0, "trigger": "", "outcome": "", "stages": [], "entities": [], "relations": [], "evidence": [], "last": 0, "updated": step}

    def _new(self, kind: str, prefix: str, title: str, step: int, artifact) -> dict:
        held = self.arcs if kind == "arc" else self.hypotheses
        # Nothing is ever taken from a board, so its size is the counter.
        row = self._row(kind, f"{prefix}-{len(held) + 1}", len(held) + 1, title, step)
        row["evidence"] = [artifact] if artifact else []
        held[title.lower()] = row
        return row

    def seed(self, seed, step: int, artifact, admitted: bool = False) -> None:
        title = clean(seed["title"])
        key, confidence = title.lower(), clamp(seed["confidence"])
        if not title or seed["qualifies"] is None:
            return
        arc = self.arcs.get(key)
        if seed["qualifies"] or admitted:
            if arc:
                arc["opportunity"] = max(arc["opportunity"], confidence)
                return
            arc = self._new("arc", "arc", title, step, artifact)
            arc["status"], arc["opportunity"] = "forming", max(NEW_LEAST, confidence)
            if key in self.hypotheses:
                self.hypotheses[key]["status"] = "admitted"
        elif not arc:
            held = self.hypotheses.get(key)
            if held is None:
                held = self._new("hypothesis", "hyp", title, step, None)
                held["status"], held["opportunity"] = "hypothesis", confidence
            else:
                held["opportunity"] = max(held["opportunity"], confidence)
                held["updated"] = step
            if artifact and artifact not in held["evidence"]:
                held["evidence"] = [*held["evidence"], artifact][-HYPOTHESIS_EVIDENCE:]

    def judge(self, verdict, step: int, artifact) -> None:
        held = self.hypotheses.get(clean(verdict["title"]).lower())
        if held is None or held["status"] != "hypothesis":
            return
        if verdict["confidence"] is not None:
            held["opportunity"] = clamp(verdict["confidence"])
        held["updated"] = step
        if verdict["decision"] == "reject":
            held["status"] = "rejected"
        elif verdict["decision"] == "admit":
            held["status"] = "admitted"
            self.seed({"title": held["title"], "qualifies": True, "confidence": held["opportunity"]}, step, artifact, admitted=True)

    def evidence_arc(self, tick, step: int) -> dict | None:
        best = clean(tick["best"])
        fits = [(fit_score(f), arc) for f in items(tick["fits"]) if (arc := self.arcs.get(clean(f["title"]).lower()))]
        named = self.arcs.get(best.lower())
        if named and any(arc is named and s >= FIT_LEAST for s, arc in fits):
            return named
        top = max(fits, key=lambda x: x[0], default=None)
        if top and top[0] >= FIT_LEAST:
            return top[1]
        if best.upper() == "NEW":
            first = next((clean(s["title"]).lower() for s in items(tick["seeds"]) if s["qualifies"]), "")
            return self.arcs.get(first)
        return None

    def take(self, arc: dict, tick, step: int) -> None:
        for text in ("trigger", "outcome"):
            arc[text] = clean(tick[text]) or arc[text]
        for lists in ("stages", "entities", "relations"):
            arc[lists] = united(arc[lists], tick[lists])
        if tick["status"] in ("forming", "broadly_complete", "unresolved"):
            arc["status"] = tick["status"]
        if tick["artifact"] and tick["artifact"] not in arc["evidence"]:
            arc["evidence"] = [*arc["evidence"], tick["artifact"]][-ARC_EVIDENCE:]
        arc["updated"], arc["progress"] = step, max(arc["progress"], progress_of(arc))

    def choose(self, preferred: dict | None, step: int) -> None:
        active = next((a for a in self.arcs.values() if a["id"] == self.own["id"]), None)
        preferred = preferred or active
        ranked = []
        for arc in self.arcs.values():
            if arc["status"] == "broadly_complete" and arc["opportunity"] < COMPLETE_LEAST:
                continue
            priority = arc["opportunity"] + min(WAIT_MOST, WAIT_GAIN * max(0, step - arc["last"]))
            if priority >= RUN_LEAST or arc is preferred:
                ranked.append((-priority, arc["last"], arc["n"], arc))
        chosen = min(ranked, key=lambda x: x[:3])[3] if ranked else preferred
        self.own["id"] = chosen["id"] if chosen else ""
        if chosen:
            chosen["last"] = step

    def consume(self, tick) -> None:
        step, artifact, seen = int(tick["step"]), tick["artifact"], set()
        for fit in items(tick["fits"]):
            arc = self.arcs.get(clean(fit["title"]).lower())
            if arc:
                seen.add(arc["id"])
                arc["opportunity"] = max(arc["opportunity"] * SEEN_DECAY, fit_score(fit))
        for arc in self.arcs.values():
            if arc["id"] not in seen:
                arc["opportunity"] *= UNSEEN_DECAY
        for verdict in items(tick["verdicts"]):
            self.judge(verdict, step, artifact)
        for seed in items(tick["seeds"]):
            self.seed(seed, step, artifact)
        for candidate in items(tick["candidates"]):
            arc = self.arcs.get(clean(candidate["title"]).lower())
            if arc:
                arc["opportunity"] = max(arc["opportunity"], fit_score(candidate))
        arc = self.evidence_arc(tick, step)
        if arc:
            self.take(arc, tick, step)
        self.choose(arc, step)
        self.own["n"], self.own["updated"] = int(tick["seq"]), step

    def rows(self) -> list[dict]:
        return [*self.arcs.values(), *self.hypotheses.values(), self.own]


_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def ticked(state: DataFrame, ticks: DataFrame) -> DataFrame:
    """The state of all runs after some ticks.  A tick that a run has seen (its ``seq``
    isn't beyond the run's last) is passed over, so ticks may repeat.  state: ``STATE``; ticks:
    ``TICK``; a null run is dropped."""

    def fold(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        board = Board(int(key[0]), old.to_dict("records"))
        for tick in new.sort_values("seq").to_dict("records"):
            if tick["seq"] > board.own["n"]:
                board.consume(tick)
        return pd.DataFrame(board.rows(), columns=_COLUMNS)

    known = ticks.where("run IS NOT NULL AND seq IS NOT NULL AND step IS NOT NULL")
    return state.groupBy("run").cogroup(known.groupBy("run")).applyInPandas(fold, STATE)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The batches whose versions are committed, in order."""
    names = (n for n, is_dir in entries(spark, folder) if is_dir and n.startswith("batch-")) if exists(spark, folder) else ()
    return sorted(int(n[6:]) for n in names if n[6:].isdigit() and exists(spark, f"{folder}/{n}/_SUCCESS"))


def read_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The newest version (of the batches before one, if given); empty without one."""
    known = [v for v in versions(spark, folder) if before is None or v < before]
    return spark.read.schema(STATE).parquet(f"{folder}/batch-{known[-1]:09d}") if known else spark.createDataFrame([], STATE)


def upsert(ticks: DataFrame, batch: int, folder: str) -> bool:
    """Put a batch into the table; False if its version is there already."""
    spark = ticks.sparkSession
    if batch in versions(spark, folder):
        return False
    ticked(read_state(spark, folder, batch), ticks).write.mode("overwrite").parquet(f"{folder}/batch-{batch:09d}")
    return True


def consume(ticks: DataFrame, folder: str, checkpoint: str):
    """Run a stream of ticks into the table until all there is was taken."""
    query = ticks.writeStream.foreachBatch(lambda rows, number: upsert(rows, number, folder) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
