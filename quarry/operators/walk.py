"""The guided walk over a semantic map, and evidence packets for scorers.

The walk's state is small (one question, a few dozen nodes), so it lives on the driver; the
map's adjacency is read once per node through filters on the edge table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPANSIONS = 8
#: A node with more edges is no place to walk through: an error says so.
WIDEST = 10_000


@dataclass
class Walk:
    """One current node; nodes seen but not expanded stay open; visited ones never reopen."""

    edges: DataFrame  # src, dst, relation
    visited: list[str] = field(default_factory=list)
    open: dict[str, str] = field(default_factory=dict)  # node: where it was seen
    kept: list[tuple] = field(default_factory=list)  # evidence shown on visited nodes
    current: str = ""

    def expand(self, node: str) -> list[tuple]:
        """Make a node current and open its neighbours in either direction."""
        if node in self.visited:
            raise ValueError(f"{node} was visited")
        self.open.pop(node, None)
        self.current = node
        self.visited.append(node)
        rows = sorted(map(tuple, self.edges.where((F.col("src") == node) | (F.col("dst") == node)).select("src", "relation", "dst").distinct().limit(WIDEST + 1).collect()))
        if len(rows) > WIDEST:
            raise ValueError(f"{node} has over {WIDEST} edges")
        self.kept += [r for r in rows if r not in self.kept]
        for a, _, b in rows:
            other = b if a == node else a
            if other not in self.visited:
                self.open.setdefault(other, node)
        return rows

    def next(self, wished: list[str]) -> str:
        """The first wish that is open; empty if none is."""
        return next((w for w in wished if w in self.open), "")


def investigate(edges: DataFrame, start: str, judge) -> Walk:
    """Walk until the judge (a function of the walk: wished nodes, or none to answer) is
    content, nothing is open, or the expansions are used up."""
    walk = Walk(edges)
    walk.expand(start)
    for _ in range(EXPANSIONS):
        node = walk.next(judge(walk) or [])
        if not node:
            break
        walk.expand(node)
    return walk


#: An evidence packet.
PACKET = (
    "phase string, currentEvidence struct<artifactId:string,artifactType:string,canonicalContent:string,provenance:string>, "
    "neighbours array<struct<artifactId:string,relation:string,signature:string>>, "
    "arcs array<struct<arcId:string,title:string,arcType:string,actor:string,goal:string,steps:array<string>,entities:array<string>,persistedObjects:array<string>,outcome:string,compactEvidenceSummary:string>>, "
    "recentPath array<string>"
)


def _cut(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def _few(a: Column, n: int, each: int) -> Column:
    return F.transform(F.slice(F.coalesce(a, F.array().cast("array<string>")), 1, n), lambda x: _cut(x, each))


def packets(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packets, rejects): texts and lists within their bounds; lists are cut first and
    blank ids dropped after; a packet without a current artifact is rejected."""
    e = F.col("currentEvidence")
    evidence = F.struct(_cut(e.artifactId, 1000).alias("artifactId"), _cut(e.artifactType, 120).alias("artifactType"), F.coalesce(e.canonicalContent, F.lit("")).alias("canonicalContent"), _cut(e.provenance, 4000).alias("provenance"))
    near = F.filter(
        F.transform(F.slice("neighbours", 1, 250), lambda n: F.struct(_cut(n.artifactId, 1000).alias("artifactId"), _cut(n.relation, 120).alias("relation"), _cut(n.signature, 4000).alias("signature"))),
        lambda n: n.artifactId != "",
    )
    arcs = F.filter(
        F.transform(
            F.slice("arcs", 1, 100),
            lambda a: F.struct(
                _cut(a.arcId, 1000).alias("arcId"),
                _cut(a.title, 500).alias("title"),
                F.when(a.arcType == "technical", "technical").otherwise("business").alias("arcType"),
                _cut(a.actor, 1000).alias("actor"),
                _cut(a.goal, 2000).alias("goal"),
                _few(a.steps, 100, 2000).alias("steps"),
                _few(a.entities, 100, 1000).alias("entities"),
                _few(a.persistedObjects, 100, 1000).alias("persistedObjects"),
                _cut(a.outcome, 2000).alias("outcome"),
                _cut(a.compactEvidenceSummary, 6000).alias("compactEvidenceSummary"),
            ),
        ),
        lambda a: a.arcId != "",
    )
    phase = F.when(F.col("phase").isin("scout", "pass1", "pass2"), F.col("phase")).otherwise("scout")
    out = raw.select(phase.alias("phase"), evidence.alias("currentEvidence"), F.coalesce(near, F.array()).alias("neighbours"), F.coalesce(arcs, F.array()).alias("arcs"), _few(F.col("recentPath"), 100, 1000).alias("recentPath"))
    ok = out.currentEvidence.artifactId != ""
    return out.where(ok), out.where(~ok)
