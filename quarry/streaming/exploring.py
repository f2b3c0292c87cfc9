"""The exploration loop as keyed streaming state: each step sees what the step before left.

A run walks its topology.  It observes an artifact, puts that one's unvisited neighbours behind
its frontier, applies a judgment, and resolves where the judgment wants to go; that choice is
the next observation, so steps can't be computed apart.  Judgments arrive as a stream keyed by
run; what a run knows stays in the state store: its topology in a map, its frontier in a list,
its position, visits and branches in a value.  A restart from the checkpoint goes on where the
last finished batch left each run.

Judgments of a run come in order of ``seq``, over batches as well.  Runs without a topology give
no rows; judgments after a run's end are dropped; null branches and wishes count as none; ties
go to neighbours of the observed artifact, then to the least id.
"""

from __future__ import annotations

import heapq
import zlib

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Steps of a run, and how much of its frontier it keeps.
STEPS, FRONTIER = 60, 120
#: Links of a run's topology that are read from the state at once.
BUCKET = 1000

OUTPUT = "run long, seq long, step int, observed string, frontier int, candidates int, next string, status string"


def use_rocksdb(spark: SparkSession) -> None:
    """Arbitrary keyed state lives in RocksDB, whose snapshots go to the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def topology(edges: DataFrame, roots: DataFrame, hits: DataFrame, per_bucket: int = BUCKET) -> DataFrame:
    """What runs walk, as the loop's initial state: (run, bucket, buckets, artifacts, ids,
    priorities), a link per place of the arrays.  An artifact links to its neighbours, a search's
    hits are the neighbours of ``search:<query>``, and the root is that of the empty name; each
    neighbour counts once, with its highest priority.  An artifact's links are in the bucket that
    its name hashes to; a run has as many buckets as keep some ``per_bucket`` links in each.
    edges: run, src, dst, priority; roots: run, id; hits: run, query, id, priority."""
    rows = edges.select("run", F.col("src").alias("artifact"), F.col("dst").alias("id"), "priority")
    rows = rows.unionByName(roots.select("run", F.lit("").alias("artifact"), "id", F.lit(0.0).alias("priority")))
    rows = rows.unionByName(hits.select("run", F.concat(F.lit("search:"), "query").alias("artifact"), "id", "priority"))
    best = rows.where("run IS NOT NULL AND artifact IS NOT NULL AND id IS NOT NULL").groupBy("run", "artifact", "id").agg(F.max(F.coalesce("priority", F.lit(0.0))).alias("priority"))
    sizes = best.groupBy("run").agg(F.ceil(F.count("*") / per_bucket).cast("long").alias("buckets"))
    dealt = best.join(sizes, "run").withColumn("bucket", F.crc32("artifact") % F.col("buckets"))
    listed = dealt.groupBy("run", "bucket", "buckets").agg(F.array_sort(F.collect_list(F.struct("artifact", "id", "priority"))).alias("n"))
    return listed.select("run", "bucket", "buckets", F.col("n.artifact").alias("artifacts"), F.col("n.id").alias("ids"), F.col("n.priority").alias("priorities"))


class Explorer(StatefulProcessor):
    def __init__(self, steps: int = STEPS, keep: int = FRONTIER):
        self.steps, self.keep = steps, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.near = handle.getMapState("topology", "bucket long", "buckets long, artifacts array<string>, ids array<string>, priorities array<double>")
        self.frontier = handle.getListState("frontier", "id string, priority double")
        self.run = handle.getValueState("run", "step int, current string, over boolean, visited array<string>, stories array<string>, branches array<string>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState
        self.near.updateValue((row.bucket,), (row.buckets, list(row.artifacts), list(row.ids), list(row.priorities)))

    def _load(self, bucket: int) -> int:
        """Read a bucket, once a batch; how many there are."""
        if bucket not in self.read:
            found = self.near.getValue((bucket,))
            self.read[bucket] = {}
            for artifact, i, priority in zip(*found[1:4]) if found else ():
                self.read[bucket].setdefault(artifact, []).append((i, priority))
            self.buckets = found[0] if found else self.buckets
        return self.buckets

    def _of(self, artifact: str) -> list[tuple[str, float]]:
        # The first bucket to be read tells how many there are; the empty name is in bucket 0.
        bucket = zlib.crc32(artifact.encode()) % max(1, self._load(0))
        self._load(bucket)
        return self.read[bucket].get(artifact, [])

    def _merge(self, frontier: list, items: list, visited: set) -> list:
        known = {i for i, _ in frontier}
        return [*frontier, *(x for x in items if x[0] not in known and x[0] not in visited)][-self.keep :]

    def _resolve(self, said: Row, frontier: list, near: list, visited: set):
        """(next artifact or None, frontier)."""
        best = lambda items: min(items, key=lambda x: (-x[1], x[0]), default=None)
        if said.next_type == "stop":
            return None, frontier
        wish = None
        if said.next_type == "search" and said.next_id is not None:
            hits = self._of(f"search:{said.next_id}")
            frontier = self._merge(frontier, hits, visited)
            wish = best([x for x in hits if x[0] not in visited])
        elif said.next_type == "artifact":
            wish = next((x for x in frontier if x[0] == said.next_id and x[0] not in visited), None)
        if wish is None:
            local = {i for i, _ in near}
            here = best([x for x in near if x[0] not in visited])
            far = best([x for x in frontier if x[0] not in visited and x[0] not in local])
            wish = far if here is None or (far is not None and far[1] > here[1]) else here
        if wish is None:
            return None, frontier
        return wish[0], [x for x in frontier if x[0] != wish[0]]

    def handleInputRows(self, key, rows, timerValues):
        self.read: dict[int, dict] = {}
        self.buckets = 0
        state = self.run.get()
        if state is None:
            root = self._of("")
            if not root:
                return
            step, current, over, visited, branches = 0, root[0][0], False, [], set()
            frontier: list = self._merge([], self._of(current), set())
        else:
            step, current, over, visited = state[0], state[1], state[2], list(state[3])
            branches = set(zip(state[4], state[5]))
            if over:
                return
            frontier = [(x[0], x[1]) for x in self.frontier.get()]
        # No more judgments than the steps left can count.
        for said in heapq.nsmallest(self.steps - step, rows, key=lambda r: r.seq):
            step += 1
            if current not in visited:
                visited.append(current)
            seen, near = set(visited), self._of(current)
            frontier = self._merge(frontier, near, seen)
            offered = {i for i, _ in [*near, *frontier] if i not in seen}
            if said.branch is not None:
                (branches.discard if said.branch_status in ("closed", "bounded") else branches.add)((said.story, said.branch))
            target = None
            if said.closes and not any(s == said.story for s, _ in branches):
                status, over = "closed", True
            else:
                target, frontier = self._resolve(said, frontier, near, seen)
                status = "no_frontier" if target is None else "budget_exhausted" if step == self.steps else "exploring"
                over = status != "exploring"
            yield Row(run=key[0], seq=said.seq, step=step, observed=current, frontier=len(frontier), candidates=len(offered), next=target, status=status)
            if over:
                break
            current = target
        still = sorted(branches, key=repr)
        self.run.update((step, current, over, visited, [s for s, _ in still], [b for _, b in still]))
        if frontier and not over:
            self.frontier.put(frontier)
        else:
            self.frontier.clear()


def explored(judgments: DataFrame, start: DataFrame, steps: int = STEPS, keep: int = FRONTIER) -> DataFrame:
    """A row per step that a run takes (``OUTPUT``).  judgments, a stream: run, seq, story,
    branch, branch_status, closes, next_type (search, artifact, stop or other), next_id;
    start: as ``topology`` gives."""
    use_rocksdb(judgments.sparkSession)
    return judgments.groupBy("run").transformWithState(Explorer(steps, keep), OUTPUT, "append", "None", initialState=start.groupBy("run"))


class Allocator(StatefulProcessor):
    """Numbers of things in the order in which a run first names them: they never move, since
    a thing's number stays in the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long")
        self.numbers = handle.getMapState("numbers", "name string", "n long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.numbers.updateValue((initialState.name,), (initialState.n,))
        now = self.last.get()[0] if self.last.exists() else 0
        self.last.update((max(now, initialState.n),))

    def handleInputRows(self, key, rows, timerValues):
        first: dict[str, int] = {}
        for r in rows:
            if r.name is not None and not (r.name in first and first[r.name] <= r.seq):
                first[r.name] = r.seq
        n = self.last.get()[0] if self.last.exists() else 0
        for name, seq in sorted(first.items(), key=lambda x: (x[1], x[0])):
            if not self.numbers.containsKey((name,)):
                n += 1
                self.numbers.updateValue((name,), (n,))
                yield Row(run=key[0], name=name, seq=seq, n=n)
        if n:
            self.last.update((n,))


def allocated(named: DataFrame, earlier: DataFrame) -> DataFrame:
    """(run, name, seq, n) of each name's first place in a run: n goes on from the run's highest
    number, names known from ``earlier`` keep theirs and give no row.  Ties of seq go to the
    lesser name, null names have no number.
    named, a stream: run, seq, name; earlier: run, name, n."""
    use_rocksdb(named.sparkSession)
    return named.groupBy("run").transformWithState(Allocator(), "run long, name string, seq long, n long", "append", "None", initialState=earlier.groupBy("run"))


def run_to_files(df: DataFrame, path: str, checkpoint: str):
    """Process all that there is into a folder of Parquet files that holds each batch once."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
