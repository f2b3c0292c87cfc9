"""Quality rules judged by an isolation forest.

Every document gets the base statistics of the rules and ratios made of them.  A tree splits
its own draw of the labelled rows, nearly all good, at random until rows stand alone; a row that few
splits isolate is anomalous.  An isolation forest's trees take few rows each by definition, so that
odd ones stand alone; all labelled rows can be drawn, each as likely as any other of its kind.
The threshold on the score is set on all labelled rows, good and bad, each scored by a forest
that never saw it: of the thresholds that may keep ``keep`` of all good rows, as far as so many
labels can tell, that with the best balanced accuracy.  Scores are counted in Spark, by ranges.

``grown``, ``cross_scores`` and ``calibrate`` do the same to rows in memory.

Edge cases: null and empty texts have no words and fail the base rule; equal texts get
equal verdicts; very long texts are read whole; with fewer than eight labelled good rows
nothing is anomalous and the base rule alone decides; other columns pass through or are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import textstats
from quarry.llm.bpe import slices
from quarry.llm.sample import every_labelled
from quarry.runtime import bound_batches, materialise

#: The signs counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Code points judged at a time.
SLICE = 1 << 20
#: Rows that a tree takes at most.
ROWS = 512
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "sign_ratio", "single_ratio", "same_neighbour_ratio")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: symbol, upper case, neither letter nor number."""
    symbol = np.zeros(0x110000, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    upper = np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)
    sign = ~np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000) & ~textstats.separators()
    return symbol, upper, sign


def statistics(texts: list[str]) -> np.ndarray:
    """A row per text: BASE, then what FEATURES need besides."""
    n = len(texts)
    cp, stops = textstats.join(texts)
    starts, ends, hashes = textstats.words(cp)
    owner = np.searchsorted(stops, starts, "right")
    count = lambda of, weights=None: np.bincount(of, weights=weights, minlength=n)
    n_words, word_chars = count(owner), count(owner, ends - starts)
    symbol, upper, sign = _tables()
    hits = lambda t: count(np.searchsorted(stops, np.flatnonzero(t[cp]), "right"))
    # Lines: each ends at a line feed; one that equals an earlier line of its text counts.
    feeds = np.flatnonzero(cp == 0x0A)
    begins = np.concatenate([[0], feeds[:-1] + 1])
    has_word = np.searchsorted(starts, feeds) > np.searchsorted(starts, begins)
    begins, feeds = begins[has_word], feeds[has_word]
    of_line = np.searchsorted(stops, begins, "right")
    line_keys = textstats.mix(textstats.span_hashes(cp, begins, feeds) + of_line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    dup_lines = count(of_line, pd.Series(line_keys).duplicated().to_numpy())
    # Windows of three words within one text, found twice or more there.
    repeat = np.zeros(len(hashes), bool)
    keys = textstats.window_hashes(hashes, 3)
    if len(keys):
        whole = owner[:-2] == owner[2:]
        keys = textstats.mix(keys + owner[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        again = np.zeros(len(keys), bool)
        again[whole] = pd.Series(keys[whole]).duplicated(keep=False).to_numpy()
        for k in range(3):
            repeat[k : k + len(again)] |= again
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    return np.column_stack([n_words, word_chars, hits(symbol), dup_lines, count(owner, repeat), count(of_line), hits(upper), hits(sign), count(owner, ends - starts == 1), count(owner, same)]).astype(np.float64)


def features(s: np.ndarray) -> np.ndarray:
    n, chars, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1), np.maximum(s[:, 5], 1)
    return np.column_stack([np.log1p(s[:, 0]), s[:, 1] / n, s[:, 2] / n, s[:, 3] / lines, s[:, 4] / n, s[:, 6] / chars, s[:, 7] / chars, s[:, 8] / n, s[:, 9] / n])


def base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < 50) | (100 * s[:, 4] > 50 * s[:, 0])


def _usual_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a random tree over n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grown_tree(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A row per node of a tree over all rows of x: feature (-1: leaf), cut, children, path length."""
    deepest = max(1, int(np.ceil(np.log2(max(2, len(x))))) + 2)
    nodes: list[list[float]] = []

    def grow(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + _usual_path(len(part))])
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 and depth < deepest else []
        if len(spread):
            f = int(rng.choice(spread))
            cut = rng.uniform(part[:, f].min(), part[:, f].max())
            left = part[:, f] < cut
            nodes[at][0], nodes[at][1] = f, cut
            nodes[at][2] = grow(part[left], depth + 1)
            nodes[at][3] = grow(part[~left], depth + 1)
        return at

    grow(x, 0)
    return np.array(nodes)


def tree_of(nodes: np.ndarray) -> tuple[np.ndarray, ...]:
    return nodes[:, 0].astype(np.int64), nodes[:, 1], nodes[:, 2:4].astype(np.int64), nodes[:, 4]


@dataclass
class IsolationForest:
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    rows: int = 0

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 128, rows: int = ROWS, seed: int = 7) -> "IsolationForest":
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        return cls([tree_of(grown_tree(x[rng.choice(len(x), rows, replace=False)], rng)) for _ in range(trees if len(x) > 1 else 0)], rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1]: the higher, the shorter the paths that isolate a row."""
        if not self.trees:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, child, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                r, node = rows[inner], at[inner]
                at[inner] = child[node, (x[r, feature[node]] >= cut[node]).astype(np.int64)]
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(_usual_path(self.rows), 1e-9))


@dataclass
class Model:
    forest: IsolationForest
    threshold: float

    def anomalous(self, s: np.ndarray) -> np.ndarray:
        return self.forest.score(features(s)) > self.threshold


def most_rejected(n: int, keep: float, level: float = 0.95) -> int:
    """So many of ``n`` good rows may fall beyond a threshold that keeps ``keep`` of all of them:
    the ``level`` quantile of a binomial.  One odd row among few says little about its share."""
    mean = n * (1 - keep)
    # Far beyond the quantile nothing is left to add up.
    at = np.arange(1, min(n, int(mean + 20 * mean**0.5 + 50)) + 1)
    odds = np.log(max(1 - keep, 1e-300)) - np.log(max(keep, 1e-300))
    logs = n * np.log(max(keep, 1e-300)) + np.concatenate([[0.0], np.cumsum(np.log(n - at + 1) - np.log(at) + odds)])
    return min(int(np.searchsorted(np.cumsum(np.exp(logs)), level)), max(0, n - 1))


def calibrate(good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """The threshold with the best balanced accuracy that may keep ``keep`` of the good rows."""
    if not len(good):
        return 1.0
    least = float(np.sort(good)[len(good) - 1 - most_rejected(len(good), keep)])
    if not len(bad):
        # Nothing is gained by rejecting a good row.
        return float(good.max())
    cuts = np.unique(np.concatenate([[least], good[good >= least], bad[bad >= least]]))
    gain = [(good <= c).mean() + (bad > c).mean() for c in cuts]
    return float(cuts[int(np.argmax(gain))])


def grown(x: np.ndarray, fine: np.ndarray, rest: np.ndarray, contamination: float, seed: int, rows: int = ROWS) -> IsolationForest:
    """A forest over the rows ``fine`` of x and so many of ``rest`` as make ``contamination``."""
    few = rest[: max(1, round(contamination * len(fine)))]
    return IsolationForest.fit(x[np.concatenate([fine, few])], rows=rows, seed=seed)


def per_tree(good: int, folds: int) -> int:
    """Rows of a tree, so many as the smallest fold's forest has too."""
    return max(2, min(ROWS, good - -(-good // folds)))


def cross_scores(x: np.ndarray, fine: np.ndarray, rest: np.ndarray, contamination: float, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """The scores of both kinds of rows, each by a forest of the other folds; every tree takes
    as many rows as a whole forest's would (``per_tree``), or scores weren't on one scale."""
    rows_each = per_tree(len(fine), folds)
    out = np.zeros(len(fine)), np.zeros(len(rest))
    for k in range(folds):
        learn = [rows[np.arange(len(rows)) % folds != k] for rows in (fine, rest)]
        forest = grown(x, *learn, contamination, 8 + k, rows_each)
        for scores, rows in zip(out, (fine, rest)):
            if len(rows[k::folds]):
                scores[k::folds] = forest.score(x[rows[k::folds]])
    return out


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, good, x) of all labelled documents that pass the base rule: a hash of the id, and the features."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE):
                s = statistics(texts)
                some = np.flatnonzero(~base_failed(s))
                of = pa.array(some + part.start)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("y").take(of), pa.array(features(s[some]).tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    # An id with several texts counts once.
    rows = every_labelled(docs, labels, "quality").mapInArrow(run, "doc_id long, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    return materialise(rows.where("y IN (0, 1)").select(F.xxhash64("doc_id").alias("key"), (F.col("y") == 1).alias("good"), "x"), "measured")


def forests(rows: DataFrame, fine: np.ndarray, rest: np.ndarray, contamination: float, trees: int) -> list[IsolationForest]:
    """A forest for each fold that doesn't see its rows, and the last for all rows; rows: (key,
    good, x).  ``fine`` and ``rest`` count the folds' good and bad rows.

    Trees are grown in Spark.  Each draws the rows whose hashes with its number are least, as
    many for every forest, or scores weren't on one scale."""
    folds = len(fine)
    each = max(2, min(ROWS, int(fine.sum() - fine.max())))
    # So many of a kind can a forest draw from; ``contamination`` of the good ones' number are bad.
    pool = {True: np.append(fine.sum() - fine, fine.sum()), False: np.append(rest.sum() - rest, rest.sum())}
    bad = np.minimum(pool[False], max(1, round(contamination / (1 + contamination) * each)))
    quota = {True: np.minimum(pool[True], each - bad), False: bad}
    # A draw's bound lies so far above its share that too few rows are next to impossible.
    bound = {kind: np.minimum(1.0, (quota[kind] + 8 * np.sqrt(quota[kind]) + 8) / np.maximum(1, pool[kind])) for kind in quota}
    numbers = np.arange((folds + 1) * trees)
    seeds = textstats.mix((numbers + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    of = numbers // trees

    def drawn(batches):
        held: list[tuple] = []

        def out():
            tree, lot, good, x = (np.concatenate(c) for c in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(tree), pa.array(lot), pa.array(good), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["tree", "lot", "good", "x"])

        for batch in batches:
            for key, good, x in zip(*(batch.column(c).to_pylist() for c in ("key", "good", "x"))):
                lot = (textstats.mix(seeds ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)) / 2.0**53
                some = np.flatnonzero((lot < bound[good][of]) & (of != key % folds))
                held.append((some, lot[some], np.full(len(some), good), np.tile(x, (len(some), 1))))
                if len(held) >= 64:
                    yield out()
        if held:
            yield out()

    def grow(key, part):
        tree = int(key[0])
        part = part.sort_values("lot", kind="stable")
        least = [part[part["good"] == kind].head(int(quota[kind][tree // trees])) for kind in (True, False)]
        nodes = grown_tree(np.array(pd.concat(least)["x"].tolist()), np.random.default_rng(tree))
        return pd.DataFrame({"tree": [tree], "nodes": [nodes.ravel().tolist()]})

    got = rows.mapInArrow(drawn, "tree long, lot double, good boolean, x array<double>").groupBy("tree").applyInPandas(grow, "tree long, nodes array<double>").collect()
    by = {r.tree: tree_of(np.array(r.nodes).reshape(-1, 5)) for r in got}
    return [IsolationForest([by[k] for k in numbers[of == f]], each) for f in range(folds + 1)]


def threshold(scores: DataFrame, keep: float) -> float:
    """What ``calibrate`` gives, of (score, good) in Spark: rows are counted by score, counts added
    up by ranges of it."""
    counts = scores.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counts = materialise(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    # A row per partition.
    sums = counts.groupBy("part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("g", "b")))
    good, bad = counts.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not good:
        return 1.0
    upto = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    sure = counts.join(F.broadcast(before), "part").select("score", (F.col("g") + F.sum("good").over(upto)).alias("g"), (F.col("b") + F.sum("bad").over(upto)).alias("b"), F.col("good").alias("here"))
    if not bad:
        return sure.where("here > 0").agg(F.max("score")).first()[0]
    gain = F.col("g") / good + (bad - F.col("b")) / bad
    best = F.struct(gain.alias("gain"), (-F.col("score")).alias("score"))
    return -sure.where(F.col("g") >= good - most_rejected(good, keep)).agg(F.max(best).alias("best")).first().best.score


def fit(docs: DataFrame, labels: DataFrame, keep: float = 0.995, contamination: float = 0.02, folds: int = 4, trees: int = 128) -> Model:
    """Fit on all labelled rows.

    The threshold is set on the scores that forests of the other folds give, the model's own
    forest draws from all rows.  Forests see so many bad rows as make ``contamination`` of
    the good ones: without any, ratios that are always 0 in good text would never be split on."""
    rows = measured(docs, labels)
    fold = F.expr(f"pmod(key, {folds})")
    sizes = {(r.good, r.fold): r["count"] for r in rows.groupBy("good", fold.alias("fold")).count().collect()}
    fine, rest = (np.array([sizes.get((kind, k), 0) for k in range(folds)]) for kind in (True, False))
    if fine.sum() < 2 * folds:
        return Model(IsolationForest.fit(np.zeros((0, len(FEATURES)))), 1.0)
    *others, whole = forests(rows, fine, rest, contamination, trees)

    def run(batches):
        for batch in batches:
            x, of = np.array(batch.column("x").to_pylist()).reshape(-1, len(FEATURES)), batch.column("key").to_numpy() % folds
            score = np.zeros(len(x))
            for k in range(folds):
                score[of == k] = others[k].score(x[of == k])
            yield pa.RecordBatch.from_arrays([pa.array(score), batch.column("good")], names=["score", "good"])

    return Model(whole, threshold(rows.mapInArrow(run, "score double, good boolean"), keep))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Per document the base statistics and the verdict."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE):
                s = statistics(texts)
                failed = base_failed(s)
                score = model.forest.score(features(s))
                columns = [pa.array(s[:, k].astype(np.int64)) for k in range(len(BASE))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part.start : part.stop], *columns, pa.array(failed), pa.array(~failed & (score <= model.threshold)), pa.array(score)], names=["doc_id", *BASE, "base_failed", "kept", "anomaly"])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return typed.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, anomaly double")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents kept, with all their columns, in one narrow pass."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            keep = []
            for _, texts in slices(batch, "text", SLICE):
                s = statistics(texts)
                keep.append(~base_failed(s) & ~model.anomalous(s))
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
