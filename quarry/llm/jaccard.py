"""Near-duplicate join on word n-grams with Bayesian candidate pruning.

A document is its set of ``words``-word shingles (a shorter text: all its words as one).
Documents with equal sets form a class, and one of each class goes on.  Classes that agree
in a band of MinHash values are candidates.  A candidate pair's MinHash values are compared
a few at a time; with a uniform prior the similarity's posterior is a beta distribution,
and the pair is dropped once the probability of reaching the threshold falls below the
tolerance.  Pairs that survive are verified exactly on their sets.

Buckets of up to ``SMALL`` classes emit pairs.  Larger ones (big groups of near copies, or
a passage that many documents share) emit a star instead; the stars' components are cut
into blocks, and every pair of blocks is compared inside one task that returns counts and
a spanning forest, never the pairs.  So rows stay proportional to the documents while no
link is lost to a cap.

Classes carry numbers of their own, so ids may be null or repeat.  A document is a pair of
id and text: rows that repeat both share a verdict, and ``keep_one`` keeps one of them; rows
that share an id but not the text are judged apart.  A group's class_id is its least id, null
ids last (so it is null only if all are); kept is the document of that id, of the least text
hash where several have it.

Edge cases: null and empty texts have no words, link with nothing and stand alone, each row
kept; equal texts are one class however many; every row counts in n_links; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textstats
from quarry.llm.bpe import slices
from quarry.llm.forest import unite
from quarry.operators.components import connected_components
from quarry.runtime import bound_batches, discard, materialise

HASHES, ROWS = 128, 4  # 32 bands of 4: a pair at 0.8 shares none with probability 5e-8
STEP = 16
SMALL = 32
BLOCK, BLOCK_BYTES = 384, 32 << 20
HEAVY = 10_000
BROADCAST_IDS = 1_000_000


@cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """By the number of values compared: the fewest matches with which a pair stays.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m)."""
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after the other, and their counts."""
    cp, stops = textstats.join(texts)
    starts, _, hashes = textstats.words(cp)
    owner = np.searchsorted(stops, starts, "right")
    n_words = np.bincount(owner, minlength=len(texts))
    keys = textstats.window_hashes(hashes, words)
    whole = owner[: len(keys)] == owner[words - 1 :] if len(keys) else np.zeros(0, bool)
    keys, of = keys[whole], owner[: len(whole)][whole]
    first = np.cumsum(n_words) - n_words
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(short):
        extra = np.array([textstats.window_hashes(hashes[first[k] : first[k] + n_words[k]], int(n_words[k]))[0] + np.uint64(n_words[k]) for k in short], np.uint64)
        keys, of = np.concatenate([keys, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        keys, of = keys[order], of[order]
    marked = textstats.mix(keys + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    once = ~pd.Series(marked).duplicated().to_numpy() if len(marked) else np.zeros(0, bool)
    return keys[once], np.bincount(of[once], minlength=len(texts))


def minhash(keys: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A row of HASHES 32-bit values per text; texts without shingles get zeros."""
    out = np.zeros((len(count), HASHES), np.uint32)
    full = np.flatnonzero(count)
    stops = np.cumsum(count[full])
    begin, k = 0, 0
    with np.errstate(over="ignore"):
        while k < len(full):
            upto = max(k + 1, int(np.searchsorted(stops, begin + (1 << 15), "right")))
            end = int(stops[upto - 1])
            part, at = keys[begin:end], (stops - count[full])[k:upto] - begin
            for j, a in enumerate(_multipliers()):
                out[full[k:upto], j] = np.minimum.reduceat(part * a, at) >> np.uint64(32)
            begin, k = end, upto
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, "text", 1 << 20):
                keys, count = shingle_sets(texts, words)
                sig = minhash(keys, count)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textstats.mix(keys + np.uint64(7)), dtype=np.uint64)])
                stops = np.cumsum(count)
                with np.errstate(over="ignore"):
                    whole = (total[stops] - total[stops - count]).view(np.int64)
                own = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("code"), pa.array(whole), pa.array(count), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "code", "set_hash", "n_shingles", "sig"])

    return docs.mapInArrow(run, "doc_id long, code long, set_hash long, n_shingles long, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(part.num_rows, HASHES // ROWS, ROWS).astype(np.uint64)
                key = np.zeros(sig.shape[:2], np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(ROWS):
                        key = textstats.mix(key * np.uint64(0x9DDFEA08EB382D69) + sig[:, :, k])
                    key = textstats.mix(key + np.arange(HASHES // ROWS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                rep = np.repeat(part.column("rep").to_numpy(zero_copy_only=False), HASHES // ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(rep)], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _bucket_pairs(bands: DataFrame) -> DataFrame:
    """(a, b, star): all pairs of small buckets; for others an edge from each to the first.
    Buckets stream by in order, at most SMALL + 1 held."""

    def run(batches):
        key, held, big = None, [], False
        a, b, star = [], [], []

        def leave():
            for i, x in enumerate(held if not big else ()):
                for y in held[i + 1 :]:
                    a.append(x), b.append(y), star.append(False)

        for batch in batches:
            keys, reps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rep"))
            edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(keys)]):
                if e - s == 1 and keys[s] != key and len(held) < 2:  # the usual case
                    key, held, big = keys[s], [int(reps[s])], False
                    continue
                if keys[s] != key:
                    leave()
                    key, held, big = keys[s], [], False
                for r in reps[s:e].tolist():
                    if big:
                        a.append(held[0]), b.append(r), star.append(True)
                    else:
                        held.append(r)
                        if len(held) > SMALL:
                            big = True
                            for x in held[1:]:
                                a.append(held[0]), b.append(x), star.append(True)
                            del held[1:]
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(star)], names=["a", "b", "star"])
                a, b, star = [], [], []
        leave()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(star)], names=["a", "b", "star"])

    return bands.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(run, "a long, b long, star boolean").distinct()


def surviving(left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which rows of two signature arrays stay after comparing them step by step."""
    need = least_matches(threshold, tolerance)
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        matches[alive] += (left[alive, n - STEP : n] == right[alive, n - STEP : n]).sum(axis=1)
        alive = alive[matches[alive] >= need[n]]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _prune(pairs: DataFrame, classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ok = surviving(_sigs(part.column("sa")), _sigs(part.column("sb")), threshold, tolerance)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    sides = pairs.join(classes.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(classes.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    return sides.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) of the documents named by (rep, doc_id, code); their texts alone move
    if those are many."""
    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, "text", 1 << 20):
                keys, count = shingle_sets(texts, words)
                stops = np.cumsum(count)
                sets = [np.sort(keys[a:b]).tobytes() for a, b in zip((stops - count).tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("rep")[rows.start : rows.stop], pa.array(sets, pa.binary())], names=["rep", "shingles"])

    few = needed.count() <= BROADCAST_IDS
    named = (F.broadcast(needed) if few else needed).select("rep", F.col("doc_id").alias("id"), F.col("code").alias("own"))
    own = docs.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("code") == F.col("own"))).select("rep", "text")
    return own.mapInArrow(run, "rep long, shingles binary").dropDuplicates(["rep"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            a, b = batch.column("ka"), batch.column("kb")
            ok = [jaccard(np.frombuffer(a[k].as_py(), np.uint64), np.frombuffer(b[k].as_py(), np.uint64)) >= threshold for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sides = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("ka")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("kb")), "b")
    return sides.select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as a product of incidence matrices over the shingles
    that both sides hold, a slice of them at a time."""
    la, lb = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(la, lb)
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for sets, every in ((left, la), (right, lb)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, every), max(0, len(shared) - 1))
        ok = shared[at] == every if len(shared) else np.zeros(len(every), bool)
        places.append((row[ok], at[ok]))
    for s in range(0, len(shared), 4096):
        width = min(4096, len(shared) - s)
        dense = []
        for (row, at), n in zip(places, (len(left), len(right))):
            m = np.zeros((n, width), np.float32)
            ok = (at >= s) & (at < s + width)
            m[row[ok], at[ok] - s] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def compare_blocks(ids, weight, sig, sets, side, same: bool, threshold: float, tolerance: float):
    """All pairs of two blocks (or within one): per row the weight of its partners, and the
    row of the least id that it hangs together with here."""
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    need = least_matches(threshold, tolerance)
    for a in range(0, len(left), 128):
        rows = left[a : a + 128]
        first = (sig[rows][:, None, :STEP] == sig[right][None, :, :STEP]).sum(axis=2) >= need[STEP]
        if same:
            first &= rows[:, None] < right[None, :]
        i, j = np.nonzero(first)
        ok = surviving(sig[rows[i]], sig[right[j]], threshold, tolerance) if len(i) else np.zeros(0, bool)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if len(i) > 256:
            ui, ci = np.unique(i, return_inverse=True)
            uj, cj = np.unique(j, return_inverse=True)
            both = _overlaps([sets[rows[x]] for x in ui], [sets[right[x]] for x in uj])[ci, cj]
            size = np.array([len(s) for s in sets])
            close = both / (size[rows[i]] + size[right[j]] - both) >= threshold
        else:
            close = np.array([jaccard(sets[rows[x]], sets[right[y]]) >= threshold for x, y in zip(i, j)])
        x, y = rows[i[close]], right[j[close]]
        np.add.at(links, x, weight[y])
        np.add.at(links, y, weight[x])
        unite(root, x, y)
    return links, root


def _clusters(nodes: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, n, root): links within big buckets' components, block pair by block pair."""
    weighed = nodes.join(sets.select(F.col("rep").alias("node"), F.octet_length("shingles").alias("bytes")), "node")
    sizes = weighed.groupBy("component").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    rows = nodes.join(sizes, "component").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.join(classes.select(F.col("rep").alias("node"), "size", "sig"), "node").join(sets.withColumnRenamed("rep", "node"), "node")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "size", "sig", "shingles")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, weight = (table.column(c).to_numpy() for c in ("node", "size"))
        side = (table.column("own").to_numpy() != i).astype(np.int64)
        sets_ = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        links, root = compare_blocks(ids, weight, _sigs(table.column("sig")), sets_, side, i == j, threshold, tolerance)
        some = links > 0
        return pa.table({"node": ids[some], "n": links[some], "root": ids[root[some]]}, schema=pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))

    return dealt.groupBy("component", "i", "j").applyInArrow(run, "node long, n long, root long")


def _judged(docs: DataFrame, words: int, threshold: float, tolerance: float) -> DataFrame:
    """(doc_id, code, class_id, n_links, n_shingles, kept): code is a hash of the text."""
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("code"))
    sig = materialise(signatures(typed, words), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "code")
    classes = sig.where("n_shingles > 0").groupBy("set_hash", "n_shingles").agg(F.min(first).alias("least"), F.count("*").alias("size"), F.first("sig").alias("sig"))
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    found = materialise(_bucket_pairs(_bands(classes)), "candidates")
    stars = found.where("star").select("a", "b")
    pairs = found.where("NOT star").select("a", "b")
    hot = not stars.isEmpty()
    if hot:
        nodes = materialise(connected_components(stars), "clusters")
        near = lambda side: nodes.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        pairs = pairs.join(near("a"), "a", "left").join(near("b"), "b", "left").where("NOT (ca <=> cb) OR ca IS NULL").select("a", "b")
    pairs = materialise(_prune(pairs, classes, threshold, tolerance), "survivors")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    if hot:
        needed = needed.unionByName(nodes.select(F.col("node").alias("rep")))
    needed = materialise(needed.distinct().join(classes, "rep").select("rep", "least.doc_id", "least.code"), "needed")
    sets = materialise(_sets_of(typed, needed, words), "sets")
    links = materialise(_verify(pairs, sets, threshold), "links")
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    weights = classes.select(F.col("rep").alias("other"), "size")
    degrees = ends.join(weights, "other").select("node", F.col("size").alias("n"))
    edges, spent = links, [found, pairs, needed, sets, links]
    if hot:
        inside = materialise(_clusters(nodes, classes, sets, threshold, tolerance), "inside")
        degrees = degrees.unionByName(inside.select("node", "n"))
        edges = edges.unionByName(inside.select(F.col("node").alias("a"), F.col("root").alias("b")))
        spent += [nodes, inside]
    degrees = degrees.groupBy(F.col("node").alias("rep")).agg(F.sum("n").alias("n"))
    roots = connected_components(edges).select(F.col("node").alias("rep"), "component")
    grouped = classes.drop("sig").join(degrees, "rep", "left").join(roots, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    grouped = materialise(grouped, "grouped")
    heads = grouped.groupBy("component").agg(F.min("least").alias("head"))
    named = materialise(grouped.join(heads, "component").select("set_hash", "n_shingles", "size", "head", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links")), "named")
    discard(*spent, classes, grouped)
    rows = sig.drop("sig")
    alone = rows.where("n_shingles = 0").select("doc_id", "code", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_shingles", F.lit(True).alias("kept"))
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("code") == F.col("head.code"))
    spread = _spread_join(rows.where("n_shingles > 0"), named)
    return spread.select("doc_id", "code", F.col("head.doc_id").alias("class_id"), "n_links", "n_shingles", kept.alias("kept")).unionByName(alone)


def _spread_join(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Rows with their class.  Classes of over ``HEAVY`` rows, few by that bound, go to the
    rows; the others meet them in a shuffle."""
    key = ["set_hash", "n_shingles"]
    heavy = named.where(F.col("size") > HEAVY)
    if not 0 < heavy.count() <= BROADCAST_IDS:
        return rows.join(named, key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(named.where(F.col("size") <= HEAVY), key)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """Per row: class_id (the least id that links lead to, its own included), n_links (other
    rows at the threshold or above), n_shingles, and kept (one document of each group)."""
    return _judged(docs, words, threshold, tolerance).drop("code")


def keep_one(docs: DataFrame, words: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """One document of each group of near duplicates, with all columns."""
    judged = materialise(_judged(docs, words, threshold, tolerance).select("doc_id", "code", "n_shingles", "kept"), "judged")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("own"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("code"))
    stay = rows.join(judged.where("NOT kept").select("doc_id", "code").distinct(), same, "left_anti")
    again = judged.where("kept AND n_shingles > 0").groupBy("doc_id", "code").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():  # of rows that repeat a kept document, one
        again = materialise(again, "repeated")
        once = stay.join(again, same, "left_semi").groupBy("id", "own").agg(F.first("row").alias("row"))
        stay = stay.join(again, same, "left_anti").select("row").unionByName(once.select("row"))
    return stay.select("row.*")
