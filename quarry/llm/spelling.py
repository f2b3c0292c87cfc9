"""Spelling variants grouped by rolling-hash deletions.

Two words are near if one inserted, deleted or replaced code point makes them equal.  Deleting
one code point tells: words of equal length are near by a replacement if they agree once the
same place is deleted, and a word is near a longer one if that one agrees with it once some
place is deleted.  Prefix and suffix polynomial hashes give the hash of every deletion of every
word without building a string, for all words of one length at a time.

Integer keys alone are shuffled, dealt by their upper bits and sorted; the few places where
keys meet come back to their words, where the deleted strings themselves decide, so a collision
of hashes never counts.  Every near pair meets in exactly one group of equal deletions (a
deletion within a run of one letter counts at the run's first place only), so the near words of
a word are counted, and the largest found, group by group, and no pair is written.  Per place a
group holds as many words as there are letters, at most.

A word's form is its near word of largest count if that is large enough; forms are followed to
their end by doubling, a number of rounds that grows with the logarithm of the longest chain.

Edge cases: a null text has no words; a null id counts as an empty one; repeated rows count
each; long texts are read in slices and words of any length are taken whole; ties of the largest
near word go to the smallest one in code-point order; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import bound_batches, discard, materialise

#: Letters in UTF-8 once A-Z are lower-cased: a-z, and U+00C0 to U+00FF in two bytes.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
BREAK = re.compile(rb"[^a-z\x80-\xff]")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLICE = 1 << 20
#: Distinct words a task counts before it hands them on.
MOST_WORDS = 200_000
#: Code points whose deletion keys are built at a time.
STRIP = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)


def runs(text: str):
    """Lists of the runs of letters of a text, as bytes, slice by slice."""
    raw = text.encode("utf-8", "replace").translate(LOWER)
    at = 0
    while at < len(raw):
        cut = BREAK.search(raw, at + SLICE) if at + SLICE < len(raw) else None
        end = cut.end() if cut else len(raw)
        yield RUN.findall(raw[at:end])
        at = end


def misspelt(word: bytes, prefix: int, every: int) -> bytes:
    """The word as its document has it: a code point deleted if ``every`` divides the hash."""
    h = zlib.crc32(word, prefix)
    if h % every:
        return word
    text = word.decode()
    k = h % len(text)
    return (text[:k] + text[k + 1 :]).encode()


def count_words(docs: DataFrame, every: int, shortest: int, least: int) -> DataFrame:
    """(word, n) of the words of at least ``shortest`` code points that occur ``least`` times."""

    def run(batches):
        total: Counter = Counter()

        def leave():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for words in runs(text.as_py() or ""):
                    for word, n in Counter(words).items():
                        word = misspelt(word, prefix, every)
                        # A code point has two bytes at most.
                        if len(word) >= shortest:
                            total[word] += n
                    if len(total) > MOST_WORDS:
                        yield leave()
        yield leave()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    counted = rows.mapInArrow(run, "word string, n long").where(F.char_length("word") >= shortest)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def deletion_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of rows of code points: (of each row, of each row without each of its places)."""
    n, length = codes.shape
    before = np.zeros((n, length + 1), np.uint64)
    after = np.zeros((n, length + 1), np.uint64)
    power = np.ones(length + 1, np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(length):
            power[k + 1] = power[k] * BASE
            before[:, k + 1] = before[:, k] * BASE + c[:, k]
        for k in range(length - 1, -1, -1):
            after[:, k] = after[:, k + 1] + c[:, k] * power[length - 1 - k]
        return before[:, length], before[:, :length] * power[length - 1 - np.arange(length)] + after[:, 1:]


def deletion_keys(words: DataFrame) -> DataFrame:
    """(key, place, id, first) of every deletion of every word, and of the word itself with the
    place -1; ``first`` tells the first place of a run of one letter."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            texts = batch.column("word").to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            for length in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == length)
                step = max(1, STRIP // length)
                for s in range(0, len(rows), step):
                    some = rows[s : s + step]
                    codes = np.frombuffer("".join(texts[k] for k in some).encode("utf-32-le"), np.uint32).reshape(len(some), length)
                    whole, less = deletion_hashes(codes)
                    first = np.ones((len(some), length), bool)
                    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
                    keys = np.concatenate([whole, less.ravel()])
                    places = np.concatenate([np.full(len(some), -1), np.tile(np.arange(length), len(some))])
                    owner = np.concatenate([ids[some], np.repeat(ids[some], length)])
                    flags = np.concatenate([np.zeros(len(some), bool), first.ravel()])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(places.astype(np.int32)), pa.array(owner), pa.array(flags)], names=["key", "place", "id", "first"])

    return words.select("id", "word").mapInArrow(run, "key long, place int, id long, first boolean")


def _meetings(keys: DataFrame) -> DataFrame:
    """(kind, place, id): where keys meet.  Kind 0: a deletion at the same place of other words;
    1: a word that others reach by a deletion; 2: such a deletion."""

    def found(key, place, ids, first):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        run_of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        has_word = np.bincount(run_of, place < 0) > 0
        has_deletion = np.bincount(run_of, first & (place >= 0)) > 0
        both = (has_word & has_deletion)[run_of]
        edge = np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
        group = np.cumsum(edge) - 1
        shared = (np.bincount(group)[group] > 1) & (place >= 0)
        masks = [shared, both & (place < 0), both & first & (place >= 0)]
        kind = np.concatenate([np.full(int(m.sum()), k, np.int32) for k, m in enumerate(masks)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([place[m] for m in masks])), pa.array(np.concatenate([ids[m] for m in masks]))], names=["kind", "place", "id"])

    def run(batches):
        left = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "place", "id", "first")]
            if left is not None:
                cols = [np.concatenate(pair) for pair in zip(left, cols)]
            key = cols[0]
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            left = [c[cut:] for c in cols]
            if cut:
                yield found(*(c[:cut] for c in cols))
        if left is not None and len(left[0]):
            yield found(*left)

    dealt = keys.repartition(F.shiftrightunsigned("key", 40)).sortWithinPartitions("key", "place")
    return dealt.mapInArrow(run, "kind int, place int, id long")


def near_words(words: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, n_near, best): for each word with near ones, how many, and the one of largest count
    (ties: the smallest) as (-n, word).  ``words`` are distinct: id, word, n; ``keys`` are their
    deletion keys, which may collide."""
    met = _meetings(keys).join(words, "id")
    rest = F.when(F.col("kind") == 1, F.col("word")).otherwise(F.expr("concat(substring(word, 1, place), substring(word, place + 2))"))
    met = met.select("kind", F.when(F.col("kind") == 0, F.col("place")).otherwise(-1).alias("place"), rest.alias("rest"), "id", "word", "n")
    # Replacements: the best of a group, and for the best itself the second.
    group = Window.partitionBy("place", "rest")
    order = group.orderBy(F.desc("n"), "word")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mine = F.struct("n", "word")
    alike = met.where("kind = 0").select("id", (F.count("*").over(group) - 1).alias("n_near"), F.row_number().over(order).alias("rank"), F.first(mine).over(whole).alias("top"), F.nth_value(mine, 2).over(whole).alias("second"))
    alike = alike.where("n_near > 0").select("id", "n_near", F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("top")).alias("best"))
    # Deletions: the word gets the best of the longer ones, each of which gets the word.
    order = Window.partitionBy("rest").orderBy("kind", F.desc("n"), "word")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    longer = met.where("kind > 0").select("id", "kind", (F.count("*").over(Window.partitionBy("rest")) - 1).alias("others"), F.first(F.struct("kind", mine.alias("mine"))).over(whole).alias("head"), F.nth_value(mine, 2).over(whole).alias("second"))
    longer = longer.where("others > 0 AND head.kind = 1").select("id", F.when(F.col("kind") == 1, F.col("others")).otherwise(1).alias("n_near"), F.when(F.col("kind") == 1, F.col("second")).otherwise(F.col("head.mine")).alias("best"))
    # The smallest (-n, word) is the largest n, ties by word.
    both = alike.unionByName(longer).select("id", "n_near", F.struct((-F.col("best.n")).alias("minus"), F.col("best.word").alias("word")).alias("best"))
    return both.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root): from every word that has a form, forms followed to the last."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(now)
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")
        now._scratch = after._scratch


def variants(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    counted = count_words(docs, every, shortest, least).withColumn("id", F.monotonically_increasing_id())
    # Ids are fixed by being written.
    words = materialise(counted, "words")
    near = near_words(words, deletion_keys(words))
    big = F.when(-F.col("best.minus") >= times * F.col("n"), F.struct(F.col("best.word").alias("form"), (-F.col("best.minus")).alias("form_n")))
    judged = materialise(words.join(near, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), big.alias("to")), "judged")
    judged = judged.select("word", "n", "n_near", "to.form", "to.form_n")
    discard(words)
    roots = roots_of(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
