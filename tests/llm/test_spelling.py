"""Spelling variants against plain loops, and their edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, every=199, shortest=6, least=5, times=5):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            total[run] += 1
    n = {w: c for w, c in total.items() if len(w) >= shortest and c >= least}
    others = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, near_ones in others.items():
        best = min(near_ones, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return out


def ours(spark, rows, **kwargs):
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, word string")
    got = spelling.variants(df, **kwargs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len({r.word for r in got})
    return {tuple(r) for r in got}


def test_equals_loops(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "aaaaab", "É" * 6, "é" * 6, "×÷×÷×÷"]
    words = []
    for w in stems:
        words += [w] * rng.choice([3, 30, 150])
        for _ in range(6):
            k = rng.randrange(len(w))
            words += [rng.choice([w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "d" + w[k + 1 :]])] * rng.choice([5, 6, 40])
    rng.shuffle(words)
    rows = [(d, rng.choice([" ", ", ", "\n1", "ā"]).join(words[d::20]).title()) for d in range(20)]
    rows += [(None, "aaaaaa " * 9), (3, None), (4, ""), (5, "中" * 9), rows[0]]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, rows, every=3, shortest=4, least=2, times=2) == brute(rows, 3, 4, 2, 2)
    assert ours(spark, []) == set()


def test_chain_of_forms(spark):
    rows = [(k, " ".join(["abcdefgh"] * 700 + ["abcdefg"] * 130 + ["abcdef"] * 25 + ["bcdef", "abcdez"] * 5)) for k in range(1)]
    got = {w: r for w, _, r, *_ in ours(spark, rows, every=10**9)}
    assert got == {w: "abcdefgh" for w in ("abcdefgh", "abcdefg", "abcdef", "abcdez")}


def test_long_texts_and_words_are_whole(spark, monkeypatch):
    text = ("Wörter-" * 900_000) + "x" * 3_000 + " "
    rows = [(1, text), (2, ("x" * 3_000 + " ") * 6 + ("x" * 2_999 + " ") * 40)]
    got = {w: (n, near) for w, _, _, n, near, _ in ours(spark, rows, every=10**9)}
    assert got == {"wörter": (900_000, 0), "x" * 3_000: (7, 1), "x" * 2_999: (40, 1)}


def test_collisions_are_verified(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) for _ in range(60)})
    df = spark.createDataFrame([(k, w, 5 + k % 3) for k, w in enumerate(words)], "id long, word string, n long").cache()
    for keys in (spelling.deletion_keys(df), spelling.deletion_keys(df).withColumn("key", F.pmod("key", F.lit(7)))):
        got = {r.id: (r.n_near, r.best.word) for r in spelling.near_words(df, keys).collect()}
        expect = {}
        for k, w in enumerate(words):
            others = [(-(5 + j % 3), o) for j, o in enumerate(words) if near(w, o)]
            if others:
                expect[k] = (len(others), min(others)[1])
        assert got == expect


def test_hashes_equal_those_of_the_deleted_words():
    codes = np.array([[97, 98, 99, 98]], np.uint32)
    whole, less = spelling.deletion_hashes(codes)
    for k in range(4):
        assert spelling.deletion_hashes(np.delete(codes, k, axis=1))[0][0] == less[0, k]
    assert whole[0] not in less[0]
