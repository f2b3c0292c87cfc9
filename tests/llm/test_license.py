"""License scans against plain loops, planted notices, and edge cases."""

import math
import random
import re

import pytest

from quarry.llm import license as lic


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def places(ws, phrase):
    return [k for k in range(len(ws) - len(phrase) + 1) if ws[k : k + len(phrase)] == phrase]


def brute(rows):
    vocabulary = {w for _, phrases, passage in lic.TEMPLATES for t in [passage, *phrases] for w in words(t)} | {w for p, _ in lic.BASE_PHRASES for w in words(p)}
    texts = [words(t) for _, t in rows]
    weight = {w: math.log((len(texts) + 1) / (sum(w in ws for ws in texts) + 1)) + 1 for w in vocabulary}
    out = []
    for (doc, _), ws in zip(rows, texts):
        base = [(k, label) for p, label in lic.BASE_PHRASES for k in places(ws, words(p))]
        labels, score = {label for _, label in base}, 1.0 if base else 0.0
        for label, phrases, passage in lic.TEMPLATES:
            t, ps = words(passage), [words(p) for p in phrases]
            if not all(w in ws for p in ps for w in p):
                continue
            ranked = sorted(set(t), key=lambda w: (-weight[w], w))
            rare, need = [w for w in ranked if w in ws][: lic.RARE], min(lic.AGREE, len(ranked))
            near = {w: {k - i for k, x in enumerate(ws) if x == w for i, y in enumerate(t) if y == w} for w in rare}
            for o in set().union(*near.values()) if near else ():
                if sum(any(o + s in near[w] for s in range(-lic.SLACK, lic.SLACK + 1)) for w in rare) < need:
                    continue
                if not all(any(o - lic.SLACK <= k <= o + len(t) + lic.SLACK - len(p) for k in places(ws, p)) for p in ps):
                    continue
                labels.add(label)
                hit = sum(weight[y] for i, y in enumerate(t) if any(0 <= o + i + s < len(ws) and ws[o + i + s] == y for s in range(-lic.SLACK, lic.SLACK + 1)))
                score = max(score, hit / sum(weight[y] for y in t))
        spots = [k for k, _ in base]
        out.append((doc, len(ws), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=repr)


def ours(spark, rows):
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, labels string")
    got = lic.scan_licenses(df).collect()
    return sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got], key=repr)


def test_equals_loops(spark):
    rng = random.Random(4)
    pool = sorted({w for _, _, p in lic.TEMPLATES for w in words(p)})
    rows = []
    for d in range(120):
        ws = [rng.choice(["größe", "lorem", "the", "of", *pool[:40]]) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            _, _, passage = rng.choice(lic.TEMPLATES)
            part = passage.split()
            for _ in range(rng.randint(0, 2)):
                part.insert(rng.randrange(len(part)), rng.choice(["x", "the"])) if rng.random() < 0.5 else part.pop(rng.randrange(len(part)))
            k = rng.randint(0, len(ws))
            ws[k:k] = part
        rows.append((d, rng.choice([" ", "\n", "--"]).join(ws)))
    rows += [(None, "MIT License"), (7, None), (8, ""), (9, "MIT-LICENSE mit_license mit  license x apache license"), (10, "mitlicense é mit, license"), rows[3], rows[3]]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, []) == []


def test_notices_and_mentions(spark):
    rows = [(k, f"Lorem ipsum dolor.\n{passage}.\nSit amet.") for k, (_, _, passage) in enumerate(lic.TEMPLATES)]
    plain = [(1000, "The cc by road and a public license plate without restriction."), (1001, "cc0"), (1002, "bsd license"), (1003, "the domain by nc and 4 cc")]
    got = {r[0]: r for r in ours(spark, rows + plain)}
    for k, (label, _, _) in enumerate(lic.TEMPLATES):
        assert label in got[k][6].split(",") and got[k][7] == 1.0
    assert got[1000][6] == got[1001][6] == got[1003][6] == "" and got[1003][7] == 0
    assert "cc-by" not in got[[t[2] for t in lic.TEMPLATES].index("licensed under CC BY-NC 4.0")][6].split(",")


@pytest.mark.parametrize("n", [1, 200_000])
def test_very_long_text(spark, n):
    text = ("lorem the of software license permission " * n) + " Licensed under CC BY-NC 4.0. MIT license"
    ((_, words_n, base, first, last, own, labels, score),) = ours(spark, [(1, text)])
    assert (words_n, base, first, last, own, labels, score) == (6 * n + 9, 1, 6 * n + 7, 6 * n + 7, "mit", "cc-by-nc,mit", 1.0)
