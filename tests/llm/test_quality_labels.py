"""The threshold of the quality rules where labels are few."""

from math import comb

import numpy as np
import pytest

from quarry.llm import quality


@pytest.mark.parametrize("n, keep", [(1, 0.9), (30, 0.995), (160, 0.995), (400, 0.98), (12, 1.0), (9, 0.5)])
def test_most_rejected_is_a_binomial_quantile(n, keep):
    sums = np.cumsum([comb(n, k) * (1 - keep) ** k * keep ** (n - k) for k in range(n + 1)])
    assert quality.most_rejected(n, keep) == min(int((sums >= 0.95).argmax()), n - 1)
    assert quality.most_rejected(0, keep) == 0


def test_one_odd_good_row_does_not_let_all_bad_ones_through():
    good = np.concatenate([np.linspace(0.3, 0.4, 159), [0.9]])
    bad = np.linspace(0.5, 0.8, 20)
    cut = quality.calibrate(good, bad, 0.995)
    assert 0.4 <= cut < 0.5
    assert quality.calibrate(good, np.zeros(0), 0.995) == 0.9 and quality.calibrate(np.zeros(0), bad, 0.995) == 1.0
    # All good rows alike, and bad ones that score like them.
    assert quality.calibrate(np.full(50, 0.4), np.full(5, 0.4), 0.995) == 0.4


@pytest.mark.parametrize("seed", range(3))
def test_few_labels_find_bad_rows(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (260, 9)) * (rng.random((260, 9)) < 0.9)
    x[200:] += np.where(np.arange(9) < 3, 6, 0)
    # A good row that looks bad.
    x[5, :3] += 6
    fine, rest, held = np.arange(200), np.arange(200, 224), np.arange(224, 260)
    good, bad = quality.cross_scores(x, fine, rest, 0.02, 4)
    assert good.shape == (200,) and bad.shape == (24,) and (good > 0).all() and (bad > 0).all()
    model = quality.grown(x, fine, rest, 0.02, 7, quality.per_tree(200, 4))
    cut = quality.calibrate(good, bad, 0.995)
    assert (model.score(x[held]) > cut).mean() >= 0.9 and (model.score(x[fine]) > cut).mean() <= 0.02
    # Repeats exactly.
    assert np.array_equal(good, quality.cross_scores(x, fine, rest, 0.02, 4)[0])


@pytest.mark.parametrize("seed, bad", [(0, 300), (1, 40), (2, 0)])
def test_threshold_by_ranges_equals_that_in_memory(spark, seed, bad):
    rng = np.random.default_rng(seed)
    good, bad = np.round(rng.normal(0.4, 0.05, 2000), 3), np.round(rng.normal(0.5, 0.07, bad), 3)
    rows = [(float(s), True) for s in good] + [(float(s), False) for s in bad]
    df = spark.createDataFrame(rows, "score double, good boolean").repartition(7)
    assert quality.threshold(df, 0.995) == quality.calibrate(good, bad, 0.995)
    assert quality.threshold(df.where("NOT good"), 0.995) == 1.0


def test_all_labelled_rows_count(spark, monkeypatch):
    """6,600 labelled rows: each can be drawn by trees, and each has a score for the threshold."""
    docs = spark.range(6600).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 60 + id % 40), i -> concat('w', hash(id, i) % 5000)), ' ') || repeat(' ###', int(if(id % 11 = 0, 50, id % 3))) AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 11 <> 0) AS quality")
    seen = {}
    forests, threshold = quality.forests, quality.threshold
    monkeypatch.setattr(quality, "forests", lambda rows, fine, rest, *more: seen.update(rows=rows.count(), fine=fine.sum(), rest=rest.sum()) or forests(rows, fine, rest, *more))
    monkeypatch.setattr(quality, "threshold", lambda scores, keep: seen.update(scored=scores.count()) or threshold(scores, keep))
    model = quality.fit(docs, labels, trees=16)
    assert seen == {"rows": 6600, "fine": 6000, "rest": 600, "scored": 6600}
    kept = {r.doc_id: r.kept for r in quality.judge(docs, model).collect()}
    assert np.mean([kept[k] for k in kept if k % 11]) > 0.98 and not any(kept[k] for k in kept if k % 11 == 0)
    # Repeats exactly, however the rows are dealt.
    again = quality.fit(docs.repartition(5), labels, trees=16)
    assert again.threshold == model.threshold and all(np.array_equal(p, q) for a, b in zip(again.forest.trees, model.forest.trees) for p, q in zip(a, b))
