"""Quality, toxicity, sharding, near duplicates, and the pipeline, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import jaccard, quality, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, size string"
WORDS = [a + b + c for a in ("ta", "ri", "no", "sel") for b in ("ka", "mi", "don") for c in ("", "s", "ter", "la")]
ODD = [None, "", " \n\t ", "one", "a b c a b c a b c", "x y\nx y\n\nx y", "né 日本   z"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (".\n" if rng.random() < 0.08 else "") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = list(ODD) + [prose(rng, rng.randint(60, 200)) for _ in range(120)]
    base = prose(rng, 300)
    for k in range(45):  # near copies, over the size of a small bucket
        words = base.split(" ")
        words[rng.randrange(300)] = f"changed{k}"
        out.append(" ".join(words))
    passage = prose(rng, 60)
    out += [passage + " " + prose(rng, 80) for _ in range(20)]
    out += [base] * 6 + [out[20]] * 3
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}", len(t or ""), "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_statistics(texts):
    got = quality.statistics([t or "" for t in texts])
    for row, t in zip(got, texts):
        t, w = t or "", words_of(t)
        count, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if count[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words_of(line):
                dup += line in seen
                seen.add(line)
        assert row[:5].tolist() == [len(w), sum(map(len, w)), sum(t.count(c) for c in quality.SYMBOLS), dup, len(covered)]


def test_isolation_forest_scores_follow_path_lengths():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    f = quality.IsolationForest.fit(x, trees=32, rows=128)
    score = f.score(x)
    assert score[-1] > np.quantile(score[:-1], 0.99)
    for k in (0, 250, 500):  # walk the trees one by one
        total = 0.0
        for feature, cut, child, path in f.trees:
            at = 0
            while feature[at] >= 0:
                at = child[at, int(x[k, feature[at]] >= cut[at])]
            total += path[at]
        assert score[k] == pytest.approx(2 ** (-total / 32 / quality._usual_path(128)))


def test_quality(spark, docs, texts):
    junk = spark.createDataFrame([(1000 + k, " ".join(f"{random.Random(j * 99 + k).choice(WORDS)}{k}{j}###" for j in range(90)), "en", "s", 1, "", "") for k in range(30)], SCHEMA)
    every = docs.unionByName(junk)
    labels = every.selectExpr("doc_id", "CAST(doc_id < 1000 AS INT) AS quality", "0 AS toxic")
    model = quality.fit(every, labels)
    got = {r.doc_id: r for r in quality.judge(every, model).collect()}
    assert sum(not got[1000 + k].kept for k in range(30)) >= 27
    clean = [k for k, t in enumerate(texts) if not got[k].base_failed]
    assert np.mean([got[k].kept for k in clean]) > 0.97
    assert all(got[k].base_failed for k in range(len(ODD)))
    kept = quality.keep_good(every, model)
    assert kept.columns == every.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    none = quality.fit(docs.limit(0), labels)
    assert quality.judge(docs, none).where("kept = base_failed").count() == 0 and quality.judge(docs.limit(0), none).count() == 0


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["vilefool", "wretchling", "scumbagger"]
    rows = []
    for k in range(600):
        w = prose(rng, 120).split(" ")
        if k % 4 == 0:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((k, " ".join(w), "en", "s", 1, "", ""))
    rows += [(600, None, None, None, None, "", ""), (601, "", None, None, None, "", ""), (602, rows[4][1], "en", "s", 1, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    held = [k for k in range(600) if got[k].held_out]
    assert np.mean([got[k].predicted == (k % 4 == 0) for k in held]) > 0.95
    assert got[600].score == got[601].score < 0.3 and got[602].score == got[4].score
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k, r in got.items() if not r.predicted}
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).agg({"score": "max"}).first()[0] == 0


def test_toxicity_of_short_words_many_words_and_scripts_without_spaces():
    rng = random.Random(5)
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    letters = "bcdfghjklmnprstvwz"
    bad = {"short": ["zog", "vix", "kwu"], "many": ["".join(rng.choices(letters, k=9)) for _ in range(100)], "unspaced": ["\u9f98\u9f97\u9f96", "\u9f95\u9f94\u9f93"]}

    def text(kind, toxic):
        w = rng.choices(han, k=300) if kind == "unspaced" else prose(rng, 120).split(" ")
        for _ in range(6 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad[kind])
        return ("" if kind == "unspaced" else " ").join(w)

    for kind in bad:
        texts = [[text(kind, y) for _ in range(n)] for y, n in ((0, 900), (1, 450))]
        model = toxicity.train(texts[1][:400], texts[0][:800])
        scores = [model.scores(t[n:]) for t, n in ((texts[0], 800), (texts[1], 400))]
        assert (scores[1] >= 0.3).mean() > 0.9 and (scores[0] >= 0.3).mean() < 0.1, kind


def test_near_copies_are_one_group():
    rng = random.Random(3)
    texts = [prose(rng, 150) for _ in range(20)]
    copies = [t + " indeed" for t in texts[:5]]
    assert sorted(map(len, toxicity.groups(texts + copies))) == [1] * 15 + [2] * 5
    assert toxicity.groups([]) == [] and toxicity.groups(["", "ab"]) == [[""], ["ab"]]


def test_window_bytes_are_all_of_a_text():
    for t in ("", " ", "abc", "word " * 50, "x" * 500, "Ünï çode " * 30):
        parts = toxicity.windows(t)
        data = b" " + t.lower().encode() + b" "
        assert b"".join([p[:-1] for p in parts]) + b" " == data


def test_sharding(spark, docs, texts):
    got = sharding.kd_shards(docs, leaves=8).collect()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(texts) and set(size) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    of, weight = defaultdict(set), Counter()
    for r in got:
        of[texts[r.doc_id]].add(r.shard)
        weight[texts[r.doc_id]] += r.size
    assert all(len(shards) == 1 for shards in of.values())
    assert max(size.values()) - min(size.values()) < 2.5 * max(weight.values())
    same = spark.createDataFrame([(k, "equal" if k % 2 else f"other {k}", f"l{k % 5}", "s", 5, "", "") for k in range(400)], SCHEMA)
    spread = defaultdict(set)
    for r in sharding.kd_shards(same, leaves=8).collect():
        spread["equal" if r.doc_id % 2 else r.doc_id].add(r.shard)
    assert all(len(x) == 1 for x in spread.values()) and len(set.union(*spread.values())) > 3
    assert sharding.kd_shards(docs.limit(0), leaves=8).count() == 0


def sets_of(texts):
    out = []
    for t in texts:
        w = words_of(t)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def brute(texts):
    sets, n = sets_of(texts), len(texts)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return links, [find(k) for k in range(n)]


def test_near_duplicates(docs, texts):
    links, root = brute(texts)
    assert max(links) > jaccard.SMALL
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    assert [(got[k].n_links, got[k].class_id, got[k].kept) for k in range(len(texts))] == [(links[k], root[k], root[k] == k) for k in range(len(texts))]
    one = jaccard.keep_one(docs)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(root))
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_blocks_compare_like_pairs(texts):
    sets = [np.sort(jaccard.shingle_sets([t or ""], 5)[0]) for t in texts]
    keys, count = jaccard.shingle_sets([t or "" for t in texts], 5)
    sig = jaccard.minhash(keys, count)
    some = np.array([k for k in range(len(texts)) if len(sets[k])])
    args = (some, np.ones(len(some), np.int64), sig[some], [sets[k] for k in some])
    whole, _ = jaccard.compare_blocks(*args, np.zeros(len(some), np.int64), True, 0.8, 1e-6)
    links, _ = brute(texts)
    assert whole.tolist() == [links[k] for k in some]
    side = (np.arange(len(some)) % 2).astype(np.int64)
    parts = jaccard.compare_blocks(*args, side, False, 0.8, 1e-6)[0]
    for s in (0, 1):
        at = np.flatnonzero(side == s)
        parts[at] += jaccard.compare_blocks(some[at], np.ones(len(at), np.int64), sig[some[at]], [sets[k] for k in some[at]], np.zeros(len(at), np.int64), True, 0.8, 1e-6)[0]
    assert parts.tolist() == whole.tolist()


def test_pruning_bound_is_the_posterior():
    need = jaccard.least_matches(0.8, 1e-6)
    grid = np.linspace(0, 1, 200_001)
    for n in (16, 64, 128):
        for m in (need[n] - 1, need[n]):
            density = grid**m * (1 - grid) ** (n - m)
            p = density[grid >= 0.8].sum() / density.sum()
            assert (p >= 1e-6) == (m >= need[n])


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline

    folder = f"file://{tmp_path}"
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{folder}/labels.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, folder)
        assert out.columns == rows.columns
    packed = {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    all_rows = {r.doc_id: r.text for r in docs.collect()}
    failed = {k for k, t in all_rows.items() if quality.base_failed(quality.statistics([t or ""]))[0]}
    assert packed and not packed & failed
    ids = sorted(all_rows.keys() - failed)
    links, root = brute([all_rows[k] for k in ids])
    # Without toxic labels nothing is toxic; of a group at most one document is packed.
    assert max(Counter(root[ids.index(k)] for k in packed).values()) == 1


def test_null_and_repeated_ids(spark):
    rng = random.Random(11)
    a, b, c = (prose(rng, 120) for _ in range(3))
    rows = [(2, a + " b"), (2, c), (3, a + " c"), (4, c + " k"), (None, b), (None, b), (None, b + " z"), (None, None), (5, b + " y"), (7, "x y"), (7, "x y"), (None, "q r"), (None, "q r"), (8, ""), (8, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, rep int")
    links, _ = brute([t for _, t in rows])
    got = jaccard.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((r[0], n) for r, n in zip(rows, links))
    assert {(r.doc_id, r.class_id) for r in got} == {(2, 2), (3, 2), (4, 2), (5, 5), (None, 5), (None, None), (7, 7), (8, 8)}
    one = [(r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()]
    assert Counter(one) == Counter([rows[0], rows[1], (None, None), rows[8], rows[9], rows[11], rows[13], rows[14]])


def test_cuts_are_weighted_quantiles_of_the_widest_dimension(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(1, 90), rng.randrange(1000), rng.randrange(300), t) for t in range(400)]
    meta = spark.createDataFrame(rows, "size long, v0 long, v1 long, t long")
    tree, placed = sharding.build(meta, 2, 6, 16, 0.0)
    nodes = {r.t: r.node for r in placed.collect()}

    def check(node, held):
        n = tree[node]
        assert n.weight == sum(r[0] for r in held)
        if n.cut is None:
            assert n.leaves == 1 and all(nodes[r[3]] == node for r in held)
            return
        wide = [max(r[k] for r in held) - min(r[k] for r in held) for k in (1, 2)]
        assert n.dimension == wide.index(max(wide))
        key = lambda r: (r[1 + n.dimension], r[3])
        cut = (n.cut + (-(1 << 62),))[:2]
        left = [r for r in held if key(r) < cut]
        need, order = n.weight * (n.leaves // 2) / n.leaves, sorted(held, key=key)
        sums = [sum(r[0] for r in order[:k]) for k in range(len(order) + 1)]
        assert abs(sum(r[0] for r in left) - need) == min(abs(x - need) for x in sums)
        check(n.left, left)
        check(n.right, [r for r in held if key(r) >= cut])

    check(0, rows)


def test_scores_follow_the_definition():
    rng = random.Random(6)
    plain = [prose(rng, 80) for _ in range(200)]
    bad = [prose(rng, 40) + " vilefool " + prose(rng, 40) + " scumbagger" for _ in range(80)]
    model = toxicity.train(bad, plain)
    assert model.toxic.endswith(b" " + model.ordinary) and len(model.ordinary) <= 65536

    def length(dictionary, window):
        import zstandard

        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(window))

    for text in (plain[0], bad[0], "", "x" * 300):
        parts = toxicity.windows(text)
        odds = [model.odds[min(toxicity.HIGHEST, max(toxicity.LOWEST, length(model.ordinary, w) - length(model.toxic, w))) - toxicity.LOWEST] for w in parts]
        z = np.array([sum(odds), np.log1p(len(parts)), 1.0]) @ np.array(model.weights)
        assert model.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    a, b, c = (prose(rng, 150) for _ in range(3))
    rows = [(1, a), (1, b), (None, c), (None, c + " end"), (2, a), (2, a), (3, None), (4, "")]
    folder = f"file://{tmp_path}"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rep string, own int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (1, b), (None, min((c, c + " end"), key=lambda t: spark.sql("SELECT xxhash64(:t)", args={"t": t}).first()[0]))])
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r.doc_id for r in pieces)), key=str) == [1, 1, None]


def test_heavy_groups_go_to_their_rows(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY", 3)
    monkeypatch.setattr(sharding, "HEAVY", 3)
    links, root = brute(texts)
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    assert [(got[k].n_links, got[k].class_id) for k in range(len(texts))] == [(links[k], root[k]) for k in range(len(texts))]
    shards = defaultdict(set)
    rows = sharding.kd_shards(docs, leaves=8).collect()
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
    assert len(rows) == len(texts) and all(len(s) == 1 for s in shards.values())
