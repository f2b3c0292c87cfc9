"""Tokenizer operators against the tokenizers library and exact round trips."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe, packing, wavelet
from quarry.llm.hf import encoder
from quarry.llm.queries import tokenizer_path

P = tokenizer_path()
SCHEMA = "doc_id long, text string, ids string, shard int"
TEXTS = [
    None,
    "",
    " ",
    "it's  we'll\n\n'sup \n'tis ''s x'sy 's",
    "a  b\t\tc  d 　 e\x1cf\x85g",
    "<|endoftext|> hi<|endoftext|>",
    "12 abc12 3'd'd 'D",
    "日本語 テスト 123 🙂🙂 a🙂",
    "the same text",
    "the same text",
    "abab" * 300 + " " + "=" * 700 + "\n" * 90 + "x",
    "word " * 3000,
]
ROWS = [(k, t, "clash", 7) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash", 7)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(st.sampled_from("ab 'stre\n\t é1!　"), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_both_encoders_equal_the_library(texts):
    from tokenizers import Tokenizer

    library = test_both_encoders_equal_the_library.__dict__.setdefault("t", Tokenizer.from_file(P))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for encode in (bpe.load(P).encoder.encode, encoder(P).encode):
        ids, sizes = encode(texts)
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_long_texts_are_cut_safely(library, monkeypatch):
    from quarry.llm import pretoken

    monkeypatch.setattr(pretoken.pieces, "__defaults__", (64,))
    monkeypatch.setattr(pretoken.grouped, "__defaults__", (64,))
    text = "it's  some 'text\n with  spaces, and   more of'em " * 40
    ids, sizes = bpe.load(P).encoder.encode([text, "", text])
    assert ids.tolist() == ids_of(library, text) * 2 and sizes[1] == 0


def test_round_trip(spark, library):
    got = sorted(map(tuple, bpe.round_trip(spark.createDataFrame(ROWS, SCHEMA), P).collect()))
    want = []
    for k, t, *_ in ROWS:
        ids = ids_of(library, t)
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want)


def test_columns(spark, library):
    df = spark.createDataFrame(ROWS, SCHEMA)
    both = bpe.decode_column(bpe.encode_column(df, P), P).collect()
    assert all(r.decoded == (r.text or "") and r.shard == 7 for r in both)
    assert bpe.encode_column(df.limit(0), P).count() == 0
    with pytest.raises(ValueError):
        bpe.load(P).decode(np.array([60000]))


@given(st.lists(st.integers(0, 60000), max_size=300), st.integers(0, 60000))
@settings(max_examples=60, deadline=None)
def test_wavelet_matrix(values, other):
    m = wavelet.WaveletMatrix(wavelet.WaveletMatrix.build(np.array(values, np.uint32)))
    assert m.decode().tolist() == values
    assert [m.access(i) for i in range(len(values))] == values
    for v in {*values[:5], other}:
        places = [i for i, x in enumerate(values) if x == v]
        assert m.count(v) == len(places) and m.locate(v) == places
        assert m.rank(v, len(values) // 2) == sum(i < len(values) // 2 for i in places)


def test_wavelet_over_many_blocks():
    values = np.random.default_rng(1).zipf(1.3, 3 * wavelet.BLOCK + 77).clip(0, 50000).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.WaveletMatrix.build(values))
    assert (m.decode() == values).all()
    for i in (0, wavelet.BLOCK - 1, wavelet.BLOCK, 2 * wavelet.BLOCK + 5, len(values) - 1):
        assert m.access(i) == values[i]
    v = int(values[-1])
    places = np.flatnonzero(values == v)
    assert m.select(v, len(places) - 1) == places[-1] and m.count(v, 100, 100_000) == ((places >= 100) & (places < 100_000)).sum()


def test_token_output(spark, library, tmp_path):
    rows = [r for r in ROWS if r != ROWS[-1]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = wavelet.write_shards(df, P, 2, f"file://{tmp_path}/w", segment_tokens=50)
    got = sorted(map(tuple, wavelet.read_digests(spark, path).collect()))
    start, want = 0, []
    for k, t, *_ in rows:
        ids = [*ids_of(library, t), 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    every = [x for k, t, *_ in rows for x in [*ids_of(library, t), 2]]
    shards, at, found = sorted({r.shard for r in spark.read.parquet(path).select("shard").collect()}), 0, []
    assert max(spark.read.parquet(path).groupBy("shard").count().toPandas()["count"]) > 1  # several segments
    for k in shards:
        whole = wavelet.open_shard(spark, path, k)
        own = every[at : at + whole.n]
        assert whole.decode().tolist() == own and [whole.access(i) for i in range(whole.n)] == own
        for v in (2, own[0], own[-1], 49_999):
            places = [i for i, x in enumerate(own) if x == v]
            assert whole.locate(v) == places and whole.count(v) == len(places)
            assert [whole.select(v, i) for i in range(len(places))] == places
            lo, hi = whole.n // 4, whole.n // 2
            assert whole.count(v, lo, hi) == sum(lo <= i < hi for i in places) and whole.rank(v, hi) == sum(i < hi for i in places)
        found += [(k, i) for i, x in enumerate(own) if x == 2]
        at += whole.n
    assert at == len(every) and sorted(map(tuple, wavelet.occurrences(spark, path, 2).collect())) == found
    assert wavelet.token_output(df.limit(0), P).count() == 0


def test_packing(spark, library):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    pieces = packing.pack(df, P, size=64).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    short = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64 and all(p.sequence_tokens == at for p in parts)
        short += at < 64
    assert short <= 1
    texts = {k: t for k, t, *_ in ROWS}
    count = defaultdict(list)
    for p in pieces:
        count[p.doc_id].append(p)
    for k, parts in count.items():
        ids = [*ids_of(library, texts[k]), 1]
        copies = 2 if k == 3 else 1
        assert sum(p.length for p in parts) == copies * len(ids)
        for p in parts:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert set(count) == set(texts) and packing.pack(df.limit(0), P).count() == 0


def test_sum_of_squares_rule():
    """The level array holds the brute-force minimum at every step."""
    rng, packer, size = np.random.default_rng(3), packing.SumOfSquares(16), 16
    for n in rng.integers(1, 16, 200):
        before = packer.count.copy()
        best = None
        for level in [0, *[g for g in range(1, size) if before[g] and g + n <= size]]:
            after = before.copy()
            if level:
                after[level] -= 1
            if level + n < size:
                after[level + n] += 1
            best = min(x for x in (best, (after[1:size] ** 2).sum()) if x is not None)
        packer.place(("d", 0, np.zeros(n, np.uint32)))
        assert (packer.count[1:size] ** 2).sum() == best
