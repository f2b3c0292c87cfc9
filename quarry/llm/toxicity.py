"""Toxicity by compression distance between two zstandard dictionaries.

One dictionary is trained on windows of ordinary text.  The other holds that same content
and, before it, a dictionary trained on toxic text: on the passages whose byte n-grams are
significantly more frequent in toxic texts than in ordinary ones.  A text is cut into short
windows; how much shorter a window compresses with the toxic dictionary is a small whole
number, nearly always 0 in ordinary text.  Training windows give each difference its log
odds, of either sign; a text's evidence is the sum over its windows, and a logistic fit on
training texts turns evidence into a score in [0, 1].  Odds and fit only see texts that the
dictionaries they are measured with were not trained on: the texts are dealt into folds, and
each fold is measured with dictionaries trained on the others.

Only texts enter a score.  Edge cases: null and empty texts have no windows and get the
score of no evidence; without toxic and ordinary training rows every score is 0; very long
texts are read whole, window by window; equal texts get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import slices
from quarry.llm.sample import labelled
from quarry.runtime import bound_batches

WINDOW = 48
LEVEL = 6
LOWEST, HIGHEST = -4, 12
GRAMS = 4, 6, 8
SHINGLE = 24
_BITS = 22
TOXIC_BYTES = 4096
FOLDS = 3


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The lower-cased text in runs of whole words of about ``size`` bytes."""
    data = b" " + text.lower().encode("utf-8", "replace") + b" "
    out, at, end = [], 0, len(data) - 1
    while at < end:
        cut = data.find(b" ", min(at + size, end))
        if cut > at + 2 * size:
            cut = at + 2 * size
        out.append(data[at : cut + 1])
        at = cut
    return out


def _data(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace") + b" "


def _codes(data: bytes, n: int) -> np.ndarray:
    """A hash of the n bytes at each position."""
    at = np.frombuffer(data, np.uint8).astype(np.uint64)
    size = max(0, len(at) - n + 1)
    code = np.zeros(size, np.uint64)
    for k in range(n):
        code = code * np.uint64(1099511628211) + at[k : k + size]
    return (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)


def groups(texts: list[str], bands: int = 8, each: int = 5) -> list[list[str]]:
    """The texts in groups of near copies: equal in one band of MinHashes and in half of all."""
    rng = np.random.default_rng(7)
    by = rng.integers(1, 1 << 63, bands * each, np.uint64) | np.uint64(1)
    of: list[int] = []
    kept: list[np.ndarray] = []
    seen: dict[tuple, int] = {}
    for text in texts:
        data = _data(text)
        codes = np.unique(_codes(data, min(SHINGLE, len(data)))).astype(np.uint64)
        sketch = np.array([(codes * m).min() for m in by], np.uint64)
        keys = [(k, sketch[k * each : (k + 1) * each].tobytes()) for k in range(bands)]
        near = next((g for key in keys if (g := seen.get(key)) is not None and 2 * (kept[g] == sketch).sum() >= len(by)), None)
        if near is None:
            near = len(kept)
            kept.append(sketch)
        of.append(near)
        for key in keys:
            seen.setdefault(key, near)
    out: list[list[str]] = [[] for _ in kept]
    for g, text in zip(of, texts, strict=True):
        out[g].append(text)
    return out


def _contrast(ordinary: list[list[str]], toxic: list[list[str]], n: int, ratio: float) -> np.ndarray:
    """Per hashed n-gram the likelihood ratio (G squared) of its shares of the toxic and the
    ordinary groups; 0 where the toxic share is less than ``ratio`` times the ordinary one."""
    held = []
    for part in (ordinary, toxic):
        count = np.zeros(1 << _BITS, np.float32)
        for group in part:
            # An index that repeats is raised once, so this counts groups.
            count[np.concatenate([_codes(_data(t), n) for t in group])] += 1
        held.append(count)
    out = np.zeros(1 << _BITS, np.float32)
    share = len(toxic) / (len(ordinary) + len(toxic))
    at = np.flatnonzero(held[1] * len(ordinary) > ratio * held[0] * len(toxic))
    o, t = held[0][at].astype(np.float64), held[1][at].astype(np.float64)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0)

    et, eo = (o + t) * share, (o + t) * (1 - share)
    out[at] = 2 * (part(t, et) + part(o, eo) + part(len(toxic) - t, len(toxic) - et) + part(len(ordinary) - o, len(ordinary) - eo))
    return out


def toxic_passages(ordinary: list[list[str]], toxic: list[list[str]], least: float = 16.0, ratio: float = 5.0) -> list[bytes]:
    """All runs of toxic texts that are covered by n-grams whose contrast is over ``least``,
    4 standard deviations.  Runs are bytes, so scripts without spaces have them too.
    Near copies, given as groups, are counted once."""
    texts = [t for group in toxic for t in group]
    marks = [np.zeros(len(_data(t)) + 1, np.int32) for t in texts]
    for n in GRAMS:
        high = _contrast(ordinary, toxic, n, ratio) > least
        for text, mark in zip(texts, marks, strict=True):
            at = np.flatnonzero(high[_codes(_data(text), n)])
            mark[at] += 1
            mark[at + n] -= 1
    out = []
    for text, mark in zip(texts, marks, strict=True):
        data, inside = _data(text), np.cumsum(mark) > 0
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        out += [data[i:j] for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return out


def trained(size: int, samples: list[bytes], **how) -> bytes:
    """A dictionary of at most ``size`` bytes."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b" ".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    odds: np.ndarray = field(default_factory=lambda: np.zeros(HIGHEST - LOWEST + 1))
    weights: tuple[float, ...] = (0.0, 0.0, -40.0)  # of evidence, of log(windows), bias

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _compressors(self):
        if "_press" not in self.__dict__:

            def one(content: bytes):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                # Matches of 3 bytes and optimal parsing, so that words of few letters count.
                how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
                d.precompute_compress(compression_params=how)
                return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress

            self._press = one(self.ordinary), one(self.toxic)
        return self._press

    def differences(self, text: str) -> np.ndarray:
        """For each window, the bytes that the toxic dictionary saves, as an index into odds."""
        plain, toxic = self._compressors()
        saved = np.fromiter((len(plain(w)) - len(toxic(w)) for w in windows(text)), np.int64)
        return np.clip(saved, LOWEST, HIGHEST) - LOWEST

    def evidence(self, differences: list[np.ndarray]) -> np.ndarray:
        """Per text the summed log odds of its windows, the log of their number, and 1."""
        return np.array([(self.odds[d].sum(), np.log1p(len(d)), 1.0) for d in differences], np.float64).reshape(-1, 3)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.toxic:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.evidence([self.differences(t) for t in texts]) @ np.array(self.weights), -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method with a little shrinkage; the last column is the bias."""
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-3 * w)
        w -= step * min(1, 2 / max(np.abs(step).max(), 1e-9))  # shortened, not bent
    return w


def dictionaries(ordinary: list[list[str]], toxic: list[list[str]], dictionary_bytes: int = 65536, toxic_bytes: int = TOXIC_BYTES, most_windows: int = 60_000) -> Model:
    """A model with trained dictionaries and no odds yet.  Of the ordinary windows at most
    about ``most_windows``, evenly spaced, train the larger dictionary."""
    samples = [w for group in ordinary for t in group for w in windows(t, 64)]
    base = trained(dictionary_bytes, samples[:: max(1, len(samples) // most_windows)], level=3)
    # Training skips what it has; different passages in no order keep it going.
    passages = list(dict.fromkeys(toxic_passages(ordinary, toxic)))
    np.random.default_rng(1).shuffle(passages)
    return Model(base, trained(toxic_bytes, passages, k=24, d=8, level=3) + b" " + base) if passages else Model(base, base)


def train(toxic: list[str], ordinary: list[str], share: float | None = None) -> Model:
    """``share``: of toxic texts where the scores are to be used, for the logistic's bias;
    None: as in the training rows."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))  # copies teach nothing
    if not toxic or not ordinary:
        return Model()
    parts = groups(ordinary), groups(toxic)
    model = dictionaries(*parts)
    if model.toxic == model.ordinary:  # no passage stands out
        return Model()
    differences: list[list[np.ndarray]] = [[], []]
    for fold in range(FOLDS):
        rest = dictionaries(*([g for k, g in enumerate(part) if k % FOLDS != fold] for part in parts))
        for part, got in zip(parts, differences):
            got += [rest.differences(t) for group in part[fold::FOLDS] for t in group]
    size = HIGHEST - LOWEST + 1
    seen = [np.bincount(np.concatenate(d), minlength=size) + 0.5 for d in differences]
    model.odds = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    x = np.concatenate([model.evidence(d) for d in differences])
    y = np.concatenate([np.zeros(len(differences[0])), np.ones(len(differences[1]))])
    weights = _logistic(x, y)
    if share is not None and 0 < share < 1:
        weights[-1] += np.log(share / (1 - share)) - np.log(len(differences[1]) / len(differences[0]))
    model.weights = tuple(weights.tolist())
    return model


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learned from."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 1500, most_ordinary: int = 3000, most_signs: int = 1 << 16) -> Model:
    """Fit on at most so many labelled texts of each class (by id hash), held-out rows
    aside.  Of a text with over ``most_signs`` signs that many are used, in 64 pieces spread
    evenly over it.  The texts come to the driver: about 15 MB at usual lengths."""
    rows = labelled(docs, labels, "toxic", {1: most_toxic, 0: most_ordinary}, where=~held_out())
    size = F.length("text")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.substring("text", (k * size / 64).cast("int") + 1, F.lit(most_signs // 64)))
    text = F.when(size > most_signs, F.array_join(pieces, " ")).otherwise(F.col("text")).alias("text")
    got = sorted((r.doc_id, r.y, r.text) for r in rows.select("doc_id", "y", text).collect())
    shares = dict(labels.where(~held_out()).where("toxic IN (0, 1)").groupBy("toxic").count().collect())
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    return train([t for _, y, t in got if y], [t for _, y, t in got if not y], share=share)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Per document whether it is held out, its score and the verdict."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                s = model.scores(texts)
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return typed.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents not judged toxic, with all their columns, in one narrow pass."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            keep = [model.scores(texts) < threshold for _, texts in slices(batch, "text")]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
