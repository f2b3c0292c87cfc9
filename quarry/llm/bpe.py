"""BPE encoding and decoding by contiguous rank arrays.

A short word is held as two contiguous arrays: the ids of its parts (whose boundaries are
the array's columns) and the rank of each neighbouring pair.  The smallest rank is sought,
the boundary between its two parts deleted, and the ranks left and right of it refreshed,
until no pair has a rank.  Words of equal length go through this together, one row each, so
a step is a handful of array operations.  Long words (over ``SHORT`` bytes), where a repeated
scan would be quadratic, take a linked list and a heap with the same outcome.

Edge cases: a null text counts as empty; an empty text has no ids; strings of special
tokens inside a text become those tokens, as the tokenizers library has it; ids that the
vocabulary lacks raise an error when decoded.
"""

from __future__ import annotations

import heapq
import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.hf import _byte_signs
from quarry.llm.pretoken import BatchEncoder
from quarry.runtime import bound_batches

SHORT = 48
NONE = np.uint32(0xFFFFFFFF)


class RankBPE:
    """A byte-level vocabulary file: merge ranks for encoding, byte strings for decoding."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        vocab, byte_of = model["vocab"], {sign: b for b, sign in _byte_signs_all().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t.get("special")}
        names = {i: t for t, i in vocab.items()}
        content = {i: bytes(byte_of[c] for c in t) for i, t in names.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(content) + 1
        lengths = np.array([len(content.get(i, b"")) for i in range(size)], np.int64)
        self.known = np.array([i in content for i in range(size)])
        self.bytes = np.frombuffer(b"".join(content.get(i, b"") for i in range(size)), np.uint8)
        self.byte_at, self.byte_len = np.cumsum(lengths) - lengths, lengths
        self.of_byte = np.array([vocab[s] for _, s in sorted(_byte_signs_all().items())], np.uint32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.uint64)
        into = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        # The first mention of a pair has its rank.
        order = np.argsort(key, kind="stable")
        first = np.append(True, key[order][1:] != key[order][:-1])
        self.key, self.rank, self.into = key[order][first], order[first].astype(np.uint32), into
        self.ranks = dict(zip(self.key.tolist(), self.rank.tolist()))
        self.encoder = BatchEncoder(self.words, self.special)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def words(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in items]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(length) - length
        parts = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        count = np.zeros(len(raw), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(length[length <= SHORT]):
            rows = np.flatnonzero(length == n)
            ids, live = self._short(parts[starts[rows][:, None] + np.arange(n)])
            count[rows] = live
            done.append((rows, ids))
        long = {int(k): self._long(parts[starts[k] : starts[k] + length[k]].tolist()) for k in np.flatnonzero(length > SHORT)}
        for k, ids in long.items():
            count[k] = len(ids)
        out = np.empty(int(count.sum()), np.uint32)
        at = np.cumsum(count) - count
        for rows, ids in done:
            inside = np.arange(ids.shape[1]) < count[rows][:, None]
            out[(at[rows][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
        for k, ids in long.items():
            out[at[k] : at[k] + len(ids)] = ids
        return out, count

    def _short(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """parts: a row for each word, a column for each part.  Returns the parts left, at
        the rows' beginnings, and how many there are."""
        rows, n = parts.shape
        result, live = parts.copy(), np.full(rows, n)
        if n < 2:
            return result, live
        at = np.arange(rows)  # words still being merged
        rank = self.pair_ranks(parts[:, :-1], parts[:, 1:])  # rank[i]: of parts i and i + 1
        column = np.arange(n)
        while len(at):
            best = rank.argmin(axis=1)
            lowest = rank[np.arange(len(at)), best]
            going = lowest != NONE
            if not going.all():
                result[at[~going]] = parts[~going]
                at, parts, rank, best, lowest = at[going], parts[going], rank[going], best[going], lowest[going]
                if not len(at):
                    break
            here = np.arange(len(at))
            # The boundary after part `best` goes: what lies right of it moves one left.
            shift = column[:-1] > best[:, None]
            parts[here, best] = self.into[lowest]
            parts[:, :-1] = np.where(shift, parts[:, 1:], parts[:, :-1])
            shift = column[: n - 2] >= best[:, None]
            rank[:, :-1] = np.where(shift, rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            live[at] -= 1
            size = live[at]
            for place in (best - 1, best):  # the pairs that the new part stands in
                ok = (place >= 0) & (place + 1 < size)
                r, p = here[ok], place[ok]
                rank[r, p] = self.pair_ranks(parts[r, p], parts[r, p + 1])
                r, p = here[~ok & (place >= 0)], place[~ok & (place >= 0)]
                rank[r[p < n - 1], p[p < n - 1]] = NONE
        return result, live

    def _long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        alive = [True] * n
        into = self.into
        get = self.ranks.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i] << 32) | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = int(into[r]), False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (s := get((parts[x] << 32) | parts[y])) is not None:
                    heapq.heappush(heap, (s, x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, alive) if ok]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if len(ids) and (int(ids.max()) >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id isn't in the vocabulary")
        size = self.byte_len[ids]
        stops = np.cumsum(size)
        take = np.repeat(self.byte_at[ids] - stops + size, size)
        take += np.arange(len(take))
        return self.bytes[take].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """As the byte-level decoder: bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _byte_signs_all() -> dict[int, str]:
    return {b: chr(b) for b in range(256)} | _byte_signs()


@cache
def load(path: str) -> RankBPE:
    return RankBPE(path)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """(row offsets, texts) of about ``most`` code points each; null texts are empty."""
    texts: list[str] = []
    begin = held = 0
    values = batch.column(column)
    for k in range(len(values)):
        text = values[k].as_py() or ""
        texts.append(text)
        held += len(text)
        if held >= most:
            yield slice(begin, k + 1), texts
            texts, begin, held = [], k + 1, 0
    if texts:
        yield slice(begin, len(values)), texts


def encode_column(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add a column of ids (array<int>).  Narrow: no shuffle; a worker holds one slice of a
    batch and its word memo."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for rows, texts in slices(batch, text):
                ids, sizes = bpe.encoder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], names=[*part.schema.names, out])

    bound_batches(df.sparkSession)
    rest = df.drop(out)
    return rest.mapInArrow(run, _ddl(rest, f"`{out}` array<int>"))


def decode_column(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that a column of ids (array<int>; null: null) decodes to."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    bound_batches(df.sparkSession)
    rest = df.drop(out)
    return rest.mapInArrow(run, _ddl(rest, f"`{out}` string"))


def _ddl(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Per document the digests of its ids and of the text they decode to, in one pass:
    what the two column operators make, without shipping ids between processes."""
    import hashlib

    bound_batches(df.sparkSession)

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                ids, sizes = bpe.encoder.encode(texts)
                raw, content = memoryview(ids.astype("<u4")).cast("B"), bpe.decode_bytes(ids)
                stops = np.cumsum(sizes)
                ends = np.append(0, np.cumsum(bpe.byte_len[ids]))
                coded, decoded = [], []
                for a, b in zip((stops - sizes).tolist(), stops.tolist()):
                    coded.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                    own = content[ends[a] : ends[b]].decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(own.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[rows.start : rows.stop], pa.array(sizes), pa.array(coded), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
