"""Token output as one wavelet matrix per segment, in one compressed file per shard.

A shard's file is a Parquet file with a row per segment (about ``segment_tokens`` ids, cut
between documents); its ``matrix`` cell is self-contained: a header, then bit-planes, the
highest bit first, in zstandard-compressed blocks of 2**16 bits with a rank directory.
``WaveletMatrix`` reads it: access, rank, select, counting in a range, occurrence lookup
and bulk decoding.  Point reads decompress only the blocks they touch.  ``Shard`` does the
same over all segments of a file, and ``occurrences`` over all files at once.

Spark writes the files, so any file system it knows serves, and a task that runs again
replaces its file.

Edge cases: null text is empty; an empty document has just its end id; documents with
equal ids are ordered by their text's hash; null ids come first; an empty table gives no
file rows and no result rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import slices
from quarry.llm.hf import encoder
from quarry.runtime import bound_batches, scratch_path

BLOCK = 1 << 16
MAGIC = b"QWM1"


class WaveletMatrix:
    """A sequence of ids as bit-planes.  Plane k holds bit (bits-1-k) of each id, in the
    order that sorting stably by the bits above leaves."""

    def __init__(self, raw: bytes):
        magic, self.bits, self.n = struct.unpack_from("<4sIQ", raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.raw = raw
        self.blocks = -(-self.n // BLOCK)
        at = 16
        self.zeros = np.frombuffer(raw, "<u8", self.bits, at).astype(np.int64)
        at += 8 * self.bits
        cells = self.bits * self.blocks
        self.ones_before = np.frombuffer(raw, "<u4", cells, at).reshape(self.bits, self.blocks).astype(np.int64)
        at += 4 * cells
        size = np.frombuffer(raw, "<u4", cells, at).astype(np.int64)
        at += 4 * cells
        self.place = (at + np.cumsum(size) - size).reshape(self.bits, self.blocks)
        self.size = size.reshape(self.bits, self.blocks)
        self._open = zstandard.ZstdDecompressor()
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def build(ids: np.ndarray) -> bytes:
        n = len(ids)
        bits = max(1, int(ids.max()).bit_length()) if n else 1
        values = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        press = zstandard.ZstdCompressor(level=1)
        zeros, before, blobs = [], [], []
        for k in reversed(range(bits)):
            bit = ((values >> k) & 1).astype(bool)
            packed = np.packbits(bit)
            count, step = 0, BLOCK // 8
            for a in range(0, len(packed), step):
                block = packed[a : a + step]
                before.append(count)
                count += int(np.bitwise_count(block).sum())
                blobs.append(press.compress(block.tobytes()))
            zeros.append(n - count)
            values = np.concatenate([values[np.flatnonzero(~bit)], values[np.flatnonzero(bit)]])
        head = struct.pack("<4sIQ", MAGIC, bits, n) + np.array(zeros, "<u8").tobytes()
        return head + np.array(before, "<u4").tobytes() + np.array([len(b) for b in blobs], "<u4").tobytes() + b"".join(blobs)

    def _block(self, plane: int, block: int) -> np.ndarray:
        key = (plane, block)
        if key not in self._kept:
            if len(self._kept) > 256:
                self._kept.clear()
            a = int(self.place[key])
            self._kept[key] = np.frombuffer(self._open.decompress(self.raw[a : a + int(self.size[key])]), np.uint8)
        return self._kept[key]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        block, rest = divmod(i, BLOCK)
        data = self._block(plane, block)
        whole, over = divmod(rest, 8)
        ones = int(self.ones_before[plane, block]) + int(np.bitwise_count(data[:whole]).sum())
        return ones + (int(data[whole] >> (8 - over)).bit_count() if over else 0)

    def _bit(self, plane: int, i: int) -> int:
        block, rest = divmod(i, BLOCK)
        return int(self._block(plane, block)[rest >> 3] >> (7 - (rest & 7))) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            bit, ones = self._bit(plane, i), self._ones(plane, i)
            i = int(self.zeros[plane]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _narrow(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        if value < 0 or value.bit_length() > self.bits:
            return 0, 0
        for plane in range(self.bits):
            a, b = self._ones(plane, lo), self._ones(plane, hi)
            if value >> (self.bits - 1 - plane) & 1:
                lo, hi = int(self.zeros[plane]) + a, int(self.zeros[plane]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in [lo, hi)."""
        a, b = self._narrow(value, lo, self.n if hi is None else min(hi, self.n))
        return max(0, b - a)

    def rank(self, value: int, i: int) -> int:
        return self.count(value, 0, i)

    def select(self, value: int, k: int) -> int:
        """Position of occurrence number k (from 0) of an id."""
        first, stop = self._narrow(value, 0, self.n)
        if not 0 <= k < stop - first:
            raise IndexError(k)
        at = first + k
        for plane in reversed(range(self.bits)):
            if value >> (self.bits - 1 - plane) & 1:
                at = self._select_bit(plane, 1, at - int(self.zeros[plane]))
            else:
                at = self._select_bit(plane, 0, at)
        return at

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        before = self.ones_before[plane] if bit else np.arange(self.blocks) * BLOCK - self.ones_before[plane]
        block = int(np.searchsorted(before, k, "right")) - 1
        flags = np.unpackbits(self._block(plane, block))[: min(BLOCK, self.n - block * BLOCK)]
        return block * BLOCK + int(np.flatnonzero(flags == bit)[k - int(before[block])])

    def locate(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """All ids in order: from the lowest plane up, each plane's split is undone."""
        if not self.n:
            return np.zeros(0, np.uint32)
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        kind = values.dtype.type
        for plane in reversed(range(self.bits)):
            packed = np.concatenate([np.frombuffer(self._open.decompress(self.raw[a : a + s]), np.uint8) for a, s in zip(self.place[plane].tolist(), self.size[plane].tolist())])
            bit = np.unpackbits(packed)[: self.n].view(bool)
            zeros = int(self.zeros[plane])
            back = np.empty_like(values)
            back[np.flatnonzero(~bit)] = values[:zeros]
            back[np.flatnonzero(bit)] = values[zeros:] | kind(1 << (self.bits - 1 - plane))
            values = back
        return values.astype(np.uint32)


class Shard:
    """The ids of one shard's file as one sequence; segments are (start, matrix bytes).
    A segment's bytes are parsed when first touched."""

    def __init__(self, segments: list[tuple[int, bytes]]):
        segments = sorted(segments, key=lambda s: s[0])
        self.starts = np.array([a for a, _ in segments], np.int64)
        self._raw = [raw for _, raw in segments]
        self._open: dict[int, WaveletMatrix] = {}
        self.n = int(self.starts[-1]) + self._at(len(segments) - 1).n if segments else 0

    def _at(self, k: int) -> WaveletMatrix:
        if k not in self._open:
            self._open[k] = WaveletMatrix(self._raw[k])
        return self._open[k]

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = int(np.searchsorted(self.starts, i, "right")) - 1
        return self._at(k).access(i - int(self.starts[k]))

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in [lo, hi)."""
        hi = self.n if hi is None else min(hi, self.n)
        total = 0
        for k, start in enumerate(self.starts.tolist()):
            m = self._at(k)
            a, b = max(0, lo - start), min(m.n, hi - start)
            total += m.count(value, a, b) if a < b else 0
        return total

    def rank(self, value: int, i: int) -> int:
        return self.count(value, 0, i)

    def select(self, value: int, k: int) -> int:
        """Position of occurrence number k (from 0) of an id."""
        if k >= 0:
            for j, start in enumerate(self.starts.tolist()):
                here = self._at(j).count(value)
                if k < here:
                    return start + self._at(j).select(value, k)
                k -= here
        raise IndexError(k)

    def locate(self, value: int) -> list[int]:
        return [start + i for k, start in enumerate(self.starts.tolist()) for i in self._at(k).locate(value)]

    def decode(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(self._at(k).decode() for k in range(len(self._raw)))])


def open_shard(spark, path: str, shard: int) -> Shard:
    """A shard's file on the driver, compressed as it is."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path).where(F.col("shard") == shard).select("shard_start", "matrix")
    return Shard([(r.shard_start, bytes(r.matrix)) for r in rows.collect()])


def occurrences(spark, path: str, value: int) -> DataFrame:
    """(shard, position) of every occurrence of an id in all shards, position within the
    shard; a task searches one segment at a time."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                at = np.array(WaveletMatrix(batch.column("matrix")[k].as_py()).locate(value), np.int64) + batch.column("shard_start")[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch.column("shard")[k].as_py(), np.int32)), pa.array(at)], names=["shard", "position"])

    bound_batches(spark)
    return spark.read.schema(FILE_SCHEMA).parquet(path).select("shard", "shard_start", "matrix").mapInArrow(run, "shard int, position long")


FILE_SCHEMA = "shard int, segment int, shard_start long, doc_ids array<long>, n_tokens array<long>, matrix binary"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str, segment_tokens: int = 1 << 20) -> str:
    """Encode the documents, range-partitioned by doc_id, and write a file per shard.

    One shuffle, of the texts.  A task holds one slice of texts and one segment's ids.
    The hash beside doc_id lets a very frequent id spread over several shards.
    """

    def run(batches):
        encode = encoder(tokenizer).encode
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        names, sizes, ids, held = [], [], [], 0

        def row():
            data = np.concatenate(ids)
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()), "shard_start": pa.array([start], pa.int64()), "doc_ids": pa.array([names], pa.list_(pa.int64())), "n_tokens": pa.array([sizes], pa.list_(pa.int64())), "matrix": pa.array([WaveletMatrix.build(data)], pa.binary())}
            )

        for batch in batches:
            for rows, texts in slices(batch, "text"):
                got, count = encode(texts)
                stops = np.cumsum(count)
                got = np.insert(got, stops, end_id)
                stops = stops + np.arange(1, len(stops) + 1)
                own = batch.column("doc_id")[rows.start : rows.stop].to_pylist()
                begin = done = 0
                while done < len(own):
                    # As many documents as bring the segment to its size, one at least.
                    upto = int(np.searchsorted(stops, begin + max(1, segment_tokens - held)))
                    upto = min(len(own), upto + 1)
                    end = int(stops[upto - 1])
                    names += own[done:upto]
                    sizes += (count[done:upto] + 1).tolist()
                    ids.append(got[begin:end])
                    held += end - begin
                    begin, done = end, upto
                    if held >= segment_tokens:
                        yield row()
                        start, segment = start + held, segment + 1
                        names, sizes, ids, held = [], [], [], 0
        if held:
            yield row()

    bound_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    dealt = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "text").mapInArrow(run, FILE_SCHEMA).write.option("compression", "none").parquet(path)
    return path


def read_digests(spark, path: str) -> DataFrame:
    """Per document, from the files: where its ids start among all, how many they are, and
    their checksum.  Only a total per shard reaches the driver."""
    bound_batches(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.select("shard", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).collect()
    begin, start = {}, 0
    for shard, n in sorted((r.shard, r.n) for r in totals):
        begin[shard], start = start, start + n

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                at = begin[batch.column("shard")[k].as_py()] + batch.column("shard_start")[k].as_py()
                size = np.array(batch.column("n_tokens")[k].as_py(), np.int64)
                raw = memoryview(WaveletMatrix(batch.column("matrix")[k].as_py()).decode().astype("<u4")).cast("B")
                stops = np.cumsum(size)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((stops - size).tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, pa.array(stops - size + at), pa.array(size), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    return read_digests(spark, write_shards(docs, tokenizer, end_id, scratch_path(spark, "wavelet")))
