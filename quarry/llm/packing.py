"""Sum-of-squares online packing of token sequences.

Each task packs its own stream of documents in one narrow pass.  A level array counts the
partly filled windows at each fill level.  A document longer than a window first yields
full windows; what is left goes to the level (or a new window) for which the sum of squared
counts comes out smallest, ties to the fuller window.  A window that fills up leaves.  At a
stream's end the windows still open are closed up: the pieces of the emptiest are cut to
fill the gaps of the fullest, so that one window per task at most stays short.

Sequence ids are unique over the table: the task's number in the high bits, a counter in
the low 40.  The same input split gives the same packing when a task runs again.

Edge cases: null text is empty; an empty document is its end id alone; equal documents are
packed like any others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import slices
from quarry.llm.hf import encoder
from quarry.runtime import bound_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class SumOfSquares:
    """Windows hold pieces (document key, start, ids)."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # open windows at each level
        self.open: list[list[list]] = [[] for _ in range(size + 1)]

    def place(self, piece) -> list | None:
        """Put a piece in; returns the window if that fills it."""
        need = len(piece[2])
        if need == self.size:
            return [piece]
        # Moving a window from level g to g + need changes the sum of squares by
        # -2 N(g) + 2 N(g + need) + 2; filling it up by -2 N(g) + 1; a new one by 2 N(need) + 1.
        count = self.count
        levels = np.arange(1, self.size - need + 1)
        change = 2 - 2 * count[levels] + 2 * count[levels + need]
        if len(change):
            change[-1] = 1 - 2 * count[self.size - need]
        change = np.where(count[levels] > 0, change, np.iinfo(np.int64).max)
        new = 2 * count[need] + 1
        best = len(change) - 1 - int(change[::-1].argmin()) if len(change) else -1
        if best >= 0 and change[best] <= new:
            level = int(levels[best])
            window = self.open[level].pop()
            count[level] -= 1
        else:
            level, window = 0, []
        window.append(piece)
        level += need
        if level == self.size:
            return window
        self.open[level].append(window)
        count[level] += 1
        return None

    def close(self):
        """The windows left, the emptiest cut up to fill the fullest."""
        left = [(level, window) for level in range(self.size, 0, -1) for window in self.open[level]]
        self.__init__(self.size)
        low, high = 0, len(left) - 1
        while low <= high:
            level, window = left[low]
            gap = self.size - level
            while gap and low < high:
                at, donor = left[high]
                key, start, ids = donor.pop()
                take = min(gap, len(ids))
                window.append((key, start + len(ids) - take, ids[len(ids) - take :]))
                if take < len(ids):
                    donor.append((key, start, ids[: len(ids) - take]))
                gap -= take
                left[high] = (at - take, donor)
                if not donor:
                    high -= 1
            yield window
            low += 1


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048) -> DataFrame:
    """A row per piece: whose it is, where it lies in its document and in which sequence."""
    bound_batches(docs.sparkSession)

    def run(batches):
        encode, packer = encoder(tokenizer).encode, SumOfSquares(size)
        base, made = TaskContext.get().partitionId() << 40, 0
        out: list[tuple] = []

        def emit(window):
            nonlocal made
            offset, total = 0, sum(len(ids) for _, _, ids in window)
            for (doc, tokens), start, ids in window:
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, base + made, offset, total))
                offset += len(ids)
            made += 1

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[c.split()[0] for c in SCHEMA.split(", ")])
            out.clear()
            return rows

        for batch in batches:
            for rows, texts in slices(batch, "text"):
                ids, count = encode(texts)
                stop = 0
                for doc, n in zip(batch.column("doc_id")[rows.start : rows.stop].to_pylist(), count.tolist()):
                    own = np.append(ids[stop : stop + n], np.uint32(end_id)).astype(np.uint32)
                    stop += n
                    for start in range(0, n + 1, size):
                        if full := packer.place(((doc, n + 1), start, own[start : start + size].copy())):
                            emit(full)
                if len(out) >= 4096:
                    yield flush()
        for window in packer.close():
            emit(window)
        if out:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
