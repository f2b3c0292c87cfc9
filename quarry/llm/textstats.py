"""Word hashes of many texts at once, for rules and shingles.

A word is a run of code points other than space and the five controls 0x09 to 0x0D.
Hashes have 64 bits; different words or windows are taken as equal only if those collide.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from quarry.llm.pretoken import code_points, mix, span_hashes


@cache
def separators() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def join(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, and where each text ends
    (its line feed's place)."""
    cp = code_points("\n".join(texts) + "\n")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return cp, np.cumsum(sizes + 1) - 1


def words(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words."""
    edge = np.diff(np.concatenate([[True], separators()[cp], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return starts, ends, span_hashes(cp, starts, ends)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` words in a row (over document borders too)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            out *= np.uint64(0x9DDFEA08EB382D69)
            out += hashes[k : k + n]
    return mix(out)
