"""Array-at-a-time word splitting shared by the tokenizer operators.

The split is that of the byte-level vocabulary's pattern: contractions, then runs of
letters, numbers or other signs with one leading space each, then white space.  Texts are
joined, turned into code points and classified by table; word starts then follow from
neighbouring classes, so no regular expression runs.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from functools import cache

import numpy as np
import pandas as pd

#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that split off after an apostrophe at a word's start.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points handled at a time.  Longer texts are cut where a word surely starts.
CHUNK = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15


@cache
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE_SPACE] = SPACE
    return out


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash multiplier and of its inverse modulo 2**64."""
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _MULTIPLIER, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]), dtype=np.uint64)
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points, in order of their starts.

    Polynomial over mixed code points, for groups of spans over CHUNK code points at a
    time, so that memory beyond the texts stays fixed; a span longer than that is hashed on
    its own."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        base = int(starts[k])
        upto = int(np.searchsorted(ends, base + CHUNK, "right"))
        if upto <= k:
            out[k] = int.from_bytes(hashlib.blake2b(cp[base : ends[k]].tobytes(), digest_size=8).digest(), "little")
            k += 1
            continue
        stop = int(ends[upto - 1])
        out[k:upto] = _hash_group(cp[base:stop], starts[k:upto] - base, ends[k:upto] - base)
        k = upto
    return out


def _hash_group(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(CHUNK)
    with np.errstate(over="ignore"):
        value = cp.astype(np.uint64)
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((value + np.uint64(0x51ED)) * (value | np.uint64(0xA5A50001)) * up[: len(cp)], dtype=np.uint64, out=total[1:])
        out = (total[ends] - total[starts]) * down[starts]
        out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def word_starts(cp: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Offsets at which words start; ``firsts`` are the offsets of non-empty texts."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    space = kind == SPACE
    start = np.empty(n, bool)
    start[0] = True
    is_first = np.zeros(n + 1, bool)
    is_first[firsts] = True
    is_first[n] = True
    before_space, here_space = space[:-1], space[1:]
    follows = np.zeros(n, bool)  # a sign that isn't space follows in the same text
    follows[:-1] = ~here_space & ~is_first[1:n]
    start[1:] = np.where(
        here_space,
        ~before_space | follows[1:],
        np.where(before_space, cp[:-1] != 0x20, kind[1:] != kind[:-1]),
    )
    start |= is_first[:n]
    marks = np.flatnonzero((cp == 0x27) & start)
    if len(marks):
        last = np.append(firsts[1:], n)[np.searchsorted(firsts, marks, "right") - 1]  # end of the mark's text
        done = np.zeros(len(marks), bool)
        for ending in CONTRACTIONS:
            fits = ~done & (marks + len(ending) < last)
            for k, sign in enumerate(ending, 1):
                fits[fits] = cp[marks[fits] + k] == ord(sign)
            done |= fits
            at = marks[fits]
            start[at + 1] = False
            after = at + 1 + len(ending)
            start[after[after < n]] = True
    return np.flatnonzero(start)


def pieces(text: str, size: int = CHUNK):
    """Cut a long text where a word surely starts: at a space after a sign that isn't one."""
    at, table = 0, classes()
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and table[ord(text[cut - 1])] == SPACE:
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def grouped(texts: list[str], size: int = CHUNK):
    """Lists of (document number, piece) of about ``size`` code points each."""
    group, held = [], 0
    for k, text in enumerate(texts):
        for part in pieces(text, size) if len(text) > size else (text,):
            group.append((k, part))
            held += len(part)
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, distinct values and the first place of each."""
    codes, values = pd.factorize(hashes)
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, values, first


class BatchEncoder:
    """Encode many texts, each distinct word once.

    ``encode_words`` maps words (strings) to their ids, one after the other, and how many
    each has.  The memo holds word hashes in a sorted array (14 bytes a word beside the
    ids); it starts anew beyond ``MEMO`` words.  Words of over ``LONG`` code points
    aren't hashed and never enter it.
    """

    LONG = 256
    MEMO = 3_000_000

    def __init__(self, encode_words, special: dict[str, int] | None = None):
        self.encode_words = encode_words
        self.special = special or {}
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.uint32)
        self.size = np.zeros(0, np.uint16)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        marks = [s for s in self.special if any(s in t for t in texts)]
        if not marks:
            return self._plain(texts)
        segments, owner, ends = [], [], []
        for k, text in enumerate(texts):
            for segment, mark in _split_marks(text, marks):
                segments.append(segment)
                owner.append(k)
                ends.append(self.special[mark] if mark else -1)
        ids, sizes = self._plain(segments)
        ends, owner = np.array(ends), np.array(owner)
        stops = np.cumsum(sizes)
        ids = np.insert(ids, stops[ends >= 0], ends[ends >= 0].astype(np.uint32))
        return ids, np.bincount(owner, weights=sizes + (ends >= 0), minlength=len(texts)).astype(np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = [], np.zeros(len(texts), np.int64)
        for group in grouped(texts):
            owner = np.array([k for k, _ in group])
            lengths = np.array([len(p) for _, p in group], np.int64)
            joined = "".join(p for _, p in group)
            if not joined:
                continue
            cp = code_points(joined)
            stops = np.cumsum(lengths)
            firsts = (stops - lengths)[lengths > 0]
            starts = word_starts(cp, firsts)
            ends = np.append(starts[1:], len(cp))
            ids, per_word = self._words(joined, cp, starts, ends)
            of = owner[np.searchsorted(stops, starts, "right")]
            sizes += np.bincount(of, weights=per_word, minlength=len(texts)).astype(np.int64)
            out.append(ids)
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), sizes

    def _words(self, joined: str, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = span_hashes(cp, starts, ends)
        long = np.flatnonzero(ends - starts > self.LONG)
        hashes[long] = np.arange(len(long), dtype=np.uint64)  # each is its own
        codes, values, first = distinct(hashes)
        if len(self.keys) > self.MEMO or self.used > 1 << 31:
            self._reset()
        order = np.argsort(values)
        place = np.empty(len(values), np.int64)
        place[order] = np.searchsorted(self.keys, values[order])
        short = ends[first] - starts[first] <= self.LONG
        old = short & (place < len(self.keys))
        old[old] = self.keys[place[old]] == values[old]
        fresh = order[~old[order]]
        words = [joined[a:b] for a, b in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())]
        found, count = self.encode_words(words)
        at, size = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
        at[old], size[old] = self.at[place[old]], self.size[place[old]]
        while self.used + len(found) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(found)] = found
        at[fresh], size[fresh] = np.cumsum(count) - count + self.used, count
        keep = fresh[short[fresh]]
        if len(keep):
            self.used += len(found)
            to = place[keep]
            self.keys = np.insert(self.keys, to, values[keep])
            self.at = np.insert(self.at, to, at[keep].astype(np.uint32))
            self.size = np.insert(self.size, to, size[keep].astype(np.uint16))
        per_word = size[codes]
        stops = np.cumsum(per_word)
        take = np.repeat(at[codes] - stops + per_word, per_word)
        take += np.arange(len(take))
        return self.flat[take], per_word


def _split_marks(text: str, marks: list[str]):
    """(segment, special token after it or None), leftmost and then longest first."""
    at = 0
    while True:
        hits = [(p, -len(m), m) for m in marks if (p := text.find(m, at)) >= 0]
        if not hits:
            yield text[at:], None
            return
        p, _, m = min(hits)
        yield text[at:p], m
        at = p + len(m)
