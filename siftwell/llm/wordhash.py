"""Vectorised word cutting and hashing over many texts at once, and a table from word hashes to rows.

Texts are joined into one array of code points. Word bounds and 64-bit word hashes then come from a few numpy
passes, so Python runs once per *new* word instead of once per word. Two words are taken as equal when their 64-bit
hashes are: among ten million different words the chance that any two meet is under 1e-5.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Unicode White_Space: fixed values.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PERIOD = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _char_values() -> np.ndarray:
    return mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@functools.cache
def _place_values() -> np.ndarray:
    return mixed(np.arange(7, 7 + _PERIOD, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


@functools.cache
def char_classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and where each begins (one more entry: the end)."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=ends[1:])
    return cp, ends


def span_hashes(cp: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash (never 0) of each span; spans of positive length that follow each other without overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[::2], bounds[1::2] = starts, starts + lengths
    place = np.arange(len(cp)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(cp)]))
    place &= _PERIOD - 1
    values = _char_values()[cp] * _place_values()[place]
    last = bounds[-1] == len(cp)
    sums = np.add.reduceat(values, bounds[:-1] if last else bounds)[::2]
    return np.maximum(mixed(sums + lengths.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), np.uint64(1))


def ascii_spaces(cp: np.ndarray) -> np.ndarray:
    return (cp == 0x20) | ((cp >= 0x9) & (cp <= 0xD))


def lowered(cp: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, nothing else."""
    return np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)


def words_between(gaps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the runs without gaps inside each text, and the place of each text's first run."""
    gap = np.r_[gaps, True]
    first = np.zeros(len(gap), bool)
    first[ends] = True
    opens = ~gap
    opens[1:] &= gap[:-1] | first[1:]
    starts = np.flatnonzero(opens)
    stops = np.flatnonzero(gap | first)
    stop = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
    return starts, stop - starts, np.searchsorted(starts, ends)


def space_words(cp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words between ASCII white space."""
    return words_between(ascii_spaces(cp), ends)


def pattern_pieces(cp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same cut as the byte-level pattern (contractions, letters, numbers, others, white space) makes.

    Every code point belongs to one piece. Returns starts, lengths and the place of each text's first piece.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    kind = char_classes()[cp]
    first = np.zeros(n + 1, bool)
    first[ends] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last white space before something else stands apart from the run before it
    followed = np.zeros(n, bool)
    followed[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    starts = change | followed
    # a plain blank before a word, number or mark belongs to that piece
    led = np.zeros(n, bool)
    led[1:] = followed[:-1] & (cp[:-1] == 0x20)
    starts &= ~led
    for i in np.flatnonzero((cp == 0x27) & starts).tolist():  # an apostrophe that opens a piece of its own
        tail = cp[i + 1 : i + 3].tolist()
        stop = next((k for k in (1, 2) if i + k >= n or first[i + k]), 3)
        tail = tail[: stop - 1]
        size = 1 if tail and chr(tail[0]) in "stmd" else 2 if len(tail) == 2 and chr(tail[0]) + chr(tail[1]) in ("re", "ve", "ll") else 0
        if size:
            starts[i + 1] = False
            if size == 2:
                starts[i + 2] = False
            if i + 1 + size < n:
                starts[i + 1 + size] |= kind[i + size] == kind[i + 1 + size]
    at = np.flatnonzero(starts)
    return at, np.diff(np.r_[at, n]), np.searchsorted(at, ends)


class WordTable:
    """Word hash -> row number, for all hashes of a step at once; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.size = most, 0
        self._room(1 << 16)

    def _room(self, slots: int) -> None:
        self.keys, self.rows = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.shift = np.uint64(64 - slots.bit_length() + 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where it is not held."""
        mask, at = len(self.keys) - 1, self._slot(h)
        held = self.keys[at]
        out = np.where(held == h, self.rows[at], np.int32(-1))
        left = np.flatnonzero((held != h) & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            held = self.keys[at[left]]
            same = held == h[left]
            out[left[same]] = self.rows[at[left[same]]]
            left = left[~same & (held != 0)]
        return out

    def add(self, h: np.ndarray, rows: np.ndarray) -> None:
        """``h``: different hashes that are not held."""
        if 2 * (self.size + len(h)) > len(self.keys):
            old = self.keys != 0
            h, rows = np.r_[self.keys[old], h], np.r_[self.rows[old], rows.astype(np.int32)]
            self._room(1 << int(4 * len(h)).bit_length())
            self.size = 0
        mask, at, left = len(self.keys) - 1, self._slot(h), np.arange(len(h))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = h[free]
            done = self.keys[at[left]] == h[left]
            self.rows[at[left[done]]] = rows[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & mask
        self.size += len(h)

    def resolve(self, h: np.ndarray, learn: Callable[[np.ndarray, int], None], forget: Callable[[], None]) -> np.ndarray:
        """The row of each hash. ``learn(places, base)`` must append what belongs to the words at ``places`` of ``h`` as rows
        from ``base`` on; ``forget()`` must drop all rows, which happens between steps when the table is full."""
        if self.size > self.most:
            self.size = 0
            self._room(1 << 16)
            forget()
        rows = self.find(h)
        lost = np.flatnonzero(rows < 0)
        if len(lost):
            new, at, back = np.unique(h[lost], return_index=True, return_inverse=True)
            base = self.size
            learn(lost[at], base)
            self.add(new, np.arange(base, base + len(new), dtype=np.int32))
            rows[lost] = base + back
        return rows


def spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices first[0].. of length[0], then first[1].., and so on, as one array."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total) + np.repeat(first - before, length)
