"""Words of texts as numpy arrays: where they stand, to which text they belong, their hashes.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return; in UTF-8 these bytes occur in no other character.  Hashes have 64 bits, take A-Z as
a-z if asked, and depend on the bytes alone, so they agree between tasks and runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PERIOD = 1 << 12
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` odd pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) * _STEP) | np.uint64(1)


_BYTE = seeds(256, 1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_POWER = seeds(_PERIOD, 2)


@dataclass
class Words:
    start: np.ndarray  # byte position of each word
    end: np.ndarray
    at: np.ndarray  # text i has the words at[i] to at[i + 1] - 1

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts())


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    after[edge - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """64-bit hashes of the byte spans, which must be disjoint, ordered and not empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    first = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    taken = data[within + np.repeat(start, length)]
    power = _POWER[within % _PERIOD]
    if length.max() > _PERIOD:  # every round of the table has its own powers
        power = power + (within // _PERIOD).astype(np.uint64) * (_STEP << np.uint64(1))
    values = (_FOLDED if fold_case else _BYTE)[taken] * power
    return mix(np.add.reduceat(values, first) + length.astype(np.uint64) * _STEP)


def windows(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within one text, and the number of the first word of each."""
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.ones(total, bool)
    for edge in range(1, n):  # a run that starts up to n - 1 words before a text's first word crosses into it
        cut = at[1:-1] - edge
        whole[cut[(cut >= 0) & (cut < total)]] = False
    factor = seeds(n, 3 + n)
    value = np.zeros(total, np.uint64)
    for j in range(n):
        value += hashes[j:j + total] * factor[j]
    where = np.flatnonzero(whole)
    return mix(value[where]), where
