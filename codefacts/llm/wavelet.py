"""A wavelet matrix over the character classes of a buffer of UTF-8 texts: rank of any class, counts of boundaries, and cuts.

Each byte has one of eight classes, so the matrix has three levels, highest bit first: a level keeps its bit of every byte,
and the next level has the bytes with a 0 before those with a 1, else in their order. The bits are packed into 64-bit words with the
number of ones before each word, so a rank takes one lookup and one population count a level, wherever it is asked for.

A class tells what a byte begins: nothing (it goes on with a character, or with a run of letters) or a unit. So the number of units
that begin before a place is a sum of ranks, and the k-th unit is found by bisection on that sum.
"""

from __future__ import annotations

import numpy as np

#: Goes on with a character; goes on with a run of letters; first letter of a run; digit; space; end of line; other ASCII; other.
CONTINUED, INNER, LETTER, DIGIT, SPACE, NEWLINE, ASCII, WIDE = range(8)
#: The classes that begin a character, and those that begin a token (a run of A-Z and a-z, or one other character).
CHARACTERS = (INNER, LETTER, DIGIT, SPACE, NEWLINE, ASCII, WIDE)
TOKENS = (LETTER, DIGIT, SPACE, NEWLINE, ASCII, WIDE)
LEVELS = 3


def _table() -> np.ndarray:
    kind = np.full(256, ASCII, np.uint8)
    kind[0x80:0xC0] = CONTINUED
    kind[0xC0:] = WIDE
    for low, high in (("A", "Z"), ("a", "z")):
        kind[ord(low) : ord(high) + 1] = LETTER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
    kind[0x0A] = NEWLINE
    return kind


_KIND = _table()


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte; a run of letters ends where its text ends."""
    kind = _KIND[data]
    letter = kind == LETTER
    inner = letter[1:] & letter[:-1]
    starts = offsets[(offsets > 0) & (offsets < len(data))]
    inner[starts - 1] = False
    kind[1:][inner] = INNER
    return kind


class WaveletMatrix:
    """Ranks over a sequence of classes below 2 ** LEVELS."""

    def __init__(self, kinds: np.ndarray):
        self._words, self._before, self._zeros = [], [], []
        for level in reversed(range(LEVELS)):
            bit = (kinds >> level) & 1
            packed = np.zeros(len(kinds) // 64 * 8 + 8, np.uint8)
            own = np.packbits(bit, bitorder="little")
            packed[: len(own)] = own
            words = packed.view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self._words.append(words)
            self._before.append(np.cumsum(ones) - ones)
            self._zeros.append(len(kinds) - int(ones.sum()))
            one = bit.view(bool)
            kinds = np.concatenate((kinds[~one], kinds[one]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self._before[level][word] + np.bitwise_count(self._words[level][word] & mask)

    def rank(self, kind: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many of kind stand in [first, end), for each pair of places."""
        for i, level in enumerate(reversed(range(LEVELS))):
            low, high = self._ones(i, first), self._ones(i, end)
            if kind >> level & 1:
                first, end = low + self._zeros[i], high + self._zeros[i]
            else:
                first, end = first - low, end - high
        return end - first

    def count(self, kinds: tuple[int, ...], first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many bytes of any of the kinds stand in [first, end). All kinds but a few are counted by those few."""
        others = set(range(2**LEVELS)) - set(kinds)
        if len(others) < len(kinds):
            return end - first - sum(self.rank(k, first, end) for k in others)
        return sum(self.rank(k, first, end) for k in kinds)

    def cut(self, kinds: tuple[int, ...], first: np.ndarray, end: np.ndarray, units: np.ndarray) -> np.ndarray:
        """For each [first, end), the place after its first `units` units, which begin at bytes of the kinds: where the next one begins, or end.

        Only what is still open is looked up: a place past a cut at the end of the buffer has no word.
        """
        low, high = first.copy(), end.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) >> 1
            enough = self.count(kinds, first[open_], mid + 1) > units[open_]
            high[open_[enough]] = mid[enough]
            low[open_[~enough]] = mid[~enough] + 1
        return low
