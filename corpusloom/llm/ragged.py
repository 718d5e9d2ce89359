"""Ragged arrays of words: code points, substring fingerprints and hash tables over them, all in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from corpusloom.llm.shingles import mix

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_UP = np.cumprod(np.full(1 << 12, _BASE, dtype=_U))


class Words:
    """Words side by side as code points, with a fingerprint of any substring of up to 4095 characters."""

    def __init__(self, words: list[str]) -> None:
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(self.chars)) - self.start[self.word]

    def sums(self, most: int) -> Iterator[np.ndarray]:
        """For lengths 1 to ``most``, what ``finished`` turns into fingerprints of the characters from every position on."""
        n = len(self.chars)
        codes, out = self.chars.astype(_U) + _U(1), np.zeros(n, _U)
        for k in range(most):
            out[: max(n - k, 0)] += codes[k:] * _UP[k]
            yield out

    @staticmethod
    def finished(sums: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of substrings of one length from their sums."""
        return mix(sums + _U(length * 0xD6E8FEB86659FD93 % (1 << 64)))

    def fingerprints(self, length: int) -> np.ndarray:
        """Of the ``length`` characters from every position on, wherever a word may end; the caller masks what crosses an end."""
        out = np.zeros(len(self.chars), _U)
        for out in self.sums(length):
            pass
        return self.finished(out, length)

    def whole(self) -> np.ndarray:
        """The fingerprint of every word; words are not empty."""
        out = np.zeros(len(self.size), _U)
        for length, sums in enumerate(self.sums(int(self.size.max(initial=0))), 1):
            mine = np.flatnonzero(self.size == length)
            out[mine] = self.finished(sums[self.start[mine]], length)
        return out


class Table:
    """An open-addressing hash table from distinct fingerprints to row numbers. Only the fingerprints travel when it is pickled."""

    def __init__(self, keys: np.ndarray) -> None:
        self.given = keys
        self.bits = max(10, int(len(keys) * 2 + 1).bit_length())
        size = 1 << self.bits
        self.keys = np.zeros(size, dtype=_U)
        self.rows = np.full(size, -1, dtype=np.int32)
        slot = (keys >> _U(64 - self.bits)).astype(np.int64)
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            at = slot[left]
            free = self.rows[at] == -1
            # of several keys for one free slot, the last written stays
            self.rows[at[free]] = left[free]
            self.keys[at[free]] = keys[left[free]]
            left = left[self.rows[at] != left]
            slot[left] = (slot[left] + 1) & (size - 1)
            self.probes += 1

    def __reduce__(self) -> tuple:
        return Table, (self.given,)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        size = len(self.rows)
        slot = (keys >> _U(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.rows[slot], -1)
        open_ = np.flatnonzero((out == -1) & (self.rows[slot] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (size - 1)
            at = slot[open_]
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.rows[at[hit]]
            open_ = open_[~hit & (self.rows[at] != -1)]
        return out


class Sorted:
    """Distinct fingerprints in order: a third of ``Table``'s memory, for look-ups that are remembered."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)
