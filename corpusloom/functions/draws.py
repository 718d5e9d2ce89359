"""``functions.hashing.h32`` over many numbers at once, for resampling: MD5 in 32-bit vector arithmetic.

A draw hashes ``head rep middle row``, where only the digits of two numbers change. Numbers of equally many digits stand at fixed bytes, so
a tile of draws differs in a few words of the message, and MD5's steps run over the whole tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Draws that are hashed side by side; a tile's vectors should fit a core's cache.
TILE = 1 << 16
_ALL = 0xFFFFFFFF
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_PLUS = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]

Word = int | np.ndarray


def _mixed(i: int, b: Word, c: Word, d: Word, out: np.ndarray) -> np.ndarray:
    if i < 16:
        return np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out=out), b, out=out), d, out=out)
    if i < 32:
        return np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out=out), d, out=out), c, out=out)
    if i < 48:
        return np.bitwise_xor(np.bitwise_xor(b, c, out=out), d, out=out)
    return np.bitwise_xor(np.bitwise_or(np.invert(d, out=out), b, out=out), c, out=out)


def _mixed_numbers(i: int, b: int, c: int, d: int) -> int:
    return (d ^ (b & (c ^ d)), c ^ (d & (b ^ c)), b ^ c ^ d, c ^ (b | (d ^ _ALL)))[i // 16]


class Tile:
    """MD5 of messages that share their length; holds the vectors between calls."""

    def __init__(self, shape: tuple[int, int]) -> None:
        self.shape = shape
        self.kept = [np.empty(shape, np.uint32) for _ in range(4)]
        self.f, self.turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)

    def first(self, words: list[Word]) -> np.ndarray:
        """The digest's first 32 bits, big-endian, of messages of whole blocks given by words: numbers, or vectors that broadcast."""
        state: list[Word] = [*_START]
        for at in range(0, len(words), 16):
            last = at + 16 == len(words)
            state = self._block(state, words[at : at + 16], 61 if last else 64)  # the first word is settled in step 61
            if last:
                break
        return np.broadcast_to(np.asarray(state[0], np.uint32), self.shape).byteswap()

    def _block(self, state: list[Word], words: list[Word], steps: int) -> list[Word]:
        a, b, c, d = state
        for i in range(steps):
            word, turn = words[_WORD[i]], _TURN[i]
            if all(isinstance(x, int) for x in (a, b, c, d, word)):
                f = (_mixed_numbers(i, b, c, d) + a + _PLUS[i] + word) & _ALL
                new: Word = ((f << turn | f >> 32 - turn) + b) & _ALL
            else:
                f, turned = self.f, self.turned
                _mixed(i, *(np.uint32(x) if isinstance(x, int) else x for x in (b, c, d)), f)
                np.add(f, a, out=f)
                if isinstance(word, int):
                    np.add(f, (_PLUS[i] + word) & _ALL, out=f)
                else:
                    np.add(f, _PLUS[i], out=f)
                    np.add(f, word, out=f)
                np.right_shift(f, 32 - turn, out=turned)
                np.left_shift(f, turn, out=f)
                np.bitwise_or(f, turned, out=f)
                new = np.add(f, b, out=self.kept[i % 4])  # a's vector, which is read by now
            a, b, c, d = d, new, b, c
        if steps == 61:
            return [self._plus(b, state[0])]
        return [self._plus(x, y) for x, y in zip((a, b, c, d), state, strict=True)]

    @staticmethod
    def _plus(x: Word, y: Word) -> Word:
        return (x + y) & _ALL if isinstance(x, int) and isinstance(y, int) else np.add(x, y)


def _spans(low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """``digits, low, high`` of the runs of [low, high) whose numbers have equally many digits."""
    while low < high:
        digits = len(str(low))
        end = min(high, 10**digits)
        yield digits, low, end
        low = end


def _spread(numbers: np.ndarray, digits: int, at: int) -> dict[int, np.ndarray]:
    """The digits' part of each word of a message in which they begin at byte ``at``."""
    parts: dict[int, np.ndarray] = {}
    for k in range(digits):
        digit = (numbers // 10 ** (digits - 1 - k) % 10 + 48).astype(np.uint32) << np.uint32((at + k) % 4 * 8)
        parts[(at + k) // 4] = parts[(at + k) // 4] | digit if (at + k) // 4 in parts else digit
    return parts


def tiles(head: str, middle: str, reps: tuple[int, int], rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """``rep, h`` of tiles that cover every rep of the half-open range and every row below ``rows``: ``h[k, j]`` is ``h32`` of the text
    ``head`` + (rep + k) + ``middle`` + row, a tile's rows following on one another. The next tile overwrites nothing of ``h``."""
    before, between = head.encode(), middle.encode()
    held = Tile((0, 0))
    for row_digits, row_low, row_high in _spans(0, rows):
        for start in range(row_low, row_high, TILE):
            width = min(TILE, row_high - start)
            for digits, low, high in _spans(*reps):
                row_at = len(before) + digits + len(between)
                size = row_at + row_digits
                fixed = (before + bytes(digits) + between + bytes(row_digits) + b"\x80").ljust((size + 8) // 64 * 64 + 56, b"\0") + (size * 8).to_bytes(8, "little")
                base = [int(x) for x in np.frombuffer(fixed, "<u4")]
                by_row = _spread(np.arange(start, start + width)[None, :], row_digits, row_at)
                batch = TILE // width
                for rep in range(low, high, batch):
                    n = min(batch, high - rep)
                    words: list[Word] = [*base]
                    for w, part in _spread(np.arange(rep, rep + n)[:, None], digits, len(before)).items():
                        words[w] = base[w] + int(part[0, 0]) if n == 1 else part + np.uint32(base[w])
                    for w, part in by_row.items():
                        words[w] = part + np.asarray(words[w], np.uint32)
                    if held.shape != (n, width):
                        held = Tile((n, width))
                    yield rep, held.first(words)
