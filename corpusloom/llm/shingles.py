"""Vectorised word shingles and MinHash signatures over Arrow batches.

Words are runs of characters other than space and ``\\x09-\\x0D`` after lower-casing A-Z; a shingle is ``width`` consecutive words.
A whole batch of texts is tokenised at once: bytes are classified with one table lookup, every word gets a 64-bit polynomial
fingerprint from prefix sums, and shingles mix the fingerprints of their words. No Python loop runs per word.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

#: Bytes that are classified at once.
PART = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
#: A-Z to a-z, and every separator byte to a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        up = np.cumprod(np.full(size, _BASE, dtype=_U))
        _POWERS["up"], _POWERS["down"] = up, np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), dtype=_U))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of texts that are short together."""
    data = _FOLD[np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)]
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    blank = data == 32
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)])))
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    limits = np.concatenate(([0], np.cumsum(lengths + 1)))
    return hashes, np.searchsorted(starts, limits, side="left")


def _long(text: bytes) -> np.ndarray:
    """Word fingerprints of a long text, part by part; a word of ``PART`` bytes or more is hashed by itself."""
    found, at = [], 0
    while len(text) - at >= PART:
        cut = max(text.rfind(b, at, at + PART) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut >= at:
            found.append(_hashed([text[at:cut]])[0])
            at = cut + 1
        else:
            end = _BLANK.search(text, at)
            stop = end.start() if end else len(text)
            word = text[at:stop].lower()
            found.append(np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), dtype="<u8").astype(_U))
            at = stop
    found.append(_hashed([text[at:]])[0])
    return np.concatenate(found)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of ``texts`` in order, and the offsets (one more than texts) of each text's words."""
    if all(len(t) < PART for t in texts):
        return _hashed(texts)
    found, offsets = [], [0]
    for t in texts:
        found.append(_long(t) if len(t) >= PART else _hashed([t])[0])
        offsets.append(offsets[-1] + len(found[-1]))
    return np.concatenate(found), np.array(offsets, dtype=np.int64)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text; a shorter text has its whole word sequence as the only one."""
    hashes, offsets = word_hashes(texts)
    weights = mix(np.arange(1, width + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
    if len(hashes) >= width:
        joined = np.zeros(len(hashes) - width + 1, _U)
        for k in range(width):
            joined += hashes[k : len(hashes) - width + 1 + k] * weights[k]
        joined = mix(joined)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([(hashes[a:b] * weights[: b - a]).sum() + _U(int(b - a))], dtype=_U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def coordinates(size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and increments of the signature's hash functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, size, dtype=np.uint64) * _U(2) + _U(1), rng.integers(0, 1 << 63, size, dtype=np.uint64)


def signature(shingles: np.ndarray, params: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest 32-bit hash of the set under every function; sets of any size are taken in blocks to bound memory."""
    a, b = params
    best = np.full(len(a), np.uint32(0xFFFFFFFF), dtype=np.uint32)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        best = np.minimum(best, ((part[None, :] * a[:, None] + b[:, None]) >> _U(32)).astype(np.uint32).min(axis=1))
    return best
