"""Sets of word shingles as sorted arrays of 64-bit hashes, for many texts at a time."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (separated by ASCII white space, A-Z lower-cased) and the number of words of each text."""
    data = np.frombuffer((b" ".join(texts) + b" ").lower(), np.uint8)
    space = (data == 32) | (data >= 9) & (data <= 13)
    edge = np.diff(np.concatenate(([True], space)).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up)))
    hashes = mix((total[ends] - total[starts]) * down[starts])
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, text_ends), prepend=0)


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """For each text the distinct shingles of ``words`` words, sorted; a shorter text is one shingle, an empty none."""
    hashes, sizes = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = rolled * _STEP + hashes[k : k + len(rolled)]
    rolled = mix(rolled)
    sets, at = [], 0
    for size in sizes.tolist():
        if size >= words:
            sets.append(np.unique(rolled[at : at + size - words + 1]))
        elif size:
            short = np.zeros(1, np.uint64)
            for h in hashes[at : at + size]:
                short = short * _STEP + h
            sets.append(mix(short ^ np.uint64(size)))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += size
    return sets


def set_id(found: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    name = mix(np.array([mix(found + np.uint64(1)).sum(dtype=np.uint64) ^ np.uint64(len(found))], np.uint64))
    return int(name.view(np.int64)[0])
