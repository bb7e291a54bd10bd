"""Rolling hashes over the bytes of many texts, and the parse of texts into phrases at content-defined triggers."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(7))
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PLACE_BITS = 24


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def rolling(data: np.ndarray, lengths: list[int], base: int = _BASES[0]) -> dict[int, np.ndarray]:
    """For each length the hash of the string of that length at every place; built by doubling.

    Row ``i`` of length n exists for i + n <= len(data).
    """
    doubled = {1: _BYTE[data]}
    size = 1
    while size * 2 <= max(lengths):
        one = doubled[size]
        doubled[size * 2] = one[:-size] * _power(base, size) + one[size:] if len(one) > size else one[:0]
        size *= 2
    out = {}
    for length in lengths:
        rest, at, total = length, 0, None
        for size in sorted(doubled, reverse=True):
            if rest >= size:
                part = doubled[size][at:] if len(doubled[size]) > at else doubled[size][:0]
                if total is None:
                    total = part
                else:
                    n = min(len(total), len(part))
                    total = total[:n] * _power(base, size) + part[:n]
                at, rest = at + size, rest - size
        out[length] = total[: max(len(data) - length + 1, 0)]
    return out


def finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values."""
    size, low = 1, x
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    return low


def phrases(data: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Phrases of texts that lie one after the other in ``data`` and end at ``ends``.

    The trigger of a window is its string of ``gram`` bytes with the least hash, the leftmost of equal ones. A phrase
    is a run of windows with one trigger: (first start, number of starts, hash of the trigger, hash of the phrase).
    What a window's trigger is depends on the window alone, so equal windows have equal triggers at equal distance.
    """
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = rolling(data, [gram])[gram]
    key = finish(hashes)
    place = np.arange(len(key), dtype=np.uint64)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((key & ~mask) | (place & mask), window - gram + 1)
    starts = np.arange(len(least))
    text = np.searchsorted(ends, starts, side="right")
    inside = starts + window <= ends[text]
    trigger = (least & mask).astype(np.int64)
    # A new phrase where the trigger or the text changes, or windows begin again behind the end of a text.
    new = np.ones(len(least), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
    new &= inside
    last = np.ones(len(least), bool)
    last[:-1] = new[1:] | ~inside[1:]
    first = np.flatnonzero(new)
    count = np.flatnonzero(last & inside) - first + 1
    return first, count, key[trigger[first]], phrase_hashes(data, first, count + window - 1)


def phrase_hashes(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of strings of different lengths, from prefix sums of bytes times powers."""
    base = np.uint64(_BASES[1])
    inverse = np.uint64(pow(_BASES[1], -1, 1 << 64))
    up = np.cumprod(np.full(len(data), base, np.uint64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up)))
    down = np.cumprod(np.full(len(data), inverse, np.uint64))
    return finish((total[first + length] - total[first]) * down[first] + length.astype(np.uint64))
