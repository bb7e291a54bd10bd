"""Words of many texts as one Arrow array, without a Python object per word."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from medloom.llm.base import text_bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_set(values) -> np.ndarray:
    """A table that says for each byte whether it is one of ``values``."""
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


class Words(NamedTuple):
    """Words of several texts, each followed by one space; text k has the words ``bounds[k]`` to ``bounds[k + 1]``."""

    values: pa.LargeBinaryArray
    bounds: np.ndarray
    breaks: np.ndarray  # per word: does a break follow before the next word of its text, or does its text end there


def split_words(column: pa.Array, separators: np.ndarray, breaks: np.ndarray | None = None, lower: bool = False) -> Words:
    """Words are the longest stretches without separator bytes (all ASCII); a null text has none.

    Needs about 5 bytes per byte of text and 25 per word.
    """
    data, offsets = text_bytes(column)
    ends = offsets[1:] + np.arange(len(offsets) - 1)
    buffer = np.full(len(data) + len(ends), 32, np.uint8)
    inside = np.ones(len(buffer), bool)
    inside[ends] = False
    buffer[inside] = data
    space = separators[buffer] | ~inside
    after = np.flatnonzero(space[1:] & ~space[:-1]) + 1  # the separator behind each word
    bounds = np.concatenate(([0], np.searchsorted(after, ends, side="right")))
    last = np.zeros(len(after), bool)
    if breaks is not None:
        at = np.flatnonzero(breaks[buffer] | ~inside)
        if len(at):
            following = at[np.minimum(np.searchsorted(at, after), len(at) - 1)]
            last = following < np.append(after[1:], len(buffer))  # a break at or behind the word, before the next word's end
    del inside
    keep = ~space
    keep[1:] |= ~space[:-1]
    if lower:
        buffer = _LOWER[buffer]
    buffer[space] = 32
    flat = buffer[keep]
    stops = np.concatenate(([0], np.flatnonzero(space[keep]) + 1)).astype(np.int64)
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(after), [None, pa.py_buffer(stops), pa.py_buffer(flat)])
    return Words(values, bounds, last)


def word_numbers(words: pa.LargeBinaryArray) -> tuple[np.ndarray, int]:
    """Equal words get equal numbers from 0; and how many numbers there are."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
