"""Character n-grams of whole texts as hashed features, for many texts at a time."""

from __future__ import annotations

import unicodedata

import numpy as np

_TABLES: dict[str, np.ndarray] = {}
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def lower_letters() -> np.ndarray:
    """Code point to its lower-case letter; 32 for everything that is no letter."""
    if "lower" not in _TABLES:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(ch := chr(c))[0] == "L":
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLES["lower"] = table
    return _TABLES["lower"]


def shapes() -> np.ndarray:
    """Code point to its shape: letters become a or A, numbers 0, white space but line breaks a blank."""
    if "shape" not in _TABLES:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind[0] == "L":
                table[c] = ord("A") if kind in ("Lu", "Lt") else ord("a")
            elif kind[0] == "N":
                table[c] = ord("0")
            elif kind[0] == "Z" or kind == "Cc" and c != 10:
                table[c] = 32
        _TABLES["shape"] = table
    return _TABLES["shape"]


def code_points(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and the number of each."""
    joined = b"".join(texts).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
    heads = np.frombuffer(b"".join(texts), np.uint8) & 0xC0 != 0x80
    ends = np.cumsum([len(t) for t in texts])
    counts = np.concatenate(([0], np.cumsum(heads)))[ends] if len(heads) else np.zeros(len(texts), np.int64)
    return np.frombuffer(joined, np.uint32), np.diff(counts, prepend=0)


def gram_buckets(codes: np.ndarray, owner: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each n-gram that lies in one text and isn't all blanks."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashed = np.full(size, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    solid = np.zeros(size, bool)
    for k in range(n):
        part = codes[k : k + size]
        hashed += (part + np.uint32(1)) * _FACTORS[k]
        solid |= part != 32
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x2C1B3C6D)
    hashed >>= np.uint32(32 - bits)
    keep = solid & (owner[:size] == owner[n - 1 :])
    return owner[:size][keep], hashed[keep].astype(np.int64)
