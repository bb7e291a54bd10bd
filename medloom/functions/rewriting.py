"""Ordered literal replacements with an automaton that tells which of them can apply to a text.

A list of replacements applies one after the other, each to the result of those before. One pass of an Aho-Corasick
automaton finds the left sides in the text; only these replacements run, in order, and those whose left side can
arise from what an earlier one has written. The result is that of the whole list. ``rewritten`` is a column of it for
lists of which most apply.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def rewritten(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other, of long texts: a Python worker takes a quarter of the JVM's time."""
    pairs = [(old.encode(), new.encode()) for old, new in rules if old]

    def run(column: pa.Array) -> pa.Array:
        out = column.cast(pa.large_binary()).to_pylist()
        for k, one in enumerate(out):
            if one is not None:
                for old, new in pairs:
                    one = one.replace(old, new)
                out[k] = one
        return pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(pa.string())

    return F.arrow_udf(run, "string")(text) if pairs else text


def _can_arise(left: str, written: str) -> bool:
    """Can ``left`` occur where ``written`` was put into a text, whatever stands around it?"""
    if len(left) < 2 and not written:
        return False
    if left in written or not written:
        return True
    # It starts inside what was written, ends inside it, or goes beyond it on both sides.
    longest = min(len(left) - 1, len(written))
    overlaps = any(written[-k:] == left[:k] or written[:k] == left[-k:] for k in range(1, longest + 1))
    return overlaps or written in left


class Rewriter:
    """``rewriter(text)``: all replacements in order. Built once per task."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.rules = [(old, new) for old, new in rules if old]
        by_left: dict[str, list[int]] = {}
        for k, (old, _) in enumerate(self.rules):
            by_left.setdefault(old, []).append(k)
        self.finder = ahocorasick.Automaton()
        for old, numbers in by_left.items():
            self.finder.add_word(old, numbers)
        if by_left:
            self.finder.make_automaton()
        self.following = [
            [j for j in range(k + 1, len(self.rules)) if _can_arise(self.rules[j][0], new)]
            for k, (_, new) in enumerate(self.rules)
        ]

    def __call__(self, text: str) -> str:
        if not self.rules:
            return text
        wanted = {k for _, numbers in self.finder.iter(text) for k in numbers}
        if not wanted:
            return text
        queue = sorted(wanted)
        while queue:
            k = heapq.heappop(queue)
            old, new = self.rules[k]
            changed = text.replace(old, new)
            if changed != text:
                text = changed
                for j in self.following[k]:
                    if j not in wanted:
                        wanted.add(j)
                        heapq.heappush(queue, j)
        return text
