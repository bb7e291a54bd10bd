"""A small form for rules on a text: groups of alternatives that must occur, and combinations that must not."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from medloom.functions.text import ascii_bounds


class Need(NamedTuple):
    groups: tuple[tuple[str, ...], ...]
    unless: tuple[tuple[str, ...], ...]


def need(*groups: str | tuple[str, ...], unless: tuple = ()) -> Need:
    """Every group must occur; a tuple is a group of alternatives. ``unless``: no entry may occur, where a
    tuple occurs when all its parts do. Parts are contained text, or patterns when they have a ``\\b``.
    """

    def as_tuple(part):
        return (part,) if isinstance(part, str) else tuple(part)

    return Need(tuple(map(as_tuple, groups)), tuple(map(as_tuple, unless)))


def occurs(text: Column, part: str) -> Column:
    return text.rlike(ascii_bounds(part)) if r"\b" in part else text.contains(part)


def holds(text: Column, rule: Need) -> Column:
    out = F.lit(True)
    for group in rule.groups:
        out = out & reduce(lambda a, b: a | b, [occurs(text, p) for p in group])
    for combination in rule.unless:
        out = out & ~reduce(lambda a, b: a & b, [occurs(text, p) for p in combination])
    return out


def holds_in(text: str, rule: Need) -> bool:
    """``holds`` for a text at hand, of a rule without patterns."""
    return all(any(p in text for p in group) for group in rule.groups) and not any(
        all(p in text for p in combination) for combination in rule.unless)


def any_holds(text: Column, rules: list[Need]) -> Column:
    return reduce(lambda a, b: a | b, [holds(text, r) for r in rules])


class Enrich(NamedTuple):
    """Put ``text`` before or after a mention when mention, sentence and sentence features allow it.

    ``where``: groups of feature names, of each group at least one must be true; ``where_not``: none may be.
    """

    side: str
    text: str
    mention: Need
    sentence: Need = Need((), ())
    where: tuple[tuple[str, ...], ...] = ()
    where_not: tuple[str, ...] = ()
