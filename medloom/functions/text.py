"""String helpers: spaces, word case, ordered rewrites and word-proximity patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Words between plain spaces (tabs and line breaks stay inside words)."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_lower_word(word: Column) -> Column:
    """Has a letter and no upper-case letter."""
    return (word == F.lower(word)) & (word != F.upper(word))


def is_upper_word(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def count_words(line: Column, test) -> Column:
    return F.size(F.filter(whitespace_words(line), test))


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def ascii_bounds(pattern: str) -> str:
    """The pattern with every ``\\b`` as an edge of ASCII word characters, which is what ``\\w`` stands for.

    The JVM counts all letters as word characters at ``\\b``, but only ASCII ones as ``\\w``. A boundary before a
    letter or a group begins a word, one before a class may be any edge, and all others end a word.
    """
    pattern = re.sub(r"\\b(?=\[)", r"(?:(?<!\\w)(?=\\w)|(?<=\\w)(?!\\w))", pattern)
    pattern = re.sub(r"\\b(?=\w|\(\?|\\w)", r"(?<!\\w)", pattern)
    return pattern.replace(r"\b", r"(?!\w)")


def has_word(text: Column, *alternatives: str) -> Column:
    """Whole-word match of any alternative (ASCII word characters)."""
    return text.rlike(ascii_bounds(r"\b(?:" + "|".join(alternatives) + r")\b"))


def occurrences(text: Column, part: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part))


def rewrite(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other, each on the result of those before."""
    return reduce(lambda c, rule: F.replace(c, F.lit(rule[0]), F.lit(rule[1])), rules, text)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def proximity_pattern(first: str, second: str, between: int) -> str:
    """``first``, a gap, at most ``between`` words, then ``second``."""
    return rf"{first}\W+(?:\w+\W+){{0,{between}}}?{second}"


def near(*pairs: tuple[str, str, int]) -> str:
    """One pattern for "any of these pairs within their distance", on word boundaries."""
    return ascii_bounds(r"\b(?:" + "|".join(proximity_pattern(*pair) for pair in pairs) + r")\b")


def _plain_parts(pattern: str) -> list[str] | None:
    """Texts of which one is in all that the pattern matches, or None where that can't be read off."""
    parts = re.sub(r"\\w\*", "", pattern)
    parts = parts[3:-1].split("|") if parts.startswith("(?:") and parts.endswith(")") else [parts]
    return parts if all(re.fullmatch(r"[\w &-]+", p) for p in parts) else None


def are_near(text: Column, pairs: Sequence[tuple[str, str, int]]) -> Column:
    """Is one of the pairs within its distance? The pattern runs only where both words of a pair are in the text."""
    gates = []
    for first, second, _ in pairs:
        words_of = [p for p in (_plain_parts(first), _plain_parts(second)) if p is not None]
        gates.append(reduce(lambda a, b: a & b, [contains_any(text, p) for p in words_of], F.lit(True)))
    return reduce(lambda a, b: a | b, gates) & text.rlike(near(*pairs))


def literal(text: str) -> str:
    return re.escape(text).replace(r"\-", "-").replace(r"\ ", " ")
