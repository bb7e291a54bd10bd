"""Terms learned from the reports themselves, for mentions beyond a fixed vocabulary.

Phrases of a sentence part are counted and weighed by C-value: how often a phrase stands there by itself, and not
within longer frequent phrases, times the logarithm of one more than its words. The best phrases are a lexicon of bounded size that
every task gets; it marks the leftmost longest phrases of a sentence in one pass of an automaton.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 4
LEAST = 5
TERMS = 20_000
BREAKS = ",;:()!?"
PART = f"[{BREAKS}]+"


def _phrase_counts(sentences: DataFrame, column: str, longest: int, least: int) -> DataFrame:
    """(phrase, words, n): phrases of one to ``longest`` words within a part of a sentence that occur often enough.

    Counted like collocations: a first scan of the sentences tells by hash which phrases can occur often enough, and
    only these are spelled and counted exactly in the second, so rare phrases never go through a shuffle as text.
    """
    # The training-data operators are an optional part; only learning of terms needs them.
    from medloom.llm.base import settle
    from medloom.llm.collocations import Pieces, phrase_counts

    texts = settle(sentences.select(F.lit("").alias("lang"), F.col(column).alias("text")))
    found, _ = phrase_counts(texts, max(least, 1), pieces=Pieces(BREAKS, " ", False, longest))
    return found.select("phrase", "words", "n")


def c_values(
    sentences: DataFrame, column: str = "sentence", longest: int = LONGEST, least: int = LEAST
) -> DataFrame:
    """(phrase, words, n, longer, within, c_value) of phrases that occur at least ``least`` times.

    ``longer`` counts the frequent phrases that hold this one and ``within`` its occurrences in them, once per phrase
    that holds it; c_value is log2(words + 1) * (n - within / longer).
    """
    counted = _phrase_counts(sentences, column, longest, least)
    w = F.split("phrase", " ")
    inner = counted.filter("words > 1").select(
        "n", "words", w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("size"))
    starts = F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)
    parts = F.array_distinct(F.transform(starts, lambda a: F.array_join(F.slice("w", a, F.col("size")), " ")))
    held = inner.select("n", F.explode(parts).alias("phrase")).groupBy("phrase").agg(
        F.count(F.lit(1)).alias("longer"), F.sum("n").alias("within"))
    rows = counted.join(held, "phrase", "left").select(
        "phrase", "words", "n", F.coalesce("longer", F.lit(0)).cast("long").alias("longer"),
        F.coalesce("within", F.lit(0)).cast("long").alias("within"))
    alone = F.col("n") - F.coalesce(F.try_divide(F.col("within"), F.col("longer")), F.lit(0.0))
    return rows.withColumn("c_value", F.log2(F.col("words") + 1.0) * alone)


def lexicon(values: DataFrame, heads: Sequence[str] = (), top: int = TERMS, least_value: float = 0.0) -> list[str]:
    """The ``top`` phrases by C-value, then phrase, whose last word holds one of ``heads`` if there are any."""
    chosen = values.filter(F.col("c_value") > least_value)
    if heads:
        last = F.substring_index("phrase", " ", -1)
        chosen = chosen.filter(last.rlike("|".join(heads)))
    rows = chosen.orderBy(F.desc("c_value"), "phrase").limit(top).select("phrase").collect()
    return [r["phrase"] for r in rows]


def _is_word(character: str) -> bool:
    return character.isalnum() or character in "_&'-"


class Marker:
    """Puts marks around the leftmost longest terms of a text that stand there as whole words."""

    def __init__(self, terms: Sequence[str], opening: str, closing: str):
        self.opening, self.closing = opening, closing
        self.finder = ahocorasick.Automaton()
        for term in terms:
            self.finder.add_word(term, len(term))
        if terms:
            self.finder.make_automaton()
        self.empty = not terms

    def spans(self, text: str) -> list[tuple[int, int]]:
        longest: dict[int, int] = {}
        for last, size in () if self.empty else self.finder.iter(text):
            start, end = last + 1 - size, last + 1
            free = (start == 0 or not _is_word(text[start - 1])) and (end == len(text) or not _is_word(text[end]))
            if free and end > longest.get(start, 0):
                longest[start] = end
        found, at = [], 0
        for start in sorted(longest):
            if start >= at:
                found.append((start, longest[start]))
                at = longest[start]
        return found

    def __call__(self, text: str) -> str:
        out, at = [], 0
        for start, end in self.spans(text):
            out += [text[at:start], self.opening, text[start:end], self.closing]
            at = end
        return "".join([*out, text[at:]])


def mark_terms(df: DataFrame, column: str, terms: Sequence[str], opening: str, closing: str) -> DataFrame:
    """The rows with the terms marked in a text column; null stays null."""
    names = df.columns

    def run(batches) -> Iterator[pa.RecordBatch]:
        marker = Marker(terms, opening, closing)
        for batch in batches:
            place = batch.schema.get_field_index(column)
            marked = pa.array([None if t is None else marker(t) for t in batch.column(place).to_pylist()], pa.string())
            yield pa.record_batch([marked if i == place else c for i, c in enumerate(batch.columns)], names=names)

    return df.mapInArrow(run, df.schema)
