"""Toxic passages as maximum-scoring segments of word log-odds.

A word is scored by its unit: the word itself, or else the longest of its beginnings that stands out. Units are chosen
by the likelihood ratio of the numbers of toxic and other texts that hold them; a unit's score is the log-odds of its
words between toxic and other texts, both with an informative Dirichlet prior (a share of the background counts). All
other words share the score of the rest. A linear scan finds every maximal segment of positive total. Over random
text the best segment follows an extreme-value law, whose scale solves sum(p exp(scale * score)) = 1 over the words of
other texts and whose size constant is fitted to their best segments. A segment counts as significant if it is
expected less than ``expected`` times by chance in a text of this length; the evidence of all such segments and the
best one give the text's probability by a logistic fit on labelled texts that took no part in the word scores.

The model is fitted on a bounded sample: at most ``per_class`` texts of each label and ``units_kept`` units.

Defined results: a text without words has no segments and gets the probability of a text without evidence; without
labels every score is 0; a null text is empty; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.llm.base import batch_of, slices, text_list
from medloom.llm.decontamination import words_of
from medloom.llm.sampling import fold, sample_ids, sample_texts

PER_CLASS = 4000
UNITS_KEPT = 20_000
TABLE_KEPT = 400_000
SHORTEST_START, LONGEST_START = 4, 9
FEWEST_TEXTS = 5
PRIOR_WORDS = 500.0
STANDS_OUT = 5.0
EXPECTED = 0.05
EULER = 0.5772156649


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last exclusive, total), in linear time.

    A segment is maximal if no extension or part of it has a larger total. Runs of scores that aren't positive only
    lower the running total, so the scan visits positive words alone.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[list] = []  # [first, last, total before, total after, place in kept of the last with a smaller before]
    for at in np.flatnonzero(scores > 0).tolist():
        first, last, before, after = at, at + 1, float(total[at]), float(total[at + 1])
        back = len(kept) - 1
        while True:
            while back >= 0 and kept[back][2] >= before:
                back = kept[back][4]
            if back < 0 or kept[back][3] >= after:
                kept.append([first, last, before, after, back])
                break
            first, before = kept[back][0], kept[back][2]
            del kept[back:]
            back = back - 1
    return [(first, last, after - before) for first, last, before, after, _ in kept]


def units_of(word: bytes) -> list[bytes]:
    """The word and its beginnings, the longest first; a beginning carries a star."""
    return [word, *(word[:n] + b"*" for n in range(min(len(word) - 1, LONGEST_START), SHORTEST_START - 1, -1))]


class WordScores(dict):
    """Maps a word to the score of its unit; bounded, and filled as words are met."""

    def __init__(self, units: dict[bytes, float], rest: float):
        super().__init__()
        self.units, self.rest = units, rest

    def __reduce__(self):
        return WordScores, (self.units, self.rest)

    def unit(self, word: bytes) -> bytes | None:
        return next((u for u in units_of(word) if u in self.units), None)

    def __missing__(self, word: bytes) -> float:
        unit = self.unit(word)
        score = self.rest if unit is None else self.units[unit]
        if len(word) <= 64:
            if len(self) >= TABLE_KEPT:
                self.clear()
            self[word] = score
        return score


class Model(NamedTuple):
    words: WordScores
    scale: float
    log_size: float
    logistic: list[float]
    expected: float

    def scores(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.float64, len(words))

    def passages(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Significant segments with their evidence, -log of the number expected by chance."""
        scores = self.scores(words)
        if not (scores > 0).any():
            return []
        size = self.log_size + math.log(len(words))
        found = ((a, b, self.scale * s - size) for a, b, s in segments(scores))
        return [(a, b, e) for a, b, e in found if e > -math.log(self.expected)]

    def features(self, words: list[bytes]) -> list[float]:
        evidence = [e for _, _, e in self.passages(words)]
        return [1.0, math.log1p(sum(evidence)), math.log1p(max(evidence, default=0.0)), float(bool(evidence))]

    def probability(self, words: list[bytes]) -> float:
        z = sum(a * b for a, b in zip(self.logistic, self.features(words)))
        return 1 / (1 + math.exp(-max(min(z, 50), -50)))


COUNTS = "word binary, other long, toxic long"


def _counts(batches: Iterable[pa.RecordBatch], parts) -> Iterator[pa.RecordBatch]:
    """Counts by label of what ``parts`` makes of each text's words."""
    for batch in slices(batches):
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for text, label in zip(text_list(batch.column("text")), batch.column("label").to_pylist()):
            counts[label].update(parts(words_of(text)))
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({
            "word": pa.array(words, pa.binary()), "other": pa.array([counts[0][w] for w in words], pa.int64()),
            "toxic": pa.array([counts[1][w] for w in words], pa.int64()),
        })


def _choose(rows: DataFrame, units_kept: int) -> set[bytes]:
    """Units that more toxic texts hold than their share, by the signed root of the likelihood ratio."""
    def parts(words):
        return {unit for word in set(words) for unit in units_of(word)}

    texts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n, m = float(texts.get(1, 0)), float(texts.get(0, 0))
    if not n or not m:
        return set()
    counts = rows.mapInArrow(lambda batches: _counts(batches, parts), COUNTS)
    counts = counts.groupBy("word").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic"), F.col("other")

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = (a + b) / (n + m)
    ratio = 2 * (
        term(a, share * n) + term(b, share * m) + term(n - a, (1 - share) * n) + term(m - b, (1 - share) * m)
    )
    best = counts.filter((a >= FEWEST_TEXTS) & (a * m > b * n)).withColumn("ratio", ratio)
    best = best.filter(F.col("ratio") >= STANDS_OUT**2).orderBy(F.desc("ratio"), "word").limit(units_kept)
    return {bytes(r["word"]) for r in best.select("word").collect()}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Ridge logistic regression by Newton steps, halved until the loss falls; the first column isn't shrunk."""
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6

    def loss(beta):
        z = x @ beta
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (shrink * beta**2).sum()

    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (weight * (y - p)) - shrink * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(curve, slope)
        size, now = 1.0, loss(beta)
        while loss(beta + size * step) > now and size > 1e-6:
            size /= 2
        beta += size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return beta


def fit(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, units_kept: int = UNITS_KEPT,
    expected: float = EXPECTED,
) -> Model | None:
    """Fit on a bounded sample of the given label rows (doc_id, toxic)."""
    labelled = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("label")
    )
    share = {r["label"]: r["count"] for r in labelled.filter("label is not null").groupBy("label").count().collect()}
    rows = sample_texts(docs, sample_ids(labelled, per_class)).cache()
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    chosen = WordScores(dict.fromkeys(_choose(rows.filter(half), units_kept), 0.0), 0.0)
    if not chosen.units:
        return None
    counts = rows.filter(half).mapInArrow(
        lambda batches: _counts(batches, lambda words: [chosen.unit(w) or b"" for w in words]), COUNTS
    )
    counts = {bytes(r["word"]): (r["o"], r["t"]) for r in counts.groupBy("word").agg(
        F.sum("other").alias("o"), F.sum("toxic").alias("t")).collect()}
    m, n = (float(sum(x)) for x in zip(*counts.values()))

    def odds(other: float, toxic: float) -> float:
        prior = 0.5 + (other + toxic) * PRIOR_WORDS / (n + m)
        a, b = toxic + prior, other + prior
        return math.log(a / (n + PRIOR_WORDS + 1 - a)) - math.log(b / (m + PRIOR_WORDS + 1 - b))

    o, t = counts.pop(b"", (0, 0))
    rest = min(math.log((t + 1) / (n + 1)) - math.log((o + 1) / (m + 1)), -1e-3)
    units = {unit: odds(*seen) for unit, seen in counts.items()}
    values = np.array([*units.values(), rest])
    chance = np.array([*(other / max(m, 1) for other, _ in counts.values()), o / max(m, 1)])
    model = Model(WordScores(units, rest), _scale(values, chance), 0.0, [], expected)
    best = rows.filter(~half & (F.col("label") == 0)).mapInArrow(
        lambda batches: _best(batches, model), "words long, best double"
    )
    law = best.filter("words > 0 and best > 0").agg(
        F.avg(F.lit(model.scale) * F.col("best") - F.log("words")).alias("mean"), F.count(F.lit(1)).alias("n")
    ).first()
    # The law has mean log(size) + Euler's constant. Where hardly any text has a segment, the share of words does.
    few = math.log(max(float(chance[:-1].sum()), 1e-6))
    model = model._replace(log_size=min(law["mean"] - EULER if law["n"] >= 30 else few, 0.0))
    seen = rows.filter(~half).mapInArrow(lambda batches: _features(batches, model), "label int, x array<double>")
    seen = seen.collect()
    rows.unpersist()
    if not seen:
        return None
    x, y = np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen])
    # The sample holds equal numbers of the labels at most; weights give back their shares.
    weight = np.where(y == 1, share.get(1, 0) / max((y == 1).sum(), 1), share.get(0, 0) / max((y == 0).sum(), 1))
    weight *= len(y) / weight.sum()
    return model._replace(logistic=fit_logistic(x, y, weight).tolist())


def _scale(values: np.ndarray, chance: np.ndarray) -> float:
    """The positive root of sum(chance * exp(scale * value)) = 1, which exists as the mean score is negative."""
    low, high = 1e-3, 1.0
    if (values * chance).sum() >= 0 or values.max() <= 0:
        return 1.0
    while (chance * np.exp(np.minimum(high * values, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        if (chance * np.exp(np.minimum(middle * values, 700))).sum() < 1:
            low = middle
        else:
            high = middle
    return high


def _best(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = [words_of(t) for t in text_list(batch.column("text"))]
        best = [max((s for _, _, s in segments(model.scores(w))), default=0.0) for w in words]
        yield pa.RecordBatch.from_pydict({
            "words": pa.array(list(map(len, words)), pa.int64()), "best": pa.array(best, pa.float64()),
        })


def _features(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = [model.features(words_of(t)) for t in text_list(batch.column("text"))]
        yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "x": pa.array(x, pa.list_(pa.float64()))})


RESULT = "doc_id long, score double, passages array<struct<first:long,last:long,evidence:double>>"
_PASSAGE = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("evidence", pa.float64())])
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.list_(_PASSAGE))])


def _score(batches: Iterable[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = [words_of(t) for t in text_list(batch.column("text"))]
        if model is None:
            yield batch_of(_RESULT_ARROW, batch.column("doc_id"), [0.0] * len(words), [[]] * len(words))
            continue
        found = [[{"first": a, "last": b, "evidence": e} for a, b, e in model.passages(w)] for w in words]
        yield batch_of(_RESULT_ARROW, batch.column("doc_id"), [model.probability(w) for w in words], found)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per document: doc_id, score and the significant passages (words, end exclusive); no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(lambda batches: _score(batches, shared.value), RESULT)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Fit on the labels of the folds that aren't held out and score all documents."""
    found = score(docs, fit(docs, labels.filter(fold("doc_id", folds) != held_out)))
    return found.select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages",
    )
