"""Quality by positive-unlabelled learning.

Texts that are trusted to be good (label 1) and unlabelled texts of the whole table are told apart by a linear score
that minimises the non-negative unbiased risk: prior * loss on the trusted as good, plus the loss on the unlabelled as
bad less prior * the loss on the trusted as bad, where that difference is not allowed below zero (a step that would
take it there goes the other way). The prior is the share of label 1 among the labelled rows, or, if only good ones
are labelled, an estimate from a classifier of labelled against unlabelled. A logistic fit on labelled rows turns the
score into a probability.

Features are frequencies of 1- to 3-grams of character shapes (runs of letters count as one character) in hashed
buckets, and a few numbers on length and repetition. All models are fitted on bounded samples of ``per_class`` rows.

Defined results: a null or empty text has features 0 and is scored as such; without trusted rows every score is 1,
as nothing says that a text is bad; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm.base import batch_of, keep_rows, slices, text_list
from medloom.llm.features import code_points, gram_buckets, shapes
from medloom.llm.sampling import fold, sample_ids, sample_texts
from medloom.llm.toxicity import fit_logistic

BITS = 10
LENGTHS = (1, 2, 3)
PER_CLASS = 3000
STEPS, RATE, SHRINK = 300, 0.05, 1e-3
BATCH_TEXTS = 256


def _numbers(text: bytes) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * 6
    lines = [line for line in text.split(b"\n") if line]
    count = Counter(words)
    return [
        np.log1p(len(words)), len(count) / len(words), max(count.values()) / len(words), len(text) / len(words) / 10,
        len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)),
    ]


def features(texts: list[bytes]) -> np.ndarray:
    """A row of numbers for each text."""
    codes, sizes = code_points(texts)
    codes = shapes()[codes]
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = (codes == ord("a")) | (codes == ord("A"))
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(letter[1:] & (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1]))
    codes, owner = codes[keep], owner[keep]
    width = 1 << BITS
    columns = []
    for n in LENGTHS:
        text, bucket = gram_buckets(codes, owner, n, BITS)
        seen = np.bincount(text * width + bucket, minlength=len(texts) * width).reshape(len(texts), width)
        columns.append(np.sqrt(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)).astype(np.float32))
    # Grams of all lengths share the buckets; their hashes differ by length.
    return np.hstack([sum(columns), np.array([_numbers(t) for t in texts], np.float32).reshape(len(texts), 6)])


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        parts = [self.raw(features(texts[a : a + BATCH_TEXTS])) for a in range(0, len(texts), BATCH_TEXTS)]
        z = np.concatenate([np.zeros(0), *parts]) * self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _collect(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, by id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 19):
            texts = text_list(batch.column("text"))
            x = np.concatenate([features(texts[a : a + BATCH_TEXTS]) for a in range(0, len(texts), BATCH_TEXTS)])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "label": batch.column("label"),
                "x": pa.array([row.astype(np.float16).tobytes() for row in x], pa.binary()),
            })

    got = sorted(rows.mapInArrow(run, "doc_id long, label int, x binary").collect(), key=lambda r: r["doc_id"])
    width = (1 << BITS) + 6
    x = np.array([np.frombuffer(r["x"], np.float16) for r in got], np.float32).reshape(len(got), width)
    return x, np.array([r["label"] for r in got], np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def minimise_risk(good: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative unbiased risk with logistic loss, by Adam over all rows."""
    both = np.vstack([good, unlabelled])
    centre, spread = both.mean(axis=0), both.std(axis=0) + 1e-2
    p, u = ((x - centre) / spread / np.sqrt(both.shape[1]) for x in (good, unlabelled))
    p, u = (np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32) for x in (p, u))
    beta = np.zeros(p.shape[1], np.float32)
    first, second = np.zeros_like(beta), np.zeros_like(beta)
    for step in range(1, STEPS + 1):
        zp, zu = p @ beta, u @ beta
        as_bad = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        rise_bad = u.T @ (_sigmoid(zu) / len(u)) - prior * (p.T @ (_sigmoid(zp) / len(p)))
        if as_bad >= 0:
            rise = prior * (p.T @ (-_sigmoid(-zp) / len(p))) + rise_bad
        else:
            rise = -rise_bad
        rise[:-1] += SHRINK * beta[:-1]
        first += 0.1 * (rise - first)
        second += 0.001 * (rise**2 - second)
        beta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = beta[:-1] / spread / np.sqrt(both.shape[1])
    return weights.astype(np.float32), float(beta[-1] - centre @ weights)


def estimate_prior(good: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of good rows among the unlabelled, where only good ones are labelled.

    A classifier of half of the good against the unlabelled gives the ratio of their densities, which is one over the
    share wherever only good rows lie; it is taken as its mean over the other half.
    """
    half = len(good) // 2
    x = np.vstack([good, unlabelled])
    x = np.hstack([np.ones((len(x), 1)), (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-2) / np.sqrt(x.shape[1])])
    seen, y = x[half:], np.repeat([1.0, 0.0], [len(good) - half, len(unlabelled)])
    odds = np.exp(np.clip(x[:half] @ fit_logistic(seen, y, np.ones(len(y)), 1.0), -20, 20))
    ratio = odds.mean() * len(unlabelled) / (len(good) - half) if half else 1.0
    return float(np.clip(1 / ratio, 0.05, 0.99))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Fit on bounded samples: trusted rows, labelled rows (doc_id, quality) and rows of the whole table."""
    labelled = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("label")
    )
    share = {r["label"]: r["count"] for r in labelled.filter("label is not null").groupBy("label").count().collect()}
    if not share.get(1):
        return None
    x, y = _collect(sample_texts(docs, sample_ids(labelled, per_class)))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("label"))
    unlabelled, _ = _collect(sample_texts(docs, sample_ids(every, per_class)))
    good = x[y == 1]
    if not len(good) or not len(unlabelled):
        return None
    prior = share[1] / sum(share.values()) if share.get(0) else estimate_prior(good, unlabelled)
    weights, bias = minimise_risk(good, unlabelled, min(prior, 0.99))
    model = Model(weights, bias, 1.0, 0.0, prior)
    if share.get(0) and len(set(y.tolist())) == 2:
        z = model.raw(x)
        # The sample holds equal numbers of the labels at most; weights give back their shares.
        weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
        spread = z.std() or 1.0
        shift, slope = fit_logistic(
            np.stack([np.ones(len(z)), z / spread], axis=1), y, weight * len(y) / weight.sum(), 0.01)
        model = model._replace(slope=slope / spread, shift=shift)
    return model


RESULT = "doc_id long, score double"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score(batches: Iterable[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        scores = np.ones(batch.num_rows) if model is None else model.score(text_list(batch.column("text")))
        yield batch_of(_RESULT_ARROW, batch.column("doc_id"), scores)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Fit on the labels of the folds that aren't held out and score all documents."""
    model = fit(docs, labels.filter(fold("doc_id", folds) != held_out))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = narrow.mapInArrow(lambda batches: _score(batches, shared.value), RESULT)
    return found.select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """The documents, with all columns, that the classifier doesn't reject."""
    model = fit(docs, labels.filter(fold("doc_id", folds) != held_out))
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda batch: shared.value.score(text_list(batch.column("text"))) >= 0.5)
