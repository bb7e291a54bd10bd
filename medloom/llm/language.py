"""Language by a string kernel: which n-grams of letters a text has, compared with landmark texts.

The kernel of two texts is the number of n-grams (1 to 3 letters, blended) that both hold, over the root of the
product of their numbers. Nyström landmarks, an even choice from the learned sample, turn kernel ridge regression into
one matrix: a text's kernel values with the landmarks times the weights gives the score of each language against the
rest. Texts are scored in batches, as two matrix products.

Presence is kept in hashed buckets, so a text of any length is a row of fixed size. The model is fitted on a bounded
sample: at most ``per_language`` texts of each language, and at most ``landmarks`` landmarks.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text if nothing could be
learned; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm.base import batch_of, slices, text_list
from medloom.llm.features import code_points, gram_buckets, lower_letters
from medloom.llm.sampling import fold, sample_ids, sample_texts

BITS = 14
LENGTHS = (1, 2, 3)
PER_LANGUAGE = 400
LANGUAGES = 64
LANDMARKS = 128
RIDGE = 1e-3
BATCH_TEXTS = 128


def presence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets each text has, and whether it has a letter."""
    codes, sizes = code_points(texts)
    codes = lower_letters()[codes]
    owner = np.repeat(np.arange(len(texts)), sizes)
    found = np.zeros((len(texts), 1 << BITS), np.bool_)
    for n in LENGTHS:
        found[gram_buckets(codes, owner, n, BITS)] = True
    letters = np.zeros(len(texts), np.bool_)
    letters[owner[codes != 32]] = True
    return found, letters


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray  # buckets by landmark, scaled by the root of the landmark's number of n-grams
    weights: np.ndarray  # landmark by language
    bias: np.ndarray

    def score(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for a in range(0, len(texts), BATCH_TEXTS):
            part = texts[a : a + BATCH_TEXTS]
            found, letters = presence(part)
            size = np.sqrt(np.maximum(found.sum(axis=1), 1))[:, None]
            kernel = (found.astype(np.float32) @ self.landmarks) / size
            each = kernel @ self.weights + self.bias
            best = each.argmax(axis=1)
            names += [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())]
            value = np.clip((each[np.arange(len(part)), best] + 1) / 2, 0, 1)
            scores[a : a + len(part)] = np.where(letters, value, 0)
        return names, scores


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=1 << 18):
        found, letters = presence(text_list(batch.column("text")))
        bits = [np.packbits(row).tobytes() for row in found]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "label": batch.column("label"), "bits": pa.array(bits, pa.binary()),
            "letters": pa.array(letters),
        })


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on a bounded sample of the given rows (doc_id, text, lang); rows are as many bits as there are buckets.

    With more than ``LANGUAGES`` languages the most frequent are learned.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label"))
    frequent = labelled.filter("label is not null").groupBy("label").count()
    frequent = frequent.orderBy(F.desc("count"), "label").limit(LANGUAGES).select("label")
    ids = sample_ids(labelled.join(F.broadcast(frequent), "label"), per_language)
    rows = sample_texts(docs, ids).mapInArrow(_features, "doc_id long, label string, bits binary, letters boolean")
    rows = sorted(rows.filter("letters").collect(), key=lambda r: (r["doc_id"], r["label"]))
    if not rows:
        return None
    languages = sorted({r["label"] for r in rows})
    found = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in rows]).astype(np.float32)
    found /= np.sqrt(found.sum(axis=1, keepdims=True))
    number = np.array([languages.index(r["label"]) for r in rows])
    # Landmarks: the languages in turn, so that each has its share.
    turn = np.zeros(len(rows), np.int64)
    for k in range(len(languages)):
        turn[number == k] = np.arange((number == k).sum())
    chosen = np.lexsort((number, turn))[:landmarks]
    marks = found[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    mapped = (found @ marks.T).astype(np.float64) @ root
    target = np.where(number[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each language weighs the same.
    weight = (1 / np.bincount(number, minlength=len(languages)))[number]
    weight *= len(rows) / weight.sum()
    bias = (weight[:, None] * target).sum(axis=0) / len(rows)
    scaled = mapped * weight[:, None]
    gram = mapped.T @ scaled + RIDGE * len(rows) * np.eye(mapped.shape[1])
    beta = np.linalg.solve(gram, scaled.T @ (target - bias))
    return Model(languages, np.ascontiguousarray(marks.T), (root @ beta).astype(np.float32), bias.astype(np.float32))


RESULT = "doc_id long, lang_pred string, score double"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(batches: Iterable[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        if model is None:
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
        else:
            names, scores = model.score(text_list(batch.column("text")))
        yield batch_of(_RESULT_ARROW, batch.column("doc_id"), names, scores)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per document: doc_id, lang_pred, score; no shuffle. The model is landmarks x buckets, about 8 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(lambda batches: _predict(batches, shared.value), RESULT)


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Fit on the folds that are not held out and predict all documents."""
    model = fit(docs.filter(fold("doc_id", folds) != held_out))
    found = predict(docs, model)
    return found.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score")
