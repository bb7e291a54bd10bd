"""Benchmark decontamination: an FM-index per shard of training text answers which test phrases occur in it, and where.

A shard is a slice of documents in a task. Its words become numbers; a word that no test phrase has becomes a border,
and a run of words between borders shorter than the shortest phrase is left out, as no phrase can lie there. Over the
rest stands an FM-index: Burrows-Wheeler transform from a suffix array by prefix doubling, ranks from a wavelet
matrix, every 16th suffix position sampled. All phrases are searched backwards side by side; a phrase's occurrences
are located by walking to the next sampled position, and their words are merged into removal spans.

Test items are a stated query set: they go to the tasks in blocks of at most ``block_bytes`` of text, each over all
documents. One block is the usual case and needs no shuffle; the spans of several are merged by document.

Defined results: a null text has no words, no hits and is not contaminated; an item without words has no phrase; rows
of the same item id are one item; items without an id count as the item ''; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm.base import batch_of, keep_rows, slices, text_list

WINDOW = 13
BLOCK_BYTES = 16 << 20
SAMPLE = 16
SHARD_BYTES = 4 << 20

# Word bytes are digits, a-z and all of UTF-8 beyond ASCII; A-Z is lower-cased, everything else separates.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
END, BORDER, FIRST = 0, 1, 2


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class FMIndex:
    """Occurrences of phrases in a row of numbers from FIRST on, with BORDER between runs."""

    def __init__(self, row: np.ndarray, sample: int = SAMPLE):
        row = np.append(row, END)
        n = len(row)
        order = self._suffix_array(row)
        self.bwt = row[order - 1]
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(row))))
        self.levels = max(int(row.max()).bit_length(), 1)
        self.ones, self.zeros = [], []
        left = self.bwt
        for level in reversed(range(self.levels)):
            bits = (left >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bits))))
            self.zeros.append(n - int(self.ones[-1][-1]))
            left = np.concatenate((left[bits == 0], left[bits == 1]))
        self.sampled = order % sample == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.sample = order[self.sampled]

    @staticmethod
    def _suffix_array(row: np.ndarray) -> np.ndarray:
        rank, n, step = row.astype(np.int64), len(row), 1
        while True:
            key = rank * (max(n, int(rank.max()) + 1) + 1)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            if new[order[-1]] == n - 1 or step >= n:
                return order
            rank, step = new, step * 2

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform, by one descent of the wavelet matrix."""
        start = np.zeros_like(place)
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros):
            bit = (symbol >> level) & 1
            a, b = ones[place], ones[start]
            place = np.where(bit == 1, zeros + a, place - a)
            start = np.where(bit == 1, zeros + b, start - b)
        return place - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) place of the suffixes that begin with each phrase (rows of equal length)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.bwt), np.int64)
        live = np.flatnonzero((phrases < len(self.smaller) - 1).all(axis=1))
        high[np.setdiff1d(np.arange(len(phrases)), live)] = 0
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[live, k]
            both = self.rank(np.concatenate((symbol, symbol)), np.concatenate((low[live], high[live])))
            low[live] = self.smaller[symbol] + both[: len(live)]
            high[live] = self.smaller[symbol] + both[len(live) :]
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Positions in the row of suffixes at these places."""
        places, steps, out = places.copy(), 0, np.zeros(len(places), np.int64)
        todo = np.arange(len(places))
        while len(todo):
            found = self.sampled[places[todo]]
            out[todo[found]] = self.sample[self.sample_rank[places[todo[found]]]] + steps
            todo = todo[~found]
            symbol = self.bwt[places[todo]]
            places[todo] = self.smaller[symbol] + self.rank(symbol, places[todo])
            steps += 1
        return out


class Phrases:
    """The windows of a block of test items, as numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.items = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, FIRST + len(self.vocab)) for w in words_of(text)]
            for k in range(max(len(ids) - window, 0) + 1 if ids else 0):
                owners.setdefault(tuple(ids[k : k + window]), set()).add(number[item])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lists = list(owners.values())
        self.item_of = np.array([i for found in lists for i in sorted(found)], np.int64)
        self.item_at = np.concatenate(([0], np.cumsum([len(found) for found in lists]))).astype(np.int64)
        phrases = list(owners)
        for length in sorted(set(map(len, phrases))):
            which = [i for i, p in enumerate(phrases) if len(p) == length]
            self.by_length[length] = np.array([phrases[i] for i in which], np.int64), np.array(which)
        self.shortest = min(self.by_length, default=0)

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words per text, words hit per text, merged spans (first and last word, counted over all texts), and the
        pairs (text, item) with an occurrence, by text and item."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        begins = np.concatenate(([0], np.cumsum(sizes)))
        none = np.zeros((0, 2), np.int64)
        total = int(begins[-1])
        if not total or not self.by_length:
            return sizes, np.zeros(len(texts), np.int64), begins, none, none
        get = self.vocab.get
        # One border after each text keeps phrases within it.
        ids = np.full(total + len(texts), BORDER, np.int64)
        place = np.arange(total) + np.repeat(np.arange(len(texts)), sizes)
        ids[place] = np.fromiter((i for w in words for i in map(get, w, repeat(BORDER))), np.int64, total)
        known = ids != BORDER
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        first, last = edge[::2], edge[1::2]
        keep = last - first >= self.shortest
        first, last = first[keep], last[keep]
        if not len(first):
            return sizes, np.zeros(len(texts), np.int64), begins, none, none
        length = last - first + 1  # with the border behind it
        start = np.cumsum(length) - length
        origin = np.arange(int(length.sum())) + np.repeat(first - start, length)
        index = FMIndex(ids[origin])
        change = np.zeros(len(ids) + 1, np.int64)
        found = []
        for size, (phrases, which) in self.by_length.items():
            low, high = index.search(phrases)
            times = high - low
            if not times.any():
                continue
            suffix = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            at = origin[index.locate(suffix)]
            np.add.at(change, at, 1)
            np.add.at(change, at + size, -1)
            found.append(np.stack((at, np.repeat(which, times)), axis=1))
        hit = np.cumsum(change[:-1])[place] > 0
        text_of = np.repeat(np.arange(len(texts)), sizes)
        n_hit = np.bincount(text_of[hit], minlength=len(texts))
        flags = np.zeros(len(ids), np.int8)
        flags[place] = hit
        edge = np.flatnonzero(np.diff(np.concatenate(([0], flags, [0]))))
        spans = np.stack((edge[::2], edge[1::2]), axis=1)
        spans -= np.searchsorted(begins[1:] + np.arange(len(texts)), spans[:, 0], side="right")[:, None]
        pairs = none
        if found:
            at, which = np.concatenate(found).T
            text = np.searchsorted(begins[1:] + np.arange(len(texts)), at, side="right")
            pairs = np.unique(np.stack((text, which), axis=1), axis=0)
            times = self.item_at[pairs[:, 1] + 1] - self.item_at[pairs[:, 1]]
            inner = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            item = self.item_of[np.repeat(self.item_at[pairs[:, 1]], times) + inner]
            pairs = np.unique(np.stack((np.repeat(pairs[:, 0], times), item), axis=1), axis=0)
        return sizes, n_hit, begins, spans, pairs


FOUND = "doc_id long, digest binary, n_words long, items array<string>, spans array<struct<first:long,last:long>>"
_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
_FOUND_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64()),
    ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN)),
])


def _find(batches: Iterable[pa.RecordBatch], phrases: Phrases, with_digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=SHARD_BYTES):
        texts = text_list(batch.column("text"))
        sizes, _, begins, spans, pairs = phrases.find(texts)
        items: list[list[str]] = [[] for _ in texts]
        for text, item in pairs.tolist():
            items[text].append(phrases.items[item])
        merged: list[list] = [[] for _ in texts]
        if len(spans):
            owner = np.searchsorted(begins[1:], spans[:, 0], side="right")
            local = spans - begins[owner][:, None]
            for text, (first, last) in zip(owner.tolist(), local.tolist()):
                merged[text].append({"first": first, "last": last})
        digest = [hashlib.sha256(t).digest() if with_digest else None for t in texts]
        yield batch_of(_FOUND_ARROW, batch.column("doc_id"), digest, sizes, items, merged)


def _blocks(benchmark: DataFrame, block_bytes: int, window: int) -> Iterator[Phrases]:
    """Blocks of items, each of about ``block_bytes`` of text, brought to the driver one after the other."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // block_bytes) or 1
    for k in range(count):
        block = items.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == k)
        yield Phrases([(r["item"], (r["text"] or "").encode()) for r in block.toLocalIterator()], window)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document: doc_id, digest, n_words, items (ids, sorted) and spans (removal spans in words, last exclusive)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = list(_blocks(benchmark, block_bytes, window))

    def found(phrases: Phrases) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(phrases)
        several = len(blocks) > 1
        return docs.mapInArrow(lambda batches: _find(batches, shared.value, several), FOUND)

    if len(blocks) == 1:
        return found(blocks[0])
    whole = found(blocks[0]).select("doc_id", "digest", "n_words", "items", "spans")
    for phrases in blocks[1:]:
        whole = whole.unionByName(found(phrases))
    # Repeated rows give the same lists, so a document that is there twice is counted as often as in one block.
    per_block = whole.groupBy("doc_id", "digest").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_set("items")).alias("items"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.count(F.lit(1)).alias("_rows"),
    )
    start = F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")

    def join(done, span):
        last = F.element_at(done, -1)
        return F.when(
            (F.size(done) > 0) & (span["first"] <= last["last"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"))),
            ),
        ).otherwise(F.concat(done, F.array(span)))

    merged = per_block.select(
        "doc_id", "digest", "n_words", F.array_sort(F.array_distinct("items")).alias("items"),
        F.aggregate("spans", start, join).alias("spans"),
        F.explode(F.sequence(F.lit(1), (F.col("_rows") / len(blocks)).cast("int"))).alias("_copy"),
    )
    return merged.drop("_copy")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest columns of the query."""
    hits = benchmark_hits(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "spans",
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents, with all columns, of which under a twentieth of the words lies in test phrases."""
    blocks = list(_blocks(benchmark, block_bytes, window))
    if len(blocks) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(blocks[0])

        def clean(batch):
            sizes, n_hit, *_ = shared.value.find(text_list(batch.column("text")))
            return (n_hit == 0) | (20 * n_hit < sizes)

        return keep_rows(docs, clean)
    hits = benchmark_hits(docs, benchmark, window, block_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    bad = hits.filter((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).select(
        F.col("doc_id").alias("_bad_id"), F.col("digest").alias("_bad_digest")).distinct()
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    return docs.join(
        bad, F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (digest == F.col("_bad_digest")), "left_anti")
