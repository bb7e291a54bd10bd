"""Removal of repeated substrings by a prefix-free parse of the corpus.

1. Parse: each text is cut into phrases at triggers found by a rolling hash (see ``parsing``). A phrase stands for a run
   of windows of 100 bytes with one trigger, and its string covers them all.
2. Dictionary: phrases are brought together by trigger. A trigger met once has no repeated window. Equal phrases are
   whole repeats: all but the first in corpus order (doc_id, then place) go as a whole. What remains is the dictionary
   of the different phrases, each with its first place.
3. Suffixes: only triggers with several different phrases can hold further repeats. The suffixes of their phrases that
   are at least a window long are sorted; neighbours with a common prefix of a window are one class. The order of
   phrases in the corpus tells which member of a class comes first, all others go. For highly repetitive text the
   dictionary is small however often its phrases occur.
4. Each document's removed windows are merged into spans.

Triggers are chosen by least hash, so phrases are bounded and the suffixes of one class share a trigger; the suffix
array can therefore be built in parts, by trigger. A trigger with very many phrases is split before the shuffle: its
windows are dealt to shares by a hash of the window, so that equal ones stay together, and each goes to one share
only. Of equal windows in one slice of the texts only the first is sent; the others are known to go.

Defined results: a null text is empty and keeps nothing; rows of equal id and text are one document, returned as often
as they are there; rows of equal id and different text are ordered by a hash of the text; rows without an id come
last; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.llm.base import batch_of, settle, slices, text_bytes, text_list
from medloom.llm.parsing import finish, phrases, rolling

WINDOW = 100
GRAM = 32
BLOCK = 1 << 22
PHRASES_PER_TASK = 20_000
SPLIT = 8  # shares for as many phrases: windows that are dealt one by one take more room than whole phrases
SORT_BYTES = 1 << 20
_LAST = (1 << 63) - 1


def _parse(data: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Phrases of texts in blocks of bounded size; a phrase that a block's end cuts in two stays right, as its parts
    only become different phrases of one trigger."""
    parts = []
    for begin in range(0, max(len(data) - window + 1, 1), BLOCK):
        stop = min(begin + BLOCK + window - 1, len(data))
        first, count, trigger, phrase = phrases(data[begin:stop], np.append(ends[ends > begin] - begin, stop), window, gram)
        parts.append((first + begin, count, trigger, phrase))
    return [np.concatenate(x) for x in zip(*parts)]


def _phrase_rows(batches: Iterable[pa.RecordBatch], window: int, gram: int, full: bool) -> Iterator[pa.RecordBatch]:
    """(h, rh, doc, tie, span) of each phrase, or the trigger h alone; span is start * 256 + number of windows."""
    for batch in slices(batches):
        data, offsets = text_bytes(batch.column("text"))
        first, count, trigger, phrase = _parse(data, offsets[1:], window, gram)
        columns = {"h": pa.array(trigger.view(np.int64))}
        if full:
            text = np.searchsorted(offsets[1:], first, side="right")
            columns |= {
                "rh": pa.array(phrase.view(np.int64)), "doc": batch.column("doc").take(pa.array(text)),
                "tie": batch.column("tie").take(pa.array(text)),
                "span": pa.array((first - offsets[text]) << 8 | count),
            }
        yield pa.RecordBatch.from_pydict(columns)


PHRASE = ["h", "rh", "doc", "tie", "span"]
STRINGS = "h long, share long, doc long, tie long, start long, phrase binary"
_STRINGS_ARROW = pa.schema([
    ("h", pa.int64()), ("share", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()),
    ("phrase", pa.binary()),
])


def _strings(batches: Iterable[pa.RecordBatch], window: int, per_task: int) -> Iterator[pa.RecordBatch]:
    """The strings of dictionary phrases.

    Of a trigger with more than ``per_task`` phrases each share is sent the runs of windows that are its own. A row
    without a string is a run of windows already known to go; ``start`` is its span.
    """
    for batch in slices(batches):
        rows, split, size = [], [], 0
        for doc, tie, text, found in zip(
            batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), text_list(batch.column("text")),
            batch.column("found").to_pylist(),
        ):
            for item in found:
                start = item["span"] >> 8
                phrase = text[start : start + (item["span"] & 255) + window - 1]
                if item["phrases"] <= per_task:
                    rows.append((item["h"], 0, doc, tie, start, phrase))
                    continue
                split.append((item["h"], -(-item["phrases"] * SPLIT // per_task), doc, tie, start, phrase))
                size += len(phrase)
                if size >= SORT_BYTES:
                    rows += _dealt(split, window)
                    split, size = [], 0
        if split:
            rows += _dealt(split, window)
        if rows:
            yield batch_of(_STRINGS_ARROW, *zip(*rows))


def _dealt(split: list[tuple], window: int) -> list[tuple]:
    """Rows of ``_strings`` for phrases whose windows are dealt to shares."""
    h, shares, doc, tie, start, strings = zip(*split)
    owner, inner, place = _places(doc, tie, start, strings, window)
    late = later_suffixes(strings, place, window)
    sizes = np.array([len(x) for x in strings])
    key = finish(rolling(np.frombuffer(b"".join(strings), np.uint8), [window])[window][(np.cumsum(sizes) - sizes)[owner] + inner])
    share = (key % np.array(shares, np.uint64)[owner]).astype(np.int64)
    share[late] = -1
    edge = np.flatnonzero((owner[1:] != owner[:-1]) | (share[1:] != share[:-1])) + 1
    rows = []
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(owner)]):
        k, at, s = int(owner[a]), int(inner[a]), int(share[a])
        if s < 0:  # such rows are dealt by their place
            span = start[k] + at << 8 | b - a
            rows.append((doc[k], span, doc[k], tie[k], span, None))
        else:
            rows.append((h[k], s, doc[k], tie[k], start[k] + at, strings[k][at : at + b - a + window - 1]))
    return rows


def _places(doc, tie, start, strings, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window, string by string: its string, its place in it and its place in the corpus as a rank."""
    counts = np.array([len(s) - window + 1 for s in strings])
    owner = np.repeat(np.arange(len(strings)), counts)
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.empty(len(owner), np.int64)
    place[np.lexsort((np.array(start)[owner] + inner, np.array(tie)[owner], np.array(doc)[owner]))] = np.arange(len(owner))
    return owner, inner, place


def later_suffixes(strings: Sequence[bytes], place: np.ndarray, window: int) -> np.ndarray:
    """Of all suffixes of at least ``window`` bytes (string by string), which share their first ``window`` bytes with
    one that comes earlier in the corpus.

    ``place`` is the corpus place of each suffix as a rank.
    """
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    counts = sizes - window + 1
    begin = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    late = np.zeros(len(begin), bool)
    if not len(begin):
        return late
    # The suffix array: suffixes by their first bytes as big-endian words, then class by class by the words behind.
    which = _suffix_order(data, begin, window)
    windows = np.lib.stride_tricks.sliding_window_view(data, window)
    same = np.zeros(len(which), bool)
    for a in range(1, len(which), 1 << 16):
        part = slice(a, min(a + (1 << 16), len(which)))
        before = slice(part.start - 1, part.stop - 1)
        same[part] = (windows[begin[which[part]]] == windows[begin[which[before]]]).all(axis=1)
    group = np.cumsum(~same) - 1
    earliest = np.minimum.reduceat(place[which], np.flatnonzero(~same))
    late[which] = place[which] > earliest[group]
    return late


def _suffix_order(data: np.ndarray, begin: np.ndarray, window: int) -> np.ndarray:
    """Order of suffixes by their first ``window`` bytes."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    order = np.arange(len(begin))
    rank = np.zeros(len(begin), np.int64)
    for k in range(0, window, 8):
        at = begin + min(k, window - 8)
        word = np.ascontiguousarray(words[at]).view(">u8").ravel().astype(np.uint64)
        if k == 0:
            order = np.argsort(word, kind="stable")
        else:
            # Only suffixes that still share their rank with another are sorted on.
            first = np.concatenate(([True], rank[order[1:]] != rank[order[:-1]]))
            alone = first & np.append(first[1:], True)
            todo = np.flatnonzero(~alone)
            if not len(todo):
                return order
            members = order[todo]
            order[todo] = members[np.lexsort((word[members], rank[members]))]
        sorted_word, sorted_rank = word[order], rank[order]
        change = np.concatenate(([True], (sorted_rank[1:] != sorted_rank[:-1]) | (sorted_word[1:] != sorted_word[:-1])))
        rank[order] = np.cumsum(change)
    return order


def _late_windows(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come by trigger; those of whole shares of triggers are sorted together. Gives (doc, tie, span) of windows
    to go."""

    def handle(rows):
        _, _, doc, tie, start, strings = zip(*rows)
        owner, inner, place = _places(doc, tie, start, strings, window)
        late = later_suffixes(strings, place, window)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], late.view(np.int8), [0]))))
        first, last = edge[::2], edge[1::2]
        out = []
        for a, b in zip(first.tolist(), last.tolist()):
            while a < b:  # a run of windows ends with its phrase
                k, at = int(owner[a]), int(inner[a])
                stop = min(b, a + len(strings[k]) - window + 1 - at)
                out.append((doc[k], tie[k], start[k] + at << 8 | stop - a))
                a = stop
        return out

    schema = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("span", pa.int64())])
    rows, size = [], 0
    for batch in batches:
        known = pc.is_null(batch.column("phrase"))
        if known.true_count:
            gone = batch.filter(known)
            yield batch_of(schema, gone.column("doc"), gone.column("tie"), gone.column("start"))
            batch = batch.filter(pc.invert(known))
        for row in zip(*(batch.column(c).to_pylist() for c in _STRINGS_ARROW.names)):
            if size >= SORT_BYTES and row[:2] != rows[-1][:2]:
                if out := handle(rows):
                    yield batch_of(schema, *zip(*out))
                rows, size = [], 0
            rows.append(row)
            size += len(row[-1])
    if rows and (out := handle(rows)):
        yield batch_of(schema, *zip(*out))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,last:long>>"
_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
_RESULT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("kept_sha256", pa.string()), ("spans", pa.list_(_SPAN)),
])


def merge_windows(spans: list[int], window: int) -> list[tuple[int, int]]:
    """Byte spans (end exclusive) covered by runs of windows given as start * 256 + number."""
    out: list[list[int]] = []
    for span in sorted(spans):
        first, last = span >> 8, (span >> 8) + (span & 255) + window - 1
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def _remove(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for doc_id, text, shared, first, late in zip(
            batch.column("doc_id").to_pylist(), text_list(batch.column("text")),
            *(batch.column(c).to_pylist() for c in ("shared", "first", "late")),
        ):
            go = set(shared or ()).difference(first or ()) | set(late or ())
            spans = merge_windows(list(go), window)
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            rows.append((doc_id, len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest(),
                         [{"first": a, "last": b} for a, b in spans]))
        yield batch_of(_RESULT_ARROW, *zip(*rows))


def repeated_substrings(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, phrases_per_task: int = PHRASES_PER_TASK
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (bytes, end exclusive)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # A hash of the text is only carried along where ids alone don't order the documents.
    unique = rows.groupBy("doc").count().filter("count > 1").isEmpty()
    tie: Column = F.lit(0).cast("long") if unique else F.xxhash64("text")
    rows = rows.select("doc_id", "doc", tie.alias("tie"), "text")
    once = rows if unique else rows.dropDuplicates(["doc", "tie"])
    once = once.select("doc", "tie", "text")

    triggers = once.select("text").mapInArrow(lambda b: _phrase_rows(b, window, gram, False), "h long")
    shared = settle(triggers.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    # Columns that can't be null get no filters of their own, which would make the uses of this shuffle differ.
    found = once.mapInArrow(
        lambda b: _phrase_rows(b, window, gram, True), ", ".join(f"{c} long not null" for c in PHRASE))
    found = found.join(shared, "h")

    dictionary = found.groupBy("h", "rh").agg(F.min(F.struct("doc", "tie", "span")).alias("first"))
    dictionary = dictionary.select("h", "first.doc", "first.tie", "first.span")
    # The filter on all columns lets this count read the same shuffle of the phrases as the other uses.
    places = ["doc", "tie", "span"]
    several = dictionary.groupBy("h").agg(F.count(F.lit(1)).alias("phrases"), *[F.max(c).alias(f"_{c}") for c in places])
    several = several.filter("phrases > 1").dropna(subset=[f"_{c}" for c in places]).select("h", "phrases")

    # Both joins with the texts ask for the same columns by the same key, so the texts are shuffled once.
    keys = ["doc"] if unique else ["doc", "tie"]
    unsure = dictionary.join(several, "h").groupBy(*keys).agg(
        F.collect_list(F.struct("h", "phrases", "span")).alias("found"))
    texts = rows if unique else once.withColumn("doc_id", F.col("doc"))
    strings = texts.join(unsure, keys).select("doc_id", "doc", "tie", "text", "found").mapInArrow(
        lambda b: _strings(b, window, phrases_per_task), STRINGS)
    strings = strings.repartition("h", "share").sortWithinPartitions("h", "share")
    late = strings.mapInArrow(lambda b: _late_windows(b, window), "doc long, tie long, span long")

    def lists(spans: DataFrame, name: str, *more: Column) -> DataFrame:
        return spans.groupBy(*keys).agg(F.collect_list("span").alias(name), *more)

    # Asking for all columns of the phrases here as well lets both uses read one shuffle of them.
    unused = [F.max(c).alias(f"_{c}") for c in ("rh", "tie") if c not in keys]
    whole = rows.join(lists(found, "shared", *unused), keys, "left")
    whole = whole.join(lists(dictionary, "first"), keys, "left")
    whole = whole.join(lists(late, "late"), keys, "left")
    columns = ["doc_id", "doc", "tie", "text", "shared", "first", "late", *(f"_{c}" for c in ("rh", "tie") if c not in keys)]
    return whole.select(*columns).mapInArrow(lambda b: _remove(b, window), RESULT)
