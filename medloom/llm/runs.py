"""Runs: stretches of words that repeat with a period, found by minimizers at several scales.

Periods below ``SHORT`` are found by comparing the words with themselves at each lag. Longer ones are found by scale:
for periods from ``lo`` to ``2 * lo`` the hashes of all stretches of ``lo / 4`` words are taken, and in each window of
``3 * lo / 4`` stretches the leftmost least one is selected. A run of period q holds a window whose shift by q lies in
it too, so two selected places at distance q have equal hashes; such pairs are extended to both sides. Stretches that
have a period of at most half their length are never selected, hence equal ones are at least ``lo / 8`` words apart and
a place has at most 16 partners. Windows of nothing but such stretches lie within one run of a short period; a run made
of two of them exists only where two runs of the same short period touch, and follows from their ends alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm.base import slices
from medloom.llm.shingles import mix
from medloom.llm.words import byte_set, split_words, word_numbers

SHORT = 16
LEAST_LENGTH = 12
SPACE = byte_set([32, *range(9, 14)])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of true values."""
    edges = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _short(words: np.ndarray) -> np.ndarray:
    """Runs of periods below ``SHORT``: rows of start, end, period."""
    found = [np.zeros((0, 3), np.int64)]
    for q in range(1, min(SHORT, len(words) // 2 + 1)):
        a, b = _stretches(words[q:] == words[:-q])
        long = b - a >= q
        found.append(np.stack((a[long], b[long] + q, np.full(long.sum(), q)), 1))
    return np.concatenate(found)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of runs that are one stretch, that of the smallest period; ordered by start, then end."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[first]


def _selected(hashes: np.ndarray, barred: np.ndarray, width: int) -> np.ndarray:
    """Places that are the leftmost least of a window of ``width`` places, barred ones left out."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    bits = np.uint64(n.bit_length())
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = (hashes >> bits << bits) | np.arange(n, dtype=np.uint64)
    least[barred] = none
    t = 1
    while 2 * t <= width:
        least = np.minimum(least[:-t], least[t:])
        t *= 2
    if width > t:
        least = np.minimum(least[: t - width], least[width - t :])
    least = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return (least[least != none] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _pairs(places: np.ndarray, hashes: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of selected places with equal hashes at a distance from ``lo`` to ``2 * lo``."""
    own = hashes[places]
    order = np.lexsort((places, own))
    places, own = places[order], own[order]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in range(1, len(places)):
        near = np.flatnonzero((own[t:] == own[:-t]) & (places[t:] - places[:-t] < 2 * lo))
        if not len(near):
            break
        near = near[places[near + t] - places[near] >= lo]
        left.append(places[near])
        right.append(places[near + t])
    return np.concatenate(left), np.concatenate(right)


def _reach(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from ``a`` and ``b`` on agree, forwards or backwards; ``a`` is before ``b``."""
    done, size = 0, 64
    limit = len(words) - b if step > 0 else a + 1
    while done < limit:
        size = min(size, limit - done)
        if step > 0:
            equal = words[a + done : a + done + size] == words[b + done : b + done + size]
        else:
            equal = (words[a - done - size + 1 : a - done + 1] == words[b - done - size + 1 : b - done + 1])[::-1]
        if not equal.all():
            return done + int(equal.argmin())
        done += size
        size *= 2
    return done


def _extended(words: np.ndarray, left: np.ndarray, right: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """Runs around pairs of equal stretches of ``k`` words."""
    # Words agree at this lag over at least 4k words around a pair inside a run: k more on one side at least.
    after = hashes[np.minimum(left + k, len(hashes) - 1)] == hashes[np.minimum(right + k, len(hashes) - 1)]
    before = (left >= k) & (hashes[np.maximum(left - k, 0)] == hashes[np.maximum(right - k, 0)])
    left, right = left[after | before], right[after | before]
    lag = right - left
    order = np.lexsort((left, lag))
    found, last, end = [], -1, -1
    for a, q in zip(left[order].tolist(), lag[order].tolist()):
        if q == last and a < end:
            continue
        start = a - _reach(words, a - 1, a + q - 1, -1) if a else 0
        last, end = q, a + _reach(words, a, a + q, 1)
        if end - start >= q:
            found.append((start, end + q, q))
    return np.array(found, np.int64).reshape(-1, 3)


def _touching(words: np.ndarray, runs: np.ndarray, lo: int) -> np.ndarray:
    """Runs with a period from ``lo`` to ``2 * lo`` made of two runs of one shorter period that touch or overlap."""
    runs = runs[(runs[:, 2] <= lo // 8) & (runs[:, 1] - runs[:, 0] >= lo)]
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    near = np.flatnonzero((runs[1:, 2] == runs[:-1, 2]) & (runs[1:, 0] <= runs[:-1, 1]))
    found = []
    for (a, b, d), (c, e, _) in zip(runs[near].tolist(), runs[near + 1].tolist()):
        cycle = words[b - d : b]
        phase = next((z for z in range(d) if (words[c + z : c + z + d] == cycle).all()), None)
        if phase is None:
            continue
        q = lo + (c + phase - (b - d) - lo) % d
        while q < 2 * lo and q <= min(b - a, e - c):
            start, stop = max(a, c - q), min(b, e - q)
            # Where both short runs break at the same word of the period, the long one may go on.
            if a == c - q and start:
                start -= _reach(words, start - 1, start + q - 1, -1)
            if b == e - q:
                stop += _reach(words, stop, stop + q, 1)
            if stop - start >= q:
                found.append((start, stop + q, q))
            q += d
    return np.array(found, np.int64).reshape(-1, 3)


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST_LENGTH) -> np.ndarray:
    """All runs of several texts, given as numbers of words: rows of text, start, length, period, in this order.

    A run is a stretch of one text with smallest period q and at least ``max(least, 2 * q)`` words that no neighbouring
    word extends. Takes about 40 bytes per word and, beyond the words at each scale, time in proportion to the runs.
    """
    sizes = np.diff(bounds)
    # A number of its own between texts, so that nothing repeats across them.
    line = np.empty(len(words) + len(sizes), np.int64)
    breaks = bounds[1:] + np.arange(len(sizes))
    inside = np.ones(len(line), bool)
    inside[breaks] = False
    line[inside] = words
    line[breaks] = -1 - np.arange(len(sizes))
    runs = _smallest(_short(line))
    lo, kept, hashes = SHORT, np.arange(len(line)), mix(line.astype(np.uint64) * _STEP + _STEP)
    width = 1
    while sizes.max(initial=0) >= 2 * lo:
        long = np.repeat(sizes >= 2 * lo, sizes + 1)[kept]
        kept, hashes = kept[long], hashes[long]
        part, k = line[kept], lo // 4
        while width < k:
            following = np.append(hashes[width:], mix(np.arange(min(width, len(hashes)), dtype=np.uint64)))[: len(hashes)]
            hashes = mix(hashes * _STEP + following)
            width *= 2
        # Known runs, as places among the kept words; texts are kept whole.
        at = np.searchsorted(kept, runs[:, 0])
        here = (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == runs[:, 0])
        own = np.stack((at, at + runs[:, 1] - runs[:, 0], runs[:, 2]), 1)[here]
        short = own[(own[:, 2] <= k // 2) & (own[:, 1] - own[:, 0] >= k)]
        change = np.zeros(len(part) + 1, np.int32)
        np.add.at(change, short[:, 0], 1)
        np.add.at(change, short[:, 1] - k + 1, -1)
        left, right = _pairs(_selected(hashes, np.cumsum(change[:-1]) > 0, 3 * lo // 4), hashes, lo)
        found = np.concatenate((_extended(part, left, right, hashes, k), _touching(part, own, lo)))
        if len(found):
            found[:, 1] += kept[found[:, 0]] - found[:, 0]
            found[:, 0] = kept[found[:, 0]]
            runs = _smallest(np.concatenate((runs, found)))
        lo *= 2
    length = runs[:, 1] - runs[:, 0]
    runs = runs[length >= np.maximum(least, 2 * runs[:, 2])]
    text = np.searchsorted(breaks, runs[:, 0])
    start = runs[:, 0] - (bounds[:-1] + np.arange(len(sizes)))[text]
    runs = np.stack((text, start, runs[:, 1] - runs[:, 0], runs[:, 2]), 1)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """The runs of each text and the text without their repeats: (doc_id, n_words, runs, collapsed).

    ``runs`` are structs of start, length and period in words, by start, then period. ``collapsed`` has the words that
    are in no run behind the first period of it, joined by one space. Each row is handled by itself: repeated rows give
    repeated results; a null or empty text has no words, no runs and an empty collapsed text; a null id is kept; other
    columns are ignored. A text is handled whole; the longest one takes about 40 bytes per word and 10 per byte.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def run(batches):
        for batch in slices(batches):
            words = split_words(batch.column("text"), SPACE)
            numbers, _ = word_numbers(words.values)
            runs = find_runs(numbers, words.bounds, least)
            first = words.bounds[:-1][runs[:, 0]] + runs[:, 1]
            change = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(change, first + runs[:, 3], 1)
            np.add.at(change, first + runs[:, 2], -1)
            kept = np.cumsum(change[:-1]) == 0
            left = words.values if kept.all() else words.values.filter(pa.array(kept))
            stops = np.frombuffer(left.buffers()[1], np.int64)[: len(left) + 1] if len(left) else np.zeros(1, np.int64)
            edges = stops[np.concatenate(([0], np.cumsum(kept)))[words.bounds]].tolist()
            data = memoryview(left.buffers()[2]) if len(left) else b""
            texts = [bytes(data[a : max(a, b - 1)]) for a, b in zip(edges[:-1], edges[1:])]
            lists = np.searchsorted(runs[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(_RUN))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(words.bounds)), pa.ListArray.from_arrays(lists, items),
                 pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, by checksum of the id, get a tail that repeats with a period.

    With h the checksum and g = floor(h / 10), h divisible by 10 and n words, the words from a = g % n on repeat the
    first p = 1 + floor((n - a) / (3 + g % 8)) of them; such texts are joined by single spaces.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    step = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"), F.when(F.pmod(h, F.lit(10)) == 0, split).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    step = step.select("doc_id", "text", "w", n.alias("n"), a.alias("a"), p.alias("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    cycle = F.slice("w", F.col("a") + 1, F.col("p"))
    repeated = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(F.array_repeat(cycle, times))), F.lit(1), F.col("n"))
    new = F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))
    return step.select("doc_id", new.alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run (then smallest start, then period) and checksums of the runs and of the collapsed text."""
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    best = F.array_max(order)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    step = found.select("doc_id", "runs", "collapsed", best.alias("b"), F.array_join(lines, "").alias("lines"))
    length, period = F.col("b.l"), -F.col("b.p")
    return step.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"), length.alias("length"),
        period.alias("period"), F.expr("(1000 * b.l) div (-b.p)").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
