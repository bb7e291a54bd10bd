"""Collocations: frequent phrases that stand out against their parts, by partitioned mining (SON).

Each shard, a block of texts that fits a task, is mined by itself: all its phrases of one to five words, with their local
counts. The local counts are added up by hash, and only phrases that can reach the support in all shards together are
candidates; a share of the support per shard would fall to one with many shards and let every phrase pass. Hashes are
packed in sorted blobs, a few bytes per phrase and shard, so the shuffle is in proportion to the texts. A second scan
counts the candidates exactly in all texts. They travel as a bit table of their hashes: a phrase that falls on a set bit
by chance is counted too, exactly, and drops out below the support, so any size of the table gives the same rows. The
counts of a shard are packed too, a row for each language and share of the hashes, and added up phrase by phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medloom.llm.base import settle, slices
from medloom.llm.shingles import mix
from medloom.llm.words import byte_set, split_words

LONGEST = 5
SUPPORT = 100
TOP = 2000
SHARD_BYTES = 20 << 20
BITS_PER_CANDIDATE = 16
MOST_BITS = 1 << 28
CHUNK_BITS = 1 << 15
BUCKETS = 1 << 10
BUCKET_BYTES = 32 << 20
BLOBS_AT_ONCE = 128
# Of the second scan: shares of the phrases, how many phrases are packed at a time, and counts kept before they are added up.
SHARES = 256
PACKED_AT_ONCE = 1 << 18
COUNTS_AT_ONCE = 1 << 20
LANGUAGES_SENT = 4096
NO_LANGUAGE = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces(NamedTuple):
    """How texts are taken apart: breaks between pieces, spaces between words (ASCII), and words of the longest phrase."""

    breaks: str
    spaces: str
    lower: bool
    longest: int


PIECES = Pieces(".,;:!?\n\v\f\r", " \t", True, LONGEST)


class Block:
    """The words of a block of texts: number, hash, language, and how many words are left in their piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array, pieces: Pieces = PIECES):
        self.longest = pieces.longest
        breaks = pieces.breaks.encode()
        words = split_words(texts, byte_set([*pieces.spaces.encode(), *breaks]), byte_set(breaks), pieces.lower)
        coded = words.values.dictionary_encode()
        spelled = [w[:-1] for w in coded.dictionary.to_pylist()]
        self.spelled = pa.array(spelled, pa.large_binary())
        self.word = coded.indices.to_numpy(zero_copy_only=False)
        named = pc.fill_null(langs.cast(pa.string()), NO_LANGUAGE).dictionary_encode()
        self.langs = named.dictionary
        self.lang = np.repeat(named.indices.to_numpy(zero_copy_only=False), np.diff(words.bounds))
        ends = np.flatnonzero(words.breaks)
        at = np.arange(len(self.word), dtype=np.int32)
        self.left = (ends[np.searchsorted(ends, at)] - at + 1).astype(np.int32) if len(at) else at
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, spelled), np.uint64, len(spelled))
        names = [name.encode() for name in self.langs.to_pylist()]
        self.salt = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))

    def longer(self, hashes: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the phrases of ``length`` words at ``places``, from those of one word less (of the language, for 1)."""
        return mix(hashes * _STEP + self.hash[self.word[places + (length - 1)]])

    def shares(self, places: np.ndarray, length: int) -> np.ndarray:
        """Which share of all phrases those at ``places`` belong to, by their hashes."""
        hashes = self.salt[self.lang[places]]
        for k in range(1, length + 1):
            hashes = self.longer(hashes, places, k)
        return (hashes >> np.uint64(32)).astype(np.int64) % SHARES

    def phrases(self, places: np.ndarray, length: int) -> pa.Array:
        """The phrases of ``length`` words at ``places``."""
        parts = [self.spelled.take(pa.array(self.word[places + k])) for k in range(length)]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
        return joined.cast(pa.large_string()).cast(pa.string())

    def same(self, places: np.ndarray, others: np.ndarray, length: int) -> bool:
        """Are the phrases at both places the same everywhere?"""
        words = all((self.word[places + k] == self.word[others + k]).all() for k in range(length))
        return words and bool((self.lang[places] == self.lang[others]).all())


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense numbers of the keys, an index of each, and how often it occurs."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    dense = np.empty(len(keys), np.int32)
    dense[order] = np.repeat(np.arange(len(first), dtype=np.int32), counts)
    return dense, order[first], counts


def locally_frequent(block: Block, support: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and counts of all phrases that reach the support of their language (by its number) in the block, by length.

    A phrase is looked at only where its beginning and its end, of one word less, reach the support.
    """
    size = len(block.spelled)
    places = np.arange(len(block.word))
    hashes, number, shorter = block.salt[block.lang], block.lang, None
    for length in range(1, block.longest + 1):
        wanted = block.left[places] >= length
        if shorter is not None:
            wanted &= shorter[places + 1]
        places, hashes, number = places[wanted], hashes[wanted], number[wanted]
        if not len(places):
            return
        hashes = block.longer(hashes, places, length)
        dense, at, counts = _counted(number.astype(np.int64) * size + block.word[places + (length - 1)])
        enough = counts >= support[block.lang[places[at]]]
        yield hashes[at[enough]], counts[enough]
        wanted = enough[dense]
        places, hashes, number = places[wanted], hashes[wanted], dense[wanted]
        shorter = np.zeros(len(block.word) + 1, bool)
        shorter[places] = True


def counts_of(block: Block, known) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length by length, a place of each phrase in the block and its count, for phrases with ``known(hashes)``.

    All parts of a candidate are candidates, so longer phrases are looked up only where both parts are known.
    """
    places = np.arange(len(block.word))
    hashes, shorter = block.salt[block.lang], None
    for length in range(1, block.longest + 1):
        wanted = block.left[places] >= length
        if shorter is not None:
            wanted &= shorter[places + 1]
        places, hashes = places[wanted], hashes[wanted]
        hashes = block.longer(hashes, places, length)
        wanted = known(hashes)
        places, hashes = places[wanted], hashes[wanted]
        if not len(places):
            return
        shorter = np.zeros(len(block.word) + 1, bool)
        shorter[places] = True
        dense, at, counts = _counted(hashes)
        if not block.same(places, places[at][dense], length):  # two phrases of one hash: tell them apart word by word
            number = block.lang[places]
            for k in range(length):
                dense, at, counts = _counted(number.astype(np.int64) * len(block.spelled) + block.word[places + k])
                number = dense
        yield length, places[at], counts


def _blocks(batches, limit: int, pieces: Pieces) -> Iterator[Block]:
    """Blocks of about ``limit`` bytes of text. A longer text is cut at breaks between pieces, where it has any."""
    texts, langs, size = [], [], 0
    for batch in slices(batches, limit=limit // 4):
        text = pc.fill_null(batch.column("text"), "")
        lang = batch.column("lang")
        bytes_of = pc.sum(pc.binary_length(text)).as_py() or 0
        if size and size + bytes_of > limit:
            yield Block(_joined(texts), _joined(langs), pieces)
            texts, langs, size = [], [], 0
        if bytes_of > limit and len(text) == 1:
            for part in _cut(text[0].as_py(), limit, pieces.breaks):
                yield Block(pa.array([part]), lang, pieces)
            continue
        texts.append(text)
        langs.append(lang)
        size += bytes_of
    if texts:
        yield Block(_joined(texts), _joined(langs), pieces)


def _joined(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays([p.cast(pa.large_string()) for p in parts])


def _cut(text: str, limit: int, breaks: str) -> Iterator[str]:
    """Parts of a text that end at a break between pieces, where there is one within ``limit`` characters."""
    start = 0
    while start < len(text):
        stop = start + limit
        if stop < len(text):
            last = max(text.rfind(c, start, stop) for c in breaks)
            following = [text.find(c, stop) for c in breaks] if last < start else [last]
            stop = min((k for k in following if k >= 0), default=len(text)) + 1
        yield text[start:stop]
        start = stop


def _blobs(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keys and counts by bucket, which is what stands above the low 32 bits; the bytes of sorted numbers lie in planes."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    bucket, low = (keys >> np.uint64(32)).astype(np.int32), keys.astype("<u4")
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts[1:], len(keys))
    for k in range(0, len(starts), BLOBS_AT_ONCE):
        some = list(zip(starts[k : k + BLOBS_AT_ONCE].tolist(), ends[k : k + BLOBS_AT_ONCE].tolist()))
        planes = [low[a:z].view(np.uint8).reshape(-1, 4).T.tobytes() for a, z in some]
        columns = [pa.array(bucket[starts[k : k + BLOBS_AT_ONCE]]), pa.array(planes, pa.binary()), pa.array([counts[a:z].tobytes() for a, z in some], pa.binary())]
        yield pa.record_batch(columns, names=["bucket", "low", "counts"])


def _frequent(batches, support: int, kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """The keys whose counts add up to the support, from blobs in the order of their buckets."""

    def keys_of(bucket: int, lows: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        low = np.concatenate(lows)
        order = np.argsort(low, kind="stable")
        low = low[order]
        starts = np.flatnonzero(np.diff(low, prepend=~low[:1]))
        sums = np.add.reduceat(np.concatenate(counts)[order], starts, dtype=np.int64)
        keys = low[starts[sums >= support]].astype(np.int64) + (bucket << 32)
        return pa.record_batch([pa.array(keys)], names=["h"])

    last, lows, counts = None, [], []
    for batch in batches:
        for bucket, low, count in zip(*[c.to_pylist() for c in batch.columns]):
            if lows and bucket != last:
                yield keys_of(last, lows, counts)
                lows, counts = [], []
            last = bucket
            lows.append(np.ascontiguousarray(np.frombuffer(low, np.uint8).reshape(4, -1).T).view("<u4")[:, 0])
            counts.append(np.frombuffer(count, kind))
    if lows:
        yield keys_of(last, lows, counts)


def candidates(texts: DataFrame, support: int, shard_bytes: int, pieces: Pieces = PIECES) -> tuple[DataFrame, int]:
    """Beginnings of the hashes of all phrases that reach the support, and how many bits of a hash are left out of them.

    Phrases that share a beginning count together, so some more are candidates by chance; none is lost.
    """
    sizes = texts.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    # Languages without room for a frequent phrase are left out, as far as the list sent along reaches.
    largest = {r["lang"]: r["bytes"] for r in sizes.orderBy(F.desc("bytes"), "lang").limit(LANGUAGES_SENT).collect()}
    whole = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = (max(BUCKETS, whole // BUCKET_BYTES) - 1).bit_length()
    shift, kind = 32 - width, np.min_scalar_type(support)

    def run(batches):
        for block in _blocks(batches, shard_bytes, pieces):
            room = [largest.get(name, support) >= support for name in block.langs.to_pylist()]
            for found, counts in locally_frequent(block, np.where(room, 1, np.iinfo(np.int64).max)):
                # A count beyond the support says no more than the support itself.
                yield from _blobs(found >> np.uint64(shift), np.minimum(counts, support).astype(kind))

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = texts.mapInArrow(run, "bucket int, low binary, counts binary").repartition(parts, "bucket")
    found = packed.sortWithinPartitions("bucket").mapInArrow(lambda batches: _frequent(batches, support, kind), "h long")
    return found, shift


def _bit_table(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each candidate, in a table of at most ``MOST_BITS``, which is 32 MB; tasks pack chunks of it."""
    bits = 1 << 16
    while bits < min(MOST_BITS, BITS_PER_CANDIDATE * hashes.count()):
        bits *= 2

    def packed(chunk: int, chosen: np.ndarray) -> pa.RecordBatch:
        held = np.zeros(CHUNK_BITS, bool)
        held[chosen] = True
        data = np.packbits(held, bitorder="little").tobytes()
        return pa.record_batch([pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], names=["chunk", "bits"])

    def run(batches):
        last, held = None, []
        for batch in batches:
            chunks, places = batch.column("chunk").to_numpy(), batch.column("place").to_numpy()
            starts = np.flatnonzero(np.diff(chunks, prepend=chunks[:1] - 1))
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(chunks)]):
                if last is not None and chunks[a] != last:
                    yield packed(last, np.concatenate(held))
                    held = []
                last = int(chunks[a])
                held.append(places[a:z])
        if held:
            yield packed(last, np.concatenate(held))

    width = CHUNK_BITS.bit_length() - 1
    rows = hashes.selectExpr(f"shiftright(h & {bits - 1}L, {width}) as chunk", f"cast(h & {CHUNK_BITS - 1} as int) as place")
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk long, bits binary")
    table = np.zeros(max(bits, CHUNK_BITS) // 8, np.uint8)
    for row in found.collect():
        table[row["chunk"] * CHUNK_BITS // 8 : (row["chunk"] + 1) * CHUNK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return table, bits


def phrase_counts(
    docs: DataFrame, support: int = SUPPORT, shard_bytes: int = SHARD_BYTES, pieces: Pieces = PIECES
) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to ``pieces.longest`` words with at least ``support`` occurrences in a language, and the words of each language.

    (lang, phrase, words, n) and (lang, words). A null language is ``und``; a null text has no words.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE))
    texts = docs.select(lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found, shift = candidates(texts, support, shard_bytes, pieces)
    hashes = settle(found)
    table, bits = _bit_table(hashes)
    sent = texts.sparkSession.sparkContext.broadcast(table)  # at most MOST_BITS

    def known(hashes):
        at = (hashes >> np.uint64(shift)) & np.uint64(bits - 1)
        return (sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1

    sums = settle(added_up(local_counts(texts, known, shard_bytes, pieces), support))
    return sums.filter("phrase is not null"), sums.filter("phrase is null and n > 0").select("lang", F.col("n").alias("words"))


def local_counts(texts: DataFrame, known, shard_bytes: int, pieces: Pieces = PIECES) -> DataFrame:
    """(lang, share, phrases, n): the counts of the phrases with ``known(hashes)`` in each shard, packed by share.

    A shard has a few rows per share, however many phrases it has. Share -1 has a null phrase with all words.
    """

    def run(batches):
        for block in _blocks(batches, shard_bytes, pieces):
            totals = np.bincount(block.lang, minlength=len(block.langs))
            yield _packed(block.langs, np.arange(len(totals)), np.full(len(totals), -1), pa.nulls(len(totals), pa.string()), totals)
            held, size = [], 0
            for length, places, counts in counts_of(block, known):
                for a in range(0, len(places), PACKED_AT_ONCE):
                    at = places[a : a + PACKED_AT_ONCE]
                    if size and size + len(at) > PACKED_AT_ONCE:
                        yield _packed(block.langs, *_joined_columns(held))
                        held, size = [], 0
                    held.append((block.lang[at], block.shares(at, length), block.phrases(at, length), counts[a : a + PACKED_AT_ONCE]))
                    size += len(at)
            if held:
                yield _packed(block.langs, *_joined_columns(held))

    return texts.mapInArrow(run, "lang string, share int, phrases array<string>, n array<long>")


def _joined_columns(held: list[tuple]) -> tuple:
    langs, shares, phrases, counts = zip(*held)
    return np.concatenate(langs), np.concatenate(shares), pa.concat_arrays(phrases), np.concatenate(counts)


def _packed(langs: pa.Array, lang: np.ndarray, share: np.ndarray, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """Phrases and counts as one row per share and language (by its number)."""
    order = np.lexsort((lang, share))
    lang, share = lang[order], share[order]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(lang) != 0) | (np.diff(share) != 0)
    starts = np.flatnonzero(new)
    offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, c) for c in (phrases.take(pa.array(order)), pa.array(counts[order].astype(np.int64)))]
    return pa.record_batch(
        [langs.take(pa.array(lang[starts])).cast(pa.string()), pa.array(share[starts].astype(np.int32)), *lists], names=["lang", "share", "phrases", "n"])


def added_up(packed: DataFrame, support: int) -> DataFrame:
    """(lang, phrase, words, n) of the phrases that reach the support, and a null phrase with all words of each language.

    A task holds the different phrases of one share and language, and some counts more.
    """

    def total(parts: list[tuple[pa.Array, pa.Array]]) -> pa.Table:
        phrases, counts = (pa.chunked_array(list(c)) for c in zip(*parts))
        sums = pa.table([phrases, counts], names=["phrase", "n"]).group_by("phrase").aggregate([("n", "sum")]).combine_chunks()
        return sums.select(["phrase", "n_sum"]).rename_columns(["phrase", "n"])

    def rows_of(lang: str, parts: list[tuple[pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
        sums = total(parts)
        sums = sums.filter(pc.or_(pc.is_null(sums["phrase"]), pc.greater_equal(sums["n"], support)))
        for batch in sums.to_batches(max_chunksize=1 << 16):
            phrase, n = batch.columns
            words = pc.fill_null(pc.add(pc.count_substring(phrase, " "), pa.scalar(1, pa.int32())), 0)
            yield pa.record_batch([pa.array([lang] * len(n), pa.string()), phrase, words, n], names=["lang", "phrase", "words", "n"])

    def run(batches):
        last, held, size, summed = None, [], 0, 0
        for batch in batches:
            langs, shares = (batch.column(c).to_pylist() for c in ("lang", "share"))
            phrases, counts = batch.column("phrases"), batch.column("n")
            for i, key in enumerate(zip(langs, shares)):
                if held and key != last:
                    yield from rows_of(last[0], held)
                    held, size, summed = [], 0, 0
                last = key
                held.append((phrases.slice(i, 1).flatten(), counts.slice(i, 1).flatten()))
                size += len(held[-1][0])
                if size - summed > max(COUNTS_AT_ONCE, summed):
                    sums = total(held)
                    held, size = [tuple(sums[c].chunk(0) for c in ("phrase", "n"))], len(sums)
                    summed = size
        if held:
            yield from rows_of(last[0], held)

    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = packed.repartition(parts, "lang", "share").sortWithinPartitions("lang", "share")
    return ordered.mapInArrow(run, "lang string, phrase string, words int, n long")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The best ``top`` phrases of two to five words per language: (lang, rank, phrase, a, l, r, n, score).

    ``a`` counts the phrase, ``n`` all words of the language, ``l`` and ``r`` the two parts at the cut of the lowest
    score, ``floor(1000 * a * n / (l * r))``, in decimals of 38 digits; equal scores go to the first cut. Phrases
    within a longer one that is as frequent are left out. Order: score and ``a`` descending, then the phrase.

    Texts without words, empty tables and languages without a frequent phrase give no rows; repeated rows count as
    often as they stand there; other columns are ignored. Texts beyond ``shard_bytes`` are cut at breaks.
    """
    return scored_phrases(*phrase_counts(docs, support, shard_bytes), top)


def scored_phrases(frequent: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Candidates, scores and ranks from the counts of all frequent phrases and of the words per language."""
    long = frequent.filter("words >= 2")
    # A longer phrase of equal count holds one that is longer by one word only, and of equal count too.
    inside = long.select("lang", "n", F.explode(F.array(_part(F.lit(1), F.col("words") - 1), _part(F.lit(2), F.col("words") - 1))).alias("phrase"))
    outer = inside.filter(F.instr("phrase", " ") > 0).distinct()
    kept = long.join(outer, ["lang", "phrase", "n"], "left_anti")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words")
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals.withColumnRenamed("words", "n"), "lang")
    scored = scored.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * (cast(a as decimal(17,0)) * cast(n as decimal(17,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "b.*").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _part(start, length):
    return F.array_join(F.slice(F.split("phrase", " "), start, length), " ")
