"""Groups of near-duplicate documents: Jaccard self-join of shingle sets with rare-first prefix filtering.

1. Shingles that many documents share are counted (repeats within blocks of each task, summed over all tasks). Sets
   are ordered from rare to frequent; an order only has to be the same everywhere, so the counts may be rough.
2. Of a set of n shingles the first n - ceil(0.8 n) + 1 are its prefix: two similar sets share a shingle of both
   prefixes. Equal sets have one name and take part once. Prefix rows whose shingle only one set has are dropped.
3. Candidates are pairs that share a prefix shingle and pass the length filter and the positional filter (what can
   still be shared behind the shingle). A suffix filter and then the sets themselves decide, once per pair.
4. Not every pair of a large group is built. In a round each set is compared with one partner of another tree,
   the one most likely to be the original of its lists; linked sets grow into trees, parts of one component. Then all
   candidate pairs are compared whose sets lie in different trees, so no link between components is lost; pairs
   within a tree can't change the result. A sketch of each set, 256 numbers, proves most of them apart before texts
   are moved; long lists are dealt in blocks.
5. Components follow from the links by least labels with pointer jumping, in Spark joins.

Defined results: documents without words have 0 shingles and are a component of their own, as are rows without an id
(component_id null); equal documents are one component; repeated rows are returned as often as they are there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from medloom.llm.base import settle, slices, text_list
from medloom.llm.shingles import set_id, shingle_sets

SHINGLE_WORDS = 5
# Bytes of text whose shingles are made at a time, at about 40 bytes of arrays each.
TEXT_SLICE = 1 << 19
BLOCK_SHINGLES = 1 << 20
REPEATS = 4
FREQUENT_KEPT = 1 << 18
SETS_SEEN = 1 << 20
SKETCH = 256
LIST_BLOCK = 4096
STAR_ROUNDS = 1
SUFFIX_FROM = 1 << 13


class Threshold(NamedTuple):
    """Similarity of at least part / whole."""

    part: int = 4
    whole: int = 5

    def prefix(self, n: int) -> int:
        return n - -(-self.part * n // self.whole) + 1

    def overlap(self, a, b):
        """Least number of shared elements of two similar sets of these sizes."""
        return -(-self.part * (a + b) // (self.part + self.whole))

    def overlap_column(self, a: Column, b: Column) -> Column:
        return F.ceil(self.part * (a + b) / F.lit(float(self.part + self.whole)) - 1e-9)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


FIRST_PASS = "doc_id long, n_shingles long, sid long, s long, n long"


def _first_pass(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Names of all sets (doc_id, n_shingles, sid), and (s, n): shingles that REPEATS different sets of a block hold."""
    schema = pa.schema([(c.split(" ")[0], pa.int64()) for c in FIRST_PASS.split(", ")])

    def rows(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        empty = pa.nulls(len(next(iter(columns.values()))), pa.int64())
        return pa.RecordBatch.from_arrays([columns.get(f.name, empty) for f in schema], schema=schema)

    def counted(sets):
        found, count = np.unique(np.concatenate(sets), return_counts=True)
        keep = count >= REPEATS
        return rows({"s": pa.array(found[keep].view(np.int64)), "n": pa.array(count[keep])})

    block, size, seen = [], 0, set()
    for batch in slices(batches, limit=TEXT_SLICE):
        sets = shingle_sets(text_list(batch.column("text")), words)
        names = [set_id(found) if len(found) else None for found in sets]
        yield rows({
            "doc_id": batch.column("doc_id"), "n_shingles": pa.array([len(found) for found in sets], pa.int64()),
            "sid": pa.array(names, pa.int64())})
        for name, found in zip(names, sets):
            if name in seen:
                continue
            seen.add(name)
            block.append(found)
            size += len(found)
        if size >= BLOCK_SHINGLES:
            yield counted(block)
            block, size, seen = [], 0, set()
    if block:
        yield counted(block)


def first_pass(docs: DataFrame, words: int = SHINGLE_WORDS) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """Names of all sets, and the most frequent shingles (sorted) with their counts, at most FREQUENT_KEPT, in one pass."""
    rows = settle(_narrow(docs).mapInArrow(lambda b: _first_pass(b, words), FIRST_PASS))
    counts = rows.filter("s is not null").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(FREQUENT_KEPT)
    got = counts.toArrow()
    shingle = got.column("s").to_numpy().view(np.uint64)
    order = np.argsort(shingle)
    return rows.filter("s is null").select("doc_id", "n_shingles", "sid"), (shingle[order], got.column("n").to_numpy()[order])


def _rare_first(found: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
    if not len(shingle) or not len(found):
        return found
    at = np.minimum(np.searchsorted(shingle, found), len(shingle) - 1)
    often = np.where(shingle[at] == found, count[at], 0)
    return found[np.argsort(often, kind="stable")] if often.any() else found


def _prefixes(batches, words: int, limit: Threshold, frequent) -> Iterator[pa.RecordBatch]:
    """Prefix rows (s, sid, n, pos); a set that this task has met is left out."""
    shingle, count = frequent
    seen: set[int] = set()
    for batch in slices(batches, limit=TEXT_SLICE):
        rows, names, sizes = [], [], []
        for found in shingle_sets(text_list(batch.column("text")), words):
            if not len(found):
                continue
            name = set_id(found)
            if name in seen:
                continue
            if len(seen) < SETS_SEEN:
                seen.add(name)
            rows.append(_rare_first(found, shingle, count)[: limit.prefix(len(found))])
            names.append(name)
            sizes.append(len(found))
        if rows:
            lengths = np.array([len(r) for r in rows])
            pos = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_pydict({
                "s": pa.array(np.concatenate(rows).view(np.int64)), "sid": pa.array(np.repeat(names, lengths), pa.int64()),
                "place": pa.array(np.repeat(sizes, lengths).astype(np.int64) << 32 | pos),
            })


def _texts_of(batches, words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=TEXT_SLICE):
        texts = text_list(batch.column("text"))
        sets = shingle_sets(texts, words)
        yield pa.RecordBatch.from_pydict({
            "sid": pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
            "text": pa.array(texts, pa.binary()), "sketch": pa.array([sketch_of(s) for s in sets], pa.binary()),
        })


def sketch_of(found: np.ndarray) -> bytes:
    """Numbers of elements by their last bits: two sets share at most the sum of the smaller numbers of each part.

    A part of 255 or more says nothing.
    """
    counts = np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """A bound on the number of shared elements of two sorted arrays: halves are matched with halves only."""
    if depth == 0 or not len(a) or not len(b):
        return min(len(a), len(b))
    at = len(a) // 2
    cut = int(np.searchsorted(b, a[at]))
    return suffix_bound(a[:at], b[:cut], depth - 1) + suffix_bound(a[at:], b[cut:], depth - 1)


def similar(a: np.ndarray, b: np.ndarray, limit: Threshold) -> bool:
    need = limit.overlap(len(a), len(b))
    if len(a) > len(b):
        a, b = b, a
    # Looking all elements up costs less than the bound, unless the sets are large.
    if not len(a) or len(b) > SUFFIX_FROM and suffix_bound(a, b) < need:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) >= need


def _verify(batches, words: int, limit: Threshold) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text_a", TEXT_SLICE):
        a = shingle_sets(text_list(batch.column("text_a")), words)
        b_texts = text_list(batch.column("text_b"))
        different = list(dict.fromkeys(b_texts))  # one partner may stand in many rows
        b = dict(zip(different, shingle_sets(different, words)))
        keep = pa.array([similar(x, b[t], limit) for x, t in zip(a, b_texts)], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def _size(place: str) -> Column:
    return F.shiftright(F.col(place), 32)


def _candidates(pairs: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs (a, place_a, b, place_b) that pass the length and the positional filter."""
    na, nb = _size("place_a"), _size("place_b")
    behind = F.least(na - F.col("place_a").bitwiseAND(0xFFFFFFFF), nb - F.col("place_b").bitwiseAND(0xFFFFFFFF))
    length = F.least(na, nb) * limit.whole >= F.greatest(na, nb) * limit.part
    return pairs.filter(length & (behind >= limit.overlap_column(na, nb)))


def components(links: DataFrame) -> DataFrame:
    """(v, label) with the least vertex that can be reached, for links (a, b); all in Spark joins."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = settle(both.distinct())
    labels = settle(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label"))
    )
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("v") == F.col("a")).select(
            "v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("v").alias("u"), F.col("label").alias("up"))
        step = step.join(up, F.col("label") == F.col("u")).select("v", "old", F.least("label", "up").alias("label"))
        step = settle(step)
        labels = step.select("v", "label")
        if step.filter("label < old").isEmpty():
            return labels


def similar_links(docs: DataFrame, frequent, words: int = SHINGLE_WORDS, limit: Threshold = Threshold()) -> DataFrame:
    """Links (a, b) between names of different similar sets, enough of them to connect every component."""
    spark = docs.sparkSession
    docs = _narrow(docs)
    frequent = spark.sparkContext.broadcast(frequent)
    rows = docs.select("text").mapInArrow(
        lambda b: _prefixes(b, words, limit, frequent.value), "s long, sid long, place long")
    shared = rows.groupBy("s").agg(F.min("sid").alias("least"), F.max("sid").alias("most")).filter("least < most")
    shared = settle(shared.select("s"))
    lists = settle(rows.join(shared, "s").groupBy("s", "sid").agg(F.first("place").alias("place")))
    lists = settle(_ranked(lists, limit))
    names = lists.select("sid").distinct()
    texts = docs.select("text").mapInArrow(lambda b: _texts_of(b, words), "sid long, text binary, sketch binary")
    texts = settle(texts.join(names, "sid").groupBy("sid").agg(
        F.first("text").alias("text"), F.first("sketch").alias("sketch")))

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b"))
        rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return rows.mapInArrow(lambda b: _verify(b, words, limit), "a long, b long")

    links, trees = None, None
    for _ in range(STAR_ROUNDS):
        found = settle(verified(_partners(_in_trees(lists, trees), limit)))
        links = found if links is None else links.unionByName(found)
        trees = components(links)
        if found.isEmpty():
            break

    # All other candidates between different trees; in a list, only the sets outside its largest tree look for others.
    grown = settle(_in_trees(lists, trees))
    sizes = grown.groupBy("s", "tree").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("s").agg(F.max(F.struct("n", "tree")).alias("largest"), F.count(F.lit(1)).alias("trees"))
    largest = largest.filter("trees > 1").select("s", F.col("largest.tree").alias("largest"))
    mixed = settle(grown.join(largest, "s"))
    return links.unionByName(verified(settle(_across_trees(mixed, texts.select("sid", "sketch"), limit))))


def _across_trees(mixed: DataFrame, sketches: DataFrame, limit: Threshold) -> DataFrame:
    """Distinct pairs (a, b) of one list and different trees that the filters can't prove apart.

    Lists are dealt in blocks of members: each pair of blocks is one small piece of work, however long a list is, and
    only pairs that pass leave it.
    """
    sizes = mixed.groupBy("s").agg((F.floor((F.count(F.lit(1)) - 1) / LIST_BLOCK) + 1).cast("int").alias("blocks"))
    rows = mixed.join(sizes, "s").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "s", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "place",
        "tree", (F.col("tree") != F.col("largest")).alias("outside"),
    ).join(sketches, "sid").repartition("s", "i", "j").sortWithinPartitions("s", "i", "j")
    return rows.mapInArrow(lambda b: _block_pairs(b, limit), "a long, b long").distinct()


def _block_pairs(batches, limit: Threshold) -> Iterator[pa.RecordBatch]:
    def pairs(rows: pa.Table):
        sid, place, tree, block = (rows.column(c).to_numpy() for c in ("sid", "place", "tree", "block"))
        outside = rows.column("outside").to_numpy(zero_copy_only=False)
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        full = sketch.max(axis=1) == 255
        n, behind = place >> 32, (place >> 32) - (place & 0xFFFFFFFF)
        cross = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        for x in np.flatnonzero(outside):
            # A pair of two outside members is met from both sides and kept from one.
            ok = (tree != tree[x]) & ~(outside & (sid <= sid[x]))
            if cross:
                ok &= block != block[x]
            need = limit.overlap(n[x], n)
            ok &= (np.minimum(n[x], n) * limit.whole >= np.maximum(n[x], n) * limit.part)
            y = np.flatnonzero(ok & (np.minimum(behind, behind[x]) >= need))
            if len(y):
                shared = np.minimum(sketch[y], sketch[x]).sum(axis=1, dtype=np.int64)
                y = y[(shared >= need[y]) | full[y] | full[x]]
                yield from ((min(sid[x], sid[k]), max(sid[x], sid[k])) for k in y)

    def whole_lists():
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in slices([batch], "sketch", 1 << 22):
                key = np.stack([part.column(c).to_numpy() for c in ("s", "i", "j")])
                cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), part.num_rows]):
                    piece = part.slice(a, b - a)
                    if held and any(held[0].column(c)[0] != piece.column(c)[0] for c in ("s", "i", "j")):
                        yield pa.Table.from_batches(held)
                        held = []
                    held.append(piece)
        if held:
            yield pa.Table.from_batches(held)

    found: set[tuple[int, int]] = set()
    for rows in whole_lists():
        found.update(pairs(rows))
        if len(found) > 1 << 16:
            a, b = zip(*found)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            found = set()
    if found:
        a, b = zip(*found)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _ranked(lists: DataFrame, limit: Threshold) -> DataFrame:
    """List rows with the rank of their set: the share of its prefix that other sets have too.

    An original shares all of its prefix with its copies, a copy has shingles of its own edits, which stand first.
    """
    n = _size("place")
    prefix = n - F.ceil(n * limit.part / F.lit(float(limit.whole)) - 1e-9) + 1
    ranks = lists.groupBy("sid").agg((F.count(F.lit(1)) / F.max(prefix)).alias("rank"))
    return lists.select("s", "sid", "place").join(ranks, "sid").select("s", "sid", "place", "rank")


def _in_trees(lists: DataFrame, trees: DataFrame | None) -> DataFrame:
    if trees is None:
        return lists.withColumn("tree", F.col("sid"))
    return lists.join(trees.withColumnRenamed("v", "sid"), "sid", "left").select(
        "s", "sid", "place", "rank", F.coalesce("label", "sid").alias("tree"))


def _partners(lists: DataFrame, limit: Threshold) -> DataFrame:
    """For each set the one pair with a set of another tree: the best ranked of a list, of those lists most often so."""
    row = F.struct("rank", "sid", "place", "tree")
    first = lists.groupBy("s").agg(F.max(row).alias("first"))
    lists = lists.join(first, "s")
    second = lists.filter(F.col("tree") != F.col("first.tree")).groupBy("s").agg(F.max(row).alias("second"))
    lists = lists.join(second, "s")
    other = F.when(F.col("tree") != F.col("first.tree"), F.col("first")).otherwise(F.col("second"))
    pairs = lists.withColumn("other", other).select(
        F.col("sid").alias("a"), F.col("place").alias("place_a"), F.col("other.sid").alias("b"),
        F.col("other.place").alias("place_b"), F.col("other.rank").alias("rank"))
    pairs = _candidates(pairs, limit).groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.max("rank").alias("rank"))
    best = pairs.groupBy("a").agg(F.max(F.struct("times", "rank", "b")).alias("best"))
    pairs = best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b"))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, limit: Threshold = Threshold()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id that links reach)."""
    rows, frequent = first_pass(docs, words)
    labels = components(similar_links(docs, frequent, words, limit))
    rows = rows.join(labels, F.col("sid") == F.col("v"), "left")
    rows = rows.select("doc_id", "n_shingles", F.coalesce("label", "sid").alias("class"))
    # The least id of a class, with partial minima before the shuffle; classes may be large, so the join back is
    # a plain one that can be split.
    least = rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    rows = rows.join(least, "class", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, limit: Threshold = Threshold()) -> DataFrame:
    """The documents, with all columns, of which no group has more than one: the row of the least doc_id stays.

    Documents without words stay as they are. Whole rows are shuffled once.
    """
    rows, frequent = first_pass(docs, words)
    labels = components(similar_links(docs, frequent, words, limit))
    rows = rows.filter("sid is not null").join(labels, F.col("sid") == F.col("v"), "left")
    first = rows.groupBy(F.coalesce("label", "sid").alias("class")).agg(F.min(F.struct("doc_id", "sid")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_first_id"), F.col("first.sid").alias("_first_sid"))
    names, schema = docs.columns, docs.schema

    def named(batches):
        for batch in slices(batches, limit=TEXT_SLICE):
            sets = shingle_sets(text_list(batch.column("text")), words)
            sid = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sid], names=[*names, "_first_sid"])

    marked = docs.mapInArrow(named, StructType([*schema.fields, StructField("_first_sid", LongType())]))
    marked = marked.withColumn("_first_id", F.col("doc_id").cast("long"))
    wordless = marked.filter("_first_sid is null").select(*names)
    kept = marked.filter("_first_sid is not null").join(
        first.withColumnRenamed("_first_sid", "_s").withColumnRenamed("_first_id", "_i"),
        (F.col("_first_sid") == F.col("_s")) & F.col("_first_id").eqNullSafe(F.col("_i")),
    ).dropDuplicates(["_first_sid", "_first_id"]).select(*names)
    return kept.unionByName(wordless)
