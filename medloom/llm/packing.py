"""Packing by bounded-space online best fit: a fixed number of open windows per partition.

Each partition streams its documents through at most ``open_windows`` windows. A document's remainder goes to the
open window it fits best. If it fits none and all windows are open, the fullest is topped up with a cut of it and
emitted, so windows leave full. At the end the open windows of a partition are merged into full ones; what is then
left, less than one window per partition, is laid end to end over all partitions and cut at window borders. The very
last piece is cut at powers of two, which need no padding.

Defined results: a null or empty text is the end id alone; an empty table gives no rows; repeated documents are packed
each on its own; any other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medloom.llm.base import batch_of, slices, text_list
from medloom.llm.tokens import word_ids
from medloom.session import cut_lineage

CAPACITY = 2048
OPEN_WINDOWS = 64
END_ID = 1
LEFT_OVER = 1 << 62

PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "part int, ids binary"
)
_PIECE_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int32()),
    ("ids", pa.binary()),
])
PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class _Windows:
    """The open windows of one partition, ordered by free room. A piece is (doc_id, doc_tokens, start, ids)."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.open: list[tuple[int, int]] = []
        self.pieces: dict[int, list] = {}
        self.made = 0

    def add(self, doc_id, ids: bytes) -> Iterator[list]:
        """Place a document; yields the windows it fills."""
        total, start = len(ids) // 4, 0
        while start < total:
            rest = total - start
            if rest >= self.capacity:
                take, window = self.capacity, None
            else:
                at = bisect_left(self.open, (rest, -1))
                if at < len(self.open):
                    take, window = rest, self.open.pop(at)
                elif len(self.open) < self.limit:
                    take, window = rest, (self.capacity, self.made)
                    self.pieces[self.made] = []
                    self.made += 1
                else:
                    window = self.open.pop(0)
                    take = window[0]
            piece = (doc_id, total, start, ids[4 * start : 4 * (start + take)])
            start += take
            if window is None:
                yield [piece]
                continue
            free, name = window
            self.pieces[name].append(piece)
            if free == take:
                yield self.pieces.pop(name)
            else:
                insort(self.open, (free - take, name))

    def rest(self) -> tuple[list[list], list]:
        """All open windows laid end to end: full windows, and what is less than one."""
        full, last, room = [], [], self.capacity
        for _, name in self.open:
            for doc_id, total, start, ids in self.pieces[name]:
                while ids:
                    cut = ids[: 4 * room]
                    last.append((doc_id, total, start, cut))
                    start, room, ids = start + len(cut) // 4, room - len(cut) // 4, ids[len(cut) :]
                    if room == 0:
                        full.append(last)
                        last, room = [], self.capacity
        return full, last


def _rows(window: list, sequence: int, part: int, keep_ids: bool) -> Iterator[tuple]:
    at = 0
    for doc_id, total, start, ids in window:
        n = len(ids) // 4
        yield doc_id, start, n, zlib.crc32(ids), total, sequence, at, part, ids if keep_ids else None
        at += n


def _pack_part(batches: Iterable[pa.RecordBatch], encode: Callable, end: bytes, capacity: int, limit: int):
    part = TaskContext.get().partitionId()
    windows, made, out = _Windows(capacity, limit), part << 32, []
    for batch in slices(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_list(batch.column("text"))):
            for window in windows.add(doc_id, encode(text) + end):
                out.extend(_rows(window, made, part, False))
                made += 1
        if out:
            yield batch_of(_PIECE_ARROW, *zip(*out))
            out = []
    full, last = windows.rest()
    for window in full:
        out.extend(_rows(window, made, part, False))
        made += 1
    out.extend(_rows(last, -1, part, True))
    if out:
        yield batch_of(_PIECE_ARROW, *zip(*out))


def _cut_left(batches: Iterable[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Cut left pieces, which know their place in the whole row of left ids, at window borders."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            whole = row["_total"] // capacity
            ends = [capacity * whole]
            for bit in reversed(range(capacity.bit_length())):
                if (row["_total"] - capacity * whole) >> bit & 1:
                    ends.append(ends[-1] + (1 << bit))
            place, done = row["_base"] + row["offset"], 0
            while done < row["length"]:
                if place < ends[0]:
                    sequence = place // capacity
                    begin, stop = sequence * capacity, (sequence + 1) * capacity
                else:
                    k = next(i for i, e in enumerate(ends) if place < e)
                    sequence, begin, stop = whole + k - 1, ends[k - 1], ends[k]
                n = min(row["length"] - done, stop - place)
                ids = row["ids"][4 * done : 4 * (done + n)]
                out.append((row["doc_id"], row["start"] + done, n, zlib.crc32(ids), row["doc_tokens"],
                            LEFT_OVER + sequence, place - begin, row["part"], None))
                place, done = place + n, done + n
        if out:
            yield batch_of(_PIECE_ARROW, *zip(*out))


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    open_windows: int = OPEN_WINDOWS,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences of a partition are numbered by (partition, count), those made of left pieces from 2^62 on. The one pass
    over the texts is kept by a checkpoint, as both parts of the result read it; it holds numbers, and ids for less
    than one window per partition.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        return _pack_part(batches, word_ids(tokenizer).encode, end, capacity, open_windows)

    packed = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE))
    done = packed.filter("sequence_id >= 0").select(*PIECE_COLUMNS)
    left = packed.filter("sequence_id < 0")
    # One row per partition of the input is all that this window sees.
    totals = left.groupBy("part").agg(F.sum("length").alias("_n"))
    order = Window.orderBy("part")
    base = totals.select(
        F.col("part").alias("_part"), (F.sum("_n").over(order) - F.col("_n")).alias("_base"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    left = left.join(base, F.col("part") == F.col("_part")).drop("_part")
    left = left.mapInArrow(lambda batches: _cut_left(batches, capacity), PIECE)
    return done.unionByName(left.select(*PIECE_COLUMNS))
