"""Readers and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from medloom.session import cut_lineage

SLICE_BYTES = 1 << 21


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a table that later steps read, and have Spark remove the shuffle files that only led to it."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return cut_lineage(df.select("*"))
    finally:
        conf.set(CLEANUP, before)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``limit`` bytes of text, so that arrays per byte stay small.

    A row is never cut: a longer text is a slice of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes.astype(np.int64)) // limit
        starts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [batch.num_rows]))
        for a, b in zip(starts[:-1], starts[1:]):
            yield batch.slice(int(a), int(b - a))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, one text after the other, and n + 1 offsets; a null text is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def keep_rows(docs: DataFrame, wanted, column: str = "text") -> DataFrame:
    """The rows, with all their columns, for which ``wanted(record batch)`` gives true; runs over slices."""

    def run(batches):
        for batch in slices(batches, column):
            yield batch.filter(pa.array(wanted(batch), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
