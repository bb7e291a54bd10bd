"""Bounded samples of labelled rows for the models, and folds by checksum of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a row without an id is in fold 0."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds))


def sample_ids(labelled: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` ids of each label, those with the smallest hashes: (doc_id, label).

    Ids with several labels count with the largest. Hashes depend on ids alone, so the sample is the same however
    the rows are dealt. The limit is applied per task before the shuffle.
    """
    once = labelled.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    # Hashes are even, so about twice the wanted rows of a label lie below this bound; few enough to be ordered.
    # The labels are the classes of a model, a handful of rows.
    sizes = F.broadcast(once.groupBy("label").agg(F.count(F.lit(1)).alias("_size")))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    near = once.join(sizes, "label").filter(share * F.col("_size") <= 2 * per_class + 100)
    order = Window.partitionBy("label").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), "doc_id")
    return near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_class).select("doc_id", "label")


def sample_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One text for each sampled id: (doc_id, label, text). The ids are a bounded sample, so they are broadcast."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text"))
